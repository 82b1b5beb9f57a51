"""Several values packed in one string field: split into one row per value, position kept.

1. *Start model.* Values whose container leaves no doubt (lists, objects, quoted strings) show how a
   text starts and what may follow a comma, semicolon or slash inside one. Both are counted over all
   rows in a table of ``BUCKETS`` hashed word pairs, so the model has one size at any data size.
2. *Delimiters per source.* For each source (here: each field) every candidate delimiter is scored on
   the values that hold it: how many of the pieces begin as texts begin (piece type regularity), and
   how often all pieces of a value agree (piece-count consistency). A delimiter above ``firm`` always
   splits; a weaker one splits only where the piece behind it begins as a text begins.
3. Quoted pieces, lists, objects, keys, bullets and numbers are opened, and the pieces exploded with
   their position.

Defined results: null, blank and "NONE" fields and empty containers hold no value; nothing between
two delimiters is no value and takes no position; repeated rows give repeated values; extra columns
are not read.
"""

from __future__ import annotations

import ast
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
FIRM = 0.97

#: Candidates, longest first. Fixed values.
DELIMITERS = ("\n", "\t", "||", "//", ";;", "|", ";", " / ", "/", ",")
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›", "”": "”"}
_KEY = r"(?:A|B-O|B-S|C-O|C-S|D)"
_LEAD = re.compile(rf"^(?:[-*•·–—]\s+|\(?\d{{1,3}}[.)]\s+|\[\d{{1,3}}\]\s*|{_KEY}\s*(?:\([^()]*\)\s*)?(?:=>|->|→|[:=])\s*|{_KEY}\s+[-–—]\s+)")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _pair(text: str) -> tuple[int, int]:
    """Hash buckets of the first two words and of the first one."""
    words = [m.group() for m in itertools.islice(_WORD.finditer(text), 2)]
    two = " ".join(words).casefold()
    one = words[0].casefold() if words else ""
    return zlib.crc32(two.encode()) % BUCKETS, zlib.crc32(("1 " + one).encode()) % BUCKETS


def _container(text: str) -> list[str] | None:
    """Texts of a list or object literal, or None if the value is none."""
    if text[:1] not in "[{(" or text[-1:] not in "]})" or re.match(r"^[\[(]\d{1,3}[\])]", text):
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
    out: list[str] = []

    def walk(x: object) -> None:
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            named = next((v for k, v in x.items() if str(k).strip().lower() in ("highlighted_evidence", "text", "evidence")), None)
            if named is not None or any(str(k).strip().lower() in ("highlighted_evidence", "category") for k in x):
                walk(named)
            else:
                for v in x.values():
                    walk(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                walk(v)

    walk(value)
    return [t for s in out if (t := s.strip())]


def _strip_lead(s: str) -> str:
    while m := _LEAD.match(s):
        s = s[m.end() :]
    return s.strip()


def _quoted(text: str, at: int, seps: str) -> tuple[str, int] | None:
    """The quoted text that opens at ``at`` and where it ends, if its close stands before a delimiter."""
    close = QUOTES[text[at]]
    i = at + 1
    while (i := text.find(close, i)) >= 0:
        if text[i - 1] == "\\":
            i += 1
        elif close in "\"'" and text[i + 1 : i + 2] == close and i > at + 1:
            i += 2
        else:
            rest = text[i + 1 :].lstrip(" ")
            if not rest or rest[0] in seps or rest[0] in QUOTES and (len(rest) < len(text) - i - 1):
                inner = text[at + 1 : i]
                if close in "\"'":
                    inner = inner.replace(close * 2, close)
                return re.sub(r"\\([\"'\\/])", r"\1", inner), i + 1
            i += 1
    return None


def tokens(text: str) -> Iterator[tuple[str, str, bool]]:
    """(delimiter before, raw piece, was quoted). Cuts at every candidate delimiter outside quotes."""
    seps = "".join({d.strip(" ")[0] for d in DELIMITERS})
    at, n, before, start = 0, len(text), "", 0
    fresh = True
    while at < n:
        if fresh:
            lead = re.match(r"\s*", text[at:]).end()
            m = _LEAD.match(text[at + lead :])
            head = at + lead + (m.end() if m else 0)
            if head < n and text[head] in QUOTES and (got := _quoted(text, head, seps)):
                yield before, got[0], True
                at = start = got[1]
                before = " "
                while at < n and text[at] == " ":
                    at += 1
                start = at
                fresh = at < n and text[at] in QUOTES
                continue
            fresh = False
        d = next((d for d in DELIMITERS if text.startswith(d, at)), None)
        if d:
            piece = text[start:at]
            if piece.strip():
                yield before, piece, False
            before = d if piece.strip() or not before or before == " " else before
            at += len(d)
            start, fresh = at, True
        else:
            at += 1
    if text[start:].strip():
        yield before, text[start:], False


class StartModel:
    """How texts begin, against what follows a weak delimiter inside one text."""

    def __init__(self, begins: np.ndarray, follows: np.ndarray) -> None:
        self.begins, self.follows = begins, follows

    def begins_text(self, piece: str) -> bool:
        if _LEAD.match(piece.lstrip()):
            return True
        two, one = _pair(piece)
        b, f = self.begins[two], self.follows[two]
        if b + f == 0:
            b, f = self.begins[one], self.follows[one]
        return bool(b > f)


_NUMBERED = ((r"\(", r"\)"), (r"\[", r"\]"), ("", r"\)"), ("", r"\."))


def _numbered(text: str) -> list[str] | None:
    """Items of a list whose numbers count up in one style, on one line or several; None if there is no second."""
    for left, right in _NUMBERED:
        m = re.match(rf"\s*{left}(\d{{1,3}}){right}\s", text)
        if not m:
            continue
        cuts, at, n = [m.start()], m.end(), int(m.group(1))
        while nxt := re.compile(rf"(?<=[\s;,|/]){left}{n + 1}{right}\s").search(text, at):
            cuts.append(nxt.start())
            at, n = nxt.end(), n + 1
        if len(cuts) > 1:
            return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
    return None


def _item(piece: str) -> str:
    """One item without number, delimiter behind it and quotes around it."""
    s = _strip_lead(re.sub(r"(?:\s|;|,|\||//)+$", "", piece.strip()))
    if s and s[0] in QUOTES and (got := _quoted(s, 0, "")) and got[1] == len(s):
        return got[0].strip()
    return s


def _bare(value: str | None) -> str:
    v = (value or "").strip("\ufeff \t\r\n\v\f\xa0")
    return "" if v.upper() == "NONE" else v


def split_value(value: str | None, model: StartModel, firm: frozenset[str]) -> list[str]:
    """The texts of one field value in order. ``firm``: delimiters that always split in its source."""
    v = _bare(value)
    if not v:
        return []
    if (got := _container(v)) is not None:
        return got
    if (items := _numbered(v)) is not None:
        return [t for i in items if (t := _item(i))]
    out: list[str] = []
    open_piece: list[str] | None = None

    def flush() -> None:
        nonlocal open_piece
        if open_piece is not None:
            s = _strip_lead("".join(open_piece).strip())
            if s:
                out.append(s)
            open_piece = None

    for before, piece, was_quoted in tokens(v):
        if was_quoted:
            flush()
            if piece.strip():
                out.append(piece.strip())
        elif open_piece is None:
            open_piece = [piece]
        elif before in firm or model.begins_text(piece):
            flush()
            open_piece = [piece]
        else:
            open_piece += [before, piece]
    flush()
    return out


def _sure_texts(v: str) -> list[str] | None:
    """Texts of a value whose container leaves no doubt about its borders."""
    if (got := _container(v)) is not None:
        return got
    if (items := _numbered(v)) is not None:
        return [t for i in items if (t := _item(i))]
    parts = list(tokens(v))
    return [p for _, p, q in parts] if parts and all(q for _, _, q in parts) else None


_SOFT = re.compile(r"[,;/]\s*")


def _count(values: Iterator[str]) -> tuple[Counter, Counter]:
    begins: Counter = Counter()
    follows: Counter = Counter()
    for v in values:
        v = _bare(v)
        if not v:
            continue
        if (sure := _sure_texts(v)) is not None:
            for t in sure:
                for b in _pair(t):
                    begins[b] += 1
                for m in _SOFT.finditer(t):
                    for b in _pair(t[m.end() :]):
                        follows[b] += 1
        else:
            first = next(tokens(v), None)
            if first and not first[2]:
                for b in _pair(_strip_lead(first[1].strip())):
                    begins[b] += 1
    return begins, follows


def long_form(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """``row_id, field, value`` of the packed fields; one scan, no shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return df.select(F.col(id_col).cast("bigint").alias("row_id"), pairs.alias("x")).select("row_id", "x.field", "x.value").where("value is not null and trim(value) not in ('', 'NONE', '{}', '[]')")


def fit_starts(values: DataFrame) -> StartModel:
    """Counts over all rows; the driver gets at most 2 x BUCKETS small rows whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b: Counter = Counter()
        f: Counter = Counter()
        for pdf in batches:
            begins, follows = _count(pdf["value"])
            b.update(begins)
            f.update(follows)
        keys = sorted(set(b) | set(f))
        yield pd.DataFrame({"bucket": keys, "b": [b[k] for k in keys], "f": [f[k] for k in keys]})

    rows = values.select("value").mapInPandas(run, "bucket int, b bigint, f bigint").groupBy("bucket").agg(F.sum("b").alias("b"), F.sum("f").alias("f")).collect()
    begins, follows = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for r in rows:
        begins[r["bucket"]], follows[r["bucket"]] = r["b"], r["f"]
    return StartModel(begins, follows)


def score_delimiters(values: DataFrame, model: StartModel) -> DataFrame:
    """One row per source and delimiter: ``field, delimiter, n_values, regularity, consistency``."""
    shared = values.sparkSession.sparkContext.broadcast((model.begins, model.follows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = StartModel(*shared.value)
        n: Counter = Counter()
        for pdf in batches:
            for field, v in zip(pdf["field"], pdf["value"]):
                v = _bare(v)
                if not v or _container(v) is not None or _numbered(v) is not None:
                    continue
                by: dict[str, list[bool]] = {}
                for before, piece, quoted in tokens(v):
                    if before.strip(" ") and not quoted:
                        by.setdefault(before, []).append(m.begins_text(piece))
                for d, ok in by.items():
                    n[field, d, "values"] += 1
                    n[field, d, "pieces"] += len(ok)
                    n[field, d, "ok"] += sum(ok)
                    n[field, d, "same"] += all(ok)
        keys = sorted({k[:2] for k in n})
        yield pd.DataFrame([(*k, *(n[(*k, x)] for x in ("values", "pieces", "ok", "same"))) for k in keys], columns=["field", "delimiter", "v", "p", "ok", "same"])

    part = values.select("field", "value").mapInPandas(run, "field string, delimiter string, v bigint, p bigint, ok bigint, same bigint")
    return part.groupBy("field", "delimiter").agg(F.sum("v").alias("n_values"), (F.sum("ok") / F.sum("p")).alias("regularity"), (F.sum("same") / F.sum("v")).alias("consistency"))


def split_packed(df: DataFrame, id_col: str, fields: tuple[str, ...], firm: float = FIRM) -> DataFrame:
    """``row_id, field, pos, value_text``: every text of the packed fields."""
    values = long_form(df, id_col, fields)
    model = fit_starts(values)
    scores = score_delimiters(values, model).collect()  # sources x delimiters: a few rows
    sure: dict[str, frozenset[str]] = {}
    for field in fields:
        sure[field] = frozenset(r["delimiter"] for r in scores if r["field"] == field and min(r["regularity"], r["consistency"]) >= firm)
    shared = df.sparkSession.sparkContext.broadcast((model.begins, model.follows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = StartModel(*shared.value)
        for pdf in batches:
            rows = [(i, f, k, t) for i, f, v in zip(pdf["row_id"], pdf["field"], pdf["value"]) for k, t in enumerate(split_value(v, m, sure[f]))]
            yield pd.DataFrame(rows, columns=["row_id", "field", "pos", "value_text"])

    return values.mapInPandas(run, "row_id bigint, field string, pos int, value_text string")
