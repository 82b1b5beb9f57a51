"""Languages of documents and of their sentences by error-correcting output codes.

Each language has a codeword of ``BITS`` bits; one binary classifier per bit (logistic, over hashed
character 2- to 4-grams of letters) gives a margin. Decoding is loss-weighted: the language whose codeword
has the least logistic loss over all margins is chosen; a small gap to the second is flagged as ambiguous.
A document is read sentence by sentence; the cheapest path through the sentences' losses, with a price per
change of language, gives its segments.

The classifiers are fitted on a bounded sample of labelled documents (``mixed_rows`` in their natural mix and
up to ``per_language`` of each label, by id hash). Labels may be wrong and documents mixed: each document, then
each sentence, is first judged by n-gram chances counted over the others, and only what agrees is fitted.
Everything else covers every document. ``count`` has no sample: it counts the n-grams of every labelled document
on the executors, and its model reads by their chances.

Defined results: null, empty and letterless texts have no language and are no case; a label that is null,
blank or names no language is missing; other spellings, codes and regions of the right language are right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("en", "es", "fr", "de", "pt", "it", "nl", "ru")
BITS = 15
SPACE = 1 << 16

#: Of the counts over every document: parts that judge one another, n-grams of one row.
FOLDS, ROW = 3, 4096

#: Names and codes of the languages, and labels that name none.
NAMES = {
    "en": ("en", "eng", "english", "inglés", "anglais", "englisch"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "castilian"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "ru": ("ru", "rus", "russian", "русский"),
}
NO_LANGUAGE = ("", "und", "unk", "unknown", "n/a", "na", "none", "null", "nil", "nan", "xx", "xxx", "zxx", "mul", "mis", "-", "--", "?", "??", "other", "auto", "undefined", "undetermined", "multi", "multiple", "mixed", "no", "tbd", "0")
_BY_NAME = {n: k for k, v in NAMES.items() for n in v}

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|[\r\n\x0b\x0c\x85  ]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"<[^<>\s]{1,40}>|https?://\S+|\S+@\S+")


def letters(text: str) -> list[str]:
    """Runs of letters outside markup, links and addresses."""
    return _LETTERS.findall(_MARKUP.sub(" ", text) if "<" in text or "@" in text or "://" in text else text)


def normalize_label(label: str | None) -> str:
    """A language code; '' if the label names no language; the folded label if it names another one."""
    s = re.sub(r"[​﻿ ]", " ", label or "").strip(" \t\r\n\"'.;,()[]").casefold()
    if s in NO_LANGUAGE:
        return ""
    if s in _BY_NAME:
        return _BY_NAME[s]
    head = re.split(r"[-_ /(]", s)[0]
    if head in NO_LANGUAGE:
        return ""
    return _BY_NAME.get(head, s)


def codewords(seed: int = 11) -> np.ndarray:
    """8 codewords of BITS bits in {-1, 1}: the columns of most balanced splits, far apart in pairs."""
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(400):
        cols = np.array([rng.permutation([1] * 4 + [-1] * 4) for _ in range(BITS)]).T
        d = min(((cols[a] != cols[b]).sum() for a in range(8) for b in range(a)), default=0)
        if d > far:
            best, far = cols, d
    return best.astype(np.float32)


def sentences(text: str) -> list[str]:
    """Sentences in reading order; pieces without letters join the one before."""
    out: list[str] = []
    for s in _SENTENCE.split(text):
        if not s or not s.strip():
            continue
        if letters(s) or not out:
            out.append(s)
        else:
            out[-1] += " " + s
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, concatenated, and where each text's begin."""
    clean = [" " + " ".join(letters(t)).lower() + " " for t in texts]
    size = np.array([len(c) for c in clean], np.int64)
    a = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(clean), dtype=np.int32), size)
    grams, real = np.zeros((len(a), 3), np.int32), np.zeros((len(a), 3), bool)
    h = a
    with np.errstate(over="ignore"):
        for k, n in enumerate((2, 3, 4)):
            if len(a) < n:
                break
            h = h[: len(a) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + a[n - 1 :]
            grams[: len(h), k] = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
            real[: len(h), k] = own[: len(h)] == own[n - 1 :]
    count = np.bincount(own, real.sum(1), len(texts)).astype(np.int64) if len(a) else np.zeros(len(texts), np.int64)
    return grams[real], np.concatenate([[0], np.cumsum(count)])


def chunks(texts: list[str], chunk: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``chunk`` n-grams together."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) * 3 <= chunk):
            n += len(texts[hi]) * 3
            hi += 1
        yield lo, hi
        lo = hi


def margins(w: np.ndarray, texts: list[str], chunk: int = 400_000) -> np.ndarray:
    """One margin per text and bit; work is cut into chunks of n-grams, whole texts only."""
    out = np.zeros((len(texts), w.shape[1]), np.float32)
    for lo, hi in chunks(texts, chunk):
        idx, at = features(texts[lo:hi])
        if len(idx):
            total = np.zeros((hi - lo, w.shape[1]), np.float32)
            full = at[:-1] < at[1:]
            sums = np.add.reduceat(w[idx], at[:-1][full], axis=0)
            total[full] = sums / np.sqrt((at[1:] - at[:-1])[full])[:, None]
            out[lo:hi] = total
    return out


def fit_bits(texts: list[str], langs: np.ndarray, code: np.ndarray, rounds: int = 5, rate: float = 0.5, seed: int = 3) -> np.ndarray:
    """Logistic weights (SPACE x BITS), averaged over the later half of the steps."""
    rng = np.random.default_rng(seed)
    idx, at = features(texts)
    size = at[1:] - at[:-1]
    use = np.nonzero(size > 0)[0]
    w = np.zeros((SPACE, BITS), np.float32)
    mean = np.zeros_like(w)
    kept = 0
    for r in range(rounds):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 256)):
            spans = [idx[at[i] : at[i + 1]] for i in part]
            flat = np.concatenate(spans)
            n = size[part]
            scale = (1 / np.sqrt(n)).astype(np.float32)
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            m = np.add.reduceat(w[flat], begin, axis=0) * scale[:, None]
            y = code[langs[part]]
            g = y / (1 + np.exp(np.clip(y * m, -30, 30))) * scale[:, None] * rate
            order = np.argsort(flat, kind="stable")
            ordered = flat[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            rows = np.repeat(np.arange(len(part)), n)[order]
            w[ordered[first]] += np.add.reduceat(g.take(rows, axis=0), first, axis=0)
        if r >= rounds // 2:
            mean += w
            kept += 1
    return mean / max(kept, 1)


def losses(m: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Logistic loss of each language's codeword, texts x languages."""
    return np.logaddexp(0, -m[:, None, :] * code[None]).sum(2)


class Model:
    def __init__(self, w: np.ndarray, code: np.ndarray, known: np.ndarray | None = None, change: float = 4.0, shortest: int = 6, soften: float = 3.0) -> None:
        self.w, self.code, self.change, self.shortest, self.soften = w, code, change, shortest, soften
        self.out = np.zeros(len(code), np.float32) if known is None or not known.any() else np.where(known, 0, 1e6).astype(np.float32)

    def loss(self, texts: list[str]) -> np.ndarray:
        """Loss of each language, texts x languages."""
        return losses(margins(self.w, texts), self.code) + self.out

    def read(self, texts: list[str]) -> list[list[tuple[int, list[str], float, bool]]]:
        """Per text its segments in order: (language, sentences, confidence, ambiguous)."""
        parts = [sentences(t) for t in texts]
        loss = self.loss([s for p in parts for s in p])
        out, at = [], 0
        for p in parts:
            own = loss[at : at + len(p)]
            at += len(p)
            size = np.array([sum(map(len, letters(s))) for s in p])
            if not size.sum():
                out.append([])
                continue
            own = np.where((size >= self.shortest)[:, None], own, own.min(1, keepdims=True)) if (size >= self.shortest).any() else own
            path = self._path(own)
            runs: list[tuple[int, list[str], float, bool]] = []
            lo = 0
            for hi in range(1, len(p) + 1):
                if hi == len(p) or path[hi] != path[lo]:
                    total = own[lo:hi].sum(0)
                    rel = np.exp(-(total - total.min()) / self.soften)
                    second = np.partition(total, 1)[1] - total.min()
                    runs.append((int(path[lo]), p[lo:hi], float(rel[path[lo]] / rel.sum()), bool(second < 1.0)))
                    lo = hi
            out.append(runs)
        return out

    def _path(self, loss: np.ndarray) -> np.ndarray:
        cost = loss[0].copy()
        back = np.zeros(loss.shape, np.int64)
        for i in range(1, len(loss)):
            best = int(cost.argmin())
            stay = cost <= cost[best] + self.change
            back[i] = np.where(stay, np.arange(loss.shape[1]), best)
            cost = np.where(stay, cost, cost[best] + self.change) + loss[i]
        path = np.zeros(len(loss), np.int64)
        path[-1] = cost.argmin()
        for i in range(len(loss) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def log_chances(count: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log chances from counts (SPACE x languages)."""
    n = count + smooth
    return np.log(n / n.sum(0)).astype(np.float32)


def word_chances(idx: np.ndarray, at: np.ndarray, lang: np.ndarray, use: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log chance of each n-gram in the texts ``use`` of each language (SPACE x languages)."""
    of = np.repeat(np.where(use, lang, len(LANGS)).astype(np.int32), np.diff(at))
    n = np.bincount(idx * np.int32(len(LANGS) + 1) + of, minlength=SPACE * (len(LANGS) + 1)).reshape(SPACE, -1)[:, :-1]
    return log_chances(n, smooth)


def chances(table_: np.ndarray, idx: np.ndarray, at: np.ndarray, texts: np.ndarray, seen: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Log chance of each of ``texts`` in each language; languages without a text are out of the question."""
    out = np.zeros((len(texts), len(LANGS)), np.float32)
    for lo in range(0, len(texts), chunk):
        spans = [idx[at[i] : at[i + 1]] for i in texts[lo : lo + chunk]]
        size = np.array([len(x) for x in spans])
        full = np.flatnonzero(size)
        if len(full):
            begin = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            out[lo + full] = np.add.reduceat(table_[np.concatenate(spans)], begin, axis=0)
    out[:, ~seen] = -np.inf
    return out


def agreeing(texts: list[str], lang: np.ndarray, folds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Which labels the texts of the *other* folds bear out, and the gap in favour of the best other language.

    A text is judged by n-gram chances counted without it, so that no wrong label can vouch for itself. The
    chances of a label are a mixture over all texts that bear it: a text of another language finds a better
    one in its own label as long as that language bears its label more often than this one.
    """
    idx, at = features(texts)
    fold = np.arange(len(texts)) % folds
    best, gap = np.full(len(texts), -1), np.zeros(len(texts))
    for f in range(folds):
        use = fold != f
        seen = np.bincount(lang[use], minlength=len(LANGS)) > 0
        if not seen.any():
            continue
        mine = np.flatnonzero(fold == f)
        got = chances(word_chances(idx, at, lang, use), idx, at, mine, seen)
        best[mine] = got.argmax(1)
        gap[mine] = got.max(1) - got[np.arange(len(mine)), lang[mine]]
    return best == lang, gap


def train(texts: list[str], labels: list[str], chars_per_language: int = 60_000, seed: int = 17) -> Model:
    """A model from labelled documents, some of whose labels are wrong and some of which mix languages.

    Labels, then the sentences of the documents kept, are judged by cross-fitted n-gram chances (``agreeing``);
    the bits are fitted once, on up to ``chars_per_language`` characters of sentences of each language, so that
    frequent languages do not outweigh rare ones. Languages without a document left are never chosen.
    """
    code = codewords()
    lang = np.array([LANGS.index(x) for x in labels], np.int64)
    none = Model(np.zeros((SPACE, BITS), np.float32), code)
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, lang = [texts[i] for i in order], lang[order]
    for _ in range(2):  # the second time without the labels that the first found wrong
        if not len(texts):
            return none
        keep = np.flatnonzero(agreeing(texts, lang)[0])
        texts, lang = [texts[i] for i in keep], lang[keep]
    parts = [(s, k) for t, k in zip(texts, lang) for s in sentences(t)]
    if not parts:
        return none
    flat, own = [s for s, _ in parts], np.array([k for _, k in parts])
    # a sentence keeps its document's language unless it clearly speaks another one
    same, gap = agreeing(flat, own)
    size = np.array([len(s) for s in flat])
    pick: list[np.ndarray] = []
    for k in range(len(LANGS)):
        mine = np.flatnonzero((own == k) & (same | (gap < 2.0)))
        pick.append(mine[np.cumsum(size[mine]) - size[mine] < chars_per_language])
    use = np.concatenate(pick)
    known = np.array([len(x) > 0 for x in pick])
    return Model(fit_bits([flat[i] for i in use], own[use], code, rounds=4), code, known)


def _labelled(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``h, t, k``: id hash, text and language of the documents whose label names one."""
    label = F.lower(F.regexp_replace(F.col(label_col), r"[\s\u200b]", ""))
    code = F.coalesce(*[F.when(F.regexp_extract(label, r"^([^-_]*)", 1).isin(list(v)), F.lit(k)) for k, v in NAMES.items()])
    return df.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"), code.alias("k")).where("t is not null and length(t) > 20 and k is not null")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", mixed_rows: int = 2000, per_language: int = 300, passage: int = 4000) -> Model:
    """A model from ``mixed_rows`` labelled documents and up to ``per_language`` of each label, by id hash.

    Of a longer document one passage of ``passage`` characters counts, from a place by id hash; all three bounds are parameters.
    """
    rows = _labelled(df, id_col, text_col, label_col)
    begin = F.when(F.length("t") > passage, F.pmod(F.col("h"), F.length("t") - passage) + 1).otherwise(1).cast("int")
    rows = rows.select("h", "k", F.substring("t", begin, F.lit(passage)).alias("t"))
    first = rows.orderBy("h", "t").limit(mixed_rows).collect()
    w = Window.partitionBy("k").orderBy(F.desc("h"), "t")
    more = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("h", "k", "t").collect()
    got = sorted({(r["h"], r["k"], r["t"]) for r in (*first, *more)})
    return train([t for _, _, t in got], [k for _, k, _ in got])


class Counted(Model):
    """Reads by the chances of the n-grams as counted (SPACE x languages)."""

    def __init__(self, n: np.ndarray) -> None:
        super().__init__(np.zeros((0, BITS), np.float32), codewords(), n.sum(0) > 0)
        self.table = log_chances(n)

    def loss(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(LANGS)), np.float32)
        for lo, hi in chunks(texts, 400_000):
            out[lo:hi] = chances(self.table, *features(texts[lo:hi]), np.arange(hi - lo), np.ones(len(LANGS), bool))
        return self.out - out / 3  # each letter counts in n-grams of three lengths


def _grams(rows: DataFrame, judges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Counts (FOLDS x SPACE x languages) of the n-grams of all ``rows`` whose labels every judge bears out."""
    cells = FOLDS * len(LANGS)
    shared = rows.sparkSession.sparkContext.broadcast(judges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((cells + 1, SPACE), np.int64)
        for pdf in batches:
            texts, langs, folds = list(pdf["t"]), np.array([LANGS.index(k) for k in pdf["k"]], np.int64), pdf["fold"].to_numpy()
            for lo, hi in chunks(texts, 2_000_000):
                (idx, at), lang, fold = features(texts[lo:hi]), langs[lo:hi], folds[lo:hi]
                kept = np.ones(hi - lo, bool)
                for table_, seen in shared.value:
                    for f in range(FOLDS):
                        mine = np.flatnonzero(kept & (fold == f))
                        kept[mine] = seen[f].any() & (chances(table_[f], idx, at, mine, seen[f]).argmax(1) == lang[mine])
                own = np.where(kept, fold * len(LANGS) + lang, cells)
                n += np.bincount(np.repeat(own, np.diff(at)) * SPACE + idx, minlength=n.size).reshape(n.shape)
        parts = n[:-1].reshape(cells, -1, ROW)
        cell, part = np.nonzero(parts.any(2))
        yield pd.DataFrame({"cell": cell, "part": part, "n": [parts[i, j].tobytes() for i, j in zip(cell, part)]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(ROW, np.int64)
        for x in pdf["n"]:
            n += np.frombuffer(x, np.int64)
        return pdf.iloc[:1].assign(n=[n.tobytes()])

    ddl = "cell int, part int, n binary"
    out = np.zeros((cells, SPACE // ROW, ROW), np.int64)
    for r in rows.mapInPandas(run, ddl).groupBy("cell", "part").applyInPandas(total, ddl).collect():  # 24 x 16 rows of 32 KB at most
        out[r["cell"], r["part"]] = np.frombuffer(r["n"], np.int64)
    shared.unpersist()
    return out.reshape(FOLDS, len(LANGS), SPACE).transpose(0, 2, 1)


def count(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Counted:
    """A model counted over every labelled document and all of its text.

    As in ``train``, a document counts only if chances counted over the documents of the other parts (by id hash)
    bear its label out, twice: the second time without the labels that the first found wrong. Nothing but the
    counts, whose size is fixed, is brought to the driver.
    """
    rows = _labelled(df, id_col, text_col, label_col).select("t", "k", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))
    judges: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(2):
        n = _grams(rows, judges)
        others = n.sum(0) - n
        judges.append((np.stack([log_chances(x) for x in others]), others.sum(1) > 0))
    return Counted(_grams(rows, judges).sum(0))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per document and segment: ``doc_id, seg_no, n_segments, lang, confidence, ambiguous, label, n_chars``.

    Texts without letters give one row with a null language.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, id_col, text_col, label_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                rows = []
                for i, label, runs in zip(part["doc_id"], part["label"], m.read([t or "" for t in part["text"]])):
                    name = normalize_label(label)
                    if not runs:
                        rows.append((i, 0, 0, None, None, None, name, 0))
                    for k, (lang, sents, conf, vague) in enumerate(runs):
                        rows.append((i, k, len(runs), LANGS[lang], conf, vague, name, sum(map(len, sents))))
                yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "n_segments", "lang", "confidence", "ambiguous", "label", "n_chars"])

    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    return src.mapInPandas(run, "doc_id bigint, seg_no int, n_segments int, lang string, confidence double, ambiguous boolean, label string, n_chars int")


def label_cases(found: DataFrame) -> DataFrame:
    """Missing and wrong labels and the segments of mixed documents: ``doc_id, kind, seg_no, lang``."""
    kind = F.when(F.col("n_segments") > 1, "mixed").when(F.col("label") == "", "missing").when(F.col("label") != F.col("lang"), "wrong")
    return found.where("lang is not null").select("doc_id", kind.alias("kind"), "seg_no", "lang").where("kind is not null")
