"""Defective answers of prompt and response pairs: one defect per answer at most.

empty           no word of its own
copied          zstandard with the prompt's text as dictionary needs almost nothing to write it
refusal         a sentence outside quotes declines the task (dictionary of cues by language)
other_language  the language dictionary gives it another language than the prompt's text
truncated       it stops where texts go on (ending model over all answers and reference summaries)

in this order of precedence. The language dictionary and the ending model are fitted on all rows.

Defined results: an answer whose prompt was never sent is no pair; a null answer of a sent prompt is empty;
with a null, empty or missing prompt text an answer can be neither copied nor of another language; repeated
results are repeated pairs; of several prompt texts under one id the one with the lowest row id counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm import dictionaries, endings
from timberline.session import materialize

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")
#: An answer is copied when this share of what it says alone is already said by the prompt.
COPIED = 0.6

_LABEL = re.compile(r"^\s*(?:summary|post to be summarized|post|text|answer|resumen|résumé|zusammenfassung|resumo|riassunto|samenvatting|резюме)\s*:\s*", re.I)
_HOLLOW = re.compile(r"^(?:n/?a|none|null|nil|nan|no (?:output|summary|content|answer|response)|empty|undefined|not available|tbd|todo|<[^<>]{1,12}>|summary|answer|)$", re.I)


def open_wrapper(answer: str) -> tuple[str, bool]:
    """The text of an answer without label or object around it, and whether that object was left open."""
    t = answer.replace("​", "").replace("﻿", "").strip()
    broken = False
    if m := re.match(r"^\{\s*\"?\w+\"?\s*:\s*", t):
        body = t[m.end() :]
        try:
            value = json.loads(t)
            t = str(next(iter(value.values()), "") or "") if isinstance(value, dict) else body
        except ValueError:
            broken = not re.search(r"[\"'”]?\s*\}\s*$", body)
            t = re.sub(r"[\"']?\s*\}\s*$", "", body)
            t = t[1:] if t[:1] in "\"'" else t
    while m := _LABEL.match(t):
        t = t[m.end() :]
    return t.strip(), broken


def is_empty(text: str) -> bool:
    if "<" not in text and len(re.findall(r"[^\W_]{2,}", text[:80])) > 5:
        return False
    bare = re.sub(r"<[^<>]{1,12}>", " ", text)
    bare = re.sub(r"[^\w]+", " ", bare).strip()
    return not re.search(r"[^\W_]", bare) or bool(_HOLLOW.match(text.strip(" \t\r\n[](){}\"'.*-_")))


def plain(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.casefold()).strip()


class Copies:
    """How much of an answer zstandard finds in the prompt when the prompt is its dictionary."""

    def __init__(self, level: int = 6) -> None:
        self.level = level
        self.args = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(level=level, **self.args)
        self.last: tuple[str, zstandard.ZstdCompressor | None] = ("", None)

    def share(self, prompt: str, answer: str) -> float:
        """0: nothing of the answer stands in the prompt; 1: all of it."""
        if self.last[0] != prompt:
            p = plain(prompt)
            own = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(p.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **self.args) if len(p) >= 8 else None
            self.last = (prompt, own)
        with_prompt = self.last[1]
        a = plain(answer)
        if len(a) < 8 or with_prompt is None:
            return 0.0
        a = a.encode()
        fixed = 12.0
        alone = max(len(self.alone.compress(a)) - fixed, 4.0)
        known = max(len(with_prompt.compress(a)) - fixed, 0.0)
        return float(np.clip(1.0 - known / alone, 0.0, 1.0))


def pairs(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """``result_id, shot, answer, post``: every answer to a prompt that was sent, with the prompt's text."""
    post = prompts.where("post_id is not null and post is not null and trim(post) <> ''").groupBy("post_id").agg(F.min_by("post", "row_id").alias("post"))
    sides = F.explode(F.array(F.struct(F.lit("zero_shot").alias("shot"), F.col("zero_shot_summary").alias("answer"), F.lit(True).alias("sent")), F.struct(F.lit("one_shot").alias("shot"), F.col("one_shot_summary").alias("answer"), F.col("retrieved_timeline").isNotNull().alias("sent"))))
    both = results.select(F.col("result_id").cast("bigint").alias("result_id"), "post_id", "zero_shot_summary", "one_shot_summary", "retrieved_timeline")
    # answers to no post have no partner: each gets a key of its own, so that they do not meet in one task
    both = both.withColumn("key", F.coalesce("post_id", F.concat(F.lit("\x00"), F.coalesce(F.col("result_id").cast("string"), F.lit("")))))
    return both.join(post.withColumnRenamed("post_id", "key"), "key", "left").select("result_id", "post", sides.alias("x")).where("x.sent").select("result_id", "x.shot", "x.answer", "post")


def flag_pairs(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """``result_id, shot, defect, copied_share, log_odds`` of every pair; defect is null for a sound answer."""
    answers = results.select(F.explode(F.array("zero_shot_summary", "one_shot_summary", "gold_summary")).alias("text")).where("text is not null")
    posts = prompts.select(F.col("post").alias("text")).where("text is not null")
    shared = results.sparkSession.sparkContext.broadcast(dictionaries.fit_language(answers.unionByName(posts)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, copies = dictionaries.Languages(shared.value), Copies()
        for pdf in batches:
            opened = [open_wrapper(a or "") for a in pdf["answer"]]
            ctx = [endings.final_context(endings.clean(t)) for t, _ in opened]
            spoken: dict[str, tuple[int, float, int]] = {}
            defects, shares = [], []
            for (text, _), post in zip(opened, pdf["post"]):
                share, defect = 0.0, None
                if is_empty(text):
                    defect = "empty"
                elif post and (share := copies.share(post, text)) >= COPIED and not short_quote(text, post):
                    defect = "copied"
                elif dictionaries.is_refusal(text):
                    defect = "refusal"
                else:
                    if post:
                        if post not in spoken:
                            spoken[post] = languages.of(post)
                        a, p = languages.of(answer_words(text)), spoken[post]
                        if a[0] != p[0] and a[1] > 3.0 and p[1] > 3.0 and a[2] >= 3 and p[2] >= 3:
                            defect = "other_language"
                defects.append(defect)
                shares.append(share)
            kinds = ["broken" if broken else ending for (_, broken), (_, ending) in zip(opened, ctx)]
            yield pd.DataFrame({"result_id": pdf["result_id"], "shot": pdf["shot"], "defect": defects, "copied_share": shares, "ending": kinds, "tail": [endings.tail_of(c) for c, _ in ctx]})

    seen = materialize(pairs(results, prompts).mapInPandas(run, "result_id bigint, shot string, defect string, copied_share double, ending string, tail string"), "pairs")
    odds, _ = endings.log_odds(seen, answers)
    cut = (F.col("ending") == "broken") | (F.col("ending").isin("open", "dots") & (F.col("log_odds") > -1.0))
    return seen.join(odds, "tail", "left").select("result_id", "shot", F.coalesce("defect", F.when(cut, "truncated")).alias("defect"), "copied_share", "log_odds")


def answer_words(text: str) -> str:
    """What the answer says itself, if it says anything outside its quotes."""
    own = dictionaries.unquoted(text)
    return own if len(dictionaries.words(own)) >= 3 else text


def short_quote(text: str, post: str) -> bool:
    """One short sentence of a longer post, and nothing else of it."""
    a, p = plain(text), plain(post)
    return len(a) < 0.2 * len(p) and len(a) < 60
