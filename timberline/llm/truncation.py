"""Texts cut off before their end, and how often each source cuts.

The ending model (``endings``) gives each value the log-odds that its final context is one where texts go
on. The threshold is set per column and language, source and length: the share of a language's values that
look cut moves it for that language; where many values of one length (a field limit) look cut, the prior that
another of that length is cut rises, elsewhere it stays at the source's share for such lengths. How often the
source's cut and whole texts lack a full stop or end in dots counts too.

Defined results: null and blank values are no cases; a value that ends in a replacement character was cut
inside one; an ellipsis is judged by what stands before it; whole texts that lack only the last full stop,
or end in a bracket, quotation mark or symbol, are judged by their last words. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import dictionaries, endings
from timberline.session import materialize

OUT = "field string, row_id bigint, source string, lang string, n_chars int, ending string, tail string"


def long_values(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``field, row_id, source, text`` of the given (table, id, source column, text column)."""
    out = None
    for df, id_col, source, text in parts:
        one = df.select(F.lit(text).alias("field"), F.col(id_col).cast("bigint").alias("row_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def score_endings(values: DataFrame, corpus: DataFrame) -> DataFrame:
    """How each value ends and the log-odds that texts go on there, counted over the texts of ``corpus``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [endings.clean(t or "") for t in pdf["text"]]
            ctx = [endings.final_context(t) for t in texts]
            lang = [dictionaries.seed_language(dictionaries.words(t)) for t in texts]
            yield pd.DataFrame({"field": pdf["field"], "row_id": pdf["row_id"], "source": pdf["source"], "lang": [dictionaries.LANGS[k] if k >= 0 else "" for k in lang], "n_chars": [len(t or "") for t in pdf["text"]], "ending": [k for _, k in ctx], "tail": [endings.tail_of(c) for c, _ in ctx]})

    seen = materialize(values.where("text is not null and trim(text) <> ''").mapInPandas(run, OUT), "values")
    odds, base = endings.log_odds(seen, corpus)
    score = F.when(F.col("ending") == "broken", 50.0).when(F.col("ending") == "end", float(np.log(base))).otherwise(F.col("log_odds"))
    return materialize(seen.join(odds, "tail", "left").select("field", "row_id", "source", "lang", "n_chars", "ending", score.alias("score")), "scored")


def _priors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Prior log-odds of a cut for each length of one field and source, from a histogram of lengths."""
    pdf = pdf.sort_values("n_chars")
    size, n, cut = pdf["n_chars"].to_numpy(), pdf["n"].to_numpy(float), pdf["n_cut"].to_numpy(float)
    lo, hi = np.searchsorted(size, size - 8), np.searchsorted(size, size + 8, "right")

    def near(x: np.ndarray) -> np.ndarray:
        """Sums over the 17 lengths around each."""
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[hi] - total[lo]

    share = (cut.sum() + 0.5) / (n.sum() + 1)
    around = (near(n) - n) / 16
    spike = (n >= 12) & (n > 3 * around + 5)
    # a limit says nothing about the lengths beside it
    near_n, near_cut = near(np.where(spike, 0, n)), near(np.where(spike, 0, cut))
    p = np.where(spike, (cut + share) / (n + 1), (near_cut + 4 * share) / (near_n + 4))
    p = np.clip(p, 1e-4, 1 - 1e-3)
    out = pd.DataFrame({"field": pdf["field"].iloc[0], "source": pdf["source"].iloc[0], "n_chars": size, "prior": np.log(p / (1 - p))})
    n_cut, n_whole = pdf["n_cut"].sum(), pdf["n"].sum() - pdf["n_cut"].sum()
    for kind in ("open", "dots"):  # how the source's cut and whole texts end
        c, w = pdf[f"{kind}_cut"].sum(), pdf[kind].sum() - pdf[f"{kind}_cut"].sum()
        out[f"{kind}_odds"] = np.log((c + 1) / (n_cut + 3)) - np.log((w + 1) / (n_whole + 3))
    return out


def _by_language(scored: DataFrame, firm: float = 20.0) -> DataFrame:
    """``field, lang, shift``: how far the log-odds of a cut in a language lie from those of its column.

    Languages of few values stay near their column (``firm`` values of its share are added to each).
    """
    per = scored.groupBy("field", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("c"))  # a row per column and language
    whole = Window.partitionBy("field")
    p = (F.sum("c").over(whole) + 0.5) / (F.sum("n").over(whole) + 1)
    q = (F.col("c") + firm * F.col("p")) / (F.col("n") + firm)
    logit = lambda x: F.log(x / (1 - x))
    return per.withColumn("p", p).select("field", "lang", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), logit(q) - logit(F.col("p")))).alias("shift"))


def find_cuts(parts: list[tuple[DataFrame, str, str, str]], more_texts: DataFrame | None = None) -> DataFrame:
    """``field, row_id, source, lang, n_chars, is_cut, log_odds`` of every value that is not null or blank."""
    values = long_values(parts)
    corpus = values.select("text").where("text is not null")
    scored = score_endings(values, corpus if more_texts is None else corpus.unionByName(more_texts))
    cut = F.col("score") > 0
    of_kind = [F.count_if((F.col("ending") == k) & c).alias(k + name) for k in ("open", "dots") for name, c in (("", F.lit(True)), ("_cut", cut))]
    hist = scored.groupBy("field", "source", "n_chars").agg(F.count("*").alias("n"), F.count_if(cut).alias("n_cut"), *of_kind)
    prior = hist.groupBy("field", "source").applyInPandas(_priors, "field string, source string, n_chars int, prior double, open_odds double, dots_odds double")
    got = scored.join(prior, ["field", "source", "n_chars"])
    manner = F.when(F.col("ending") == "open", F.col("open_odds")).when(F.col("ending") == "dots", F.col("dots_odds")).otherwise(0.0)
    got = got.join(F.broadcast(_by_language(scored)), ["field", "lang"])
    odds = F.col("score") + F.col("prior") + F.col("shift") + manner
    return got.select("field", "row_id", "source", "lang", "n_chars", (odds > 0).alias("is_cut"), odds.alias("log_odds"))


def cut_rates(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Per field and source: values, texts, cuts, the share of texts cut, and the most frequent cut length."""
    found = find_cuts(parts)
    by_len = found.groupBy("field", "source", "n_chars").agg(F.count("*").alias("n"), F.sum(F.col("is_cut").cast("int")).alias("c"))
    return by_len.groupBy("field", "source").agg(F.sum("n").alias("n_texts"), F.sum("c").alias("n_cut"), F.round(F.sum("c") / F.sum("n"), 6).alias("cut_share"), F.max_by("n_chars", F.struct("c", "n_chars")).alias("usual_cut_length"))
