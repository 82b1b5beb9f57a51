"""Mixing sources to target shares by iterative proportional fitting.

1. Tokens of each document (``tokens``), its language and its topic give cells source x language x topic;
   their token sums are the seed table. The language is the one most of the text is in, as ``language`` reads
   it by n-grams counted over every labelled document, whatever the label. Topics are clusters of the language's
   documents by the words they use (spherical k-means of hashed, idf-weighted words), fitted on every document:
   each pass sums on the executors, in whole multiples of 1 / UNIT, so that no sum hangs on the order of the rows.
2. The total is the largest one at which no source must be repeated more often than it may.
3. Raking: cell weights are scaled in turn to the language and topic shares of the corpus and to the
   target shares of the sources (last, so these hold exactly); no cell may exceed its source's cap, and
   what a capped cell cannot take goes to the other cells of the source.
4. Sampling: a document's expected number of uses is its cell's weight over the cell's tokens. Uses are
   drawn by systematic sampling along the documents of a cell in order of size, block by block, so token
   shares come out close to the weights without a global sort and without random noise in size.

Defined results: documents without tokens, of an unknown source or of a source without target are used
0 times; a source with a target but no tokens stays empty and the report shows it; null shares count as 0,
null caps as 1; repeated documents are separate documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import language, tokens
from timberline.session import materialize

BLOCK = 4000

#: Hashed words of the topic vectors, topics of a language.
WORDS, TOPICS = 2048, 5

UNIT = float(1 << 20)

#: Of one block of documents of a language (id hashes, words): topic, a number and a vector each.
Step = Callable[[str, np.ndarray, list[np.ndarray]], list[tuple[int, float, np.ndarray]]]


def _words(text: str) -> np.ndarray:
    """The distinct hashed content words of a text."""
    return np.unique(np.array([zlib.crc32(w.encode()) % WORDS for w in language.letters(text.lower()) if len(w) > 3], np.int64))


def _sum(a: tuple[float, np.ndarray], b: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _least(a: tuple[float, np.ndarray], b: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
    return min(a, b, key=lambda x: (x[0], x[1].tobytes()))


def _merged(rows: Iterable[tuple[str, int, float, np.ndarray]], merge: Callable) -> pd.DataFrame:
    """One row per language and topic."""
    of: dict[tuple[str, int], tuple[float, np.ndarray]] = {}
    for lang, c, n, x in rows:
        of[lang, c] = merge(of[lang, c], (n, x)) if (lang, c) in of else (n, x)
    return pd.DataFrame([(*key, float(n), x.tobytes()) for key, (n, x) in of.items()], columns=["lang", "c", "n", "x"])


class Documents:
    """Documents (id hash, language, words) in passes: what a step gives for every block of them, merged."""

    def __init__(self, rows: DataFrame | pd.DataFrame) -> None:
        self.rows = rows

    def over(self, step: Step, merge: Callable) -> dict[tuple[str, int], tuple[float, np.ndarray]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield _merged(((lang, *got) for pdf in batches for lang, part in pdf.groupby("lang") for got in step(lang, part["h"].to_numpy(), list(part["words"]))), merge)

        def again(pdf: pd.DataFrame) -> pd.DataFrame:
            return _merged(((r.lang, r.c, r.n, np.frombuffer(r.x)) for r in pdf.itertuples()), merge)

        ddl = "lang string, c int, n double, x binary"
        got = next(run(iter([self.rows]))) if isinstance(self.rows, pd.DataFrame) else self.rows.mapInPandas(run, ddl).groupBy("lang", "c").applyInPandas(again, ddl).toPandas()  # 8 languages x topics rows of 16 KB
        return {(r.lang, int(r.c)): (r.n, np.frombuffer(r.x)) for r in got.itertuples()}


def _unit(words: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents, the document of each, its weight there, and which documents have any weight."""
    flat, own = np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])
    norm = np.sqrt(np.bincount(own, idf[flat] ** 2, len(words)))
    return flat, own, np.round(idf[flat] / np.where(norm > 0, norm, 1.0)[own] * UNIT) / UNIT, norm > 0


class Topics:
    """Clusters of the documents of each language by their words."""

    def __init__(self, texts: list[str], langs: list[str], k: int = TOPICS) -> None:
        rows = pd.DataFrame({"h": np.arange(len(texts)), "lang": langs, "words": [_words(t) for t in texts]})
        self.fit(Documents(rows[rows["words"].map(len) > 0]), k)

    @classmethod
    def of_all(cls, rows: DataFrame) -> Topics:
        """Of every document of a table ``h, lang, words``."""
        out = cls.__new__(cls)
        out.fit(Documents(rows), TOPICS)
        return out

    def fit(self, docs: Documents, k: int, rounds: int = 12) -> None:
        """Seeds are drawn one by one from all documents, by the square of their distance to the nearest seed so far."""
        self.idf: dict[str, np.ndarray] = {}
        self.cent: dict[str, np.ndarray] = {}
        for (lang, _), (n, x) in docs.over(lambda _, h, words: [(0, len(words), np.bincount(np.concatenate(words), minlength=WORDS).astype(np.float64))], _sum).items():
            self.idf[lang] = np.where(x > 0, np.log((1 + n) / (1 + x)), 0.0)
            self.cent[lang] = np.zeros((0, WORDS))
        idf, cent = self.idf, self.cent  # sent with each pass
        weighed = docs.over(lambda lang, h, words: [(0, float(_unit(words, idf[lang])[3].sum()), np.zeros(0))], _sum)
        room = {lang: min(k, max(1, int(n) // 8)) if n else 0 for (lang, _), (n, _) in weighed.items()}
        for seed in range(max(room.values(), default=0)):

            def draw(lang: str, h: np.ndarray, words: list[np.ndarray], seed: int = seed) -> list[tuple[int, float, np.ndarray]]:
                if seed >= room[lang]:
                    return []
                flat, own, x, full = _unit(words, idf[lang])
                gap = 1.0 - np.max([np.bincount(own, x * c[flat], len(words)) for c in cent[lang]], 0) if seed else np.ones(len(words))
                gap = np.where(full, np.maximum(gap, 1e-9), 0.0)
                with np.errstate(over="ignore", divide="ignore"):
                    u = (h.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    u = (u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    wait = -np.log(((u >> np.uint64(11)) + 0.5) / 2.0**53) / gap**2  # the least of these is a draw by gap squared
                i = int(wait.argmin())
                v = np.zeros(WORDS)
                v[words[i]] = x[own == i]
                return [(0, float(wait[i]), v)]

            for (lang, _), (_, v) in docs.over(draw, _least).items():
                cent[lang] = np.vstack([cent[lang], v])

        def near(lang: str, h: np.ndarray, words: list[np.ndarray]) -> list[tuple[int, float, np.ndarray]]:
            if not room[lang]:
                return []
            flat, own, x, full = _unit(words, idf[lang])
            to = np.array([np.bincount(own, x * c[flat], len(words)) for c in cent[lang]]).argmax(0)
            total = np.bincount(to[own] * WORDS + flat, x, len(cent[lang]) * WORDS).reshape(-1, WORDS)
            return [(int(c), float((to[full] == c).sum()), total[c]) for c in np.unique(to[full])]

        for _ in range(rounds):
            moved = False
            for (lang, c), (_, x) in docs.over(near, _sum).items():
                new = x / np.linalg.norm(x)
                moved |= not np.array_equal(new, cent[lang][c])
                cent[lang][c] = new
            if not moved:
                break
        for lang in cent:
            cent[lang] = cent[lang] if len(cent[lang]) else np.zeros((1, WORDS))

    def of(self, text: str, lang: str) -> str:
        """The language's topic whose centre is nearest; 'none' for texts without words and languages without topics."""
        return self.of_words(_words(text), lang)

    def of_words(self, words: np.ndarray, lang: str) -> str:
        if lang not in self.cent or not len(words):
            return "none"
        weight = self.idf[lang][words]
        return f"{lang}-{int((self.cent[lang][:, words] @ weight).argmax())}"


def main_language(model: language.Model, texts: list[str]) -> list[str]:
    """The language that most characters of each text are in; 'none' without letters."""
    out = []
    for runs in model.read(texts):
        size: dict[int, int] = {}
        for lang, sents, _, _ in runs:
            size[lang] = size.get(lang, 0) + sum(map(len, sents))
        out.append(language.LANGS[max(size, key=lambda k: (size[k], -k))] if size else "none")
    return out


def read_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_rows: int | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, text`` of every document.

    Languages and topics are fitted on every document; ``topic_rows`` is for callers that ask for topics of so many of each language.
    """
    model = language.count(docs, id_col, text_col, lang_col)
    own = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    spark = docs.sparkSession
    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    read = spark.sparkContext.broadcast(model)

    def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["lang"] = main_language(read.value, [t or "" for t in pdf["text"]])
            pdf["words"] = [_words(t or "") for t in pdf["text"]]
            yield pdf[["doc_id", "source", "lang", "words", "text"]]

    # the documents are read once: kept, with their language and words, in the shared folder
    spoken = materialize(cols.mapInPandas(speak, "doc_id bigint, source string, lang string, words array<int>, text string"), "spoken")
    worded = spoken.where("lang <> 'none' and size(words) > 0").select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang", "words")
    if topic_rows is not None:
        worded = worded.withColumn("n", own).where(F.col("n") <= topic_rows)
    known = spark.sparkContext.broadcast(Topics.of_all(worded.select("h", "lang", "words")))

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["topic"] = [known.value.of_words(w, k) for w, k in zip(pdf["words"], pdf["lang"])]
            yield pdf[["doc_id", "source", "lang", "topic", "text"]]

    return spoken.mapInPandas(sort, "doc_id bigint, source string, lang string, topic string, text string")


def rake(sizes: np.ndarray, shares: np.ndarray, caps: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of cells (source x language x topic): sources to ``shares``, other marginals as in ``sizes``."""
    have = sizes.sum((1, 2))
    share = np.where(have > 0, shares, 0.0)
    if share.sum() <= 0:
        return np.zeros_like(sizes)
    share = share / share.sum()
    total = min(caps[i] * have[i] / share[i] for i in range(len(share)) if share[i] > 0)
    goal = total * share
    lang, top = sizes.sum((0, 2)) / sizes.sum() * total, sizes.sum((0, 1)) / sizes.sum() * total
    w = sizes * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[:, None, None]
    limit = sizes * caps[:, None, None]

    def scaled(axis: tuple[int, int], to: np.ndarray) -> np.ndarray:
        now = w.sum(axis)
        f = np.divide(to, now, out=np.ones_like(to), where=now > 0)
        return w * np.expand_dims(f, axis)

    for _ in range(rounds):
        w = scaled((0, 2), lang)
        w = scaled((0, 1), top)
        w = scaled((1, 2), goal)
        for _ in range(20):  # what capped cells cannot take goes to the source's other cells
            over = w > limit
            w = np.minimum(w, limit)
            miss = goal - w.sum((1, 2))
            if not over.any() or (miss <= 1e-9 * total).all():
                break
            free = np.where(w < limit, w, 0.0)
            room = free.sum((1, 2))
            f = np.divide(miss, room, out=np.zeros_like(miss), where=room > 0)
            w = w + free * np.maximum(f, 0)[:, None, None]
    return np.minimum(w, limit)


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", path: str | None = None, topic_rows: int | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of every document of a source with a target."""
    goal = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("m")).orderBy("source").collect()
    names = [r["source"] for r in goal]
    spark = docs.sparkSession
    wanted = docs.join(F.broadcast(targets.select(F.col("source").alias(source_col)).distinct()), source_col, "left_semi")  # a row per source
    cols = read_documents(wanted, id_col, text_col, source_col, lang_col, topic_rows)
    counted = tokens.count_tokens(cols, "text", ("doc_id", "source", "lang", "topic"), path)
    counted = materialize(counted, "tokens")
    cells = counted.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).toPandas()  # targets x 9 languages x TOPICS rows at most
    langs, topics = sorted(set(cells["lang"])), sorted(set(cells["topic"]))
    sizes = np.zeros((len(names), max(len(langs), 1), max(len(topics), 1)))
    for r in cells.itertuples():
        sizes[names.index(r.source), langs.index(r.lang), topics.index(r.topic)] = r.n
    w = rake(sizes, np.array([r["s"] for r in goal]), np.array([float(r["m"]) for r in goal])) if sizes.sum() else sizes
    plan = pd.DataFrame([(r.source, r.lang, r.topic, float(w[i, j, k] / r.n) if r.n else 0.0, max(1, math.ceil(r.docs / BLOCK)), float(goal[i]["m"])) for r in cells.itertuples() for i, j, k in [(names.index(r.source), langs.index(r.lang), topics.index(r.topic))]], columns=["source", "lang", "topic", "rate", "blocks", "cap"])
    rates = spark.createDataFrame(plan, "source string, lang string, topic string, rate double, blocks int, cap double")
    x = counted.join(F.broadcast(rates), ["source", "lang", "topic"])
    x = x.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    cell = ["source", "lang", "topic", "block"]
    seen = F.row_number().over(Window.partitionBy(*cell).orderBy("n_tokens", F.xxhash64("doc_id"), "doc_id"))
    u = F.pmod(F.xxhash64(*cell), F.lit(1_000_003)) / 1_000_003.0
    drawn = F.floor(seen * F.col("rate") + u + 1e-9) - F.floor((seen - 1) * F.col("rate") + u + 1e-9)
    copies = F.when(F.col("n_tokens") > 0, F.least(drawn, F.col("cap").cast("bigint"))).otherwise(0).cast("int")
    return x.select("doc_id", "source", "lang", "topic", "n_tokens", copies.alias("copies"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and reached share of tokens, tokens, documents used and the most uses of one."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum((F.col("copies") > 0).cast("bigint")).alias("docs_used"), F.max("copies").alias("most_uses"), F.sum("n_tokens").alias("tokens_available"))
    total = got.agg(F.sum("tokens").alias("total"))
    out = targets.join(got, "source", "left").crossJoin(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens_available", F.lit(0)).alias("tokens_available"))
