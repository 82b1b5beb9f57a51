import numpy as np
import pytest

from timberline.llm import mixing


def test_rake_keeps_sources_exact_and_caps():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 5000, (4, 3, 5)).astype(float)
    share, caps = np.array([0.4, 0.3, 0.2, 0.1]), np.array([1.0, 2.0, 3.0, 1.0])
    w = mixing.rake(sizes, share, caps)
    assert np.allclose(w.sum((1, 2)) / w.sum(), share, atol=1e-6)
    assert (w <= sizes * caps[:, None, None] + 1e-6).all()
    assert np.isclose((w.sum((1, 2)) / (sizes.sum((1, 2)) * caps)).max(), 1)  # as large as the caps allow
    assert mixing.rake(sizes, np.zeros(4), caps).sum() == 0


def test_mix(spark, medium):
    docs, targets = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/mix_targets.parquet")
    mixed = mixing.mix(docs.withColumn("n_tokens", docs["n_chars"]), targets)
    rep = mixing.mix_report(mixed, targets).collect()
    assert len(rep) == 7 and np.isclose(sum(r["reached_share"] for r in rep), 1, atol=1e-4)
    for r in rep:
        assert r["most_uses"] <= r["max_repeats"] and abs(r["reached_share"] - r["target_share"]) < 0.02
    assert mixed.where("copies > 0 and n_tokens = 0").count() == 0
    assert mixing.mix(docs.where("false"), targets).count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "some words here", "a", None), (2, None, "a", "en"), (3, "", "a", "en"), (4, "other words", None, "en"), (5, "other words", "zz", "en"), (1, "some words here", "a", None), (6, "b words", "b", "en")], "doc_id bigint, text string, source string, lang string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, None), ("c", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 6} and all(r["copies"] == 0 for r in got if r["doc_id"] in (2, 3))


def test_topics_are_what_documents_share():
    rng = np.random.default_rng(2)
    of = {"tea": "kettle teapot leaves saucer steep infusion".split(), "rail": "station railway platform carriage signal conductor".split(), "sea": "harbour anchor lighthouse breaker current trawler".split()}
    named = [(k, " ".join(rng.choice(v, 12)) + " today somewhere") for k, v in of.items() for _ in range(60)]
    t = mixing.Topics([x for _, x in named], ["en"] * len(named), k=3)
    got = [t.of(x, "en") for _, x in named]
    assert sum(max(got[i : i + 60].count(g) for g in set(got)) for i in (0, 60, 120)) >= 0.95 * 180 and len(set(got)) == 3
    assert t.of("", "en") == "none" and t.of("kettle", "fr") == "none" and mixing.Topics([], []).of("kettle", "en") == "none"


def test_language_is_read_not_taken_from_the_label(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("source is not null")
    read = mixing.read_documents(docs, "doc_id", "text", "source", "lang", 200)
    rows = read.join(docs.select("doc_id", docs["lang"].alias("label")), "doc_id").toPandas()
    assert len(rows) == docs.count() and set(rows["lang"]) <= {*mixing.language.LANGS, "none"}
    assert (rows["lang"] == rows["label"]).mean() > 0.6 and (rows[rows["lang"] == "none"]["topic"] == "none").all()
    assert rows[rows["lang"] == "en"]["topic"].nunique() > 1


def test_languages_and_topics_are_fitted_on_every_document(spark, monkeypatch):
    rng = np.random.default_rng(4)
    en = [("en", " ".join(rng.choice([f"{a}{b}" for a in ("walk", "read", "cook", "plant", "paint") for b in ("ing", "ers", "able")], 9)) + f" {'the' if i % 2 else 'and'} with this") for i in range(1500)]
    nl = [("nl", " ".join(rng.choice("vandaag gisteren wandelen lezen koken buurman fietsen avond".split(), 9)) + " het een niet") for _ in range(700)]
    rows = [(i, t, "a", k) for i, (k, t) in enumerate(en + nl)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(3)
    monkeypatch.setattr(mixing.language, "fit", lambda *a, **k: pytest.fail("fitted on a sample"))
    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or real(self, x))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(docs, targets).count() == 2200
    (topics,) = (x for x in sent if isinstance(x, mixing.Topics))
    (model,) = (x for x in sent if isinstance(x, mixing.language.Model))
    for lang, of in (("en", en), ("nl", nl)):
        words = [mixing._words(t) for _, t in of]
        n = np.bincount(np.concatenate(words), minlength=mixing.WORDS)
        idf = np.where(n > 0, np.log((1 + len(of)) / (1 + n)), 0.0)
        assert np.allclose(topics.idf[lang], idf) and len(topics.cent[lang]) == mixing.TOPICS
        idx, _ = mixing.language.features([t for _, t in of])
        grams = np.bincount(idx, minlength=mixing.language.SPACE)
        assert np.allclose(model.table[:, mixing.language.LANGS.index(lang)], mixing.language.log_chances(grams[:, None])[:, 0])


def test_topics_do_not_hang_on_partitions(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("text is not null and lang in ('en', 'es')").select("doc_id", "lang", "text").toPandas()
    rows = spark.createDataFrame([(int(i) * 7919, k, [int(w) for w in mixing._words(t)]) for i, k, t in docs.itertuples(index=False)], "h bigint, lang string, words array<int>").where("size(words) > 0")
    one, other = mixing.Topics.of_all(rows.repartition(1)), mixing.Topics.of_all(rows.repartition(5, "h"))
    assert all(np.array_equal(one.cent[k], other.cent[k]) and np.array_equal(one.idf[k], other.idf[k]) for k in ("en", "es"))


def test_wrong_labels_are_not_counted(spark):
    of = {"en": "the morning walk with this friend and the dog was good", "nl": "vandaag het wandelen met een buurman en niet zonder hond"}
    rows = [(i, of[k if i % 5 else ("nl" if k == "en" else "en")] + f" {i}", k) for i, k in ((i, ("en", "nl")[i % 2]) for i in range(400))]
    model = mixing.language.count(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    clean = np.stack([np.bincount(mixing.language.features([t for i, t, k in rows if k == lang and i % 5])[0], minlength=mixing.language.SPACE) for lang in ("en", "nl")], 1)
    assert np.allclose(model.table[:, [mixing.language.LANGS.index(k) for k in ("en", "nl")]], mixing.language.log_chances(clean))
    assert mixing.main_language(model, list(of.values()) + ["", "12"]) == ["en", "nl", "none", "none"]
