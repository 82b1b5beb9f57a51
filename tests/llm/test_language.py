import numpy as np
import pytest

from timberline.llm import language as L

TEXTS = {
    "en": ["The rain kept on through the morning.", "I would like to try walking again with my sister.", "They said that nothing happened at the clinic."],
    "es": ["La lluvia no paró en toda la mañana.", "Me gustaría volver a caminar con mi hermana.", "Dijeron que no pasó nada en la clínica."],
    "fr": ["La pluie n'a pas cessé de la matinée.", "J'aimerais marcher à nouveau avec ma sœur.", "Ils ont dit que rien ne s'est passé à la clinique."],
    "de": ["Der Regen hörte den ganzen Morgen nicht auf.", "Ich möchte wieder mit meiner Schwester spazieren.", "Sie sagten, dass in der Klinik nichts geschah."],
    "pt": ["A chuva não parou a manhã inteira.", "Eu gostaria de voltar a caminhar com minha irmã.", "Disseram que não aconteceu nada na clínica."],
    "it": ["La pioggia non ha smesso per tutta la mattina.", "Vorrei tornare a camminare con mia sorella.", "Hanno detto che in clinica non è successo niente."],
    "nl": ["De regen hield de hele ochtend niet op.", "Ik zou graag weer met mijn zus gaan wandelen.", "Ze zeiden dat er in de kliniek niets gebeurde."],
    "ru": ["Дождь не прекращался всё утро.", "Хочу снова гулять с сестрой.", "Сказали, что в клинике ничего не случилось."],
}


@pytest.fixture(scope="module")
def model():
    texts = [" ".join(np.random.default_rng(i).permutation(v)) for v in TEXTS.values() for i in range(12)]
    labels = [k for k in TEXTS for _ in range(12)]
    labels[0] = "ru"  # a wrong label
    return L.train(texts, labels)


def test_codewords_are_far_apart():
    c = L.codewords()
    assert c.shape == (8, L.BITS) and min((c[a] != c[b]).sum() for a in range(8) for b in range(a)) >= 6


def test_sentences_and_segments(model):
    for k, v in TEXTS.items():
        (lang, sents, conf, vague), *rest = model.read([" ".join(v)])[0]
        assert L.LANGS[lang] == k and not rest and len(sents) == 3 and conf > 0.9 and not vague
    mixed = TEXTS["en"][0] + " " + TEXTS["de"][1] + "\n" + TEXTS["de"][2] + " " + TEXTS["en"][1] + " 🙂 ... <|end|>"
    assert [L.LANGS[r[0]] for r in model.read([mixed])[0]] == ["en", "de", "en"]
    for t in ("", "  ", "12:30", "🙂🙂", "...", "​", "<|endoftext|>"):
        assert model.read([t]) == [[]]
    assert len(model.read([TEXTS["fr"][0] + " " + TEXTS["fr"][1] * 3000])[0]) == 1


@pytest.mark.parametrize("label, want", [("en", "en"), ("EN", "en"), (" en", "en"), ("en-GB", "en"), ("fr_CA", "fr"), ("English", "en"), ("deu", "de"), ("русский", "ru"), (None, ""), ("", ""), ("und", ""), ("N/A", ""), ("xx", ""), ("-", ""), ("mul", ""), ("unknown", ""), ("sv", "sv")])
def test_labels(label, want):
    assert L.normalize_label(label) == want


def test_frame(spark, model):
    en, es = " ".join(TEXTS["en"]), " ".join(TEXTS["es"])
    rows = [(1, en, "EN", 0), (2, en, "fr", 0), (3, en, None, 0), (4, en + " " + es, "en", 0), (5, None, "en", 0), (6, "12:30", None, 0), (7, "", "en", 0), (3, en, None, 0), (8, es * 2000, "es-MX", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, seg_no int")
    got = L.identify(df, model=model)
    cases = sorted(map(tuple, L.label_cases(got).collect()))
    assert cases == sorted([(2, "wrong", 0, "en"), (3, "missing", 0, "en"), (3, "missing", 0, "en"), (4, "mixed", 0, "en"), (4, "mixed", 1, "es")])
    assert L.identify(df.where("false")).count() == 0


def test_held_out_agreement(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    m = L.fit(docs.where("doc_id % 2 = 0"))
    got = L.identify(docs.where("doc_id % 2 = 1"), model=m).where("n_segments = 1 and label <> ''").toPandas()
    assert (got["label"] == got["lang"]).mean() > 0.82  # about one label in eight is wrong


@pytest.fixture(scope="module")
def corpus():
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"])
    docs["k"] = [L.normalize_label(x) for x in docs["lang"]]
    docs = docs[docs["k"].isin(L.LANGS) & (docs["text"].str.len() > 20)].sort_values("doc_id")
    held, rest = docs[docs["doc_id"] % 10 == 0].head(300), docs[docs["doc_id"] % 10 != 0]
    return held, rest


def _fitted(rest, seed, noise, thin=None, true=None):
    rng = np.random.default_rng(seed)
    docs = rest.sample(frac=1, random_state=seed)
    if thin:
        docs = docs[~((true.reindex(docs.index) == thin) & (rng.random(len(docs)) > 0.12))]
    k = docs["k"].to_numpy().copy()
    flip = rng.random(len(k)) < noise
    k[flip] = rng.choice(L.LANGS, flip.sum())
    docs = docs.assign(k=k)
    docs = [docs.iloc[:1000], docs.iloc[1000:].groupby("k").head(200)]
    return L.train([t for d in docs for t in d["text"]], [x for d in docs for x in d["k"]], chars_per_language=15_000)


def _spoken(model, held):
    return [[L.LANGS[r[0]] for r in runs] for runs in model.read(list(held["text"]))]


@pytest.mark.parametrize("noise", [0.12, 0.3])
def test_fit_withstands_wrong_labels(corpus, noise):
    held, rest = corpus
    want = _spoken(_fitted(rest, 99, 0.0), held)
    for seed in range(10):
        assert np.mean([a != b for a, b in zip(want, _spoken(_fitted(rest, seed, noise), held))]) <= 0.01, seed


def test_fit_withstands_rare_languages(corpus):
    held, rest = corpus
    model = _fitted(rest, 99, 0.0)
    want = _spoken(model, held)
    true = rest["k"].where([len(runs) == 1 and runs[0] == k for runs, k in zip(_spoken(model, rest), rest["k"])], "")
    for lang in L.LANGS:
        assert np.mean([a != b for a, b in zip(want, _spoken(_fitted(rest, 5, 0.12, lang, true), held))]) <= 0.03, lang


def test_languages_without_a_text_are_never_chosen():
    model = L.train([" ".join(TEXTS[k]) for k in ("en", "de") for _ in range(6)], [k for k in ("en", "de") for _ in range(6)])
    assert {L.LANGS[r[0]] for v in TEXTS.values() for r in model.read([" ".join(v)])[0]} <= {"en", "de"}
    assert L.train([], []).read(["some text"])[0][0][1] == ["some text"]
