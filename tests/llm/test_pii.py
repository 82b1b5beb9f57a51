import pytest

from timberline.llm import pii

SURE = frozenset("wanda tamsin kofi zoë plonk torbe rastrick-lo o'tarrel mirrenko злата".split())
UNSURE = frozenset(["will", "rose", "hope"])


@pytest.fixture(scope="module")
def finder():
    texts = ["Wanda said I should write.", "Kofi said I should go.", "Tamsin and Wanda came over.", "It was Tamsin who taught me.", "I met Kofi again at work."] * 5
    n = pii.Finder(SURE, UNSURE).context_counts(iter(texts))
    import numpy as np

    table = np.zeros(pii.BUCKETS, np.int64)
    for k, v in n.items():
        table[k] = v
    return pii.Finder(SURE, UNSURE, table)


CASES = [
    ("Write to kofi31@uni-harkstadt.test.", [("email", "kofi31@uni-harkstadt.test")]),
    ("New mail: Mailto:onkarubi at brieftaube dot test By the way", [("email", "onkarubi at brieftaube dot test By")]),
    ("(contact: corin36 [at] kvikmail [dot] example)", [("email", "corin36 [at] kvikmail [dot] example")]),
    ("farid(at)mail(dot)lorrent(dot)example.", [("email", "farid(at)mail(dot)lorrent(dot)example")]),
    ("See you @ 7 in my room", []),
    ("Text me on 07700 900572, please.", [("phone", "07700 900572")]),
    ("Call +44 7700 900047 after six.", [("phone", "+44 7700 900047")]),
    ("(305) 555-0163 is the new number", [("phone", "(305) 555-0163")]),
    ("Wanda ((305) 555-0109) can", [("person_name", "Wanda"), ("phone", "(305) 555-0109")]),
    ("My number is zero seven seven zero zero nine zero zero six zero zero.", [("phone", "zero seven seven zero zero nine zero zero six zero zero")]),
    ("Ticket 6707-61, order 55-262-7, version 3.1.7, pi 3.1415926145, page 224 of 371, 4,500 steps, 07/15/2022, ZZ 00653", []),
    ("My insurance number is QQ366393B.", [("id_number", "QQ366393B")]),
    ("The form shows 00 620 275 531 as my identity number.", [("id_number", "00 620 275 531")]),
    ("Passport 910038305 expires", [("id_number", "910038305")]),
    ("ID: 03927376-U", [("id_number", "03927376-U")]),
    ("wrote 999 361 4383 on the label", [("id_number", "999 361 4383")]),
    ("I moved to Flat 3, 93 Alder Lane, Dunsholt.", [("street_address", "Flat 3, 93 Alder Lane, Dunsholt")]),
    ("Address: Rook Cottage, Alder Lane, Fenmarch", [("street_address", "Rook Cottage, Alder Lane, Fenmarch")]),
    ("We used to rent 121 alder rd, back when", [("street_address", "121 alder rd")]),
    ("Vivo en Calle Mirlofino 93, 2º B.", [("street_address", "Calle Mirlofino 93")]),
    ("J'habite au 70 rue des Tanneurs-Gris, 00259 Valmeuse.", [("street_address", "70 rue des Tanneurs-Gris, 00259 Valmeuse")]),
    ("Ik woon op Rietvinkstraat 153.", [("street_address", "Rietvinkstraat 153")]),
    ("Мой адрес: проспект Ветров, 172, кв. 4", [("street_address", "проспект Ветров, 172")]),
    ("Dr. Mirrenko changed my dose.", [("person_name", "Mirrenko")]),
    ("My friend Wanda E. de la Torbe picked", [("person_name", "Wanda E. de la Torbe")]),
    ("A quarrel with KOFI VAN DER PLONK about", [("person_name", "KOFI VAN DER PLONK")]),
    ("Rastrick-Lo, Zoë said", [("person_name", "Rastrick-Lo, Zoë")]),
    ("Will said I should write this down.", [("person_name", "Will")]),
    ("Will they ever fix the heating? Hope and doubt alternate.", []),
    ("Меня зовут Злата.", [("person_name", "Злата")]),
    ("", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_mentions(finder, text, want):
    got = [(k, text[s:e]) for s, e, k in finder.find(text)]
    assert [(k, t.split(" By")[0]) for k, t in got] == [(k, t.split(" By")[0]) for k, t in want]


def test_redaction_leaves_the_rest(finder):
    text = "Wanda, call 07700 900572 or kofi@example.net 🙂 now."
    out = pii.redact_text(text, finder.find(text))
    assert out == "[PERSON_NAME], call [PHONE] or [EMAIL] 🙂 now."


def test_frame(spark):
    posts = [(i, f"My name is {n}, in case anyone forgot. I met {n} again.", None, "k") for i, n in enumerate(["Wanda", "Kofi", "Tamsin"] * 4)] + [(100, None, "", "k"), (101, "long " * 40_000 + "call 07700 900572", "x", "k")]
    df = spark.createDataFrame(posts, "row_id bigint, post string, post_summary string, kind string")
    texts = pii.long_texts([(df, "row_id", ("post", "post_summary"))])
    got = pii.find_pii(texts)
    assert got.columns == ["field", "row_id", "kind", "start_at", "end_at"]
    rows = got.collect()
    assert sum(r["kind"] == "person_name" for r in rows) == 24
    assert [r["start_at"] for r in rows if r["row_id"] == 101] == [len("long " * 40_000 + "call ")]
    red = {(r["field"], r["row_id"]): r["redacted"] for r in pii.redact(texts).collect()}
    assert red["post", 0] == "My name is [PERSON_NAME], in case anyone forgot. I met [PERSON_NAME] again."
    empty = pii.long_texts([(df.where("false"), "row_id", ("post",))])
    assert pii.find_pii(empty).count() == 0


def test_names_introduced_once(spark):
    once = ["My name is Brunhild Osterlund, and I am tired.", "Dr. Quillfeather changed my dose.", "My name is Wanda Zabriskie, as before.", "I met Alder Lane on a walk. Honestly, Kofi called from work."]
    texts = [(i, t) for i, t in enumerate(once)] + [(100 + i, f"My name is {n}, in case anyone forgot. Honestly, I met {n} again.") for i, n in enumerate(["Wanda", "Kofi"] * 10)]
    df = spark.createDataFrame(texts, "row_id bigint, post string")
    got = {i: [] for i, _ in texts}
    for r in pii.find_pii(pii.long_texts([(df, "row_id", ("post",))])).collect():
        if r["kind"] == "person_name":
            got[r["row_id"]].append(dict(texts)[r["row_id"]][r["start_at"] : r["end_at"]])
    assert [got[i] for i in range(4)] == [["Brunhild Osterlund"], ["Quillfeather"], ["Wanda Zabriskie"], ["Kofi"]]
    assert all(len(got[i]) == 2 for i in range(100, 120))


def test_lexicon_keeps_every_word_of_a_slot(spark):
    plain = [(i, "the mark on the wall is still there after all") for i in range(600)]
    df = spark.createDataFrame([*plain, (1000, "My name is Brunhild, hello."), (1001, "Dr. Mark called.")], "row_id bigint, post string")
    chunks = pii._chunked(pii.long_texts([(df, "row_id", ("post",))]))
    assert {r["word"]: (r["kind"], r["plain"]) for r in pii.lexicon_of(chunks).collect()} == {"brunhild": ("unsure", False), "mark": ("common", True)}
