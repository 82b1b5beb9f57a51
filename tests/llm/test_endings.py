import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import dictionaries, endings, pairs, truncation

PARTS = [("The writer", "Hope", "Anger at my sister", "A sense of calm", "Guilt about the move"), ("describes the evening", "returns in the garden", "is hinted at but not named", "outweighs the worry about the exam", "appears while drawing"), (" with some detail", ", as in earlier posts", " although sleep is poor", "", ", if only briefly")]


def texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choice(PARTS[0]) + " " + rng.choice(PARTS[1]) + rng.choice(PARTS[2]) + "." for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    e, g = np.zeros((endings.TABLES, endings.SIZE), np.int64), np.zeros((endings.TABLES, endings.SIZE), np.int64)
    endings.count([endings.clean(t) for t in texts(800)], e, g)
    return endings.Endings(e, g)


def score(model, text):
    c, kind = endings.final_context(endings.clean(text))
    return kind, float(model.log_odds([c])[0])


def test_cut_and_whole(model):
    rng = random.Random(3)
    whole = texts(200, 9)
    assert np.mean([score(model, t.rstrip("."))[1] < 0 for t in whole]) > 0.97
    cut = []
    for t in whole:
        at = rng.randint(12, len(t) - 4)
        while t[at - 1] in ". ," or t[at] in " .,":  # inside a word
            at -= 1
        cut.append(t[:at])
    assert np.mean([score(model, t)[1] > 0 for t in cut]) > 0.95


def test_final_marks():
    assert endings.final_context("It ends here.")[1] == "end"
    assert endings.final_context('It ends here."')[1] == "end"
    assert endings.final_context("It ends here. 🙂")[1] == "end"
    assert endings.final_context("It ends here. (7/10)")[1] == "end"
    assert endings.final_context("it goes and so on...")[1] == "end"
    assert endings.final_context("it is cut he...") == ("it is cut he", "dots")
    assert endings.final_context("in two �")[1] == "broken"
    assert endings.final_context("no stop")[1] == "open"


def test_find_cuts(spark):
    base = texts(1500, 4)
    rows = [(i, ("lim", "free", None)[i % 3], t[:60] if i % 3 == 0 else t) for i, t in enumerate(base)] + [(9001, "lim", None), (9002, "lim", " "), (9003, "free", "x" * 30_000 + "."), (9004, "free", base[0])]
    df = spark.createDataFrame(rows, "row_id bigint, source string, v string").withColumn("score", F.lit(0))
    got = truncation.find_cuts([(df, "row_id", "source", "v")]).toPandas().set_index("row_id")
    assert 9001 not in got.index and 9002 not in got.index and not got.loc[9004, "is_cut"]
    truth = {i: i % 3 == 0 and len(t) > 60 for i, t in enumerate(base)}
    assert np.mean([bool(got.loc[i, "is_cut"]) == truth[i] for i in truth]) > 0.93  # some are cut where a sentence could end
    rates = {r["source"]: r for r in truncation.cut_rates([(df, "row_id", "source", "v")]).collect()}
    assert rates["lim"]["usual_cut_length"] == 60 and rates["free"]["cut_share"] < 0.02
    assert truncation.find_cuts([(df.where("false"), "row_id", "source", "v")]).count() == 0


def test_wrappers_and_empty():
    assert pairs.open_wrapper('{"summary": "x y"}') == ("x y", False)
    assert pairs.open_wrapper('{"summary": "x "y" z"}') == ('x "y" z', False)
    assert pairs.open_wrapper('{"summary": "x y')[1]
    assert pairs.open_wrapper("Summary:\n\nPost: x") == ("x", False)
    for e in ("", " ", "...", "-", "<br>", "N/A", "null", "[no output]", '""', '{"summary": ""}', "Summary:", "​"):
        assert pairs.is_empty(pairs.open_wrapper(e)[0])
    assert not pairs.is_empty("No")


@pytest.mark.parametrize("text, want", [
    ("I'm sorry, but I can't help with summarizing this content.", True), ("As a language model, I am not able to assess a person.", True), ("I’d rather not write up such entries.", True), ("Lo siento, pero no puedo ayudar con este contenido.", True), ("Désolé, mais je ne peux pas traiter ce contenu.", True), ("Ich kann diesen Text nicht zusammenfassen.", True), ("Извините, но я не могу помочь с этим текстом.", True),
    ('"I can\'t do this" is how the writer sums up the post.', False), ("They say they cannot help my cousin right now and feel sorry about it.", False), ("The writer is sorry to be unable to join me and declines politely.", False),
])
def test_refusals(text, want):
    assert dictionaries.is_refusal(text) == want


def test_flag_pairs(spark):
    de = ["Die Person zieht sich zurück und verbringt den Morgen allein, weil sie sehr müde ist.", "Der Kontakt mit der Mutter scheint ihr in dieser Woche zu helfen und das ist gut."]
    posts = [f"I walked to work on day {i} and then I sat by the canal with my old friend. The cat slept all day in the house." for i in range(40)]
    ok = texts(40, 5)
    p = spark.createDataFrame([(i, f"P{i}", posts[i], 1) for i in range(40)] + [(100, "P0", "later text", 1), (101, "P38", "", 1)], "row_id bigint, post_id string, post string, defect int")
    answers = {0: ("copied", posts[0]), 1: ("copied", "Summary: " + posts[1].upper()), 2: ("empty", None), 3: ("empty", "N/A"), 4: ("refusal", "I cannot provide a summary of this post."), 5: ("other_language", de[0]), 6: ("other_language", de[1]), 7: ("truncated", ok[7] + " The writer describes the evening with some de"), 8: (None, f'"{posts[8][:30]}". ' + ok[8]), 9: (None, ok[9].rstrip("."))}
    r = spark.createDataFrame([(i, f"P{i}", answers.get(i, (None, ok[i]))[1], ok[i] if i % 2 else None, "T" if i % 2 else None, ok[i]) for i in range(40)] + [(500, "missing", ok[3], None, None, None)], "result_id bigint, post_id string, zero_shot_summary string, one_shot_summary string, retrieved_timeline string, gold_summary string")
    filler = spark.createDataFrame([(1000 + i, "none", t, None, None, t) for i, t in enumerate(texts(400, 6) + de * 30)], r.schema)
    out = {(x["result_id"], x["shot"]): x["defect"] for x in pairs.flag_pairs(r.unionByName(filler), p).where("result_id < 1000").collect()}
    assert len(out) == 41 + 20
    for i, (want, _) in answers.items():
        assert out[i, "zero_shot"] == want, (i, want, out[i, "zero_shot"])
    assert all(v is None for k, v in out.items() if k[1] == "one_shot") and out[500, "zero_shot"] is None
    assert pairs.flag_pairs(r.where("false"), p).count() == 0


def test_every_context_has_its_own_count(spark):
    """More contexts than the hashed tables have places: scores as from plain counts."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzабвгдежз"
    corpus = ["".join(rng.choices(letters, k=rng.randint(150, 250))) + "." for _ in range(6000)]
    answers = [t.rstrip(".") for t in corpus[:20]] + [t[:120] for t in corpus[20:40]] + ["".join(rng.choices(letters, k=100)) for _ in range(20)]
    rows = [(i, f"P{i}", t, None, None, None) for i, t in enumerate(answers)] + [(1000 + i, "none", None, None, None, t) for i, t in enumerate(corpus)]
    r = spark.createDataFrame(rows, "result_id bigint, post_id string, zero_shot_summary string, one_shot_summary string, retrieved_timeline string, gold_summary string")
    p = spark.createDataFrame([], "row_id bigint, post_id string, post string")
    got = {x["result_id"]: x["log_odds"] for x in pairs.flag_pairs(r, p).where("result_id < 1000").collect()}
    want_of = {t[-k:] for t in answers for k in endings.LENGTHS}
    n, ends = dict.fromkeys(want_of, 0), dict.fromkeys(want_of, 0)
    base = [0, 0]
    for t in answers + corpus:
        for at in range(len(t)):
            base[0] += at >= 3
            base[1] += at >= 3 and t[at] == "."
            for k in endings.LENGTHS:
                if at >= k and (c := t[at - k : at]) in n:
                    n[c] += 1
                    ends[c] += t[at] == "."
    for i, t in enumerate(answers):
        q = base[1] / base[0]
        for k in endings.LENGTHS:
            q = (ends[t[-k:]] + 1.5 * q) / (n[t[-k:]] + 1.5)
        assert got[i] == pytest.approx(np.log(base[1] / base[0]) - np.log(q), abs=1e-6), i


def test_long_limits_are_told_from_other_long_texts(spark):
    whole = texts(400, 21)
    filler = " ".join(texts(600, 22))
    longer = [filler[: filler.rindex(".", 0, 16_500 + 37 * i) + 1] for i in range(40)]
    cut = [("ab" * i + filler)[:20_000].rstrip(". ").ljust(20_000, "h") for i in range(40)]
    stop = filler[:19_999].rstrip(".") + "."
    stop = stop.rjust(20_000, "x")
    rows = [(i, "lim", t) for i, t in enumerate(whole + longer + cut + [stop])]
    df = spark.createDataFrame(rows, "row_id bigint, source string, v string")
    got = {r["row_id"]: r for r in truncation.find_cuts([(df, "row_id", "source", "v")]).collect()}
    odds = [got[i]["log_odds"] for i in range(len(rows))]
    assert got[480]["n_chars"] == 20_000 and got[440]["n_chars"] == 20_000
    assert max(odds[400:440]) < max(odds[:400]) + 1.0 and odds[480] > max(odds[400:440]) + 3.0
    assert len(got) == len(rows)


def test_copies_whose_words_are_cut_differently():
    post = "I walked to work on Tuesday and then I sat by the canal with my old friend Jonathan. The cat slept all day in the house, and nobody remembered the appointment with the dentist until the evening came around again."
    split = " ".join(w[: len(w) // 2] + "​" + w[len(w) // 2 :] if len(w) > 3 else w for w in post.split())
    glued = "".join(w + " " * (i % 3 == 2) for i, w in enumerate(post.split()))
    copies = pairs.Copies()
    assert copies.share(post, split) >= pairs.COPIED
    assert copies.share(post, glued) > 0.5
    assert copies.share(post, "The writer describes quiet hours at home, relief about a visit, and some lingering worry over tasks left undone.") < 0.3
    assert copies.share("", split) == 0.0
