import os
import random

import numpy as np
import pytest

from readloom.llm import leaks, mixing, reading
from readloom.llm.text import words_of

DOCS = "doc_id bigint, url string, host string, source string, lang string, http_status int, text string, tokens int, w double, level int, term string, place int"
ITEMS = "item_id bigint, suite string, passage string, term string, n int"


def docs(spark, rows):
    """rows: dicts of doc_id, text and other columns."""
    return spark.createDataFrame([(r.get("doc_id"), r.get("url"), "h", r.get("source"), r.get("lang"), r.get("status", 200), r.get("text"), 1, 1.0, 1, "t", 2) for r in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, "s", p, "t", 1) for i, p in rows], ITEMS)


def test_words():
    assert words_of("It's <b>B-2</b>&amp;x &#8203;; co­op ze​ro") == ["it", "s", "b", "2", "x", "coop", "zero"]
    assert words_of("divi-\nded, divi-  \r\n  ded soft­\nened well- known\nend-") == ["divided", "divided", "softened", "well", "known", "end"]
    assert words_of("a < b and c > d & e") == ["a", "b", "and", "c", "d", "e"]
    assert words_of(None) == [] and words_of("") == [] and words_of("ÉCOLE Straße") == ["école", "straße"]


PASSAGE = " ".join(f"word{i % 17}x{i}" for i in range(40))


def brute_leaks(d, its, run=13):
    out = set()
    for r in d:
        w = words_of(r.get("text"))
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for i, p in its:
            q = words_of(p)
            if i is not None and r["doc_id"] is not None and any(tuple(q[k : k + run]) in grams for k in range(len(q) - run + 1)):
                out.add((r["doc_id"], i))
    return out


@pytest.mark.parametrize("block", [20_000, 2])
def test_leaks_against_brute_force(spark, block):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(30)] + ["the", "of"]
    its = [(1, PASSAGE), (2, PASSAGE.upper()), (3, "too short"), (4, None), (5, ""), (None, PASSAGE), (6, " ".join(rng.choice(vocabulary) for _ in range(60))), (7, "the " * 30)]
    w, v = PASSAGE.split(), its[6][1].split()
    texts = [None, "", PASSAGE, "x " + " ".join(w[5:18]) + " y", " ".join(w[5:17]) + " y", " ".join(w[:12]) + " gap " + " ".join(w[12:24]), "<p>".join(w[3:20]).upper(), " ".join(w[::-1])]
    texts += [" ".join(w[:6]) + " wo-\nrd" + w[6][4:] if w[6].startswith("word") else "", "the " * 12, "the " * 13, "the of " * 5000, " ".join(v[20:33]), " ".join(v[20:32]), PASSAGE + " " + its[6][1], " ".join(w[:13]) + " filler" * 100_000]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(300)) + " " + " ".join(v[k : k + n]) for k, n in ((0, 13), (10, 12), (47, 13), (30, 20))]
    d = [{"doc_id": i, "text": t} for i, t in enumerate(texts)] + [{"doc_id": None, "text": PASSAGE}, {"doc_id": 2, "text": PASSAGE}]
    found = leaks.phrase_matches(docs(spark, d), items(spark, its + its[:1]), block=block)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == brute_leaks(d, its)
    pairs = [tuple(r) for r in leaks.p7_found(docs(spark, d), items(spark, its)).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == got


@pytest.mark.parametrize("words,texts", [(1, 1), (50, 3), (1 << 19, 2)])
def test_one_index_answers_several_query_sets(spark, tmp_path, words, texts):
    rng = random.Random(5)
    w = [f"v{i}" for i in range(12)]
    its = [(k, " ".join(rng.choice(w) for _ in range(30))) for k in range(6)]
    d = [{"doc_id": 7 * k, "text": " ".join(rng.choice(w) for _ in range(20)) + " " + " ".join(its[k % 6][1].split()[k % 9 : k % 9 + 10 + k % 7]) + " end"} for k in range(40)]
    leaks.build_index(docs(spark, d[:25]), words, texts).write.parquet(f"{tmp_path}/index")
    leaks.build_index(docs(spark, d[25:]), words, texts).write.mode("append").parquet(f"{tmp_path}/index")
    index = leaks.read_index(spark, f"{tmp_path}/index")
    for some in (its[:2], its[2:], its):
        got = [(r.doc_id, r.item_id, r.place, r.item_place, r.length) for r in leaks.find_phrases(index, items(spark, some)).collect()]
        assert {g[:2] for g in got} == brute_leaks(d, some)
        text, passage = {r["doc_id"]: words_of(r["text"]) for r in d}, {i: words_of(p) for i, p in some}
        for doc, item, place, at, n in got:
            assert text[doc][place : place + n] == passage[item][at : at + n] and n >= 13
            assert at == 0 or place == 0 or text[doc][place - 1] != passage[item][at - 1]
        near = {(r.doc_id, r.item_id): r.share for r in leaks.find_near(index, items(spark, some)).collect()}
        assert near == brute_shares(d, some)


def test_every_word_of_every_text_is_indexed(spark):
    d = [{"doc_id": 1, "text": "b a b"}, {"doc_id": 2, "text": None}, {"doc_id": 3, "text": "a <p>"}, {"doc_id": 4, "text": "<p>"}]
    found = {}
    for row in leaks.build_index(docs(spark, d)).collect():
        seg = leaks.Segment(row.asDict(), {"a", "b"})
        for t in ("a", "b"):
            for x in seg.postings(t).tolist():
                found.setdefault(t, set()).add((int(seg.docs[x >> 34]), x & (1 << 34) - 1))
    assert found == {"a": {(1, 1), (3, 0)}, "b": {(1, 0), (1, 2)}}


def test_leaks_empty(spark):
    none_d, none_i = docs(spark, []), items(spark, [])
    assert leaks.p7_found(none_d, items(spark, [(1, PASSAGE)])).collect() == []
    assert leaks.p7_found(docs(spark, [{"doc_id": 1, "text": PASSAGE}]), none_i).collect() == []


def test_proximity(spark):
    w = PASSAGE.split()
    shuffled = w[:13] + sorted(w[13:], reverse=True)
    d = [{"doc_id": 1, "text": " ".join(shuffled)}, {"doc_id": 2, "text": " ".join(w[:13])}, {"doc_id": 3, "text": "none"}]
    got = {(r.doc_id, r.item_id): r.share for r in leaks.proximity_matches(docs(spark, d), items(spark, [(9, PASSAGE)])).collect()}
    assert set(got) == {(1, 9)}


def brute_shares(d, its, share=0.8):
    out = {}
    for r in d:
        w = words_of(r["text"])
        for i, p in its:
            q = words_of(p)
            n = max((len(set(q) & set(w[k : k + len(q)])) for k in range(max(1, len(w) - len(q) + 1))), default=0)
            if n / len(set(q)) >= share:
                out[r["doc_id"], i] = max(out.get((r["doc_id"], i), 0), n / len(set(q)))
    return out


def test_proximity_wherever_a_stretch_begins(spark):
    rng = random.Random(2)
    w = PASSAGE.split()
    its = [(9, PASSAGE), (10, " ".join(f"t{i % 7} u{i}" for i in range(15)))]
    d = [{"doc_id": k, "text": " ".join([f"f{i}" for i in range(k)] + w)} for k in range(0, 45, 5)]
    d += [{"doc_id": 100 + k, "text": " ".join(w[:13] + ["gap"] * k + rng.sample(w[13:], 27))} for k in range(12)]
    d += [{"doc_id": 200 + k, "text": " ".join(["x"] * k + (its[1][1] + " ").split() + w[:20])} for k in range(9)] + [{"doc_id": 5, "text": "x"}, {"doc_id": 5, "text": PASSAGE}]
    got = [tuple(r) for r in leaks.proximity_matches(docs(spark, d), items(spark, its)).collect()]
    want = brute_shares(d, its)
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want and want[10, 9] == 1


def test_proximity_without_a_whole_window(spark):
    w = PASSAGE.split()
    other = PASSAGE.replace("word", "rare")
    its = [(9, PASSAGE), (10, other), (11, "a b c")]
    replaced = [x if i % 12 < 11 else f"new{i}" for i, x in enumerate(w)]
    d = [{"doc_id": 1, "text": " ".join(replaced)}, {"doc_id": 2, "text": " ".join(w[:32])}, {"doc_id": 3, "text": " ".join(w[:31])}, {"doc_id": 4, "text": " ".join(w[8:])}]
    d += [{"doc_id": 10 + k, "text": " ".join(w[k::5])} for k in range(5)] + [{"doc_id": 20, "text": " ".join(x for i, x in enumerate(w) if i % 5)}]
    got = {(r.doc_id, r.item_id): r.share for r in leaks.proximity_matches(docs(spark, d), items(spark, its)).collect()}
    assert got == brute_shares(d, its[:2]) == {(1, 9): 0.925, (2, 9): 0.8, (4, 9): 0.8, (20, 9): 0.8}
    assert leaks.proximity_matches(docs(spark, []), items(spark, its)).collect() == [] == leaks.proximity_matches(docs(spark, d), items(spark, [])).collect()


# ---------------------------------------------------------------- mixing

TOKENIZER = mixing.TOKENIZER
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
TARGETS = "source string, target_share double, max_repeats int, share double, cap int"


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0.0, 1) for r in rows], TARGETS)


def corpus(n=3000):
    rng = random.Random(6)
    out = []
    for i in range(n):
        s = rng.choices(["big", "mid", "tiny", "other", None], [60, 30, 2, 5, 3])[0]
        out.append({"doc_id": i, "source": rng.choice([s, s and s.upper() + " "]), "lang": rng.choice(["en", "EN", "de-DE", None, "??"]), "url": f"http://h/{rng.choice(['news', 'shop', 'help'])}/x", "text": "some words here " * rng.randint(1, 60), "status": 404 if rng.random() < 0.02 else 200})
    return out


@needs_tokenizer
def test_mix(spark):
    d = corpus()
    goal = [("Big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 1)]
    rows = mixing.mix(docs(spark, d + d[:50]), targets(spark, goal)).collect()
    by = {r["doc_id"]: r for r in d}
    assert len({r.doc_id for r in rows}) == len(rows)
    cap = {"big": 1, "mid": 2, "tiny": 4}
    assert all(1 <= r.copies <= cap[r.source] and by[r.doc_id]["status"] == 200 and by[r.doc_id]["source"].strip().lower() == r.source for r in rows)
    total = sum(r.tokens * r.copies for r in rows)
    share = {s: sum(r.tokens * r.copies for r in rows if r.source == s) / total for s in cap}
    for s, want in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):  # the absent source's share goes to the others
        assert abs(share[s] - want) < 0.003
        assert all(abs(r.reached_share - share[s]) < 1e-9 for r in rows if r.source == s)
    assert sum(r.copies for r in rows if r.source == "tiny") == 4 * sum(1 for r in d if (r["source"] or "").strip().lower() == "tiny" and r["status"] == 200)  # the scarcest source is used up
    again = mixing.mix(docs(spark, d[::-1]).repartition(7), targets(spark, goal)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    rep = {r.source: r for r in mixing.report(docs(spark, d), targets(spark, goal)).collect()}
    assert rep["absent"].n_documents == 0 and abs(rep["mid"].reached_share - share["mid"]) < 1e-9 and rep["tiny"].most_copies == 4


@needs_tokenizer
def test_mix_edge_cases(spark):
    goal = [("a", 0.5, 1), ("b", 0.5, 1)]
    assert mixing.mix(docs(spark, []), targets(spark, goal)).collect() == []
    odd = [{"doc_id": 1, "source": "a", "text": None}, {"doc_id": 2, "source": "a", "text": " "}, {"doc_id": 3, "source": None, "text": "x"}, {"doc_id": None, "source": "a", "text": "x"}]
    assert mixing.mix(docs(spark, odd), targets(spark, goal)).collect() == []
    assert mixing.mix(docs(spark, [{"doc_id": 1, "source": "a", "text": "x"}]), targets(spark, [])).collect() == []
    long = [{"doc_id": 1, "source": "a", "text": "word " * 200_000}, {"doc_id": 2, "source": "b", "text": "word " * 200_000}]
    assert [(r.doc_id, r.copies, r.reached_share) for r in mixing.mix(docs(spark, long), targets(spark, goal)).orderBy("doc_id").collect()] == [(1, 1, 0.5), (2, 1, 0.5)]


def test_rake():
    mass = np.array([10.0, 30.0, 20.0, 40.0])
    source, lang = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    w = mixing.rake(mass, source, [(lang, np.array([0.5, 0.5]))], np.array([20.0, 30.0]), np.array([2.0, 2.0]))
    t = w * mass
    assert np.allclose([t[:2].sum(), t[2:].sum()], [20, 30]) and (w <= 2 + 1e-9).all()
    assert abs(t[[0, 2]].sum() - 25) < 0.5
    w = mixing.rake(mass, source, [(lang, np.array([0.9, 0.1]))], np.array([40.0, 60.0]), np.array([1.0, 1.0]))
    assert np.allclose(w, 1)  # everything is needed, so nothing can be tilted


# ---------------------------------------------------------------- reading levels

LABELS = "doc_id bigint, reading_level int, annotator string, text string, level int"


def level_text(rng, level, sentences=20):
    words = {k: [f"{c}{x}" for x in ("alba", "ero", "inda", "ommo", "ulte", "yana")] for k, c in zip(range(1, 6), ("ba", "ce", "di", "fo", "gu"))}
    out = []
    for _ in range(sentences):
        pick = [rng.choice(words[level if rng.random() < 0.5 else rng.randint(1, level)]) for _ in range(8)]
        out.append("The " + " and the ".join(pick) + ".")
    return "\n".join(out)


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(8)
    truth = {i: 1 + i % 5 for i in range(400)}
    d = [{"doc_id": i, "text": f"Home | News\nLogin\n{level_text(rng, lv)}\nCopyright 2020"} for i, lv in truth.items()]
    labels = [(i, lv, "a1", "x", 0) for i, lv in truth.items() if i < 200]
    labels += [(i, max(1, min(5, truth[i] + rng.choice([-1, 0, 1]))), "sloppy", "x", 0) for i in range(0, 200, 5)]
    labels += [(1, None, "a1", "x", 0), (None, 3, "a1", "x", 0), (10_000, 3, None, "x", 0)]
    return d, labels, truth


def test_levels_on_held_out_documents(spark, graded):
    d, labels, truth = graded
    extra = [{"doc_id": 1001, "text": None}, {"doc_id": 1002, "text": ""}, {"doc_id": 1003, "text": "Home\nLogin\nNews"}, {"doc_id": 1004, "text": "Das ist ein ganz anderer Text, den keiner kennt. " * 30}, {"doc_id": 1005, "text": "Page not found. Please try again later, thanks."}, {"doc_id": 1006, "text": level_text(random.Random(1), 5, 3000)}, {"doc_id": None, "text": "x"}]
    got = {r.doc_id: r for r in reading.reading_levels(docs(spark, d + extra + d[:10]), spark.createDataFrame(labels, LABELS)).collect()}
    assert set(got) == set(truth) | set(range(1001, 1007))
    held = [i for i in truth if i >= 200]
    right = sum(got[i].reading_level == truth[i] for i in held) / len(held)
    hard = sum((got[i].reading_level >= 4) == (truth[i] >= 4) for i in held) / len(held)
    assert right > 0.85 and hard > 0.95
    assert all(got[i].reading_level is None for i in range(1001, 1006)) and got[1006].reading_level == 5
    found = {r.doc_id for r in reading.p9_found(docs(spark, d + extra), spark.createDataFrame(labels, LABELS)).collect()}
    assert found == {i for i, r in got.items() if (r.reading_level or 0) >= 4}


def test_levels_without_labels(spark, graded):
    d, _, _ = graded
    none = spark.createDataFrame([], LABELS)
    assert all(r.reading_level is None for r in reading.reading_levels(docs(spark, d[:5]), none).collect())
    assert reading.p9_found(docs(spark, []), none).collect() == []
    assert reading.p9_found(docs(spark, d[:5]), spark.createDataFrame([(0, 3, "a", "x", 0)], LABELS)).collect() in ([], [])


def test_words_of_cut_paragraphs():
    whole = "This line is whole.\n"
    assert reading.main_words(whole + "One sentence stands here. Another one follows. The third was cu") == "this line is whole one sentence stands here another one follows".split()
    for quote in ("\u00e2\u20ac\x9d", "\u00e2\x80\x9d", "\ufffd"):
        assert reading.main_words(whole + "It was late. They left the house." + quote) == "this line is whole it was late they left the house".split()
    long = " ".join(["word"] * 20) + "."
    assert reading.main_words(whole + long + " Answer 4") == "this line is whole".split() + ["word"] * 20
    assert reading.main_words(whole + "This site uses cookies to measure visits. Got it\nHome | News\nPage 1.5 of our little site") == "this line is whole".split()


def test_word_grades():
    g = reading.word_grades({"easy": np.array([10.0, 10, 10, 10, 10]), "hard": np.array([0.0, 0, 0, 10, 10]), "top": np.array([0.0, 0, 0, 0, 10])})
    assert g["easy"] < 2 < 3 < g["hard"] < g["top"]
    assert reading.word_grades({}) == {}
    w = reading.annotator_weights([(1, 3, "a"), (1, 3, "b"), (1, 5, "c"), (2, 2, "a"), (2, 2, "b"), (2, 1, "c")])
    assert w["a"] > w["c"]
