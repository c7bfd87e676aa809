import random
from collections import defaultdict

import numpy as np

from pagelake.llm import suffix_dedup as S

DOCS = "doc_id long, text string, n_chars long"


def brute(texts):
    """Words that stand in a window of MIN_WORDS words which stands earlier too."""
    seen, out = {}, defaultdict(set)
    for d in sorted(texts):
        w = (texts[d] or "").split()
        for i in range(len(w) - S.MIN_WORDS + 1):
            k = tuple(w[i : i + S.MIN_WORDS])
            if k in seen:
                out[d].update(range(i, i + S.MIN_WORDS))
            else:
                seen[k] = (d, i)
    return out


def words_found(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    return out


def corpus():
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 60, 80, 200, 49, 400)]
    texts = {}
    for d in range(60):
        w = fresh(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            w += rng.choice(passages) + fresh(rng.randrange(0, 40))
        texts[d] = " ".join(w)
    base = fresh(500)
    for d in range(100, 130):  # near copies, a word changed here and there
        v = list(base)
        for _ in range(rng.randrange(0, 4)):
            v[rng.randrange(500)] = f"x{d}"
        texts[d] = "\n".join(v)
    texts[200] = texts[201] = texts[100]
    texts[300] = " ".join(["a b c"] * 60)  # repeats itself
    texts[301] = None
    texts[302] = ""
    return texts


def test_like_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in texts.items()], DOCS).repartition(5)
    rows = S.repeats(df).collect()
    want = {d: x for d, x in brute(texts).items() if x}
    assert dict(words_found(rows)) == want
    for r in rows:
        a = (texts[r["doc_id"]] or "").split()
        assert (r["copy_of"], r["copy_first_word"]) < (r["doc_id"], r["first_word"])
        b = texts[r["copy_of"]].split()
        assert a[r["first_word"]] == b[r["copy_first_word"]]


def test_removal_leaves_each_passage_once(spark):
    texts = corpus()
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in texts.items()], DOCS).repartition(3)
    left = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    gone = brute(texts)
    for d, t in texts.items():
        w = (t or "").split()
        keep = [x for i, x in enumerate(w) if i not in gone.get(d, ())]
        if d in left:
            assert (left[d]["text"] or "").split() == keep
            assert left[d]["n_chars"] == len(left[d]["text"] or "")
        else:
            assert w and not keep
    assert left[301]["text"] is None and left[302]["text"] == ""


def test_long_runs_are_compared_over_the_cluster(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in texts.items()], DOCS).repartition(2)
    monkeypatch.setattr(S, "LONGEST_RUN", 3)
    assert dict(words_found(S.repeats(df).collect())) == {d: x for d, x in brute(texts).items() if x}


def test_edge_cases(spark):
    assert S.repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert S.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    w = " ".join(f"k{i}" for i in range(70))
    clash = spark.createDataFrame([(1, w, "x", 3), (2, w + " end", "y", 4), (None, w, "z", 5)], "doc_id long, text string, key string, pos int")
    got = {r["doc_id"]: r.asDict() for r in S.remove_repeats(clash).collect()}
    assert got[2] == {"doc_id": 2, "text": " end", "key": "y", "pos": 4}
    assert got[None]["text"] == w and got[1]["text"] == w


def test_texts_of_one_id_and_clashing_names(spark):
    w = " ".join(f"k{i}" for i in range(70))
    v = " ".join(f"m{i}" for i in range(60))
    rows = [(1, w, 0, 0, 0, 0), (1, "short", 0, 0, 0, 1), (1, w, 0, 0, 0, 2), (2, "a " + v, 0, 0, 0, 3), (2, "b b " + v + " " + w, 0, 0, 0, 4), (3, v, 0, 0, 0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cut int, row_number int, CUTS int, n int")
    left = S.remove_repeats(docs)
    assert left.columns == docs.columns
    got = {r["n"]: r["text"].split() for r in left.collect()}
    assert got[1] == ["short"]
    # rows 0 and 2 are one document; of the three copies of each passage one stays
    kept_w = [n for n in (0, 2, 4) if n in got and "k5" in got[n]]
    assert kept_w in ([0, 2], [4]) and sum("m5" in x for x in got.values()) == 1
    found = S.repeats(docs).collect()
    assert found and {r["doc_id"] for r in found} <= {1, 2, 3} and {r["copy_of"] for r in found} <= {1, 2, 3}


def test_runs_of_many_suffixes_like_brute_force(spark):
    rng = random.Random(11)
    core = [f"c{i}" for i in range(60)]
    texts = {}
    for d in range(150):  # copies that begin and end at different words of one passage, among few words
        a, z = rng.randrange(0, 12), rng.randrange(48, 61)
        texts[d] = " ".join([rng.choice("xy") for _ in range(rng.randrange(0, 4))] + core[a:z] + [rng.choice("xy") for _ in range(rng.randrange(0, 30))])
    df = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()], DOCS).repartition(3)
    assert dict(words_found(S.repeats(df).collect())) == {d: x for d, x in brute(texts).items() if x}


def test_anchors_stand_in_every_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 500).astype(np.uint64)
    at = S.anchors(h)
    for s in range(len(h) - S.MIN_WORDS + 1):
        inside = at[(at >= s) & (at < s + S.WINDOW)]
        assert len(inside) and inside[0] + S.RIGHT <= s + S.MIN_WORDS
