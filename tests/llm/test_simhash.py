import random
from collections import Counter

import xxhash

from pagelake.llm import simhash

DOCS = "doc_id long, text string, source string"


def slow_fingerprint(text):
    w = []
    for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if x:
            w.append(x)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fp = {i: slow_fingerprint(t) for i, t in rows}
    ids = list(fp)
    return fp, components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 2])


def test_documents_like_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts = [None, "", " \n\t", "One", "one TWO", "Ä b c", "ä b c", "x y z", *base]
    for b in base[:20]:
        w = b.split()
        for _ in range(5):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            texts += [" ".join(v), "  ".join(w).upper()]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)).collect()}
    fp, root = brute(rows)
    assert got == {i: (fp[i], root[i]) for i, _ in rows}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def reachable(links, values):
    return components(values, links)


def test_links_in_small_and_large_buckets(spark):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(50)}
    center = rng.getrandbits(64)
    for _ in range(600):  # all share much of their segments, and more than PAIRWISE meet in many buckets
        v = center
        for _ in range(rng.randrange(0, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = [signed(v) for v in values]
    true = {(min(a, b), max(a, b)) for k, a in enumerate(values) for b in values[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {(r["lo"], r["hi"]) for r in simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got <= true
    assert reachable(got, values) == reachable(true, values)


def test_every_link_where_buckets_are_small(spark):
    rng = random.Random(7)
    values = []
    for _ in range(60):
        v = rng.getrandbits(64)
        values += [v, v ^ 1 << rng.randrange(64), v ^ 1 << rng.randrange(64) ^ 1 << 63]
    values = [signed(v) for v in set(values)]
    true = {(min(a, b), max(a, b)) for k, a in enumerate(values) for b in values[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {(r["lo"], r["hi"]) for r in simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()} == true


def test_edge_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(3, "a b c d", "s"), (3, "a b c d", "s"), (None, "a b c d", "s"), (9, "A B C D", "s"), (5, None, "s"), (6, "", "s"), (None, "only here now ok", "s")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(3, 3), (3, 3), (5, 5), (6, 5), (9, 3)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [3, 5]
    assert sum(r["doc_id"] is None for r in kept) == 2
    clash = spark.createDataFrame([(1, "x y z", 0, 7, "c")], "doc_id long, text string, n int, fp long, component_id string")
    assert simhash.drop_near_duplicates(clash).collect()[0].asDict() == {"doc_id": 1, "text": "x y z", "n": 0, "fp": 7, "component_id": "c"}
    long = " ".join(f"w{i}" for i in range(200_000))
    assert simhash.fingerprint(long) != 0


def test_texts_of_one_id_and_clashing_names(spark):
    schema = "doc_id long, text string, _copies int, id long, n int, FP_OF_ROW int, text_hash string, least_id long"
    texts = [(3, "alpha beta gamma delta"), (3, "something quite other here now"), (3, "alpha beta gamma delta"), (3, "ALPHA beta gamma delta"), (5, "alpha beta gamma delta"), (7, "one more text that stands alone"), (2, "something quite other here now"), (None, "alpha beta gamma delta")]
    docs = spark.createDataFrame([(i, t, k, 1, 1, 1, "h", 1) for k, (i, t) in enumerate(texts)], schema)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    left = sorted((r["doc_id"] or -1, r["text"].lower()) for r in got.collect())
    assert left == [(-1, "alpha beta gamma delta"), (2, "something quite other here now"), (3, "alpha beta gamma delta"), (7, "one more text that stands alone")]


def test_crowded_segments(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 20)
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    rng = random.Random(9)
    half = rng.getrandbits(32)
    values = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(120):  # one low half, or one bit beside it, and high halves near each other
        values.add((half ^ (1 << rng.randrange(32)) * (rng.random() < 0.3)) | (0xABCD0000 ^ rng.randrange(64)) << 32)
    values = [signed(v) for v in values]
    true = {(min(a, b), max(a, b)) for k, a in enumerate(values) for b in values[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {(r["lo"], r["hi"]) for r in simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got <= true and reachable(got, values) == reachable(true, values)


def test_scratch_tables_can_be_cleared(spark):
    import os

    from pagelake.llm.common import clear_scratch, cut

    made = cut(spark.range(3), "t")
    path = made.scratch_path
    assert os.path.isdir(path)
    clear_scratch(spark)
    assert not os.path.exists(path)
