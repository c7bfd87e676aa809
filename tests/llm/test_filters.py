import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, embedding_dedup, language_id, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def normal(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def smith_waterman(a, b):
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        now = [0.0]
        for j, y in enumerate(b):
            now.append(max(0.0, row[j] + (1 if x == y else -0.5), row[j + 1] - 0.5, now[j] - 0.5))
        row = now
        best = max(best, max(now))
    return best


def test_alignment_like_plain_dynamic_programming():
    rng = random.Random(1)
    pairs = [([rng.randrange(2, 6) for _ in range(rng.randrange(1, 12))], [rng.randrange(2, 6) for _ in range(rng.randrange(1, 30))]) for _ in range(200)]
    best, first, last = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    for (a, b), s, f, z in zip(pairs, best, first, last, strict=True):
        assert s == pytest.approx(smith_waterman(a, b))
        if s:
            assert smith_waterman(a, b[f:z]) == pytest.approx(s)


def test_contamination(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30)).capitalize() + ".") for i in range(10)] + [(10, None), (11, ""), (12, "a b")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], {}
    for d in range(200):
        text = filler(rng.randrange(0, 80))
        if d % 4 == 0:
            i = rng.randrange(10)
            w = items[i][1].split()
            kind = d % 3
            if kind == 1:
                w = [x if k % 6 else word() for k, x in enumerate(w)]
            if kind == 2:
                w = [x for k, x in enumerate(w) if k % 7] + []
            text = f"{text} {' '.join(w).upper() if d % 8 else ' '.join(w)} {filler(20)}"
            want[d] = i
        docs.append((d, text))
    docs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, " ".join(items[3][1].split() * 500))]
    want[1002] = 3
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text").repartition(4)
    got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_id"] for r in got if r["doc_id"] is not None} == want
    by_id = dict(docs)
    for r in got:
        if r["doc_id"] in (None, 1002):
            continue
        a, b = normal(items[r["item_id"]][1]), normal(by_id[r["doc_id"]])
        assert r["score"] == pytest.approx(smith_waterman(a, b) / len(a))
    left = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in left} == {d for d, _ in docs} - set(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(df, none).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("hits", [1, 3, 5])
def test_edited_copies_like_brute_force(spark, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(5)
    common = ["the", "of", "to", "and", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(24)]
    docs = [(-1 - i, t) for i, t in items]  # exact copies too, beside which the destroyed words are the rarer
    for i, t in items:
        for every in (2, 3, 4, 5):
            w = t.split()
            changed = ["zz" + word() if k % every == every - 1 else x for k, x in enumerate(w)]
            added = [y for k, x in enumerate(w) for y in ([x, "zz" + word()] if k % every == every - 1 else [x])]
            gone = [x for k, x in enumerate(w) if k % every != every - 1]
            for kind, x in enumerate((changed, added, gone)):
                docs.append((i * 100 + every * 10 + kind, " ".join([word() for _ in range(30)] + x + [word() for _ in range(30)])))
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = normal(item), normal(text)
            s = smith_waterman(a, b) / len(a)
            if s >= decontaminate.THRESHOLD:
                want[d, i] = pytest.approx(s)
    assert sum(d >= 0 for d, _ in want) > 150
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want


def test_false_hits_of_the_filter_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 16)
    assert whole and sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == whole


def test_scripts_without_spaces(spark):
    item = "这是一个用来测试的句子它没有空格"
    docs = spark.createDataFrame([(1, "前面的话。" + item + "，后面"), (2, "另外一段完全不同的文字在这里"), (3, "“plain” words — only’s")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, item), (8, "plain words only s")], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["score"], r["n_words"]) for r in got} == {(1, 7, 1.0, 16), (3, 8, 1.0, 4)}


def test_texts_of_one_id_are_judged_apart(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta", 0, 0), (1, "something else that is clean", 1, 1)], "doc_id long, text string, copy long, _bad long")
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "something else that is clean", 1, 1)]


def test_urls_and_rules(spark):
    cases = [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.org/en/1", "x.org", "/en/1", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("ftp://b.com/de/9", "b.com", "/de/9", "com/de/", "block"),
        ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("http://x.org?q", "x.org", "", None, None),
        ("no url", "", "", None, None),
        (None, "", "", None, None),
        ("://HÉ.net#f", "hÉ.net", "", None, None),
        ("", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "host") for i, c in enumerate(cases)], "page_id long, url string, upper string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(len(cases))], "page_id long, good int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes).collect()}
    for i, c in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == c[1:4]
        assert got[i]["verdict"] == (c[4] or "allow")


def test_bad_hosts_are_blocked_and_new_ones_take_their_domain(spark):
    rows = [(i, "http://bad.spam.net/x") for i in range(40)] + [(100 + i, "http://good.net/x") for i in range(40)] + [(200, "http://new.spam.net/"), (201, "http://fresh.net/")]
    outcomes = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(0, 0), (None, 0), (100, None)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    assert got[0]["verdict"] == "block" and got[100]["verdict"] == "allow" and got[201]["verdict"] == "allow"
    assert got[200]["mean"] < got[201]["mean"]
    assert got[0]["mean"] < got[0]["upper"]


@pytest.mark.parametrize("name", ["op5_url_filter", "op7_chat"])
def test_queries_like_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = c.sql(queries.oracle_sql()[name]).fetchdf()
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    near = np.vstack([b + rng.standard_normal((40 if i == 0 else 2, 16)) * 0.08 for i, b in enumerate(base)])
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(np.vstack([base, near, base[:5], base[:5]]))]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, [1.0, None] + [0.0] * 14, 0), (905, [1e30] + [0.0] * 15, 1), (906, [1e-30] + [0.0] * 15, 1), (907, [], 1), (908, [float("inf")] + [0.0] * 15, 1)]
    return rows


def test_embeddings_like_brute_force(spark, monkeypatch):
    rows = vectors()
    ok = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v, _ in ok}
    label = {i: k for i, _, k in ok}
    links = {i: {j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93} for i in unit}
    root = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min([root[i], *(root[j] for j in links[i])])
            if low < root[i]:
                root[i], changed = low, True
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for block in (2048, 16):  # as one task, and block by block
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
        assert got == {i: (len(links.get(i, ())), root[i], root[i] == i) for i, _, _ in rows}
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_labels_of_any_size_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_A_TASK", 8)  # a window reaches over several tasks
    rng = np.random.default_rng(8)
    rows = []
    for size in range(31):
        base = rng.standard_normal((max(1, size // 3), 8))
        rows += [(len(rows) + k, (base[k % len(base)] + rng.standard_normal(8) * 0.12).tolist(), size) for k in range(size)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    want = {i: sum(j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93 for j in unit) for i in unit}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df).collect()} == want and sum(want.values()) > 100


def test_recall_of_passes_where_windows_are_short(spark):
    rng = np.random.default_rng(9)
    m = rng.standard_normal((1500, 32))
    m[1::2] = m[::2] + rng.standard_normal((750, 32)) * 0.3
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    true = [k for k in range(750) if unit[2 * k] @ unit[2 * k + 1] >= 0.93]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_vectors(df, window=16).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in true) >= 0.99 * len(true) > 600


def test_no_pair_of_a_large_label_is_lost(spark):
    rng = np.random.default_rng(6)
    n, pairs = 20_000, 1_000
    m = rng.standard_normal((n, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for k in range(pairs):  # rows 2k and 2k + 1 have a cosine of 0.931 to 0.97
        c = rng.uniform(0.931, 0.97)
        side = m[2 * k + 1] - (m[2 * k + 1] @ m[2 * k]) * m[2 * k]
        m[2 * k + 1] = c * m[2 * k] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (1, i // 2 * 2) if i < 2 * pairs else (0, i) for i in range(n)}


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_grams(text):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    w = re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in low))
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_languages_like_plain_naive_bayes(spark):
    rng = random.Random(4)
    stock = {"ru": "и снова день ЖИЗНЬ шла", "el": "και μία ΜΕΡΑ άλλη φορά", "zh": "今天 天气 很 好 我们", "en": "the day was long And so", "hi": "यह दिन अच्छा था और"}
    rows = [(i, " ".join(rng.choices(t.split(), k=8)) + "!", k) for i, (k, t) in enumerate(list(stock.items()) * 40)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {k: Counter(g for _, t, x in learned if x == k for g in plain_grams(t)) for k in stock}
    total = {k: sum(c.values()) + 0.5 * language_id.BUCKETS for k, c in counts.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df.drop("lang"), language_id.train(language_id.learned_rows(df))).collect()
    for r in got:  # of a few hundred n-grams none or hardly any share a bucket
        grams = plain_grams(r["text"])
        score = {k: sum(math.log((counts[k][g] + 0.5) / total[k]) for g in grams) for k in stock}
        best = max(score, key=score.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(x - score[best]) for x in score.values()), abs=1e-3)


def test_language_sample_is_bounded(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('some text ', id) AS text", "'en' AS lang")
    one = df.union(spark.createDataFrame([(9000, "ein anderer text", "de")], "doc_id long, text string, lang string"))
    langs, table = language_id.train(one, sample_rows=30)
    assert langs == ["de", "en"] and np.isfinite(table).all()


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog", "en", 0) for i in range(9)] + [(20 + i, "le chat et le chien", "fr", 0) for i in range(9)] + [(50, None, "en", 1), (51, "", None, 1), (52, "123 !?", "fr", 1), (53, "the " * 50_000, None, 1), (54, "日本語", None, 1), (None, "le chien", "fr", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.train(language_id.learned_rows(df))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df.drop("score"), model).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[53][0] == "en" and got[None][0] == "fr" and got[54][0] in ("en", "fr")
    empty = df.where("doc_id < 0")
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(df.drop("score"), language_id.train(empty)).collect()} == {"und"}
    df = df.withColumn("lang_pred", F.lit(1)).withColumn("LANG_SCORE", F.lit(2))
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {0, 20, 53}


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    graded = toxicity.grades(labels)
    held = graded.where("doc_id % 5 = 0")
    model = toxicity.train(docs, graded.where("doc_id % 5 != 0"))
    got = toxicity.score(docs, model).join(held, "doc_id").collect()
    right = sum(r["toxic"] == bool(r[-1] > 0) for r in got)
    assert len(got) > 500 and right >= 0.97 * len(got)
    assert model[1].tolist() == sorted(model[1].tolist())


def test_toxic_documents_are_found_in_each_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    graded = toxicity.grades(labels)
    model = toxicity.train(docs, graded.where("doc_id % 5 != 0"))
    bad = graded.where("grade > 0 AND doc_id % 5 = 0").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    got = toxicity.score(docs, model).select("doc_id", "toxic").join(bad, "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        mine = [r["toxic"] for r in got if r["lang"] == lang]
        assert mine and sum(mine) >= 0.8 * len(mine), lang  # es has 6


def test_how_often_a_word_stands_counts(spark):
    texts = ["a word now and then is fine", "word word word word word word now and then is fine"]
    df = spark.createDataFrame([(i, texts[i % 2]) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.train(df, toxicity.grades(labels))).collect()
    assert all(r["toxic"] == (r["doc_id"] % 2 == 1) for r in got)


@pytest.mark.parametrize("low,high", [(0, 3), (1, 3), (0, 2), (2, 5)])
def test_grades_are_those_of_the_labels(spark, low, high):
    texts = ["a fine day it is", "you vile awful fool"]
    df = spark.createDataFrame([(i, texts[i % 2]) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (low, high)[i % 2]) for i in range(200)], "doc_id long, toxic int")
    for r in toxicity.score(df, toxicity.train(df, toxicity.grades(labels))).collect():
        assert r["grade"] == (low, high)[r["doc_id"] % 2] and low <= r["severity"] <= high
        assert abs(r["severity"] - r["grade"]) < 0.5 and r["toxic"] == (r["grade"] > 0)


def test_fit_is_the_most_likely_by_a_plain_count():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (400, 3)) * [1, 1, 1]
    y = np.digitize(x @ [1.2, 0.8, -1.0] + rng.logistic(size=400), [1.0, 3.0])
    rows, feats = np.nonzero(x)
    w, t = toxicity.fit(rows, feats, x[rows, feats].astype(float), y, 3, 3)

    def loss(w, t):
        total = 0.0
        for row, grade in zip(x, y, strict=True):
            up = [1.0] + [1 / (1 + math.exp(k - float(row @ w))) for k in t] + [0.0]
            total -= math.log(up[grade] - up[grade + 1])
        return total / len(y) + toxicity.PENALTY / 2 * float(w @ w)

    best = loss(w, t)
    assert len(t) == 2 and t[0] < t[1] and w.any()
    for k in np.flatnonzero(w):  # words that speak for lower grades stay out
        for step in (-0.02, 0.02):
            assert loss(w + step * (np.arange(3) == k), t) > best - 1e-6
    for k in range(2):
        for step in (-0.02, 0.02):
            assert loss(w, t + step * (np.arange(2) == k)) > best - 1e-6


def test_toxicity_edge_cases(spark):
    texts = ["a fine day it is", "you awful fool number", "you vile awful fool"]
    rows = [(i, texts[i % 3], 7) for i in range(300)] + [(1000, None, 7), (1001, "", 7), (1002, "fool " * 100_000, 7), (None, "fool", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, 1, i % 3) for i in range(300)] + [(0, 0, 0), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df.drop("grade"), toxicity.grades(labels))
    assert len(model[1]) == 2 and model[1][0] < model[1][1]
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(got[i]["toxic"] == (i % 3 > 0) and got[i]["grade"] == i % 3 for i in range(300))
    assert got[1002]["severity"] > got[1001]["severity"] == got[1000]["severity"]
    assert 0 <= min(r["severity"] for r in got.values()) and max(r["severity"] for r in got.values()) <= 2
    nothing = toxicity.train(df.drop("grade"), toxicity.grades(labels.where("toxic = 0")))
    assert not any(r["toxic"] for r in toxicity.score(df, nothing).collect())
    assert toxicity.score(df.where("doc_id < 0"), model).count() == 0
