import corpus_pipeline

from pagelake.llm.common import cut

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"


def through(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        docs = cut(docs, name)
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, SF)


def test_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(90))
    rows = [(1, "the plain cat sat down", "en", "s", 22, 0.5, 9), (2, None, "en", None, None, None, None), (3, "", "en", "s", 0, 0.5, 9), (4, "12 34 !?", None, "s", 8, 0.5, 9), (5, words, "en", "s", 1, 0.5, 9), (6, words + " more", "en", "s", 1, 0.5, 9), (None, words, "en", "s", 1, 0.5, 9), (7, "le chat est là", "fr", "s", 14, 0.5, 9), (7, "le chat est là", "fr", "s", 14, 0.5, 9), (8, "long text " * 20_000, "en", "s", 1, 0.5, 9)]
    rows += [(100 + i, f"this is the text of page {i} and it goes on {i * i}", "en", "s", 1, 0.5, 9) for i in range(20)]
    docs, packed = through(spark, spark.createDataFrame(rows, SCHEMA))
    left = sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)
    assert not {2, 3, 4} & set(left) and left.count(7) == 1 and {1, 5, 8} <= set(left)
    assert [r["n_chars"] for r in docs.collect() if r["doc_id"] == 6] in ([], [5])
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty_table(spark):
    docs, packed = through(spark, spark.createDataFrame([], SCHEMA))
    assert docs.count() == 0 and packed.count() == 0


def test_texts_of_one_id_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, _copies int, _cut int, _lang_pred int, _lang_score int, copy long, row_number int"
    story = " ".join(f"word{i}" for i in range(80))
    rows = [(1, f"this is the first text of page one and it says {story}", "en"), (1, "another text of that page which has nothing in common", "en"), (2, "le chat est dans la maison et il dort", "fr"), (2, "le chien est dans le jardin", "fr"), (2, "le chien est dans le jardin", "fr")]
    rows += [(100 + i, f"this is the text of page {i} and it goes on {i * i}", "en") for i in range(8)] + [(200 + i, f"le texte de la page {i} est ici et {i * i}", "fr") for i in range(8)]
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1) for r in rows], schema)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == names
    left = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] < 100)
    assert left == sorted({(i, t) for i, t, _ in rows if i < 100})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("doc_id < 100").count() == 4
