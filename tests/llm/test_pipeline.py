"""The pipeline's stages one after the other, each held against what it got."""

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_ops import brute_bytes, brute_classes, check_packing


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out[name] = docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    clean, single, cut = (out[n].toPandas() for n in ("toxicity", "near_duplicates", "repeated_bytes"))
    assert 150 <= len(clean) <= 200
    classes = brute_classes(dict(zip(clean["doc_id"], clean["text"], strict=True)))
    assert sorted(single["doc_id"]) == sorted(set(classes.values()))
    want = {d: n - gone for d, n, gone, _, _ in brute_bytes(list(zip(single["doc_id"], single["text"], strict=True)), 200)}
    assert set(cut["doc_id"]) == set(want)
    # a character of which a byte went is gone as a whole
    assert all(0 <= want[r.doc_id] - len(r.text.encode()) <= 6 * (1 + want[r.doc_id] // 200) and r.n_chars == len(r.text) for r in cut.itertuples())
    check_packing(out["packing"].collect(), list(zip(cut["doc_id"], cut["text"], strict=True)), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).select("sequence_id").distinct().count() > 10


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Rows with one id or none but other texts are other documents; of like ones the least id stays."""
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    items = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("d")), (5, text("d")), (6, text("e")), (7, text("e") + " end"), (8, text("a")), (9, text("f")), (5, text("f")), (10, None), (11, "")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in items], "doc_id long, text string, lang string")
    got = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert got.columns == docs.columns
    want = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (5, text("f")), (6, text("e")), (10, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


CLASH = "doc_id long, text string, id long, key string, kept string, carry string, n_chars long, lang string, TEXT string"


def clashing(spark, items):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        return spark.createDataFrame([(d, t, i, "k", None, "c", None if t is None else len(t), "en", "T") for i, (d, t) in enumerate(items)], CLASH)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_stages_keep_rows_and_clashing_columns(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows and columns that clash, at every stage."""
    long = " ".join(f"q{i}" for i in range(20_000))
    items = [(None, "a b c"), (None, None), (1, None), (1, ""), (2, "tree " * 200), (2, "tree " * 200), (3, long), (3, "some other text of no length"), (4, long + " end")]
    docs = clashing(spark, items)
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        # columns are told apart by their place
        out = [(r[0], r[1], r[2], r[6]) for r in got.collect()]
        if name == "near_duplicates":
            assert sorted(x[2] for x in out if x[2] not in (4, 5)) == [0, 1, 6, 7]
            assert len([x for x in out if x[2] in (4, 5)]) == 1
            continue
        assert sorted(x[2] for x in out) == list(range(len(items))), name
        if name == "repeated_bytes":
            by = {x[2]: x for x in out}
            assert by[4][1].strip() == by[5][1].strip() == "" and by[7][1] == items[7][1] and by[6][1] == "" and all(x[3] == len(x[1]) for x in out)
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF).count() >= len(items)


def test_stages_of_an_empty_table(spark):
    docs = clashing(spark, [])
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs, SF).count() == 0
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF).count() == 0
