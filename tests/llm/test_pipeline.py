from pyspark.sql import functions as F

import corpus_pipeline

from .test_best_fit_packing import check_packing
from .test_ngram_jaccard import brute as jaccard
from .test_quality_rules import brute as rules


def test_stages_one_after_another(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {x[0] for x in rules([(i, r.text, r.source) for i, r in rows.items()], 50, 0.02) if x[-1]}
    first = {x[2] for x in jaccard([(i, rows[i].text) for i in good], 5, 80)}
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], "").cache())
        assert frames[-1].columns == docs.columns and frames[-1].dtypes == docs.dtypes
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert ids[1] == good and ids[2] == first and ids[3] <= first and ids[4] == ids[3]
    left = {r.doc_id: r.text for r in frames[3].collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, frames[3], "").collect()
    check_packing(list(left.items()), packed)
    total = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in total.collect()} == ids[3]


def test_rows_without_identifier_pass_the_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blank = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).cache()
    text = {i: r.text for i, r in enumerate(blank.collect())}
    verdict = {x[0]: x[-1] for x in rules([(i, x, None) for i, x in text.items()], 1000, 1.0)}
    frame, counts = blank, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "").cache()
        assert frame.dtypes == docs.dtypes
        counts.append(frame.where("doc_id IS NULL").count())
    unnamed = {i for i, r in enumerate(blank.collect()) if r.doc_id is None}
    assert counts[0] == sum(verdict[i] for i in unnamed)
    good = [(i, x) for i, x in text.items() if verdict[i]]
    groups = {c for i, _, c in jaccard(good, 5, 80) if i in unnamed}
    mixed = {c for i, _, c in jaccard(good, 5, 80) if i not in unnamed}
    assert counts[1] == len(groups - mixed) and counts[2] > 0 and counts[3] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").where("doc_id IS NULL").count() > 0


def test_rows_of_one_identifier_keep_their_texts(spark):
    shared = "this passage is in several documents and is surely longer than fifty bytes "
    rows = [(1, shared + "alpha", "s"), (2, shared + "beta", "s"), (2, "gamma has nothing to do with any of the others, not a single passage of it", "s"), (3, shared + "delta", "s"), (3, shared + "delta", "s")]
    docs = spark.createDataFrame([(i, x, "en", s, "k", "m", "d") for i, x, s in rows], "doc_id long, text string, lang string, source string, kept string, mix string, _doc string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect())
    assert got[:3] == sorted(x[:2] for x in rows)[:3] and [i for i, _ in got] == [1, 2, 2, 3, 3]
    assert got[3] == got[4] and shared not in got[3][1]


def test_clashing_names_and_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("n_chars").limit(60)
    more = docs
    for name in ("kept", "mix", "_d", "_doc", "_kept", "_gone", "_key", "row", "Token", "spans"):
        more = more.withColumn(name, F.lit(name))
    frame = more.cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "").cache()
        assert frame.columns == more.columns and frame.count() > 0
        assert frame.where("kept != 'kept' OR mix != 'mix' OR _d != '_d' OR row != 'row'").count() == 0
    frame = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "").cache()
        assert frame.count() == 0


def test_side_tables_go_when_their_stage_is_read_again(spark, tmp_path):
    from sievestone.llm import _store

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = _store.shared_root(spark).removeprefix("file://")
    before = set(__import__("os").listdir(folder))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = set(__import__("os").listdir(folder)) - before
    assert {x.split("-")[1] for x in left} <= {"sizes", "pieces", "plan", "ranked", "tokens", "encoded", "lengths"} and docs.count() > 0
