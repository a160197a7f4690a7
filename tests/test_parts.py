import pytest

from sievestone.streaming import parts
from sievestone.streaming.ingest import graded

SCHEMA = "run_id string, label long, length_px double, width_px double, area_px double, aspect_ratio double, circularity double, solidity double, eccentricity double, orientation_angle double, expected long"


def objects(run, labels, expected, length=None):
    return [(run, k, length or 90.0 + 9 * (k % 5), 40.0, 40.0 * (90 + 9 * (k % 5)), 2.0, 0.8, 0.9, 0.5, 10.0, expected) for k in labels]


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "in").mkdir()

    class Store:
        path, sent = str(tmp_path / "store"), []

        def send(self, rows):
            name = f"{len(self.sent)}"
            self.sent.append(rows)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            query = parts.grade_parts(stream, self.path, str(tmp_path / "progress"))
            assert query.awaitTermination(120) and query.exception() is None

        def grades(self):
            return sorted(parts.grades(spark, self.path).collect())

    s = Store()
    s.sent = []
    return s


def test_a_run_in_three_batches_has_the_grade_it_has_in_one(spark, store):
    whole = {"a": objects("a", range(12), 12), "b": objects("b", range(5), 5, 70.0), "late": objects("late", range(4), 9)}
    store.send(whole["a"][:4] + whole["b"])
    assert [r.run_id for r in store.grades()] == ["b"]
    store.send(whole["a"][4:8] + whole["a"][:4] + whole["late"])  # rows sent twice complete nothing: 4 + 8 rows, but 8 objects
    assert [r.run_id for r in store.grades()] == ["b"]
    store.send(whole["a"][8:])
    want = sorted(graded(spark.createDataFrame(whole["a"] + whole["b"], SCHEMA)).collect())
    assert store.grades() == want
    assert [(r.run_id, r.n, r.total) for r in parts.open_runs(spark, store.path).collect()] == [("late", 4, 9)]
    rest = parts.grade_rest(spark, store.path, spark.createDataFrame([], SCHEMA).schema).collect()
    assert rest == graded(spark.createDataFrame(whole["late"], SCHEMA)).collect()
    # a batch repeated after a failure, and rows of a run that was graded, change nothing
    parts.absorb(spark.createDataFrame(store.sent[2], SCHEMA), 2, store.path)
    assert store.grades() == want
    store.send(objects("b", range(5, 9), 5, 7000.0))
    assert store.grades() == want


def test_rows_without_a_run_or_a_total_wait(spark, store):
    store.send(objects(None, range(3), 3) + objects("x", range(3), None))
    assert store.grades() == []
    assert {r.run_id for r in parts.open_runs(spark, store.path).collect()} == {None, "x"}


def test_a_batch_reads_only_its_buckets(spark, store):
    store.send(objects("a", range(3), 3))
    rows = parts._read(spark, store.path, "rows", spark.createDataFrame([], SCHEMA).schema).where("bucket IN (3) AND part <= 7")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "bucket" in pruned and "part" in pruned
