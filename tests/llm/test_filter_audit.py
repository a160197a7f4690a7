import re
from itertools import permutations

from pyspark.sql import functions as F

from sievestone.llm.filter_audit import audit, cells, op13_filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, n string, step int, part string, filter_order string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """Counts of every part, order and step, a document at a time."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (i is not None and any(j is not None and j < i and (x or "") == text for j, x, _ in docs))
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def many(n, seed):
    return " ".join(f"w{(k * seed) % 997}" for k in range(n))


def test_odd_rows_against_brute_force(spark):
    docs = [
        (1, many(60, 1), "a"), (2, many(60, 1), "b"), (3, many(60, 1), "a"), (3, many(60, 1), "a"), (4, None, "a"), (5, "", None), (6, "", ""), (7, "the the the", "b"),
        (8, "SHOUT " * 70, "b"), (9, "a # b", None), (None, many(60, 1), "a"), (None, None, None), (10, "\x0b\x0c \t\r\n", "b"), (11, "é É " * 60, "c"),
        (12, many(200_000, 3), "c"), (13, many(200_000, 3) + "|", "c"), (2, "another text of two", "b"), (-5, "the the the", "c"),
    ]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, 0, 1), (8, 1, None), (None, 1, 1), (12, None, 1), (999, 1, 1), (2, 1, 0)]
    df = spark.createDataFrame([(*d, 0, "", 0, "", "") for d in docs], SCHEMA).repartition(5)
    marks = spark.createDataFrame([(*x, "") for x in labels], LABELS)
    got = audit(cells(df, marks))
    assert found(got) == brute(docs, labels)
    assert got.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int"), *((c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))]
    # the shares of all filters add up to the rows that any order removes, over all orders
    last = got.where("step = 5 AND filter_order = 'ABCDE'").select("part", "kept").collect()
    shares = got.where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s")).collect()
    rows = df.groupBy(F.coalesce("source", F.lit("")).alias("part")).count().collect()
    kept, count = {r.part: r.kept for r in last}, {r["part"]: r["count"] for r in rows}
    assert {r.part: r.s for r in shares} == {p: 120 * (count[p] - kept[p]) for p in count}


def test_no_rows_and_no_labels(spark):
    assert audit(cells(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))).count() == 0
    one = spark.createDataFrame([(1, "x", "s", 0, "", 0, "", "")], SCHEMA)
    assert found(audit(cells(one, spark.createDataFrame([], LABELS)))) == brute([(1, "x", "s")], [])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(op13_filter_audit(spark, sf)) == brute(docs, labels)
