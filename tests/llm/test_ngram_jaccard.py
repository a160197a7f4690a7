import random
import re

import numpy as np

from sievestone.llm import ngram_jaccard
from sievestone.llm.ngram_jaccard import PreorderWalk, jaccard_components, keep_first, op6_prefix_tree

SCHEMA = "doc_id long, text string, a string, b string, n string, token string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(rows, k):
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(rows, k=4, percent=85):
    sets = sets_of(rows, k)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {(i, len(sets[i]), find(i)) for i in ids}


def rows_of(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 6, 20, 60, 150]))] for _ in range(25)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += passage
        text = " ".join(w)
        rows.append((i * 3 + 1, text.upper() if rng.random() < 0.1 else text))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, x, "", "", "", "") for i, x in rows], SCHEMA).repartition(6)
        for k, percent in ((4, 85), (5, 80)):
            assert rows_of(jaccard_components(df, words=k, percent=percent)) == brute(rows, k, percent)


def test_chains_of_near_copies(spark):
    """Neighbours link, the ends do not: components must follow the chain."""
    words = [f"x{k}" for k in range(120)]
    rows = [(100 - j, " ".join(words[j * 3 : j * 3 + 80])) for j in range(14)]
    df = spark.createDataFrame([(i, x, "", "", "", "") for i, x in rows], SCHEMA).repartition(4)
    assert rows_of(jaccard_components(df)) == brute(rows)


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    """Near copies of one text, most of them just too far from one another: rows compared stay few, and nothing is lost."""
    rng = random.Random(5)
    rows = []
    for size in (90, 514):
        base = [f"s{size}x{k}" for k in range(size)]
        for i in range(150 if size == 90 else 30):
            w = list(base[: size - rng.randrange(4)])
            for _ in range(rng.choice([1, 2, 3]) * size // 90):
                w[rng.randrange(len(w))] = f"own{i}"
            rows.append((len(rows) * 7 % 181 + 1, " ".join(w)))
    df = spark.createDataFrame([(i, x, "", "", "", "") for i, x in rows], SCHEMA).repartition(6)
    counts, write = [], ngram_jaccard.written
    monkeypatch.setattr(ngram_jaccard, "written", lambda made, tag: (out := write(made, tag), counts.append((tag, out.count())))[0])
    assert rows_of(jaccard_components(df)) == brute(rows)
    assert sum(n for tag, n in counts if tag in ("asked", "met", "others")) <= 2 * len(rows)
    assert sum(n for tag, n in counts if tag == "linked") <= 2 * len(rows)


def test_edge_cases(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"), (8, "é b c d e " * 4000), (9, "é b c d e " * 4000 + "z")]
    df = spark.createDataFrame([(i, x, "", "", "", "") for i, x in rows], SCHEMA)
    assert rows_of(jaccard_components(df)) == brute(rows)
    twice = df.union(df)
    out = jaccard_components(twice)
    assert out.count() == 18 and rows_of(out) == brute(rows)
    assert {r.doc_id for r in keep_first(df).collect()} == {1, 2, 3, 4, 6, 7, 8}


def test_null_identifiers(spark):
    own = lambda i, n=40: " ".join(f"w{i}x{k}" for k in range(n))
    near = lambda i: own(i) + " end"
    rows = [(1, own(1)), (None, near(1)), (None, own(2)), (None, own(2)), (None, near(2)), (None, own(3)), (5, own(5)), (7, near(5)), (None, ""), (None, None), (None, " ")]
    df = spark.createDataFrame([(i, x, "", "", "", "") for i, x in rows], SCHEMA).repartition(4)
    got = jaccard_components(df)
    assert rows_of(got.where("doc_id IS NOT NULL")) == {(1, 37, 1), (5, 37, 5), (7, 38, 5)}
    assert [r.component_id for r in got.where("doc_id IS NULL").collect()] == [None] * 8
    kept = [(r.doc_id, r.text) for r in keep_first(df).collect()]
    assert keep_first(df).dtypes == df.dtypes
    two = [x for x in kept if x[1] in (own(2), near(2))]
    assert len(two) == 1 and two[0][0] is None
    assert sorted((x for x in kept if x not in two), key=str) == sorted([(1, own(1)), (None, own(3)), (5, own(5)), (None, ""), (None, None), (None, " ")], key=str)


def test_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(op6_prefix_tree(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_walk_in_any_order_of_sets():
    rng = np.random.default_rng(4)
    for _ in range(60):
        own = np.unique(rng.integers(0, 300, rng.integers(1, 250)).astype(np.uint64))
        others = [np.unique(np.concatenate([rng.choice(own, len(own) * 9 // 10), rng.integers(0, 300, rng.integers(1, 20)).astype(np.uint64)])) for _ in range(30)]
        walk = PreorderWalk(own, 80)
        for other in sorted(others, key=lambda x: x.astype(">u8").tobytes()):
            n = len(np.intersect1d(own, other))
            assert walk.links(other) == (100 * n >= 80 * (len(own) + len(other) - n))


def test_texts_and_sets_stay_where_they_are(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plans, real = {}, ngram_jaccard.written
    monkeypatch.setattr(ngram_jaccard, "written", lambda df, tag: (plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString()), real(df, tag))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables of identifiers are larger
    try:
        named = keep_first(docs).where("doc_id IS NOT NULL")
        plan = named._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id for r in named.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {c for _, _, c in brute(rows, 5, 80)}
    assert "LeftAnti" in plan and "LeftSemi" not in plan and "SortMergeJoin [cast(doc_id" not in plan and "SortMergeJoin [doc_id#" not in plan.split("Union")[0]
    assert "BroadcastHashJoin [doc_id" in plans["linked"][0] and "SortMergeJoin" not in plans["linked"][0]
