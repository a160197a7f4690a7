import math
from collections import Counter, defaultdict

import pytest

from sievestone.llm.mix_sources import bisect_exponent, mix_sources, op9_temperature

SCHEMA = "doc_id long, text string, source string, mix string, epoch string, weight string, last string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, s, "", "", "", "") for i, x, s in rows], SCHEMA).repartition(4)


def exponent(tokens, keeps):
    low, high = 0.0, 1.0
    if keeps(0.0):
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if keeps(middle) else (middle, high)
    return high


def entropy(tokens, x):
    w = [t**x for t in tokens]
    return -sum(a / sum(w) * math.log(a / sum(w)) for a in w)


def test_exponent(spark):
    tokens = [100_000, 7_000, 3_000, 500]
    totals = spark.createDataFrame([(str(k), t) for k, t in enumerate(tokens)], "source string, tokens long")
    got = bisect_exponent(totals, max_repeat=4.0)
    assert got == pytest.approx(exponent(tokens, lambda x: (max(tokens) / min(tokens)) ** (1 - x) <= 4), abs=1e-9)
    assert got == pytest.approx(1 - math.log(4) / math.log(200), abs=1e-9)
    got = bisect_exponent(totals, target_entropy=1.0)
    assert got == pytest.approx(exponent(tokens, lambda x: entropy(tokens, x) <= 1.0), abs=1e-9)
    z = lambda x: sum((t / sum(tokens)) ** x for t in tokens)
    got = bisect_exponent(totals, max_repeat=3.0, budget=50_000)
    assert got == pytest.approx(exponent(tokens, lambda x: 50_000 / sum(tokens) * (min(tokens) / sum(tokens)) ** (x - 1) / z(x) <= 3), abs=1e-9)


def check(docs, out, limit):
    """The rows against a walk through every permutation in plain Python."""
    tokens = defaultdict(int)
    for i, x, s in docs:
        tokens[s] += -(-len((x or "").encode()) // 4)
    seen = defaultdict(lambda: defaultdict(list))
    for r in out:
        seen[r.source][r.mix.epoch].append(((r.mix.block_order, r.mix.doc_order), r.doc_id, r.mix.n_tokens))
    for s, t in tokens.items():
        mine = Counter(i for i, _, k in docs if k == s)
        if not t:
            assert Counter(i for _, i, _ in seen[s][0]) == mine
            continue
        epochs = next(r.mix.epochs for r in out if r.source == s)
        assert 1 <= epochs <= limit + 1e-6
        for e in range(int(epochs)):
            assert Counter(i for _, i, _ in seen[s][e]) == mine
        quota = t * (epochs - int(epochs))
        last = sorted(seen[s].get(int(epochs), []))
        spent = sum(n for _, _, n in last)
        assert spent >= quota - 1e-6 and (not last or spent - sum(n for k, _, n in last if k == last[-1][0]) < quota)
    return seen


def test_rows(spark):
    docs = [(i, f"text {i} " * (i % 17 + 1), "big") for i in range(900)]
    docs += [(1000 + i, "abc " * (i % 9), "small") for i in range(60)] + [(2000 + i, None, "void") for i in range(5)] + [(3000 + i, "x" * 50, None) for i in range(40)]
    docs += [(4000, "same", "tiny"), (4000, "same", "tiny"), (4001, "very long " * 20_000, "big")]
    df = frame(spark, docs)
    for limit in (4.0, 1.0, 9.5):
        out = mix_sources(df, max_repeat=limit, block_tokens=300).collect()
        check(docs, out, limit)
    assert out[0].asDict().keys() == dict.fromkeys(df.columns).keys()


def test_last_pass_is_a_prefix_of_the_permutation(spark):
    docs = [(i, "word " * (i % 13 + 1), "a") for i in range(400)] + [(1000 + i, "word " * 5, "b") for i in range(80)]
    some = mix_sources(frame(spark, docs), max_repeat=1.6, block_tokens=100).collect()
    more = mix_sources(frame(spark, docs), max_repeat=2.0, block_tokens=100).collect()
    order = sorted(((r.mix.block_order, r.mix.doc_order), r.doc_id) for r in more if r.mix.epoch == 1 and r.source == "b")
    taken = sorted(((r.mix.block_order, r.mix.doc_order), r.doc_id) for r in some if r.mix.epoch == 1 and r.source == "b")
    assert 0 < len(taken) < len(order) and order[: len(taken)] == taken


def test_small_cases(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    assert mix_sources(frame(spark, [(1, "a", "s")])).count() == 1
    assert mix_sources(frame(spark, [(1, None, None)])).count() == 1
    assert mix_sources(frame(spark, [(1, "abcd", "s"), (2, "abcd", "t")])).count() == 2
    assert mix_sources(frame(spark, [(k, "abcd" * 25, "s") for k in range(100)]), max_repeat=None, budget=1000).count() == 40


def test_query(spark):
    out = op9_temperature(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in out.collect()} == docs
