import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievestone.llm import _text
from sievestone.llm.suffix_tree_lm import Shares, Tree, build_tree, count_tokens, gram, op8_suffix_tree, score_texts, token_stream

SCHEMA = "doc_id long, text string, n string, token string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def brute(rows, least_share=2.5e-7, context_share=2.5e-6):
    """Base scores, and the tree by its definition."""
    low, discount, divergence = 4, 0.5, 0.05
    uni, counts = Counter(), {2: Counter(), 3: Counter()}
    for i, text in rows:
        if not held(i):
            w = tokens_of(text)
            uni.update(w)
            for k in (2, 3):
                counts[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    n, v = sum(uni.values()), len(uni)
    least, least_context = max(low, math.ceil(least_share * n)), max(2 * low, math.ceil(context_share * n))
    root = lambda c: (uni[c] + 0.1) / (n + 0.1 * (v + 1))
    states, listed = {}, {}

    def p(context, c):
        for k in (2, 1):
            s = tuple(context[-k:])
            if len(s) == k and s in states:
                return listed.get((*s, c), 0.0) + states[s] * p(s[1:], c)
        return root(c)

    for k in (2, 3):
        nexts = {}
        for g, m in counts[k].items():
            if m >= least and all(uni[x] >= least for x in g):
                nexts.setdefault(g[:-1], {})[g[-1]] = m
        new = {}
        for s, mine in nexts.items():
            every = uni[s[0]] if k == 2 else counts[2][s]
            if every >= least_context and sum(m / every * math.log(m / every / p(s[1:], c)) for c, m in mine.items()) >= divergence:
                new[s] = (1 - sum((m - discount) / every for m in mine.values()), {(*s, c): (m - discount) / every for c, m in mine.items()})
        states |= {s: x[0] for s, x in new.items()}
        for x in new.values():
            listed |= x[1]
    out = {}
    for i, text in rows:
        w = tokens_of(text)
        out[i] = (held(i), len(w), sum(uni[c] > 0 for c in w), n, sum(math.log10(root(c)) for c in w), sum(math.log10(p(tuple(w[:j]), c)) for j, c in enumerate(w)))
    return out, states


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        x = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
        assert r.base_score == pytest.approx(x[4], rel=1e-9) and r.score == pytest.approx(x[5], rel=1e-9)


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, " \t\n"), (None, "The the THE"), (10_003, "of the " * 50_000)]
    want, states = brute(rows)
    assert len([s for s in states if len(s) == 1]) > 5 and len([s for s in states if len(s) == 2]) > 5
    compare(score_texts(spark.createDataFrame([(i, x, "", "", "") for i, x in rows], SCHEMA).repartition(5)).collect(), want)


def test_shares_decide(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    (want, few), (_, all_) = brute(rows, 2e-4, 1e-3), brute(rows)
    assert 5 < len(few) < len(all_)  # a listed pair needs more than the least count here
    compare(score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shares=Shares(2e-4, 1e-3)).collect(), want)


def test_held_out_texts_are_likelier_under_the_tree(spark):
    rows = [r for r in op8_suffix_tree(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_distributions_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a b a b a c " * 40), (2, "b a c c a b " * 40)], "doc_id long, text string")
    vocabulary = count_tokens(df)
    tree = build_tree(vocabulary, df)
    assert isinstance(tree, Tree) and len(tree.states[0][0]) and len(tree.states[1][0])
    stream = lambda text: token_stream(*_text.flat(pa.array([text])))
    for context in ("", "a", "b", "c", "a b", "b a", "c c", "zz a", "zz"):
        total = 0.1 / (tree.total + 0.1 * (tree.distinct + 1))  # the one unknown token at the root
        for word in ("a", "b", "c", "zz"):
            tokens, bounds = stream(f"{context} {word}")
            a, b = tree.steps(tokens, bounds)
            k = len(tokens) - 2
            known = np.searchsorted(tree.tokens[0], tokens[k])
            if word != "zz":
                total += a[k] + b[k] * tree.root(tree.tokens[1][known])
        tokens, bounds = stream(context)
        a, b = tree.steps(tokens, bounds)
        ends = np.asarray(vocabulary.where("n = 2").toArrow().column("n"))
        total += a[-1] + b[-1] * tree.root(ends[0])
        total += (b[-1] - 1) * 0.1 / (tree.total + 0.1 * (tree.distinct + 1))
        assert total == pytest.approx(1.0, abs=1e-12)


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    out = score_texts(spark.createDataFrame([(5, "a", "", "", "")] * 2, SCHEMA)).collect()
    assert len(out) == 2 and out[0] == out[1]


def test_what_a_tree_lists_does_not_depend_on_the_corpus(spark):
    """A passage that comes eight times is a state with what follows it, in a corpus of any size."""
    rare = "lorem ipsum dolor"
    few = [(k, rare) for k in range(100, 110)]
    many = few + [(1000 + k, "the of " * 20_000) for k in range(150)]  # some six million tokens: a share would ask for more than eight
    tree = {}
    for name, rows in (("few", few), ("many", many)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        tree[name] = build_tree(count_tokens(df), df)
    tokens, bounds = token_stream(*_text.flat(pa.array([rare])))
    for name in tree:
        a, _ = tree[name].steps(tokens, bounds)
        assert (a[1:] > 0.9).all(), name
