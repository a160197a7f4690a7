import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from sievestone.llm import _text as t
from sievestone.llm import quality_classifier as q

SCHEMA = "doc_id long, text string, score string, label int, id string, x string"
LABELS = "doc_id long, quality int, score string"


def plain_terms(text):
    """Terms one by one: their text, or None for a repeated word."""
    raw = regex.findall(rb"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~\x20\x09-\x0D]+", (text or "").encode())
    word = lambda x: not regex.match(rb"[!-/:-@\[-`{-~]", x)
    return [None if word(x) and x in raw[max(0, k - 2) : k] else x for k, x in enumerate(raw)]


def place(term):
    if term is None:
        return q.AGAIN
    data = np.frombuffer(term, np.uint8)
    return 1 + int(t.span_hashes(data, np.array([0]), np.array([len(data)]))[0] % np.uint64(q.TERMS - 1))


def plain_sums(texts):
    at, sign = q.index_vectors()
    out = np.zeros((q.TERMS, q.DIMENSIONS), np.int64)
    for text in texts:
        p = [place(x) for x in plain_terms(text)]
        for i, a in enumerate(p):
            for j in range(max(0, i - q.REACH), min(len(p), i + q.REACH + 1)):
                if j != i:
                    out[a, at[p[j]]] += sign[p[j]]
    return out


TEXTS = ["The cat, the cat *** sat on on the mat!!", None, "", "  \n\t", "a a a a", "é | ü | é | ü", "w. w. w. W", "one"] + [f"x{k % 7} y{k % 3}, z{k}" * (k % 5) for k in range(60)]


def test_terms_sums_and_pooling(spark):
    data, offsets = t.flat(pa.array(TEXTS))
    row, places = q.terms(data, offsets)
    want = [(k, place(x)) for k, text in enumerate(TEXTS) for x in plain_terms(text)]
    assert list(zip(row.tolist(), places.tolist())) == want
    sums = q.context_sums(spark.createDataFrame([(x,) for x in TEXTS], "text string").repartition(5))
    assert (sums == plain_sums(TEXTS)).all() and sums.any()
    vectors = q.word_vectors(sums)
    x = q.pooled(vectors, row, places, len(TEXTS))
    for k in range(len(TEXTS)):
        mine = [p for r, p in want if r == k]
        mean = vectors[mine].mean(0) / q.UNIT if mine else np.zeros(vectors.shape[1])
        assert np.allclose(x[k], [*mean, np.log1p(len(mine))], atol=1e-6)


def test_pieces_do_not_change_sums(monkeypatch):
    rng = np.random.default_rng(2)
    row, places = np.sort(rng.integers(0, 9, 500)), rng.integers(0, 40, 500)
    whole, parts = np.zeros(q.TERMS * q.DIMENSIONS, np.int64), np.zeros(q.TERMS * q.DIMENSIONS, np.int64)
    q.add_contexts(whole, row, places)
    vectors = q.word_vectors(whole.reshape(q.TERMS, -1))
    x = q.pooled(vectors, row, places, 9)
    monkeypatch.setattr(q, "AT_ONCE", 7)
    q.add_contexts(parts, row, places)
    assert (whole == parts).all() and (q.pooled(vectors, row, places, 9) == x).all()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(q.fit_temperature(3 * z, y) - 3) < 0.4 and abs(q.fit_temperature(z / 2, y) - 0.5) < 0.1


def test_network_learns_what_no_line_divides():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (3000, 2)).astype(np.float32)
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(int)
    net = q.fit(x[:2000], y[:2000])
    assert (((net.score(x[2000:]) > 0.5) == y[2000:]).mean()) > 0.93


@pytest.mark.parametrize("where, least", [("sf0.01", 0.93), ("sf0.1", 0.97)])
def test_held_out(spark, where, least):
    sf = f"/root/testdata/{where}"
    got = {r.doc_id: r for r in q.op12_random_indexing(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert set(got) == {r.doc_id for r in docs} and len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(got[i].score, got[i].predicted, y) for i, y in marks.items() if got[i].held_out]
    for y in (0, 1):  # each kind by itself, as most are of one
        assert np.mean([p == y for _, p, label in own if label == y]) >= least
    s, y = np.array([x[0] for x in own]), np.array([x[2] for x in own])
    assert -np.mean(np.log(np.where(y == 1, s, 1 - s).clip(1e-9))) < 0.15


def test_odd_rows(spark):
    good, bad = "plain words of some text here, and more of it.", "BUY!! NOW!! BUY!! NOW!! $$$ $$$"
    rows = [(k, f"{good} {k}" if k % 2 else f"{bad} {k}") for k in range(200)] + [(None, good), (None, bad), (301, None), (302, ""), (5, "an other text"), (7, f"{good} 7"), (400, good * 200_000)]
    labels = [(k, k % 2, "") for k in range(200)] + [(5, 0, ""), (None, 1, ""), (9, 7, ""), (999, 1, ""), (301, None, "")]
    df = spark.createDataFrame([(i, x, "", 0, "", "") for i, x in rows], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, LABELS)
    got = q.classify_quality(df, marks).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.held_out for r in by[None]] == [False, False]
    assert sorted(r.predicted for r in by[None]) == [0, 1] and by[400][0].predicted == 1
    assert by[7][0].score == by[7][1].score and by[301][0].score == by[302][0].score and len(by[5]) == 2
    again = {(r.doc_id, r.score) for r in q.classify_quality(df.repartition(7), marks).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], LABELS)
    assert q.classify_quality(none, marks).count() == 0
    df = spark.createDataFrame([(1, "a b", "", 0, "", ""), (2, None, "", 0, "", "")], SCHEMA)
    assert {r.score for r in q.classify_quality(df, marks).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, ""), (2, 1, ""), (3, 0, "")], LABELS)
    assert len({r.score for r in q.classify_quality(df, one).collect()}) == 1
