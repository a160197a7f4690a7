import re
from collections import Counter, defaultdict

from sievestone.llm import quality_rules
from sievestone.llm.quality_rules import keep_good, line_frequency_verdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rows string"


def brute(rows, min_docs, max_share, min_words_left=20, min_share_left=0.3):
    holders, texts = defaultdict(lambda: defaultdict(set)), defaultdict(dict)
    for i, text, host in rows:
        texts[host][text or ""] = min(i, texts[host].get(text or "", i))
    for host, kinds in texts.items():
        for text, i in kinds.items():
            for line in text.split("\n"):
                if w := WORD.findall(line):
                    holders[host][" ".join(w).translate(LOWER)].add(i)
    out = set()
    for i, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        n = Counter(windows)
        rep = len({j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 8)})
        seen, dup, taken = set(), 0, {}
        for line in text.split("\n"):
            if w := WORD.findall(line):
                dup += line in seen
                seen.add(line)
                key = " ".join(w).translate(LOWER)
                who = holders[host][key]
                if len(who) > max(min_docs, max_share * len(texts[host])) and min(who) != i:
                    taken[len(seen), dup] = len(w)
        failed = len(words) < 20 or 100 * rep > 30 * len(words)
        gone = sum(taken.values())
        left = len(words) - gone
        depleted = gone > 0 and (left < min_words_left or left < min_share_left * len(words))
        out.add((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, rep, gone, failed, not failed and not depleted))
    return out


LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return {tuple(r) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept").collect()}


def test_against_brute_force(spark):
    shared = "Every page of this host says so\nand says it in two lines of text."
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    rows = [(i, f"{shared}\n{own(i)}\n{own(i + 100)}\n{own(i)}", "a") for i in range(8)]
    rows += [(20 + i, shared.upper() + "\n  \n" + "x y " * (i + 1), "a") for i in range(6)]
    rows += [(30, own(30), "b"), (31, own(30), "b"), (32, None, "b"), (33, "", None), (34, "\n\n", None), (35, "é ß " * 40 + "\n##<\n", "c")]
    rows += [(40, " ".join(["a b c d e f g h"] * 3) + " " + own(40) + "\n" + own(41) + "\n\n" + own(41), None)]
    rows += [(50, "long " * 60000, "c"), (51, own(1) + "\n", "a"), (52, "\t" + own(52) + "\r\nz", "a")]
    df = spark.createDataFrame([(i, x, "en", h, 0, "clash") for i, x, h in rows], SCHEMA).repartition(5)
    for least, share in ((3, 0.0), (2, 0.5), (50, 0.02)):
        assert rows_of(line_frequency_verdict(df, min_docs=least, max_share=share)) == brute(rows, least, share)


def test_on_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert rows_of(line_frequency_verdict(df, min_docs=1)) == brute(rows, 1, 0.02)


def test_empty_and_repeated_rows(spark):
    assert line_frequency_verdict(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, "en", "a", 0, ""), (1, text, "en", "a", 0, ""), (2, text + " z", "en", "a", 0, "")], SCHEMA)
    out = line_frequency_verdict(df, min_docs=0, max_share=0.0)
    assert out.count() == 3


def test_frequent_lines_go_from_the_text(spark):
    shared = "Every page of this host says so"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    rows = [(i, f"{shared}\n{own(i)}\n\n  every PAGE\tof this host says so \né {own(i + 100)}\n{shared}", "a" if i < 9 else None) for i in range(18)]
    rows += [(30, f"{own(30)}\n{shared}", "a"), (31, own(31) + "\n", "a"), (32, shared, "a"), (33, f"{own(33)}\n{shared}", "b")]
    rows += [(None, own(40), "a"), (None, own(41), None), (None, "too short", "a"), (30, own(42), "a"), (30, "short as well", "a")]
    df = spark.createDataFrame([(i, x, "en", h, len(x), "clash") for i, x, h in rows], SCHEMA).repartition(5)
    got = keep_good(df, min_docs=5, max_share=0.0)
    assert got.dtypes == df.dtypes
    verdict = line_frequency_verdict(df, min_docs=5, max_share=0.0)
    removed = {r.doc_id: r.n_removed_words for r in verdict.where("doc_id < 30").collect()}
    left = [f"{own(i)}\n\né {own(i + 100)}\n" for i in range(18)]
    want = [(i, rows[i][1] if i in (0, 9) else left[i], rows[i][2]) for i in range(18)]
    want += [(30, own(30) + "\n", "a"), rows[19], rows[21], rows[22], rows[23], rows[25]]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) and r.rows == "clash" for r in got.collect())
    words = {i: len(WORD.findall(x)) for i, x, _ in want if i is not None and i < 30}
    assert all(words[i] == len(WORD.findall(rows[i][1])) - removed[i] for i in words)


def test_texts_are_not_shuffled(spark, monkeypatch):
    """The rows kept are those of the join, and no exchange or join has the texts."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i % 50 if i % 9 else None, f"said by all\n{own(i) if i % 7 else 'short'}\n" + "again and again\n" * (i % 3) + own(i)[: 90 * (i % 4)], "ab"[i % 2] if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame([(i, x, "en", h, len(x), "") for i, x, h in rows + rows[:20]], SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        here = keep_good(df, min_docs=5, max_share=0.0)
        monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
        joined = keep_good(df, min_docs=5, max_share=0.0)
        key = lambda r: str(tuple(r))
        assert sorted(map(key, here.collect())) == sorted(map(key, joined.collect()))
        assert 0 < here.count() < 140
        plan = here._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
