import hashlib

from sievestone.llm.chat_format import PROBE, digests, format_turns, op10_typed_parts, parse_segment

SCHEMA = "conv_id long, turn long, role string, text string, segment string, attachments string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(x or "" for _, _, role, x in mine if role == "assistant")
        every = "".join(f"{role or ''}\n{x or ''}\n" for _, _, role, x in mine)
        out[conv] = (len(mine), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_typed_parts(spark, "/root/testdata/sf0.001").collect()}
    assert got == expected(rows)


def test_control_strings_nulls_and_long_texts(spark):
    odd = ["", None, "\\", "[", "<", "\\\\[<|image:0:5|>", "</s>", "[/INST] [INST]", "[ROLE=x] y [/ROLE]", "é\U0001f600\n\n", " [/INST]", "x" * 200_000, "\r\n \t"]
    rows = [(1, k, role, text) for k, (role, text) in enumerate((r, x) for r in ("user", "assistant", "system", None, "[a]\\b=]", "") for x in odd)]
    rows += [(2, k, "assistant", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(5)
    segments = format_turns(df)
    for r in segments.where("conv_id = 1").collect():
        turn = parse_segment(r.segment)
        assert (turn.role, turn.text) == (rows[r.turn][2] or "", rows[r.turn][3] or "")
        assert r.segment[r.loss_from : r.loss_to] == "" or turn.role == "assistant"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(segments).collect()}
    assert got == expected(rows)


def test_typed_parts(spark):
    part = "struct<type:string,text:string,uri:string,tokens:int>"
    rows = [
        (1, 0, "user", [("text", "see <this> ", None, None), ("image", None, "s3://a.png", None), ("text", " and ", None, None), ("audio", None, "b.wav", 90), ("document", None, None, None), ("text", None, None, None)]),
        (1, 1, "assistant", [("text", "a [reply]", None, None)]), (1, 2, "user", None), (1, 3, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    got = format_turns(df, text_col="role", parts_col="parts").orderBy("turn").collect()
    assert got[0].segment == "[INST] see \\<this> <|image:1:576|> and <|audio:3:90|><|document:4:1024|> [/INST]"
    assert [(a.type, a.place, a.uri, a.tokens) for a in got[0].attachments] == [("image", 1, "s3://a.png", 576), ("audio", 3, "b.wav", 90), ("document", 4, None, 1024)]
    assert got[0].attachment_tokens == 1690 and got[2].segment == got[3].segment == "[INST]  [/INST]" and got[2].attachments == []
    turn = parse_segment(got[0].segment)
    assert turn.text == "see <this>  and " and turn.parts == [("image", 1, 576), ("audio", 3, 90), ("document", 4, 1024)]
    assert got[1].segment[got[1].loss_from : got[1].loss_to] == "a \\[reply]"


def test_empty_and_repeated(spark):
    assert digests(format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a", "", "")] * 2, SCHEMA)
    assert digests(format_turns(df)).first().n_turns == 2
