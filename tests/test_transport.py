import gzip
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.config import Engine, LimitExceeded, StreamRestoreError
from maskwright.operators.rules import MAX_NESTING, keyword_rule
from maskwright.operators.transport import gunzip, mask_requests, restore_responses
from maskwright.sources.json_body import JsonSyntaxError, encoded, parse, patched, request_texts, response_texts, strings
from maskwright.streaming.event_stream import SEGMENT, EventStreamRestorer, restore_event_chunks, restore_event_stream

TEXT = st.text(st.characters(exclude_categories=["Cs"]))
JSON = st.recursive(st.none() | st.booleans() | st.integers() | TEXT, lambda c: st.lists(c, max_size=4) | st.dictionaries(TEXT, c, max_size=4), max_leaves=20)
PHONE = {"[PHONE_1]": "13800138000"}


def value_of(node):
    if node.kind == "object":
        return {k: value_of(v) for k, v in node.value}
    return [value_of(v) for v in node.value] if node.kind == "array" else node.value if node.kind == "string" else json.loads(node.value)


@settings(max_examples=150, deadline=None)
@given(JSON, st.booleans())
def test_json_round_trip(value, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    assert value_of(parse(text)) == value
    new = patched(text, [(n.start + 1, n.end - 1, n.value + '"\u2028\n') for n in strings(parse(text))])
    assert [n.value for n in strings(parse(new))] == [n.value + '"\u2028\n' for n in strings(parse(text))]


def test_json_is_strict():
    for bad in ("", "{", "[1,]", '{"a":1,}', "01", '"\\ud800"', '"\\udc00"', "tru", "[1] x", '"\n"', '{"a" 1}', "-", "1.", "{a:1}", "\ufeff1"):
        with pytest.raises(JsonSyntaxError):
            parse(bad)
    parse("[" * 64 + "]" * 64)
    for large in ("[" * 65 + "]" * 65, "[" + "1," * 65_536 + "1]"):
        with pytest.raises(LimitExceeded):
            parse(large)
    assert encoded("\u2028/é\x01") == "\\u2028/é\\u0001" and encoded("\u2028", True) == "\u2028"
    assert [n.value for n in parse('{"a":1,"a":2}').named("a")] == ["1", "2"]


def test_order_of_texts():
    message = {"content": "a", "refusal": "b", "tool_calls": [{"function": {"arguments": "c"}, "custom": {"input": "d"}}], "function_call": {"arguments": "e"}}
    schema = {"title": "T", "description": "D", "properties": {"z": {"title": "Z"}, "b": {"title": "B"}}, "items": [{"title": "I"}], "not": {"$comment": "N"}, "allOf": [{"title": "A"}]}
    request = {"prediction": {"content": "p"}, "tools": [{"function": {"description": "f", "parameters": schema}, "custom": {"description": "g"}}], "messages": [message, {"content": [{"text": "t", "refusal": "r"}]}]}
    assert [n.value for n in request_texts(parse(json.dumps(request)))] == [*"abcdetrfDTINABZgp"]
    response = {"choices": [{"message": {**message, "audio": {"transcript": "x"}}}]}
    assert [n.value for n in response_texts(parse(json.dumps(response)))] == [*"abcdex"]


def test_gunzip():
    body = gzip.compress(b"abc") + gzip.compress(b"def")
    assert gunzip(body, 6) == b"abcdef"
    with pytest.raises(LimitExceeded):
        gunzip(body, 5)
    for bad in (body[:-3], body + b"x", b"abc"):
        with pytest.raises(Exception, match="Error|incomplete|incorrect"):
            gunzip(bad, 100)


def http(spark, rows, fields):
    return spark.createDataFrame(rows, f"request_id int, {fields}, headers array<struct<name:string,value:string>>, body binary")


KIND = ("Content-Type", "application/json")
BODY = '{"user":"a@b.co", "messages":[{"content":"a@b.co \\u0031"}]}'.encode()
MASKED = b'{"user":"a@b.co", "messages":[{"content":"[EMAIL_1] 1"}]}'


def test_requests(spark):
    rows = [
        (1, "POST", [KIND, ("X", "y")], BODY),
        (2, "GET", [KIND], BODY),
        (3, "post", [KIND, ("content-encoding", "gzip"), ("Transfer-Encoding", "chunked")], gzip.compress(BODY)),
        (4, "POST", [KIND, ("Digest", "x")], BODY),
        (5, "POST", [KIND], b" \n"),
        (6, "POST", [KIND], b"{"),
        (7, "POST", [("content-type", "Application/JSON ; x=1")], b'{"messages":[{"content":"none"}]}'),
        (8, "POST", [KIND, KIND], BODY),
        (9, "POST", None, None),
        (10, "POST", [KIND, ("Content-Encoding", "gzip, br")], BODY),
        (11, "POST", [KIND], b" " * 200),
        (12, "POST", [KIND], b"[1]"),
        (13, "POST", [KIND], b'{"messages":[{"content":"\xff"}]}'),
    ]
    engine = Engine().with_limits(max_input_bytes=150)
    out, known = mask_requests(http(spark, rows, "method string"), engine)
    got = {r["request_id"]: r for r in out.collect()}
    assert [got[i]["outcome"] for i in range(1, 14)] == ["masked", "bypass", "masked", "failed", "bypass", "failed", "same", "bypass", "bypass", "bypass", "failed", "same", "failed"]
    assert bytes(got[1]["out_body"]) == bytes(got[3]["out_body"]) == MASKED
    assert [tuple(h) for h in got[1]["out_headers"]] == [KIND, ("X", "y"), ("Content-Length", str(len(MASKED)))]
    assert [tuple(h) for h in got[3]["out_headers"]] == [KIND, ("Content-Length", str(len(MASKED)))]
    assert bytes(got[7]["out_body"]) == rows[6][3] and got[4]["out_body"] is None and got[9]["out_body"] is None
    assert [(e["entity"], e["replacement"]) for e in got[1]["mask_events"]] == [("EMAIL", "[EMAIL_1]")]
    assert {(r["request_id"], r["plaintext"]) for r in known.collect()} >= {(1, "a@b.co"), (3, "a@b.co")}
    again, _ = mask_requests(http(spark, rows, "method string"), engine, passthrough=True)
    assert {r["request_id"]: r["outcome"] for r in again.collect()}[6] == "bypass"


def test_responses(spark):
    body = b'{"id":"[EMAIL_1]","choices":[{"message":{"content":"[EMAIL_1] \\/ [X_9]"}}]}'
    rows = [
        (1, 200, [KIND, ("ETag", "x")], body),
        (2, 206, [KIND], body),
        (3, 200, [KIND, ("Signature", "s")], body),
        (4, 200, [("Content-Type", "text/event-stream")], b"data: x\n\n"),
        (5, 200, [KIND], b"nope"),
        (6, 200, [("Content-Type", "text/plain")], body),
        (7, 200, [KIND, ("Signature", "s")], b'{"choices":[{"message":{"content":"[X_9]"}}]}'),
        (8, 200, [KIND], b""),
    ]
    known = spark.createDataFrame([(i, "[EMAIL_1]", 'q"x') for i in range(9)], "request_id int, placeholder string, plaintext string")
    got = {r["request_id"]: r for r in restore_responses(http(spark, rows, "status int"), known).collect()}
    assert [got[i]["outcome"] for i in range(1, 9)] == ["restored", "failed", "failed", "event_stream", "failed", "bypass", "same", "same"]
    assert bytes(got[1]["out_body"]) == b'{"id":"[EMAIL_1]","choices":[{"message":{"content":"q\\"x / [X_9]"}}]}'
    assert [h["name"] for h in got[1]["out_headers"]] == ["Content-Type", "Content-Length"] and got[2]["out_headers"] == []
    assert [e["restored"] for e in got[1]["restore_events"]] == [True, False] and len(got[7]["restore_events"]) == 1


def test_no_requests(spark):
    out, known = mask_requests(http(spark, [], "method string"))
    assert out.count() == known.count() == 0


def streamed(*chunks, mapping=PHONE, engine=None):
    """Segments of a stream, with a new restorer from the state after each chunk."""
    own, out = EventStreamRestorer(mapping, engine), []
    for c in chunks:
        out += own.feed(c)
        own = EventStreamRestorer(mapping, engine, own.state())
    return out + own.finish()


def body(segments):
    return b"".join(b for b, _ in segments)


SPLIT = b'data: {"choices":[{"index":0,"delta":{"content":"x [PHO"}}]}\r\n\r\nevent: e\r\ndata: {"choices":[{"index":0,"delta":{"content":"NE_1]"},"finish_reason":"stop"}]}\r\n\r\n'


def test_event_stream():
    one = b'data: {"choices":[{"index":0,"delta":{"content":"call [PHONE_1]"}}]}\n\n'
    assert streamed(one) == [(one.replace(b"[PHONE_1]", b"13800138000"), [("PHONE", "[PHONE_1]", True)])]
    for same in (b": heartbeat\n\n", b"data: [DONE]\n\n", b"\xef\xbb\xbfid: 1\r\r", b"data: 1"):
        assert body(streamed(same)) == same
    want = b'data: {"choices":[{"index":0,"delta":{"content":"x "}}]}\r\n\r\ndata: {"choices":[{"index":0,"delta":{"content":"13800138000"}}]}\r\n\r\nevent: e\r\ndata: {"choices":[{"index":0,"delta":{"content":""},"finish_reason":"stop"}]}\r\n\r\n'
    assert all(body(streamed(SPLIT[:i], SPLIT[i:])) == want for i in range(len(SPLIT)))
    two = b'data: {"choices":[{"index":0,\ndata: "delta":{"content":"\\u0078 [SSN_9] \\/ "}}]}\n\n'
    assert streamed(two) == [(two.replace(b"\ndata: ", b" "), [("SSN", "[SSN_9]", False)])]
    tool = b'data: {"choices":[{"delta":{"tool_calls":[{"index":2,"id":"q","function":{"name":"f","arguments":"PHONE_1"}}]}}]}\n\n'
    assert body(streamed(tool, b"data: [DONE]\n\n")) == tool.replace(b"PHONE_1", b"") + tool.replace(b"PHONE_1", b"13800138000") + b"data: [DONE]\n\n"
    # two tool calls of one event with the same index are streams of their own
    pair = b'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"[PHONE"}},{"index":0,"function":{"arguments":"_1]"}}]}}]}\n\n'
    assert body(streamed(pair)).count(b"13800138000") == 0


def test_event_stream_segments_and_limits():
    plain = "y" * 40_000
    one = b'data: {"choices":[{"delta":{"content":"[PHONE_1] [PHONE_2]"}}]}\n\n'
    out = streamed(one, mapping={"[PHONE_1]": plain, "[PHONE_2]": "z"})
    assert [len(b) for b, _ in out][:-1] == [SEGMENT] * (len(out) - 1) and [len(e) for _, e in out] == [0, 0, 2]
    stream = EventStreamRestorer(PHONE)
    with pytest.raises(StreamRestoreError):
        for i in range(257):
            stream.feed(b'data: {"choices":[{"index":%d,"delta":{"content":"a"}}]}\n\n' % i)
    with pytest.raises(StreamRestoreError):
        stream.feed(b"")
    for bad in (b"data: {\n\n", b"\xff\n\n", b"\xe4\xb8"):
        with pytest.raises(StreamRestoreError):
            streamed(bad)


SCHEMA = "stream_id string, chunk_no long, chunk binary, is_eof boolean, mapping map<string,string>"


def test_event_chunks(spark):
    rows = [("s", 1, SPLIT[40:], True, None), ("s", 0, SPLIT[:40], False, PHONE), ("t", 0, b"data: {\n\n", True, {})]
    got = restore_event_chunks(spark.createDataFrame(rows, SCHEMA)).orderBy("stream_id", "chunk_no", "segment_no").collect()
    assert b"".join(bytes(r["bytes"]) for r in got if r["stream_id"] == "s") == body(streamed(SPLIT))
    assert [r["error"] for r in got if r["stream_id"] == "t"] == ["StreamRestoreError"]


def test_event_stream_in_spark(spark, tmp_path):
    rows = [("s", 1, SPLIT[40:], True, None), ("s", 0, SPLIT[:40], False, PHONE)]
    for i, row in enumerate(rows):  # the later chunk is there first
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = restore_event_stream(source).writeStream.format("memory").queryName("events_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("select * from events_out").orderBy("chunk_no", "segment_no").collect()
    assert b"".join(bytes(r["bytes"]) for r in got) == body(streamed(SPLIT))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab.\\E中", min_size=1, max_size=5), min_size=1, max_size=30), st.text("ab.\\E中", max_size=40))
def test_keyword_tree(words, text):
    """The tree's matches are those of the plain list, longest first."""
    in_python = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), p.replace(r"\E\\E\Q", "\0"), flags=re.S).replace("\0", r"\\E"))
    plain = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    assert re.findall(in_python(keyword_rule(tuple(words)).pattern), text) == re.findall(plain, text)


def test_keywords_in_spark(spark):
    words = [f"word{i}" for i in range(2000)] + ["a" * i for i in range(1, MAX_NESTING + 50)] + [r"x\Ey", "x", "中文"]
    rows = spark.createDataFrame([("word19 word1999 word2000x", 1), (r"x\Ey x 中文 aaaa", 2)], "text string, id int")
    from maskwright.operators.mask import findings

    for own in (words, [w for w in words if w.strip("a")] + ["a", "aaaa"]):
        got = findings(rows, Engine().with_recognizers().with_keywords(*own), keep=("id",)).orderBy("id", "start").collect()
        assert [r["match"] for r in got] == ["word19", "word1999", "word200", "x", r"x\Ey", "x", "中文", "aaaa"]
