"""Queries at the operators' edges: gates, limits, strategies, bodies and streams, over texts made from keys, and their SQL."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.config import Engine, Recognizer, Rule
from maskwright.operators import rules as R
from maskwright.operators.mask import mask
from maskwright.operators.restore import restore
from maskwright.operators.session import anonymize
from maskwright.operators.transport import mask_requests, restore_responses
from maskwright.streaming.event_stream import restore_event_chunks
from maskwright.streaming.stream import restore_chunks

MAIL, MAIL_SQL = "concat('c', cast(c_custkey as string), '@example.com')", "concat('c', c_custkey, '@example.com')"
ORDER_MAIL, ORDER_MAIL_SQL = MAIL.replace("c_custkey", "o_custkey"), MAIL_SQL.replace("c_custkey", "o_custkey")
JSON_TYPE = "named_struct('name', 'Content-Type', 'value', 'application/json')"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


@_query(
    f"""select c_custkey as id, case when c_custkey % 5 <> 0 and c_custkey % 60 + length({MAIL_SQL}) <= 64 then concat('[EMAIL_1] ', repeat('a', cast(c_custkey % 60 as int) - 1)) end as masked,
 case when c_custkey % 5 = 0 then 'InvalidUTF8' when c_custkey % 60 + length({MAIL_SQL}) > 64 then 'LimitExceeded' end as error from customer where c_custkey % 60 > 0"""
)
def input_gates(spark, sf_dir):
    """Texts that are not UTF-8 come first, then those over the input limit; neither is looked at."""
    text = f"if(c_custkey % 5 = 0, cast(unhex(concat(repeat('61', 100), 'C3')) as string), concat({MAIL}, ' ', repeat('a', cast(c_custkey % 60 as int) - 1))) as text"
    rows = _read(spark, sf_dir, "customer", "c_custkey as id", text).filter("id % 60 > 0")
    return mask(rows, Engine().with_recognizers(R.EMAIL).with_limits(max_input_bytes=64)).select("id", "masked", "error")


@_query(f"select c_custkey as id, case when 10 + length(c_name) <= 28 then concat('[EMAIL_1] ', c_name) end as masked, case when 10 + length(c_name) > 28 then 'LimitExceeded' end as error from (select c_custkey, concat(c_name, repeat('x', cast(c_custkey % 9 as int))) as c_name from customer)")
def output_limit(spark, sf_dir):
    """The size of the masked text is held against its limit."""
    rows = _read(spark, sf_dir, "customer", "c_custkey as id", f"concat({MAIL}, ' ', c_name, repeat('x', cast(c_custkey % 9 as int))) as text")
    return mask(rows, Engine().with_recognizers(R.EMAIL).with_limits(max_output_bytes=28)).select("id", "masked", "error")


@_query("select r_regionkey as id, case when r_regionkey > 1 then 0 else 2999 + r_regionkey end as n_events, case when r_regionkey > 1 then 'LimitExceeded' end as error from region")
def raw_candidate_cap(spark, sf_dir):
    """More raw matches than 3000 in a text are an error, before any of them is dropped."""
    rows = _read(spark, sf_dir, "region", "r_regionkey as id", "repeat('a@b.co ', cast(2999 + r_regionkey as int)) as text")
    return mask(rows, Engine().with_recognizers(R.EMAIL)).select("id", F.size("events").cast("long").alias("n_events"), "error")


_FAMILIES = R._FENCES.split("|")
_FAMILY = "['" + "', '".join(_FAMILIES) + "']"
_KEY = "concat('key ', '-----BEGIN ', a, '-----', {nl}, c_name, {nl}, '-----END ', b, '----- end')"
_KEYS_SQL = f"select c_custkey as id, {_FAMILY}[cast(c_custkey % 7 + 1 as int)] as a, {_FAMILY}[cast((c_custkey + (c_custkey % 3) // 2) % 7 + 1 as int)] as b, c_name from customer"


@_query(f"select id, case when a = b then 'key [PRIVATEKEY_1] end' else {_KEY.format(nl='chr(10)')} end as masked from ({_KEYS_SQL})")
def private_keys(spark, sf_dir):
    """A key block ends with the fence of its own family; a beginning without such an end is none."""
    names = "array('" + "', '".join(_FAMILIES) + "')"
    rows = _read(spark, sf_dir, "customer", "c_custkey as id", "c_name", f"get({names}, cast(c_custkey % 7 as int)) as a", f"get({names}, cast((c_custkey + (c_custkey % 3) div 2) % 7 as int)) as b")
    text = _KEY.format(nl="chr(10)")
    return mask(rows.selectExpr("id", f"{text} as text"), Engine().with_recognizers(R.SECRET)).select("id", "masked")


_HEX = "md5(cast(c_custkey as {}))"
_TOKEN_CASES = [
    ("CLOUDKEY", "concat('AKIA', upper(substring({0}, 1, 16)))"),
    ("JWT", "concat('eyJ', {0}, '.', substring({0}, 1, 9), '.', substring({0}, 5, 11))"),
    ("GITTOKEN", "concat('ghp_', {0}, substring({0}, 1, 4))"),
    ("GITTOKEN", "concat('glpat-', substring({0}, 1, 20))"),
    ("", "concat('AKIA', upper(substring({0}, 1, 15)))"),
    ("", "concat('eyJ', {0}, '.', substring({0}, 1, 9))"),
]


def _token_case(kind: str, masked: bool) -> str:
    h = _HEX.format(kind)
    cases = " ".join(f"when {i} then " + (f"'[{e}_1]'" if masked and e else t.format(h)) for i, (e, t) in enumerate(_TOKEN_CASES))
    return f"concat('use ', case c_custkey % {len(_TOKEN_CASES)} {cases} end, ' now')"


@_query(f"select c_custkey as id, {_token_case('varchar', True)} as masked from customer")
def cloud_keys_and_tokens(spark, sf_dir):
    """Cloud keys, signed tokens and repository tokens, and look-alikes that are too short."""
    return mask(_read(spark, sf_dir, "customer", "c_custkey as id", f"{_token_case('string', False)} as text"), Engine().with_recognizers(R.SECRET)).select("id", "masked")


@_query("select c_custkey as id, concat('see https://example.com/', case when c_custkey % 2 = 0 then '[CLOUDKEY_1]' else concat('AKIA', c_custkey) end, case when c_custkey % 2 = 0 then ' end' else ' end' end) as masked from customer where c_custkey % 2 = 0 union all select c_custkey, 'see [URL_1] end' from customer where c_custkey % 2 = 1")
def secrets_before_urls(spark, sf_dir):
    """A secret inside a longer address wins; without one the address is found."""
    key = "if(c_custkey % 2 = 0, concat('AKIA', upper(substring(md5(cast(c_custkey as string)), 1, 16))), concat('AKIA', cast(c_custkey as string)))"
    return mask(_read(spark, sf_dir, "customer", "c_custkey as id", f"concat('see https://example.com/', {key}, ' end') as text")).select("id", "masked")


_ORDER_RULE = Rule("order_no", "ORDERNO", "ORD-[0-9]+", 0.9, predicate=lambda m: m.rlike("[02468]$"))


@_query("select o_orderkey as id, case when o_orderkey % 2 = 0 then 'pay [ORDERNO_1] now' else concat('pay ORD-', o_orderkey, ' now') end as masked from orders")
def custom_rule(spark, sf_dir):
    """A rule of the user's own, with an entity and a predicate of its own."""
    engine = Engine().with_entity_type("ORDERNO").with_recognizers(_ORDER_RULE)
    return mask(_read(spark, sf_dir, "orders", "o_orderkey as id", "concat('pay ORD-', cast(o_orderkey as string), ' now') as text"), engine).select("id", "masked")


def _segment(text):
    """What stands between << and >>, once a text."""
    start, end = F.instr(text, F.lit("<<")), F.instr(text, F.lit(">>"))
    own = F.substr(text, start + 2, end - start - 2)
    head = F.octet_length(F.left(text, start + 1))
    one = F.struct(F.lit("SEGMENT").alias("entity"), head.alias("start"), (head + F.octet_length(own)).alias("end"), F.lit(0.5).cast("double").alias("score"), own.alias("text"))
    return F.when((start > 0) & (end > start + 2), F.array(one))


@_query("select c_custkey as id, concat('é <<', case when c_mktsegment is null then '' else '[SEGMENT_1]' end, '>> ', c_custkey) as masked from customer")
def custom_recognizer(spark, sf_dir):
    """A recognizer by function; its places are bytes."""
    engine = Engine().with_entity_type("SEGMENT").with_recognizers(Recognizer("segment", _segment))
    return mask(_read(spark, sf_dir, "customer", "c_custkey as id", "concat('é <<', coalesce(c_mktsegment, ''), '>> ', cast(c_custkey as string)) as text"), engine).select("id", "masked")


@_query(f"select c_custkey as id, concat('to <', upper(reverse({MAIL_SQL})), ':1>') as masked from customer")
def custom_strategy(spark, sf_dir):
    """A strategy by function of entity, plaintext and number."""
    engine = Engine().with_strategy("EMAIL", lambda e, t, n: F.concat(F.lit("<"), F.upper(F.reverse(t)), F.lit(":"), n.cast("string"), F.lit(">")))
    return mask(_read(spark, sf_dir, "customer", "c_custkey as id", f"concat('to ', {MAIL}) as text"), engine).select("id", "masked")


@_query("select o_custkey as session, o_orderkey as call, concat('to [EMAIL_', row_number() over (partition by o_custkey order by o_orderkey), ']') as masked from orders")
def redacted_numbering(spark, sf_dir):
    """What is not reversible takes a new number each time, repeats too."""
    rows = _read(spark, sf_dir, "orders", "o_custkey as session", "o_orderkey as call", f"concat('to ', {ORDER_MAIL}) as text")
    return anonymize(rows, "session", "call", engine=Engine().with_strategy("EMAIL", "redact")).select("session", "call", "masked")


@_query("with t as (select c_nationkey as session, c_custkey as call, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) select session, call, case when rn <= 2 then concat('[EMAIL_', rn, '] [PHONE_', rn, ']') end as masked, case when rn > 2 then 'LimitExceeded' end as error from t")
def session_entity_limit(spark, sf_dir):
    """Two findings a call: the third call of a session would pass the limit of five, and leaves no trace."""
    tel = "concat('138', lpad(cast(c_custkey as string), 8, '0'))"
    rows = _read(spark, sf_dir, "customer", "c_nationkey as session", "c_custkey as call", f"concat({MAIL}, ' ', {tel}) as text")
    return anonymize(rows, "session", "call", engine=Engine().with_limits(max_entities=5)).select("session", "call", "masked", "error")


@_query(f"with t as (select c_nationkey as session, c_custkey as call, length({MAIL_SQL}) as n from customer), s as (select *, sum(n) over (partition by session order by call) as upto from t) select session, call, case when upto <= 60 then concat('[EMAIL_', row_number() over (partition by session order by call), ']') end as masked, case when upto > 60 then 'LimitExceeded' end as error from s")
def session_bytes_limit(spark, sf_dir):
    """The plaintexts that a session remembers have a limit in bytes; every key's text is of about one size."""
    rows = _read(spark, sf_dir, "customer", "c_nationkey as session", "c_custkey as call", f"{MAIL} as text")
    return anonymize(rows, "session", "call", engine=Engine().with_limits(max_session_bytes=60)).select("session", "call", "masked", "error")


@_query("select n_nationkey as id, concat('a [EMAIL_2] b ', n_name, ' c [EMAIL_3]') as restored, cast(2 as bigint) as n_restored from nation")
def restored_text_is_not_read_again(spark, sf_dir):
    """A plaintext that looks like a placeholder stays."""
    rows = _read(spark, sf_dir, "nation", "n_regionkey as session", "n_nationkey as id", "concat('a [EMAIL_1] b ', n_name, ' c EMAIL_001】') as text")
    rows = rows.withColumn("text", F.replace("text", F.lit("EMAIL_001】"), F.lit("[EMAIL_2]")))
    known = _read(spark, sf_dir, "region", "r_regionkey as session", "explode(map('[EMAIL_1]', '[EMAIL_2]', '[EMAIL_2]', '[EMAIL_3]')) as (placeholder, plaintext)")
    return restore(rows, known, "session").select("id", "restored", F.size(F.filter("restore_events", lambda e: e["restored"])).cast("long").alias("n_restored"))


@_query("select r_regionkey as id, case when r_regionkey = 0 then repeat('[A_1]', 3) end as restored, case when r_regionkey > 0 then 'LimitExceeded' end as error from region")
def restore_event_cap(spark, sf_dir):
    """A text with more tokens than 65536 is refused."""
    rows = _read(spark, sf_dir, "region", "r_regionkey as id", "0 as session", "repeat('[A_1]', cast(if(r_regionkey = 0, 3, 65536 + r_regionkey) as int)) as text")
    known = _read(spark, sf_dir, "region", "1 as session", "'[B_1]' as placeholder", "r_name as plaintext")
    return restore(rows, known, "session").select("id", "restored", "error")


@_query("select n_nationkey as id, case when n_nationkey % 2 = 0 then n_name end as restored, case when n_nationkey % 2 = 1 then 'AmbiguousMapping' end as error from nation")
def repeated_mapping_rows(spark, sf_dir):
    """Rows of the mapping that say the same count once; two plaintexts for one placeholder are an error."""
    rows = _read(spark, sf_dir, "nation", "n_nationkey as session", "n_nationkey as id", "'[X_1]' as text")
    known = _read(spark, sf_dir, "nation", "n_nationkey as session", "'[X_1]' as placeholder", "explode(array(n_name, if(n_nationkey % 2 = 0, n_name, lower(n_name)))) as plaintext")
    return restore(rows, known, "session").select("id", "restored", "error")


# ---- requests and responses ---------------------------------------------------------------------


def _requests(spark, sf_dir, body: str, headers: str = f"array({JSON_TYPE})", method: str = "'POST'") -> DataFrame:
    return _read(spark, sf_dir, "customer", "c_custkey as request_id", f"{method} as method", f"{headers} as headers", f"{body} as body")


_CHAT = """encode(concat('{{"messages":[{{"content":"', {0}, '"}}]}}'), 'UTF-8')"""
_CHAT_SQL = """concat('{{"messages":[{{"content":"', {0}, '"}}]}}')"""
_GATES = [("'POST'", "'Application/JSON; charset=utf-8'", "''"), ("'GET'", "'application/json'", "''"), ("'post'", "'text/plain'", "''"), ("'POST'", "'application/json'", "'br'"), ("'POST'", "'application/json'", "'gzip, gzip'"), ("'POST'", "'application/json-seq'", "''"), ("'POST'", "'application/json'", "'Identity'")]
_PICK = lambda k: f"get(array({', '.join(g[k] for g in _GATES)}), cast(c_custkey % {len(_GATES)} as int))"


@_query(f"select c_custkey as request_id, case when c_custkey % 11 = 0 then 'bypass' when c_custkey % 7 in (0, 6) then 'masked' else 'bypass' end as outcome, case when c_custkey % 11 = 0 then concat(' ', chr(10)) when c_custkey % 7 in (0, 6) then '{{\"messages\":[{{\"content\":\"[EMAIL_1]\"}}]}}' else {_CHAT_SQL.format(MAIL_SQL)} end as body from customer")
def request_gates(spark, sf_dir):
    """Method, one exact media type, one known encoding, and a body that is not blank."""
    headers = f"array(named_struct('name', 'content-type', 'value', {_PICK(1)}), named_struct('name', 'CONTENT-ENCODING', 'value', {_PICK(2)}))"
    body = f"if(c_custkey % 11 = 0, encode(concat(' ', chr(10)), 'UTF-8'), {_CHAT.format(MAIL)})"
    out, _ = mask_requests(_requests(spark, sf_dir, body, headers, _PICK(0)))
    return out.select("request_id", "outcome", F.decode("out_body", "UTF-8").alias("body"))


_PLAIN = b'{"messages":[{"content":"to a@example.com"}]}'
_ZIPPED = gzip.compress(_PLAIN[:20], mtime=0) + gzip.compress(_PLAIN[20:], mtime=0)


@_query("""select c_custkey as request_id, case c_custkey % 3 when 0 then 'masked' when 1 then 'failed' else 'failed' end as outcome, case when c_custkey % 3 = 0 then '{"messages":[{"content":"to [EMAIL_1]"}]}' end as body, cast(case when c_custkey % 3 = 0 then 2 end as bigint) as n_headers, case c_custkey % 3 when 1 then 'InvalidRequest: gzip' when 2 then 'InvalidRequest: gzip' end as error from customer""")
def gzip_requests(spark, sf_dir):
    """Bodies of two gzip members; what follows the last one, or a member that is cut, is an error."""
    headers = f"array({JSON_TYPE}, named_struct('name', 'Content-Encoding', 'value', 'gzip'))"
    body = f"case c_custkey % 3 when 0 then X'{_ZIPPED.hex()}' when 1 then X'{_ZIPPED.hex()}0102' else X'{_ZIPPED[:-4].hex()}' end"
    out, _ = mask_requests(_requests(spark, sf_dir, body, headers))
    return out.select("request_id", "outcome", F.decode("out_body", "UTF-8").alias("body"), F.when(F.col("out_headers").isNotNull(), F.size("out_headers")).cast("long").alias("n_headers"), "error")


@_query("select c_custkey as request_id, case when c_custkey % 2 = 0 then 'failed' else 'same' end as outcome, case when c_custkey % 2 = 0 then 'InvalidRequest: signed body' end as error from customer")
def signed_requests(spark, sf_dir):
    """A signed body may pass as it is, but must not be changed."""
    headers = f"array({JSON_TYPE}, named_struct('name', 'Digest', 'value', 'x'))"
    out, _ = mask_requests(_requests(spark, sf_dir, _CHAT.format(f"if(c_custkey % 2 = 0, {MAIL}, 'none')"), headers))
    return out.select("request_id", "outcome", "error")


@_query(f"select c_custkey as request_id, case when length(body) > 60 then 'failed' when out > 62 then 'failed' else 'masked' end as outcome, case when length(body) > 60 then 'InvalidRequest: body size' when out > 62 then 'InvalidRequest: output size' end as error from (select *, length(body) - length({MAIL_SQL}) + 9 as out from (select c_custkey, {_CHAT_SQL.format(f'{MAIL_SQL}, repeat(chr(32), cast(c_custkey % 30 as int))')} as body from customer))")
def bounded_requests(spark, sf_dir):
    """A body over the input limit is not read."""
    body = _CHAT.format(f"concat({MAIL}, repeat(' ', cast(c_custkey % 30 as int)))")
    out, _ = mask_requests(_requests(spark, sf_dir, body), Engine().with_limits(max_input_bytes=60, max_output_bytes=62))
    return out.select("request_id", "outcome", "error")


@_query("""select c_custkey as request_id, case when c_custkey % 2 = 0 then 'bypass' else 'same' end as open_outcome, case when c_custkey % 2 = 0 then 'failed' else 'same' end as strict_outcome from customer""")
def broken_json_requests(spark, sf_dir):
    """A broken body fails, or with passthrough is forwarded as it is."""
    body = "encode(if(c_custkey % 2 = 0, '{\"messages\":[}', '{\"messages\":[]}'), 'UTF-8')"
    open_, _ = mask_requests(_requests(spark, sf_dir, body), passthrough=True)
    strict, _ = mask_requests(_requests(spark, sf_dir, body))
    return open_.select("request_id", F.col("outcome").alias("open_outcome")).join(strict.select("request_id", F.col("outcome").alias("strict_outcome")), "request_id")


_SCHEMA = """{"tools":[{"function":{"name":"NAME","description":"a MAIL","parameters":{"title":"t MAIL","default":"MAIL","properties":{"MAIL":{"description":"p MAIL"}},"items":[{"$comment":"MAIL"}],"enum":["MAIL"]}}}],"user":"MAIL","messages":[{"content":"1 MAIL","content":"2 MAIL"}]}"""
_MASKED_SCHEMA = """{"tools":[{"function":{"name":"NAME","description":"a [EMAIL_1]","parameters":{"title":"t [EMAIL_1]","default":"MAIL","properties":{"MAIL":{"description":"p [EMAIL_1]"}},"items":[{"$comment":"[EMAIL_1]"}],"enum":["MAIL"]}}}],"user":"MAIL","messages":[{"content":"1 [EMAIL_1]","content":"2 [EMAIL_1]"}]}"""


@_query(f"select c_custkey as request_id, replace('{_MASKED_SCHEMA}', 'MAIL', {MAIL_SQL}).replace(concat('[E', {MAIL_SQL}, '_1]'), '[EMAIL_1]') as body from customer")
def tool_schemas(spark, sf_dir):
    """Free texts of tool schemas are masked, in nested ones too; names, defaults, values and other members are not."""
    out, _ = mask_requests(_requests(spark, sf_dir, f"encode(replace('{_SCHEMA}', 'MAIL', {MAIL}), 'UTF-8')"))
    return out.select("request_id", F.decode("out_body", "UTF-8").alias("body"))


@_query("select c_custkey as request_id, concat('{\"messages\":[{\"content\":\"[EMAIL_1] \\\"q\\\" \\t / é \\u0001 ', c_custkey, '\"}]}') as body from customer")
def json_escapes(spark, sf_dir):
    """A changed text is written anew: only quotes, backslashes and control signs are escaped."""
    body = f"""encode(concat('{{"messages":[{{"content":"', {MAIL}, ' \\\\"q\\\\" \\\\u0009 \\\\/ \\\\u00e9 \\\\u0001 ', cast(c_custkey as string), '"}}]}}'), 'UTF-8')"""
    out, _ = mask_requests(_requests(spark, sf_dir, body))
    return out.select("request_id", F.decode("out_body", "UTF-8").alias("body"))


@_query(f"""select c_custkey as request_id, case c_custkey % 4 when 0 then 'failed' when 1 then 'failed' when 2 then 'same' else 'restored' end as outcome,
 case c_custkey % 4 when 2 then '{{"choices":[{{"message":{{"content":"none"}}}}]}}' when 3 then concat('{{"choices":[{{"message":{{"content":"', {MAIL_SQL}, '"}}}}]}}') end as body,
 cast(case c_custkey % 4 when 0 then 1 when 1 then 1 when 2 then 5 else 4 end as bigint) as n_headers,
 case c_custkey % 4 when 0 then 'StreamRestoreError: partial content' when 1 then 'StreamRestoreError: JSON syntax' end as error from customer""")
def response_sinks(spark, sf_dir):
    """Failed responses lose their body and the headers that told of it; restored ones their length and tag."""
    headers = f"array({JSON_TYPE}, named_struct('name', 'ETag', 'value', 'x'), named_struct('name', 'Content-Length', 'value', '1'), named_struct('name', 'Transfer-Encoding', 'value', 'chunked'), named_struct('name', 'X-Id', 'value', '7'))"
    text = "case c_custkey % 4 when 2 then 'none' else '[EMAIL_1]' end"
    body = f"""encode(concat('{{"choices":[{{"message":{{"content":"', {text}, '"}}}}]}}', if(c_custkey % 4 = 1, ',', '')), 'UTF-8')"""
    rows = _read(spark, sf_dir, "customer", "c_custkey as request_id", "if(c_custkey % 4 = 0, 206, 200) as status", f"{headers} as headers", f"{body} as body")
    known = _read(spark, sf_dir, "customer", "c_custkey as request_id", "'[EMAIL_1]' as placeholder", f"{MAIL} as plaintext")
    # a restored body gets its new length as a header, which takes the old one's place
    return restore_responses(rows, known).select("request_id", "outcome", F.decode("out_body", "UTF-8").alias("body"), (F.size("out_headers") + (F.col("outcome") == "restored").cast("int")).cast("long").alias("n_headers"), "error")


# ---- streams ------------------------------------------------------------------------------------


def _chunks(spark, sf_dir, parts: list[str], mapping: str = f"map('[EMAIL_1]', {MAIL})") -> DataFrame:
    """Binary chunks by number, from expressions over a customer."""
    rows = _read(spark, sf_dir, "customer", "c_custkey", f"posexplode(array({', '.join(parts)})) as (chunk_no, chunk)", f"{mapping} as mapping")
    return rows.selectExpr("cast(c_custkey as string) as stream_id", "cast(chunk_no as long) as chunk_no", "chunk", f"chunk_no = {len(parts) - 1} as is_eof", "mapping")


def _joined(out: DataFrame, piece, *order: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(*order, piece.alias("piece"))))
    return out.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("body"))


@_query(f"select cast(c_custkey as varchar) as stream_id, concat('é€', {MAIL_SQL}, '𝄞 end') as body from customer")
def split_characters(spark, sf_dir):
    """Characters that are cut anywhere between chunks come out whole."""
    text = "encode('é€[EMAIL_1]𝄞 end', 'UTF-8')"
    cuts = [0, 1, 3, 4, 9, 15, 16, 18, 22]
    parts = [f"substring({text}, {a + 1}, {b - a})" for a, b in zip(cuts, [*cuts[1:], 100])]
    return _joined(restore_chunks(_chunks(spark, sf_dir, parts)), F.col("text"), "chunk_no")


@_query("select cast(c_custkey as varchar) as stream_id, case when c_custkey % 2 = 0 then 'ok ;InvalidUTF8;InvalidUTF8' else 'ok ;x y;' end as body from customer")
def failed_streams(spark, sf_dir):
    """Bytes that are not UTF-8 end a stream, and every later chunk repeats the error."""
    parts = ["encode('ok ', 'UTF-8')", "if(c_custkey % 2 = 0, X'FF', encode('x ', 'UTF-8'))", "encode('y', 'UTF-8')"]
    out = restore_chunks(_chunks(spark, sf_dir, parts))
    bad = F.when(F.col("error").isNotNull(), F.concat(F.lit(";"), F.col("error")))
    own = F.coalesce(bad, F.when(F.col("chunk_no") == 0, F.col("text")).when(F.col("chunk_no") == 1, F.concat(F.lit(";"), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit(";"))))
    return _joined(out, own, "chunk_no")


_FRAME = """data: {{"choices":[{{"index":{0},"delta":{{"content":"{1}"}}}}]}}"""


def _frames(*events: str) -> str:
    return "".join(e + "\\n\\n" for e in events)


@_query(f"""select cast(c_custkey as varchar) as stream_id, concat('data: {{"choices":[{{"index":0,"delta":{{"content":"a "}}}}]}}', chr(10), chr(10), 'data: {{"choices":[{{"index":1,"delta":{{"content":"b "}}}}]}}', chr(10), chr(10),
 'data: {{"choices":[{{"index":0,"delta":{{"content":"', {MAIL_SQL}, ' x"}}}}]}}', chr(10), chr(10), 'data: {{"choices":[{{"index":1,"delta":{{"content":"[EMAIL_2] y"}}}}]}}', chr(10), chr(10), 'data: [DONE]', chr(10), chr(10)) as body from customer""")
def routed_events(spark, sf_dir):
    """Each choice is a text of its own, also where events of two choices alternate."""
    one = _frames(_FRAME.format(0, "a [EMA"), _FRAME.format(1, "b [EMAIL"))
    two = _frames(_FRAME.format(0, "IL_1] x"), _FRAME.format(1, "_2] y"), "data: [DONE]")
    out = restore_event_chunks(_chunks(spark, sf_dir, [f"encode('{one}', 'UTF-8')", f"encode('{two}', 'UTF-8')"]))
    return _joined(out, F.decode("bytes", "UTF-8"), "chunk_no", "segment_no")


@_query("""select cast(c_custkey as varchar) as stream_id, cast(4 + c_custkey % 3 as bigint) as n_segments, cast(16384 as bigint) as largest from customer where c_custkey % 50 = 0""")
def event_segments(spark, sf_dir):
    """What goes on is cut into segments of 16 KiB; the last event is one of its own."""
    frame = _FRAME.format(0, "XX").replace("XX", "', repeat('z', cast(40000 + (c_custkey % 3) * 16384 as int)), '")
    parts = [f"encode(concat('{frame}', '\\n\\n', 'data: [DONE]\\n\\n'), 'UTF-8')"]
    out = restore_event_chunks(_chunks(spark, sf_dir, parts).filter("cast(stream_id as long) % 50 = 0"))
    return out.groupBy("stream_id").agg(F.count(F.when(F.octet_length("bytes") > 0, 1)).alias("n_segments"), F.max(F.octet_length("bytes")).cast("long").alias("largest"))


_LINES = "'\\uFEFF', ': beat', {nl}, {nl}, 'event: x', {nl}, 'data: {{\"choices\":[{{\"index\":0,', {nl}, 'data: \"delta\":{{\"content\":\"to [EMAIL_1]\"}}}}]}}', {nl}, {nl}, 'data: [DONE]', {nl}, {nl}"


_LINES_SQL = "chr(65279), ': beat', {nl}, {nl}, 'event: x', {nl}, 'data: {{\"choices\":[{{\"index\":0, \"delta\":{{\"content\":\"to ', {mail}, '\"}}}}]}}', {nl}, {nl}, 'data: [DONE]', {nl}, {nl}"


@_query(f"select cast(c_custkey as varchar) as stream_id, concat({_LINES_SQL.format(nl='nl', mail=MAIL_SQL)}) as body from (select c_custkey, [chr(10), chr(13), concat(chr(13), chr(10))][cast(c_custkey % 3 + 1 as int)] as nl from customer)")
def event_lines(spark, sf_dir):
    """A byte order mark, comments, other fields, and an event of two data lines, with each of the three line ends."""
    ends = "get(array(chr(10), chr(13), concat(chr(13), chr(10))), cast(c_custkey % 3 as int))"
    return _joined(restore_event_chunks(_chunks(spark, sf_dir, [f"encode(concat({_LINES.format(nl=ends)}), 'UTF-8')"])), F.decode("bytes", "UTF-8"), "chunk_no", "segment_no")


@_query(f"""select cast(c_custkey as varchar) as stream_id, concat('data: {{"choices":[{{"index":0,"delta":{{"content":"', case when c_custkey % 2 = 0 then concat('[EMAIL_2] é ', {MAIL_SQL}) else '\\u005bEMAIL_2] \\u00e9 x' end, '"}}}}]}}', chr(10), chr(10), 'data: [DONE]', chr(10), chr(10)) as body from customer""")
def unresolved_events(spark, sf_dir):
    """A text in which nothing is restored keeps the escapes that it came with; another one is written anew."""
    frame = _FRAME.format(0, "\\\\u005bEMAIL_2] \\\\u00e9 ', if(c_custkey % 2 = 0, '[EMAIL_1]', 'x'), '")
    return _joined(restore_event_chunks(_chunks(spark, sf_dir, [f"encode(concat('{_frames(frame, 'data: [DONE]')}'), 'UTF-8')"])), F.decode("bytes", "UTF-8"), "chunk_no", "segment_no")


@_query("select cast(c_custkey as varchar) as stream_id, case when c_custkey % 2 = 0 then 'StreamRestoreError' end as error from customer where c_custkey % 25 = 0")
def event_route_budget(spark, sf_dir):
    """A stream of more than 256 routes fails."""
    many = "transform(sequence(1, cast(if(c_custkey % 2 = 0, 257, 256) as int)), i -> concat('data: {\"choices\":[{\"index\":', cast(i as string), ',\"delta\":{\"content\":\"[\"}}]}\\n\\n'))"
    out = restore_event_chunks(_chunks(spark, sf_dir, [f"encode(array_join({many}, ''), 'UTF-8')"]).filter("cast(stream_id as long) % 25 = 0"))
    return out.groupBy("stream_id").agg(F.max("error").alias("error"))


_REPLIES_SQL = """
select n_nationkey as id, 'openai' as protocol, concat('{"model":"m","messages":[{"role":"user","content":"', n_name, '"}],"stream":true}') as body, 'https://h/v1/chat/completions' as url, 2::bigint as n_headers, n_name as reply, n_name as delta, false as done from nation
union all select n_nationkey, 'anthropic', concat('{"model":"m","max_tokens":4096,"messages":[{"role":"user","content":"', n_name, '"}]}'), 'https://h/v1/messages', 3, concat(n_name, '!'), n_name, false from nation
union all select n_nationkey, 'gemini', concat('{"contents":[{"role":"user","parts":[{"text":"', n_name, '"}]}]}'), 'https://h/v1/models/m:streamGenerateContent?alt=sse', 2, concat('LLM error: ', n_name), concat(n_name, '?'), false from nation"""


@_query(_REPLIES_SQL)
def chat_protocols(spark, sf_dir):
    """Bodies for three protocols, texts of their replies and deltas of their streams."""
    from maskwright.sources.chat_protocols import PROTOCOLS, next_delta, reply_text, request_body, request_headers, request_url

    rows = _read(spark, sf_dir, "nation", "n_nationkey as id", "n_name as name")
    replies = {
        "openai": ['{{"choices":[{{"message":{{"content":"{0}"}}}}]}}', '{{"choices":[{{"delta":{{"refusal":"{0}"}}}}]}}'],
        "anthropic": ['{{"content":[{{"type":"text","text":"{0}"}},{{"type":"image"}},{{"type":"text","text":"!"}}]}}', '{{"type":"content_block_delta","delta":{{"type":"text_delta","text":"{0}"}}}}'],
        "gemini": ['{{"error":{{"message":"{0}"}}}}', '{{"candidates":[{{"content":{{"parts":[{{"text":"{0}"}},{{"text":"?"}}]}}}}]}}'],
    }
    out = []
    for p in PROTOCOLS:
        whole, part = ((lambda t: F.concat(F.lit(t.format("\0").split("\0")[0]), F.col("name"), F.lit(t.format("\0").split("\0")[1])))(t) for t in replies[p])
        own = rows.select("id", F.lit(p).alias("protocol"), request_body(p, F.lit("m"), F.col("name"), p == "openai").alias("body"), request_url(p, F.lit("https://h/v1/"), F.lit("m"), True).alias("url"), request_headers(p, F.lit("k")).alias("h"), reply_text(p, whole).alias("r"), next_delta(p, part).alias("d"))
        out.append(own.select("id", "protocol", "body", "url", F.size("h").cast("long").alias("n_headers"), F.coalesce("r.text", "r.error").alias("reply"), F.col("d.delta").alias("delta"), F.col("d.done").alias("done")))
    return out[0].union(out[1]).union(out[2])
