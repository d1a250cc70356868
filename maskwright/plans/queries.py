"""Queries over the masking operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.config import Engine, Rule
from maskwright.operators import rules as R
from maskwright.operators.mask import findings, mask
from maskwright.operators.restore import restore
from maskwright.operators.session import anonymize, mapping
from maskwright.operators.transport import mask_requests, restore_responses
from maskwright.plans import masking_sql as S
from maskwright.sources.shared import shared_table
from maskwright.streaming.event_stream import restore_event_chunks
from maskwright.streaming.stream import restore_chunks

#: Texts made from keys, for entities that the documents do not hold: name, table, id, expression (Spark and DuckDB).
_ID = "lpad(cast({} as string), {}, '0')"
DERIVED = {
    "cust_contact": ("customer", "c_custkey", f"concat('mail c', cast(c_custkey as string), '@example.com tel 138', {_ID.format('c_custkey', 8)})"),
    "cust_ssn": ("customer", "c_custkey", f"concat('ssn ', {_ID.format('c_custkey % 1000', 3)}, '-', {_ID.format('c_custkey % 100', 2)}, '-', {_ID.format('c_custkey % 10000', 4)})"),
    "cust_idcard": ("customer", "c_custkey", f"concat('id 1', {_ID.format('c_custkey', 16)}, cast(c_custkey % 10 as string))"),
    "cust_secret": ("customer", "c_custkey", "concat('password=', substring(md5(c_name), 1, 10))"),
    "order_landline": ("orders", "o_orderkey", f"concat('tel 010-', {_ID.format('o_orderkey', 8)})"),
    "order_url": ("orders", "o_orderkey", "concat('see https://example.com/o/', cast(o_orderkey as string), ' end')"),
    "order_intl": ("orders", "o_orderkey", f"concat('call +86138', {_ID.format('o_orderkey', 8)})"),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(id, text) of the documents or of a derived text."""
    if name == "documents":
        return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    table, key, text = DERIVED[name]
    return _read(spark, sf_dir, table).selectExpr(f"{key} as id", f"{text} as text")


def _texts_sql(name: str) -> str:
    if name == "documents":
        return "select doc_id as id, text from documents"
    table, key, text = DERIVED[name]
    return f"select {key} as id, {text.replace('as string', 'as varchar')} as text from {table}"


def _finder(source: str, rule: Rule):
    def find(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = findings(_texts(spark, sf_dir, source), Engine().with_recognizers(rule), keep=("id",))
        return out.select("id", "entity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "score", "match")

    return find


def _finder_sql(source: str, rule: Rule, predicate: str = "true", pattern: str | None = None) -> str:
    p = (pattern or rule.pattern).replace("'", "''")
    digit = "not regexp_matches(before, '[0-9]') and not regexp_matches(after, '[0-9]')" if rule.boundary else "true"
    return f"""
with t as ({_texts_sql(source)}),
m as (select id, string_split_regex(text, '{p}') g, regexp_extract_all(text, '{p}') m from t),
e as (select id, g, m, unnest(range(1, len(m) + 1)) i from m where len(m) > 0),
x as (select id, m[i] as v, cast(coalesce(list_sum(list_transform(g[1:i], lambda s: strlen(s))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: strlen(s))), 0) as bigint) as start,
 right(concat(coalesce(m[i-1], ''), g[i]), 1) as before, left(concat(g[i+1], coalesce(m[i+1], '')), 1) as after from e)
select id, '{rule.entity}' as entity, start, start + strlen(v) as stop, cast({rule.score} as double) as score, v as match from x where {predicate} and {digit}"""


_FINDERS = {
    "find_email": ("documents", R.EMAIL),
    "find_ip": ("documents", R.IP),
    "find_us_phone": ("documents", R.US_PHONE),
    "find_bankcard_luhn": ("documents", R.BANK_CARD),
    "find_china_phone": ("cust_contact", R.CHINA_PHONE),
    "find_ssn": ("cust_ssn", R.US_SSN),
    "find_idcard": ("cust_idcard", R.CHINA_IDCARD),
    "find_landline": ("order_landline", R.CHINA_LANDLINE),
    "find_url": ("order_url", R.URL),
    "find_intl_phone": ("order_intl", R.INTL_PHONE),
}
_PREDICATES = {"find_bankcard_luhn": S.LUHN, "find_ssn": S.SSN, "find_idcard": S.IDCARD}
_PATTERNS = {"find_ip": S.PATTERNS["ip"], "find_email": S.PATTERNS["email"]}


_FEW = Engine().with_recognizers().with_keywords("License", "the MIT", "the MIT License")
_MANY = Engine().with_recognizers().with_keywords(*[f"{w}{i}" for w in ("no such word ", "license ", "page ") for i in range(333)], "License", "the MIT", "the MIT License")


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mask(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "masked", F.size("events").cast("long").alias("n_events"), "error")


def mask_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(_texts(spark, sf_dir, "cust_contact")).select("id", "masked", F.size("events").cast("long").alias("n_events"))


def _strategy(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine().with_strategy("EMAIL", name).with_strategy("PHONE", name)
        return mask(_texts(spark, sf_dir, "cust_contact"), engine).select("id", "masked")

    return run


def region_us_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese rules are left out of the plan, so the phone numbers stay."""
    return mask(_texts(spark, sf_dir, "cust_contact"), Engine().with_regions("us")).select("id", "masked")


def entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(_texts(spark, sf_dir, "cust_secret"), Engine().with_recognizers(R.ENTROPY)).select("id", "masked")


def keywords_leftmost_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(_read(spark, sf_dir, "documents").select("doc_id", "text"), _FEW).select("doc_id", "masked")


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id card's span is also a bank card's: the higher score wins where both hold."""
    out = findings(_texts(spark, sf_dir, "cust_idcard"), Engine().with_recognizers(R.BANK_CARD, R.CHINA_IDCARD), keep=("id",))
    return out.select("id", "entity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all rules find, by language and entity, with the totals of each language and of all."""
    each = findings(_read(spark, sf_dir, "documents").select("lang", "text"), keep=("lang",))
    return each.rollup("lang", "entity").agg(F.count("*").alias("n"), F.sum(F.octet_length("match")).cast("long").alias("bytes"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, key, text = DERIVED["cust_contact"]
    return _read(spark, sf_dir, "customer").selectExpr("c_nationkey as session", f"{key} as call", f"{text} as text")


def anonymize_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize(_sessions(spark, sf_dir), "session", "call").select("session", "call", "masked")


def anonymize_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a customer is a call with the same contact, so all of a session's calls look alike."""
    text = DERIVED["cust_contact"][2].replace("c_custkey", "o_custkey")
    calls = _read(spark, sf_dir, "orders").selectExpr("o_custkey as session", "o_orderkey as call", f"{text} as text")
    return anonymize(calls, "session", "call").select("session", "call", "masked")


def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return anonymize(docs, "source", "doc_id").select("source", "doc_id", "masked", F.size("events").cast("long").alias("n_events"), "error")


def anonymize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return anonymize(turns, "conv_id", "turn").select("conv_id", "turn", "role", "masked", "error")


def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _sessions(spark, sf_dir)
    return mapping(calls, anonymize(calls, "session", "call"), "session")


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked calls, restored with their session's mapping, are the original texts."""
    calls = _sessions(spark, sf_dir)
    done = shared_table(anonymize(calls, "session", "call"), "masked")
    replies = done.select("session", "call", F.col("masked").alias("text"))
    return restore(replies, mapping(calls, done, "session"), "session").select("session", "call", "restored")


def restore_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without an entry in the mapping stay as they are and are reported."""
    replies = _read(spark, sf_dir, "nation").selectExpr("n_regionkey as session", "n_nationkey as id", "concat('see [PHONE_', cast(n_nationkey as string), '] and 【EMAIL_01】') as text")
    known = _read(spark, sf_dir, "region").selectExpr("r_regionkey as session", "'[EMAIL_1]' as placeholder", "lower(r_name) as plaintext")
    out = restore(replies, known, "session")
    return out.select("id", "restored", F.size(F.filter("restore_events", lambda e: ~e["restored"])).cast("long").alias("n_left"))


_JSON = "array(named_struct('name', 'Content-Type', 'value', 'application/json; charset=utf-8'), named_struct('name', 'Content-Length', 'value', '1'))"
_MAIL_OF, _TEL_OF = "concat('c', cast(c_custkey as string), '@example.com')", "concat('138', lpad(cast(c_custkey as string), 8, '0'))"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = f"""concat('{{"model": "m", "user":"', {_MAIL_OF}, '", "messages": [{{"role":"user", "content": "mail ', {_MAIL_OF}, '"}}, {{"content":[{{"type":"text","text":"tel \\\\u0031', substring({_TEL_OF}, 2), ' or ', {_MAIL_OF}, '"}}]}}]}}')"""
    return _read(spark, sf_dir, "customer").selectExpr("c_custkey as request_id", "if(c_custkey % 7 = 0, 'GET', 'POST') as method", f"{_JSON} as headers", f"encode({body}, 'UTF-8') as body")


def json_requests_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests: free text is masked, all other bytes stay; another method passes untouched."""
    out, _ = mask_requests(_requests(spark, sf_dir))
    return out.select("request_id", "outcome", F.decode("out_body", "UTF-8").alias("body"), F.size("out_headers").cast("long").alias("n_headers"), F.size("mask_events").cast("long").alias("n_events"))


def json_requests_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the responses are restored with: a plaintext that two texts of a request share has one placeholder."""
    return mask_requests(_requests(spark, sf_dir))[1]


def json_responses_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _read(spark, sf_dir, "customer").selectExpr("c_custkey as request_id", "'[EMAIL_1]' as placeholder", f"{_MAIL_OF} as plaintext")
    body = """'{"id":"[EMAIL_1]","choices":[{"message":{"content":"to [EMAIL_01] \\\\/ [PHONE_3]","tool_calls":[{"function":{"arguments":"{}"}}]}}]}'"""
    replies = _read(spark, sf_dir, "customer").selectExpr("c_custkey as request_id", "if(c_custkey % 5 = 0, 206, 200) as status", f"{_JSON} as headers", f"encode({body}, 'UTF-8') as body")
    out = restore_responses(replies, known)
    return out.select("request_id", "outcome", F.decode("out_body", "UTF-8").alias("body"), F.size("out_headers").cast("long").alias("n_headers"), F.size("restore_events").cast("long").alias("n_events"))


def event_streams_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placeholder that is split over two events comes back in a frame of its own before the last one."""
    one = """'data: {"choices":[{"index":0,"delta":{"content":"to [EMA"}}]}\\n\\n'"""
    two = """'data: {"choices":[{"index":0,"delta":{"content":"IL_1] ok"},"finish_reason":"stop"}]}\\n\\ndata: [DONE]\\n\\n'"""
    chunk = f"encode(if(chunk_no = 0, {one}, {two}), 'UTF-8') as chunk"
    chunks = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as stream_id", f"map('[EMAIL_1]', {_MAIL_OF}) as mapping", "explode(array(1L, 0L)) as chunk_no").selectExpr("stream_id", "chunk_no", chunk, "chunk_no = 1 as is_eof", "mapping")
    out = restore_event_chunks(chunks)
    return out.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "segment_no", "bytes"))), lambda s: F.decode(s["bytes"], "UTF-8")), "").alias("body"))


def text_chunks_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk boundary within a placeholder does not change the text."""
    chunk = "encode(element_at(array('to [EMA', 'IL_1', '] and EMAIL_2'), cast(chunk_no + 1 as int)), 'UTF-8') as chunk"
    chunks = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as stream_id", f"map('[EMAIL_1]', {_MAIL_OF}) as mapping", "explode(array(2L, 0L, 1L)) as chunk_no").selectExpr("stream_id", "chunk_no", chunk, "chunk_no = 2 as is_eof", "mapping")
    out = restore_chunks(chunks)
    return out.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"]), "").alias("text"), F.sum(F.size("events")).alias("n_events"))


def keywords_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand keywords, most of which the texts do not hold, found by one pattern tree."""
    return mask(_read(spark, sf_dir, "documents").select("doc_id", "text"), _MANY).select("doc_id", "masked")


_OTHERS = (json_requests_masked, json_requests_mapping, json_responses_restored, event_streams_restored, text_chunks_restored, keywords_many, mask_documents, mask_contacts, region_us_only, entropy_secrets, keywords_leftmost_longest, resolve_overlaps, entity_report, anonymize_sessions, anonymize_repeats, anonymize_documents, anonymize_conversations, mapping_table, restore_roundtrip, restore_unresolved)
QUERIES = {**{k: _finder(*v) for k, v in _FINDERS.items()}, **{f.__name__: f for f in _OTHERS}, "strategy_mask_middle": _strategy("mask_middle"), "strategy_hash": _strategy("hash")}

_MAIL, _TEL = "concat('c', cast(c_custkey as varchar), '@example.com')", "concat('138', lpad(cast(c_custkey as varchar), 8, '0'))"
_MIDDLE = "concat(left({0}, 3), repeat('*', cast(length({0}) - 7 as int)), right({0}, 4))"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: -(len(list_filter(string_split(w, ''), lambda x: x = c)) / 10.0) * log2(len(list_filter(string_split(w, ''), lambda x: x = c)) / 10.0)))"
_RN = "cast(row_number() over (partition by c_nationkey order by c_custkey) as varchar)"
_IDS = f"select id, text[4:] as v from ({_texts_sql('cust_idcard')})"
_USER = f"""concat('{{"model": "m", "user":"', {_MAIL}, '", "messages": [{{"role":"user", "content": "mail ')"""
_DOCS = "select doc_id as id, text from documents"
ORACLE_SQL = {
    "mask_documents": S.mask(_DOCS, Engine(), "s.id as doc_id, coalesce(m.masked, s.text) as masked, coalesce(m.n, 0) as n_events, cast(null as varchar) as error"),
    "keywords_leftmost_longest": S.mask(_DOCS, _FEW, "s.id as doc_id, coalesce(m.masked, s.text) as masked"),
    "keywords_many": S.mask(_DOCS, _MANY, "s.id as doc_id, coalesce(m.masked, s.text) as masked"),
    "anonymize_documents": S.anonymize("select doc_id as id, source as session, doc_id as call, text from documents", Engine(), "s.session as source, s.call as doc_id, coalesce(m.masked, s.text) as masked, coalesce(m.n, 0) as n_events, cast(null as varchar) as error"),
    "anonymize_conversations": S.anonymize("select conv_id * 100000 + turn as id, conv_id as session, turn as call, role, text from conversations", Engine(), "s.session as conv_id, s.call as turn, s.role, coalesce(m.masked, s.text) as masked, cast(null as varchar) as error"),
    "json_requests_masked": f"""select c_custkey as request_id, case when c_custkey % 7 = 0 then 'bypass' else 'masked' end as outcome,
 case when c_custkey % 7 = 0 then concat({_USER}, {_MAIL}, '"}}, {{"content":[{{"type":"text","text":"tel \\u0031', substring({_TEL}, 2), ' or ', {_MAIL}, '"}}]}}]}}')
 else concat({_USER}, '[EMAIL_1]"}}, {{"content":[{{"type":"text","text":"tel [PHONE_1] or [EMAIL_1]"}}]}}]}}') end as body,
 cast(2 as bigint) as n_headers, cast(case when c_custkey % 7 = 0 then 0 else 3 end as bigint) as n_events from customer""",
    "json_requests_mapping": f"select c_custkey as request_id, '[EMAIL_1]' as placeholder, 'EMAIL' as entity, {_MAIL} as plaintext from customer where c_custkey % 7 <> 0 union all select c_custkey, '[PHONE_1]', 'PHONE', {_TEL} from customer where c_custkey % 7 <> 0",
    "json_responses_restored": f"""select c_custkey as request_id, case when c_custkey % 5 = 0 then 'failed' else 'restored' end as outcome,
 case when c_custkey % 5 <> 0 then concat('{{"id":"[EMAIL_1]","choices":[{{"message":{{"content":"to ', {_MAIL}, ' / [PHONE_3]","tool_calls":[{{"function":{{"arguments":"{{}}"}}}}]}}}}]}}') end as body,
 cast(case when c_custkey % 5 = 0 then 0 else 2 end as bigint) as n_headers, cast(case when c_custkey % 5 = 0 then 0 else 2 end as bigint) as n_events from customer""",
    "event_streams_restored": f"""select cast(c_custkey as varchar) as stream_id, concat('data: {{"choices":[{{"index":0,"delta":{{"content":"to "}}}}]}}', chr(10), chr(10), 'data: {{"choices":[{{"index":0,"delta":{{"content":"', {_MAIL}, ' ok"}}}}]}}', chr(10), chr(10),
 'data: {{"choices":[{{"index":0,"delta":{{"content":""}},"finish_reason":"stop"}}]}}', chr(10), chr(10), 'data: [DONE]', chr(10), chr(10)) as body from customer""",
    "text_chunks_restored": f"select cast(c_custkey as varchar) as stream_id, concat('to ', {_MAIL}, ' and EMAIL_2') as text, cast(2 as bigint) as n_events from customer",
    **{k: _finder_sql(*v, _PREDICATES.get(k, "true"), _PATTERNS.get(k)) for k, v in _FINDERS.items()},
    "mask_contacts": "select c_custkey as id, 'mail [EMAIL_1] tel [PHONE_1]' as masked, cast(2 as bigint) as n_events from customer",
    "region_us_only": f"select c_custkey as id, concat('mail [EMAIL_1] tel ', {_TEL}) as masked from customer",
    "strategy_mask_middle": f"select c_custkey as id, concat('mail ', {_MIDDLE.format(_MAIL)}, ' tel ', {_MIDDLE.format(_TEL)}) as masked from customer",
    "strategy_hash": f"select c_custkey as id, concat('mail ', left(sha256({_MAIL}), 8), ' tel ', left(sha256({_TEL}), 8)) as masked from customer",
    "entropy_secrets": f"with t as (select c_custkey as id, substring(md5(c_name), 1, 10) as w from customer) select id, case when {_ENTROPY} >= 3.0 - 1e-9 then 'password=[SECRET_1]' else concat('password=', w) end as masked from t",
    "resolve_overlaps": f"with t as ({_IDS}) select id, case when {S.IDCARD} then 'IDCARD' else 'BANKCARD' end as entity, cast(3 as bigint) as start, cast(21 as bigint) as stop from t where {S.IDCARD} or {S.LUHN}",
    "entity_report": f"{S.findings(_DOCS, Engine())} select lang, ent as entity, count(*) as n, cast(sum(strlen(v)) as bigint) as bytes from kept k join documents d on d.doc_id = k.id group by rollup (lang, ent)",
    "anonymize_sessions": f"select c_nationkey as session, c_custkey as call, concat('mail [EMAIL_', {_RN}, '] tel [PHONE_', {_RN}, ']') as masked from customer",
    "anonymize_repeats": "select o_custkey as session, o_orderkey as call, 'mail [EMAIL_1] tel [PHONE_1]' as masked from orders",
    "mapping_table": f"with t as (select c_nationkey as session, {_RN} as rn, {_MAIL} as mail, {_TEL} as tel from customer) select session, concat('[EMAIL_', rn, ']') as placeholder, 'EMAIL' as entity, mail as plaintext from t union all select session, concat('[PHONE_', rn, ']'), 'PHONE', tel from t",
    "restore_roundtrip": f"select c_nationkey as session, c_custkey as call, concat('mail ', {_MAIL}, ' tel ', {_TEL}) as restored from customer",
    "restore_unresolved": "select n_nationkey as id, concat('see [PHONE_', cast(n_nationkey as varchar), '] and ', lower(r_name)) as restored, cast(1 as bigint) as n_left from nation join region on n_regionkey = r_regionkey",
}
