"""Chat requests and responses as rows: gates over the headers, texts out of JSON bodies, bodies put together again."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.config import MAX_REPORT_BYTES, MAX_RESTORE_EVENTS, Engine, LimitExceeded
from maskwright.operators.mask import EVENTS
from maskwright.operators.restore import EVENTS as RESTORE_EVENTS
from maskwright.operators.restore import restore
from maskwright.operators.session import anonymize, mapping
from maskwright.sources.json_body import JsonSyntaxError, encoded, parse_bytes, patched, request_texts, response_texts, within_budget
from maskwright.sources.shared import shared_table

HEADERS = "array<struct<name:string,value:string>>"
READ = "struct<text:string,found:array<struct<no:int,start:int,end:int,text:string>>,outcome:string,why:string>"
#: Headers that a changed body would make wrong, and those that tell of a body that is no longer there.
INTEGRITY = ("content-md5", "digest", "content-digest", "signature", "signature-input")
OF_THE_BODY = ("content-type", "content-length", "content-encoding", "transfer-encoding", "content-range", "etag", *INTEGRITY)
_BLANK = " \t\n\r\0\x0b"
_GZIP_PIECE = 64 << 10


def _values(name: str) -> Column:
    own = F.filter(F.coalesce("headers", F.array().cast(HEADERS)), lambda h: F.lower(h["name"]) == name)
    return F.transform(own, lambda h: F.coalesce(h["value"], F.lit("")))


def _has(*names: str) -> Column:
    return F.coalesce(F.exists("headers", lambda h: F.lower(h["name"]).isin(*names)), F.lit(False))


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def media_type() -> Column:
    """The one media type, without its parameters; null if there is none or more than one header."""
    values = _values("content-type")
    return F.when(F.size(values) == 1, F.lower(_trimmed(F.split(F.get(values, F.lit(0)), ";")[0])))


def content_encoding() -> Column:
    """identity or gzip; null for any other and for several."""
    tokens = F.filter(F.transform(F.split(F.array_join(_values("content-encoding"), ","), ","), _trimmed), lambda t: t != "")
    one = F.lower(F.get(tokens, F.lit(0)))
    return F.when(F.size(tokens) == 0, "identity").when((F.size(tokens) == 1) & one.isin("identity", "gzip"), one)


def without(*names: str) -> Column:
    return F.filter("headers", lambda h: ~F.lower(h["name"]).isin(*names))


def _with_length(kept: Column, body: Column) -> Column:
    length = F.struct(F.lit("Content-Length").alias("name"), F.octet_length(body).cast("string").alias("value"))
    return F.concat(kept, F.array(length))


def dealt(df: DataFrame, request: str) -> DataFrame:
    """The rows over all tasks: bodies cost much more to read than to move, and a small file of many is one task's."""
    return df.repartition(request)


def gunzip(data: bytes, limit: int) -> bytes:
    """All members of a gzip body; anything after the last that is no member is an error, as is more than limit bytes."""
    out = bytearray()
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, _GZIP_PIECE)
            out += piece
            if len(out) > limit:
                raise LimitExceeded("decoded body")
            data = member.unconsumed_tail
            if not data and not piece and not member.eof:
                raise zlib.error("incomplete member")
        data = member.unused_data
    return bytes(out)


def _reader(walk, limit: int, passthrough: bool):
    """Body and encoding to the decoded text and its strings; outcome: null to go on, blank, bypass or failed."""

    @F.pandas_udf(READ)
    def read(body: pd.Series, encoding: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, kind in zip(body, encoding):
            text, found, outcome, why = None, None, None, None
            if raw is not None:
                try:
                    plain = gunzip(bytes(raw), limit) if kind == "gzip" else bytes(raw)
                    if not plain.strip(b" \t\n\r"):
                        outcome = "blank"
                    else:
                        text, root = parse_bytes(plain)
                        found = [{"no": i, "start": n.start + 1, "end": n.end - 1, "text": n.value} for i, n in enumerate(walk(root))]
                except LimitExceeded as e:
                    outcome, why = "failed", f"limit: {e}"
                except (zlib.error, JsonSyntaxError) as e:
                    outcome, why = ("bypass" if passthrough else "failed"), ("gzip" if isinstance(e, zlib.error) else "JSON syntax")
            rows.append((text, found, outcome, why))
        return pd.DataFrame(rows, columns=["text", "found", "outcome", "why"])

    return read


def _stitcher(limit: int):
    @F.pandas_udf("struct<text:string,changed:boolean,over:boolean>")
    def stitch(text: pd.Series, found: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, places, texts in zip(text, found, new):
            if whole is None or places is None or texts is None:
                rows.append((whole, False, False))
                continue
            changed = [(p["start"], p["end"], t) for p, t in zip(places, texts) if t is not None and t != p["text"]]
            inside = within_budget(len(whole.encode()), [(whole[s:e], t) for s, e, t in changed], limit)
            body = patched(whole, changed) if changed and inside else whole
            rows.append((body, bool(changed), not inside or len(body.encode()) > limit))
        return pd.DataFrame(rows, columns=["text", "changed", "over"])

    return stitch


def mask_requests(df: DataFrame, engine: Engine | None = None, passthrough: bool = False, request: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Outgoing requests, and the mapping (request, placeholder, entity, plaintext) that restores their responses.

    df: request (unique, not null), method, headers, body. Added: outcome, out_headers, out_body, mask_events, error.
    outcome: `masked`, `same` (nothing to mask; forwarded byte for byte), `bypass` (no POST, another media type or
    encoding, a blank body, and with passthrough a broken gzip or JSON body), or `failed` (out_body null, error set):
    what may hold unmasked text is never forwarded after a failure. Each request is a session of its own, and the
    texts of its body are the session's calls, in a fixed order.

    Bodies are read once, in Arrow batches; recognition, numbering and masking are the native session operator's over
    the texts. What meets in one row is one body, which max_input_bytes bounds.
    """
    engine = engine or Engine()
    gate = F.when(F.coalesce(F.upper("method") != "POST", F.lit(True)), "method").when(F.coalesce(media_type() != "application/json", F.lit(True)), "media type").when(content_encoding().isNull(), "encoding")
    large = F.octet_length("body") > engine.max_input_bytes
    gated = df.withColumn("__gate", gate).withColumn("__encoding", content_encoding()).withColumn("__large", F.coalesce(F.col("__gate").isNull() & large, F.lit(False)))
    body = F.when(F.col("__gate").isNull() & ~F.col("__large"), F.coalesce("body", F.lit(b"")))
    read = _reader(request_texts, engine.max_input_bytes, passthrough)
    rows = shared_table(dealt(gated, request).withColumn("__read", read(body, "__encoding")), "requests")

    calls = rows.select(request, F.explode("__read.found").alias("__c")).select(request, F.col("__c.no").alias("no"), F.col("__c.text").alias("text"))
    done = shared_table(anonymize(calls, request, "no", "text", engine), "calls")
    changed = F.transform(F.filter("events", lambda e: F.col("masked") != F.col("text")), lambda e: F.struct(e["entity"], F.lit(0).alias("start"), F.lit(0).alias("end"), e["score"], e["replacement"])).cast(EVENTS)
    each = done.select(F.col(request).alias("__id"), F.struct("no", F.col("masked").alias("text"), changed.alias("events")).alias("c"), F.col("error").alias("e"))
    per = each.groupBy("__id").agg(F.sort_array(F.collect_list("c")).alias("__calls"), F.min("e").alias("__wrong"))
    joined = rows.join(per, rows[request] == per["__id"], "left")
    events = F.flatten(F.transform("__calls", lambda c: c["events"]))
    joined = joined.withColumn("__out", _stitcher(engine.max_output_bytes)(F.col("__read.text"), F.col("__read.found"), F.transform("__calls", lambda c: c["text"])))
    joined = joined.withColumn("__events", F.coalesce(events, F.array().cast(EVENTS)))
    report = F.aggregate("__events", F.lit(0).cast("long"), lambda t, e: t + F.octet_length(e["entity"]) + F.octet_length(e["replacement"]))
    error = (
        F.when(F.col("__large"), "InvalidRequest: body size")
        .when(F.col("__read.outcome") == "failed", F.concat(F.lit("InvalidRequest: "), F.col("__read.why")))
        .when(F.col("__wrong").isNotNull(), F.concat(F.lit("InvalidRequest: "), F.col("__wrong")))
        .when(F.col("__out.over"), "InvalidRequest: output size")
        .when(F.col("__out.changed") & _has(*INTEGRITY), "InvalidRequest: signed body")
        .when(report > MAX_REPORT_BYTES, "InvalidRequest: report size")
    )
    told = joined.withColumn("__error", error)
    outcome = F.when(F.col("__error").isNotNull(), "failed").when(F.col("__gate").isNotNull() | F.col("__read.outcome").isin("blank", "bypass"), "bypass").when(F.col("__out.changed"), "masked").otherwise("same")
    told = told.withColumn("__outcome", outcome)
    masked = F.col("__outcome") == "masked"
    new = F.encode("__out.text", "UTF-8")
    kept = F.when(F.col("__encoding") == "gzip", without("content-length", "transfer-encoding", "content-encoding")).otherwise(without("content-length", "transfer-encoding"))
    added = ("outcome", "out_headers", "out_body", "mask_events", "error")
    out = told.select(
        *[c for c in df.columns if c not in added],
        F.col("__outcome").alias("outcome"),
        F.when(F.col("__outcome") != "failed", F.when(masked, _with_length(kept, new)).otherwise(F.col("headers"))).alias("out_headers"),
        F.when(F.col("__outcome") != "failed", F.when(masked, new).otherwise(F.col("body"))).alias("out_body"),
        F.when(masked, F.col("__events")).otherwise(F.array().cast(EVENTS)).alias("mask_events"),
        F.col("__error").alias("error"),
    )
    return out, mapping(calls, done, request, "text", engine)


def restore_responses(df: DataFrame, known: DataFrame, engine: Engine | None = None, request: str = "request_id") -> DataFrame:
    """Responses with the originals put back. df: request (unique, not null), status, headers, body.

    known: (request, placeholder, plaintext). Added: outcome, out_headers, out_body, restore_events, complete, error.
    outcome: `restored`, `same` (no text changes; there may be events of tokens that stay), `bypass` (another encoding
    or media type), `event_stream` (its body is for restore_event_chunks, after the gates here), or `failed` (no body,
    the headers that told of it are gone).
    """
    engine = engine or Engine()
    stream = F.coalesce(media_type() == "text/event-stream", F.lit(False))
    gate = F.when(F.coalesce(content_encoding() != "identity", F.lit(True)), "bypass").when(stream, "event_stream").when(F.coalesce(media_type() != "application/json", F.lit(True)), "bypass")
    gated = df.withColumn("__gate", gate)
    partial = F.coalesce(F.col("status") == 206, F.lit(False)) | _has("content-range")
    early = (
        F.when(F.col("__gate") == "bypass", None)
        .when(partial, "StreamRestoreError: partial content")
        .when((F.col("__gate") == "event_stream") & _has(*INTEGRITY), "StreamRestoreError: signed body")
        .when(F.col("__gate").isNull() & (F.octet_length("body") > engine.max_output_bytes), "StreamRestoreError: body size")
    )
    gated = gated.withColumn("__early", early)
    body = F.when(F.col("__gate").isNull() & F.col("__early").isNull(), F.coalesce("body", F.lit(b"")))
    read = _reader(response_texts, engine.max_output_bytes, False)
    rows = shared_table(dealt(gated, request).withColumn("__read", read(body, F.lit("identity"))), "responses")

    texts = rows.select(request, F.explode("__read.found").alias("__c")).select(request, F.col("__c.no").alias("no"), F.col("__c.text").alias("text"))
    done = restore(texts, known, request, "text", engine)
    own = F.transform("restore_events", lambda e: F.struct(e["entity"], F.lit(0).alias("start"), F.lit(0).alias("end"), e["placeholder"], e["restored"])).cast(RESTORE_EVENTS)
    each = done.select(F.col(request).alias("__id"), F.struct("no", F.col("restored").alias("text"), own.alias("events")).alias("c"), F.col("error").alias("e"))
    per = each.groupBy("__id").agg(F.sort_array(F.collect_list("c")).alias("__texts"), F.min("e").alias("__wrong"))
    joined = rows.join(per, rows[request] == per["__id"], "left")
    joined = joined.withColumn("__out", _stitcher(engine.max_output_bytes)(F.col("__read.text"), F.col("__read.found"), F.transform("__texts", lambda c: c["text"])))
    joined = joined.withColumn("__events", F.coalesce(F.flatten(F.transform("__texts", lambda c: c["events"])), F.array().cast(RESTORE_EVENTS)))
    report = F.aggregate("__events", F.lit(0).cast("long"), lambda t, e: t + F.octet_length(e["entity"]) + F.octet_length(e["placeholder"]))
    error = (
        F.when(F.col("__early").isNotNull(), F.col("__early"))
        .when(F.col("__read.outcome") == "failed", F.concat(F.lit("StreamRestoreError: "), F.col("__read.why")))
        .when(F.col("__wrong").isNotNull(), F.concat(F.lit("StreamRestoreError: "), F.col("__wrong")))
        .when((F.size("__events") > MAX_RESTORE_EVENTS) | (report > MAX_REPORT_BYTES), "StreamRestoreError: report size")
        .when(F.col("__out.changed") & _has(*INTEGRITY), "StreamRestoreError: signed body")
        .when(F.col("__out.over"), "StreamRestoreError: output size")
    )
    told = joined.withColumn("__error", error)
    told = told.withColumn("__outcome", F.when(F.col("__error").isNotNull(), "failed").when(F.col("__gate").isNotNull(), F.col("__gate")).when(F.col("__out.changed"), "restored").otherwise("same"))
    failed, restored = F.col("__outcome") == "failed", F.col("__outcome") == "restored"
    new = F.encode("__out.text", "UTF-8")
    added = ("outcome", "out_headers", "out_body", "restore_events", "complete", "error")
    return told.select(
        *[c for c in df.columns if c not in added],
        F.col("__outcome").alias("outcome"),
        F.when(failed, without(*OF_THE_BODY)).when(restored, _with_length(without("content-length", "transfer-encoding", "etag"), new)).otherwise(F.col("headers")).alias("out_headers"),
        F.when(failed, None).when(restored, new).otherwise(F.col("body")).alias("out_body"),
        F.when(failed, F.array().cast(RESTORE_EVENTS)).otherwise(F.col("__events")).alias("restore_events"),
        (~failed).alias("complete"),
        F.col("__error").alias("error"),
    )
