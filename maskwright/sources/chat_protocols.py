"""Request bodies, reply texts and stream deltas of three public chat protocols, as column expressions. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Protocol names, paths, and what the second one asks of every request.
PROTOCOLS = ("openai", "anthropic", "gemini")
PATHS = {"openai": "/chat/completions", "anthropic": "/messages", "gemini": "/models/{model}:{action}"}
VERSION, MAX_TOKENS = "2023-06-01", 4096

_CHOICES = "error struct<message:string>, choices array<struct<message:struct<content:string>,delta:struct<content:string,refusal:string,tool_calls:array<struct<function:struct<arguments:string>>>>>>"
_BLOCKS = "type string, error struct<message:string,type:string>, content array<struct<type:string,text:string>>, delta struct<type:string,text:string>"
_PARTS = "error struct<message:string>, candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
_SCHEMA = {"openai": _CHOICES, "anthropic": _BLOCKS, "gemini": _PARTS}


def _known(protocol: str) -> None:
    if protocol not in PROTOCOLS:
        raise ValueError(f"protocol must be one of {', '.join(PROTOCOLS)}")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def request_url(protocol: str, base: Column, model: Column, stream: bool = False) -> Column:
    _known(protocol)
    root = F.regexp_replace(base, "/+$", "")
    if protocol != "gemini":
        return F.concat(root, F.lit(PATHS[protocol]))
    return F.concat(root, F.lit("/models/"), model, F.lit(":streamGenerateContent?alt=sse" if stream else ":generateContent"))


def request_headers(protocol: str, key: Column) -> Column:
    """array<struct<name,value>>, as the transport operators take them."""
    _known(protocol)
    named = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    own = {
        "openai": [named("Authorization", F.concat(F.lit("Bearer "), key))],
        "anthropic": [named("x-api-key", key), named("anthropic-version", F.lit(VERSION))],
        "gemini": [named("x-goog-api-key", key)],
    }
    return F.array(named("Content-Type", F.lit("application/json")), *own[protocol])


def request_body(protocol: str, model: Column, content: Column, stream: bool = False) -> Column:
    """The JSON body with one user message."""
    _known(protocol)
    role = F.lit("user").alias("role")
    if protocol == "gemini":
        return F.to_json(F.struct(F.array(F.struct(role, F.array(F.struct(content.alias("text"))).alias("parts"))).alias("contents")))
    fields = [model.alias("model")]
    fields += [F.lit(MAX_TOKENS).alias("max_tokens")] if protocol == "anthropic" else []
    fields.append(F.array(F.struct(role, content.alias("content"))).alias("messages"))
    fields += [F.lit(True).alias("stream")] if stream else []
    return F.to_json(F.struct(*fields))


def _text_of_parts(body: Column) -> Column:
    parts = F.flatten(F.transform(F.coalesce(body["candidates"], F.array()), lambda c: F.coalesce(c["content"]["parts"], F.array())))
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def reply_text(protocol: str, body: Column) -> Column:
    """struct<text,error> of a whole response: its text, placeholders still in it, or what went wrong."""
    _known(protocol)
    own = F.from_json(body, _SCHEMA[protocol])
    if protocol == "anthropic":
        text = F.array_join(F.transform(F.filter(F.coalesce(own["content"], F.array()), lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    elif protocol == "gemini":
        text = _text_of_parts(own)
    else:
        text = F.get(own["choices"], F.lit(0))["message"]["content"]
    failed = own["error"]["message"]
    error = F.when(failed.isNotNull(), F.concat(F.lit("LLM error: "), failed)).when(_filled(text).isNull(), "LLM response had no text content")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def next_delta(protocol: str, payload: Column) -> Column:
    """struct<delta,done,error> of one data payload of a stream; what is no JSON or of another kind is an empty delta."""
    _known(protocol)
    own = F.from_json(payload, _SCHEMA[protocol])
    nothing = F.lit(None).cast("string")
    if protocol == "anthropic":
        done, kind = F.coalesce(own["type"] == "message_stop", F.lit(False)), own["type"]
        error = F.when(kind == "error", F.coalesce(own["error"]["message"], own["error"]["type"], F.lit("upstream error")))
        delta = F.when((own["delta"]["type"] == "text_delta") & ~F.coalesce(kind.isin("error", "message_stop"), F.lit(False)), own["delta"]["text"])
    elif protocol == "gemini":
        done, failed = F.lit(False), own["error"]["message"]
        error = F.when(failed.isNotNull(), F.concat(F.lit("LLM stream error: "), failed))
        delta = F.when(failed.isNull(), _text_of_parts(own))
    else:
        done, error, one = payload == "[DONE]", nothing, F.get(own["choices"], F.lit(0))["delta"]
        calls = F.filter(F.transform(F.coalesce(one["tool_calls"], F.array()), lambda t: t["function"]["arguments"]), lambda a: _filled(a).isNotNull())
        delta = F.coalesce(_filled(one["content"]), _filled(one["refusal"]), F.get(calls, F.lit(0)))
    return F.struct(F.coalesce(delta, F.lit("")).alias("delta"), done.alias("done"), error.alias("error"))
