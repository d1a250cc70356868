"""Putting originals back: placeholder tokens, their lookup in a mapping, and the restored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.config import MAX_REPORT_BYTES, MAX_RESTORE_EVENTS, Engine
from maskwright.operators.mask import packed, unpacked

#: Either bracket may be missing, and be of either form.
TOKEN = r"[\[【]?[A-Z][A-Z0-9]*_[0-9]+[\]】]?"
EVENTS = "array<struct<entity:string,start:int,end:int,placeholder:string,restored:boolean>>"


def key_of(token: Column, max_seq_digits: int) -> Column:
    """The placeholder that a token stands for, or null if its number is too wide; leading zeros do not count."""
    digits = F.regexp_extract(token, "_([0-9]+)[^0-9]*$", 1)
    entity = F.regexp_extract(token, "([A-Z][A-Z0-9]*)_[0-9]+[^0-9]*$", 1)
    number = F.when(F.length(digits) <= max_seq_digits, digits.try_cast("bigint"))
    return F.concat(F.lit("["), entity, F.lit("_"), number.cast("string"), F.lit("]"))


def restore(df: DataFrame, mapping: DataFrame, session: str, text: str = "text", engine: Engine | None = None) -> DataFrame:
    """Adds restored, restore_events and error, in place of columns of these names; mapping: (session, placeholder,
    plaintext). Originals are not rescanned.

    Only the placeholders that a row names are looked up: its distinct tokens are joined with the mapping by session
    and placeholder and come back as a small map, so neither a session's mapping nor a text has to fit elsewhere.
    Repeated rows of the mapping count once; a placeholder with two plaintexts gives the error AmbiguousMapping.
    """
    engine = engine or Engine()
    base = packed(df, __s=F.col(session), __text=F.col(text))
    code = F.when(~F.call_function("is_valid_utf8", F.col("__text")), "InvalidUTF8").when(F.octet_length("__text") > engine.max_input_bytes, "LimitExceeded")
    base = base.withColumn("__code", code)
    base = base.withColumn("__tokens", F.when(F.col("__code").isNull(), F.regexp_extract_all("__text", F.lit(TOKEN), F.lit(0))))
    # rows of the same session and text have the same answer, so these two are the key on the way back
    base = base.withColumn("__h", F.sha2("__text", 256))
    asked = base.select(F.col("__s").alias("__rs"), F.col("__h").alias("__rh"), F.explode(F.array_distinct("__tokens")).alias("__t")).distinct()
    asked = asked.withColumn("__k", key_of(F.col("__t"), engine.max_seq_digits))
    own = mapping.select(F.col(session).alias("__ms"), F.col("placeholder").alias("__p"), F.col("plaintext").alias("__v"))
    met = asked.join(own, F.col("__rs").eqNullSafe(F.col("__ms")) & (F.col("__k") == F.col("__p")))
    each = met.groupBy("__rs", "__rh", "__t").agg(F.min("__v").alias("__v"), (F.min("__v") != F.max("__v")).alias("__two"))
    got = each.groupBy("__rs", "__rh").agg(F.map_from_entries(F.collect_list(F.struct("__t", "__v"))).alias("__map"), F.max("__two").alias("__two"))
    joined = base.join(got, F.col("__s").eqNullSafe(F.col("__rs")) & (F.col("__h") == F.col("__rh")), "left")
    plain = lambda t: F.try_element_at(F.col("__map"), t)
    entity = lambda t: F.regexp_extract(t, "([A-Z][A-Z0-9]*)_[0-9]+[^0-9]*$", 1)
    gaps = joined.withColumn("__gaps", F.split("__text", TOKEN, -1))
    pieces = F.concat(F.transform("__tokens", lambda t, i: F.concat(F.get("__gaps", i), F.coalesce(plain(t), t))), F.array(F.element_at("__gaps", -1)))

    def step(acc, i):
        t = F.get("__tokens", i)
        start = acc["at"] + F.octet_length(F.get("__gaps", i))
        event = F.struct(entity(t).alias("entity"), start.alias("start"), (start + F.octet_length(t)).alias("end"), t.alias("placeholder"), plain(t).isNotNull().alias("restored"))
        return F.struct((start + F.octet_length(t)).alias("at"), F.array_append(acc["out"], event).alias("out"))

    n = F.size("__tokens")
    events = F.when(n.between(1, MAX_RESTORE_EVENTS), F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.struct(F.lit(0).alias("at"), F.array().cast(EVENTS).alias("out")), step, lambda a: a["out"])).otherwise(F.array().cast(EVENTS))
    report = F.aggregate("__tokens", F.lit(0).cast("long"), lambda t, x: t + F.octet_length(entity(x)) + F.octet_length(x))
    made = gaps.withColumn("__out", F.when(F.col("__code").isNull(), F.array_join(pieces, "")))
    over = (n > MAX_RESTORE_EVENTS) | (report > MAX_REPORT_BYTES) | (F.octet_length("__out") > engine.max_output_bytes)
    error = F.coalesce("__code", F.when(F.col("__two"), "AmbiguousMapping"), F.when(over, "LimitExceeded"))
    return unpacked(made, df.columns, restored=F.when(error.isNull(), F.col("__out")), restore_events=F.when(error.isNull(), events).otherwise(F.array().cast(EVENTS)), error=error)
