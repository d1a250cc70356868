"""Session-scoped masking: placeholders that stay the same within a session, and the mapping back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from maskwright.config import Engine, InvalidRequest
from maskwright.functions.strategies import replacement, reversible
from maskwright.operators.mask import CANDIDATES, EVENTS, exploded, packed, spliced, unpacked, with_findings
from maskwright.sources.shared import shared_table


def _replay(engine: Engine):
    """Calls of one session in order, each accepted as a whole or not at all; numbers as they come out of that."""
    session, order = "__s", "__o"

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs: dict[str, int] = {}
        known: dict[tuple[str, str], int] = {}
        entities = size = 0
        out = []
        for row in pdf.sort_values(order).to_dict("records"):
            fs = list(row["f"]) if row["f"] is not None else []
            own_seq, own_known, added = dict(seqs), dict(known), 0
            numbers, grown, error = [], 0, row["error"]
            for f in fs:
                key = (f["entity"], f["text"])
                if f["reversible"] and key in own_known:
                    n = own_known[key]
                else:
                    n = own_seq[f["entity"]] = own_seq.get(f["entity"], 0) + 1
                    if f["reversible"]:
                        own_known[key] = n
                        added += len(f["text"].encode())
                numbers.append({"start": f["start"], "seq": n})
                made = f["fixed_bytes"] if f["fixed_bytes"] is not None else len(f["entity"]) + 3 + len(str(n))
                grown += made - (f["end"] - f["start"])
            if error is None and (entities + len(fs) > engine.max_entities or size + added > engine.max_session_bytes or row["bytes"] + grown > engine.max_output_bytes):
                error = "LimitExceeded"
            if error is None:
                seqs, known, entities, size = own_seq, own_known, entities + len(fs), size + added
            out.append({session: row[session], order: row[order], "numbers": numbers if error is None else [], "error": error})
        return pd.DataFrame(out, columns=[session, order, "numbers", "error"])

    return replay


def anonymize(df: DataFrame, session: str, order: str, text: str = "text", engine: Engine | None = None) -> DataFrame:
    """Adds masked, events and error, in place of columns of these names. Rows are calls; null is a session too, and an
    order that comes first. A repeated (session, order) raises InvalidRequest.

    A reversible plaintext takes the next number of its entity at its first place in the session, by call and place;
    every other finding takes a number of its own. Numbers come from windows over the findings alone, without the
    texts; findings are computed once and written to the shared folder. Sessions whose totals may reach a limit are replayed call by call, since a refused call gives its numbers
    back; their size is bounded by those limits for all but refused calls.
    """
    engine = engine or Engine()
    calls = df.select(F.col(session).alias("__s"), F.col(order).alias("__o"), F.col(text).alias("__t"))
    marks = with_findings(calls, "__t", engine, "__f")
    marks = shared_table(marks.select("__s", "__o", F.octet_length("__t").alias("bytes"), "__f", F.col("error").alias("__early")), "findings")
    keys = ["__s", "__o"]
    if not marks.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise InvalidRequest(f"{session} and {order} do not name a call")
    flat = marks.filter(F.col("__early").isNull()).select(*keys, "bytes", F.explode("__f").alias("x"))
    flat = flat.select(*keys, "bytes", "x.entity", "x.start", "x.end", F.col("x.text").alias("match")).withColumn("rev", reversible(engine, F.col("entity")))
    place = F.struct("__o", "start")
    same = W.partitionBy("__s", "entity", "match")
    placed = flat.withColumn("first", F.when(F.col("rev"), F.min(place).over(same)).otherwise(place))
    numbered = placed.withColumn("seq", F.dense_rank().over(W.partitionBy("__s", "entity").orderBy("first")).cast("long"))
    tagged = F.col("entity").isin([e for e in engine.entities if engine.strategy(e) in ("placeholder", "redact")])
    own = lambda n: F.octet_length(replacement(engine, F.col("entity"), F.col("match"), n))
    numbered = numbered.withColumn("fixed", F.when(~tagged, own(F.lit(1)))).withColumn("made", own(F.col("seq")) - (F.col("end") - F.col("start")))
    numbered = numbered.withColumn("new", F.when(F.col("rev") & (F.col("first") == place), F.octet_length("match")).otherwise(0))
    one = F.struct("start", "end", "entity", F.col("match").alias("text"), F.col("rev").alias("reversible"), F.col("fixed").alias("fixed_bytes"))
    calls = numbered.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start", "seq"))).alias("numbers"),
        F.sort_array(F.collect_list(one)).alias("f"),
        F.count("*").alias("n"),
        F.sum("new").alias("new"),
        F.max("bytes").alias("bytes"),
        (F.max("bytes") + F.sum("made")).alias("size"),
    )
    whole = W.partitionBy("__s")
    over = (F.sum("n").over(whole) > engine.max_entities) | (F.sum("new").over(whole) > engine.max_session_bytes) | (F.max("size").over(whole) > engine.max_output_bytes)
    totals = calls.withColumn("over", over)
    kinds = {f.name: f.dataType for f in totals.schema}
    schema = T.StructType([T.StructField("__s", kinds["__s"]), T.StructField("__o", kinds["__o"]), T.StructField("numbers", kinds["numbers"]), T.StructField("error", T.StringType())])
    none = F.lit(None).cast("string").alias("error")
    slow = totals.filter("over").select(*keys, "f", "bytes", none).groupBy("__s").applyInPandas(_replay(engine), schema)
    known = totals.filter("not over").select(*keys, "numbers", none).unionByName(slow).withColumnsRenamed({"error": "__late", "numbers": "__numbers"})
    known = known.withColumnsRenamed({"__s": "__ks", "__o": "__ko"})
    met = marks.drop("bytes").join(known, F.col("__s").eqNullSafe(F.col("__ks")) & F.col("__o").eqNullSafe(F.col("__ko")), "left")
    told = shared_table(met.drop("__ks", "__ko"), "numbers")
    rows = packed(df, __js=F.col(session), __jo=F.col(order), __t=F.col(text))
    joined = rows.join(told, F.col("__js").eqNullSafe(F.col("__s")) & F.col("__jo").eqNullSafe(F.col("__o")), "left")
    fs = F.when(F.col("__late").isNull() & F.col("__early").isNull(), F.col("__f")).otherwise(F.array().cast(CANDIDATES))
    ready = joined.withColumn("__fs", fs).withColumn("__error", F.coalesce("__early", "__late"))
    reps = F.transform(F.arrays_zip(F.col("__fs").alias("f"), F.col("__numbers").alias("n")), lambda x: replacement(engine, x["f"]["entity"], x["f"]["text"], x["n"]["seq"]))
    ready = ready.withColumn("__reps", F.when(F.size("__fs") > 0, reps).otherwise(F.array().cast("array<string>")))
    events = F.transform(F.filter(F.arrays_zip(F.col("__fs").alias("f"), F.col("__reps").alias("r")), lambda x: x["f"]["text"] != x["r"]), lambda x: F.struct(x["f"]["entity"], x["f"]["start"], x["f"]["end"], x["f"]["score"], x["r"].alias("replacement")))
    masked = F.when(F.col("__error").isNull(), spliced(F.col("__t"), F.col("__fs"), F.col("__reps")))
    return unpacked(ready, df.columns, masked=masked, events=events.cast(EVENTS), error=F.col("__error"))


def mapping(df: DataFrame, anonymized: DataFrame, session: str, text: str = "text", engine: Engine | None = None) -> DataFrame:
    """(session, placeholder, entity, plaintext): the reversible replacements of the accepted calls."""
    engine = engine or Engine()
    each = exploded(anonymized.select(session, F.col(text).alias("__t"), F.col("events").alias("__events")), session, "__t", __e=F.col("__events"))
    plain = F.decode(F.substring(F.encode("__t", "UTF-8"), F.col("__e.start") + 1, F.col("__e.end") - F.col("__e.start")), "UTF-8")
    rows = each.select(session, F.col("__e.replacement").alias("placeholder"), F.col("__e.entity").alias("entity"), plain.alias("plaintext"))
    return rows.filter(reversible(engine, F.col("entity"))).distinct()
