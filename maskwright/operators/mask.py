"""Recognition, overlap resolution and one-shot masking, per row and without shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.config import MAX_CANDIDATES, SECRETS, Engine, RegexError, Rule
from maskwright.functions.strategies import replacement
from maskwright.functions.validators import score_ok

CANDIDATE = "struct<entity:string,start:int,end:int,score:double,text:string,cstart:int,cend:int,rec_idx:int,ord:int>"
CANDIDATES = f"array<{CANDIDATE}>"
EVENTS = "array<struct<entity:string,start:int,end:int,score:double,replacement:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """The rows as one column __row beside the named ones, so that no column of theirs clashes with ours."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), *[c.alias(k) for k, c in own.items()])


def unpacked(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The packed columns and the added ones, which take the place of columns of the same name."""
    made = df.select("__row", *[c.alias(f"__added{i}") for i, c in enumerate(added.values())])
    kept = [F.col("__row")[c].alias(c) for c in columns if c not in added]
    return made.select(*kept, *[F.col(f"__added{i}").alias(k) for i, k in enumerate(added)])


def exploded(df: DataFrame, *kept: str, **of: Column) -> DataFrame:
    """The kept columns and a row for each element of the array (elements are not null).

    A plain explode() of a column has Spark infer a filter on its size, which moves below every projection with all that
    the array is made from written out again, matches within loops over matches.
    """
    (name, array), = of.items()
    return df.select(*kept, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def compiled(df: DataFrame, rule: Rule) -> None:
    """Raises RegexError on the driver for a pattern that the executors could not compile."""
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(rule.pattern)
    except Exception as e:
        raise RegexError(f"{rule.name}: {str(e).splitlines()[-1]}") from None


def _located(gaps: Column, whole: Column, own: Column, rule: Rule, index: int, order: int) -> Column:
    """Candidates of one rule from its matches and the texts between them, in bytes and in code points."""
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("c"), _none(CANDIDATES).alias("out"))

    def step(acc, i):
        gap, match, part = F.get(gaps, i), F.get(whole, i), F.get(own, i)
        b_end = acc["b"] + F.octet_length(gap) + F.octet_length(match)
        c_end = acc["c"] + F.char_length(gap) + F.char_length(match)
        found = F.struct(
            F.lit(rule.entity).alias("entity"),
            (b_end - F.octet_length(part)).alias("start"),
            b_end.alias("end"),
            F.lit(float(rule.score)).alias("score"),
            part.alias("text"),
            (c_end - F.char_length(part)).alias("cstart"),
            c_end.alias("cend"),
            F.lit(index).alias("rec_idx"),
            (F.lit(order * 10_000) + i).alias("ord"),
        ).cast(CANDIDATE)
        good = F.lit(True) if rule.predicate is None else rule.predicate(part)
        if rule.boundary:
            before = F.right(F.concat(F.coalesce(F.get(whole, i - 1), F.lit("")), gap), F.lit(1))
            after = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(whole, i + 1), F.lit(""))), F.lit(1))
            good = good & ~before.rlike("[0-9]") & ~after.rlike("[0-9]")
        return F.struct(b_end.alias("b"), c_end.alias("c"), F.when(good, F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    n = F.size(whole)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), start, step, lambda a: a["out"])).otherwise(_none(CANDIDATES))


def with_candidates(df: DataFrame, text: str, engine: Engine) -> DataFrame:
    """Adds __candidates (in recognizer order) and __raw_over, whether a recognizer or the text has too many."""
    plan = list(enumerate(engine.plan()))
    # three projections, whatever the number of rules: matches, the texts between them, candidates
    matches, gaps, found, raw = [], [], [], []
    for order, (index, rule) in plan:
        name = f"__r{order}"
        raw.append(F.size(f"{name}_m"))
        found.append(F.col(name))
        if isinstance(rule, Rule):
            compiled(df, rule)
            likely = F.lit(True) if rule.likely is None else rule.likely(F.col(text))
            hits = lambda g, rule=rule: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))
            matches.append(F.when(likely, hits(0)).otherwise(_none("array<string>")).alias(f"{name}_m"))
            some = F.size(f"{name}_m") > 0
            gaps.append(F.when(some, F.split(text, rule.pattern, -1)).alias(f"{name}_g"))
            if rule.group:
                gaps.append(F.when(some, hits(rule.group)).alias(f"{name}_o"))
        else:
            given = F.coalesce(rule.find(F.col(text)), _none("array<struct<entity:string,start:int,end:int,score:double,text:string>>"))
            matches.append(given.alias(f"{name}_m"))
    candidates = []
    for order, (index, rule) in plan:
        name = f"__r{order}"
        if isinstance(rule, Rule):
            own = F.col(f"{name}_o" if rule.group else f"{name}_m")
            empty = F.raise_error(F.lit(f"InvalidFinding: {rule.name}: empty match")).cast(CANDIDATES)
            made = F.when(F.exists(f"{name}_m", lambda m: m == ""), empty).when(F.size(f"{name}_m") > MAX_CANDIDATES, _none(CANDIDATES)).otherwise(_located(F.col(f"{name}_g"), F.col(f"{name}_m"), own, rule, index, order))
        else:
            made = F.transform(f"{name}_m", _checked(F.col(text), index, order, engine))
        candidates.append(made.alias(name))
    out = df.select(*df.columns, *matches)
    out = out.select("*", *gaps).select("*", *candidates)
    every = F.concat(*found) if found else _none(CANDIDATES)
    over = [r > MAX_CANDIDATES for r in raw] + [F.size(every) > MAX_CANDIDATES]
    any_over = over[0]
    for o in over[1:]:
        any_over = any_over | o
    return out.select(*df.columns, every.alias("__candidates"), any_over.alias("__raw_over"))


def _checked(text: Column, index: int, order: int, engine: Engine):
    """A finding of a user's function, with its span held against the text; a wrong one fails the query."""

    def check(f, i):
        head = F.encode(text, "UTF-8")
        piece = F.substring(head, f["start"] + 1, f["end"] - f["start"])
        before = F.substring(head, F.lit(1), f["start"]).cast("string")
        fits = (f["start"] >= 0) & (f["end"] > f["start"]) & (f["end"] <= F.octet_length(text)) & (piece == F.encode(f["text"], "UTF-8")) & F.call_function("is_valid_utf8", before) & score_ok(f["score"])
        known = f["entity"].isin(list(engine.entities))
        cstart = F.char_length(before)
        own = F.struct(f["entity"], f["start"], f["end"], f["score"], f["text"], cstart.alias("cstart"), (cstart + F.char_length(f["text"])).alias("cend"), F.lit(index).alias("rec_idx"), (F.lit(order * 10_000) + i).alias("ord")).cast(CANDIDATE)
        wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.coalesce(f["entity"], F.lit("null")))).cast(CANDIDATE)
        return F.when(~F.coalesce(known, F.lit(False)), wrong("UnknownEntityType")).when(F.coalesce(fits, F.lit(False)), own).otherwise(wrong("InvalidFinding"))

    return check


def resolved(candidates: Column) -> Column:
    """Non-overlapping findings by start: secrets first, then longer spans, higher scores, earlier recognizers."""
    key = lambda c: F.struct((~c["entity"].isin(list(SECRETS))).cast("int").alias("k1"), (c["start"] - c["end"]).alias("k2"), (-c["score"]).alias("k3"), c["rec_idx"].alias("k4"), c["ord"].alias("k5"), c.alias("c"))
    ordered = F.sort_array(F.transform(candidates, key))

    def take(kept, x):
        own = x["c"]
        clash = F.exists(kept, lambda k: (k["start"] < own["end"]) & (own["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, own))

    chosen = F.aggregate(ordered, _none(CANDIDATES), take)
    by_start = F.sort_array(F.transform(chosen, lambda c: F.struct(c["start"].alias("s"), c.alias("c"))))
    return F.transform(by_start, lambda x: x["c"])


def with_findings(df: DataFrame, text: str, engine: Engine, out: str = "findings") -> DataFrame:
    """Adds the resolved findings and an error code: InvalidUTF8, LimitExceeded or null."""
    code = F.when(~F.call_function("is_valid_utf8", F.col(text)), "InvalidUTF8").when(F.octet_length(text) > engine.max_input_bytes, "LimitExceeded")
    gated = df.withColumn("__text", F.when(code.isNull(), F.col(text))).withColumn("__code", code)
    found = with_candidates(gated, "__text", engine)
    error = F.coalesce("__code", F.when(F.col("__raw_over"), "LimitExceeded"))
    kept = F.when(error.isNull() & F.col("__text").isNotNull(), resolved(F.col("__candidates"))).otherwise(_none(CANDIDATES))
    return found.select(*df.columns, kept.alias(out), error.alias("error"))


def spliced(text: Column, findings: Column, replacements: Column) -> Column:
    """The text with each finding replaced; findings are sorted and disjoint, replacements stand at the same places."""
    start = F.struct(F.lit(0).alias("at"), _none("array<string>").alias("parts"))

    def step(acc, x):
        gap = F.substr(text, acc["at"] + 1, x["f"]["cstart"] - acc["at"])
        return F.struct(x["f"]["cend"].alias("at"), F.concat(acc["parts"], F.array(gap, x["r"])).alias("parts"))

    pairs = F.arrays_zip(findings.alias("f"), replacements.alias("r"))
    rest = lambda a: F.array_join(F.array_append(a["parts"], F.substr(text, a["at"] + 1)), "")
    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(pairs, start, step, rest))


def mask(df: DataFrame, engine: Engine | None = None, text: str = "text") -> DataFrame:
    """Adds masked, events and error: each row by itself, numbers from 1 in each row, nothing remembered.

    Columns of these names that the table has are replaced; all others stay as they are.
    """
    engine = engine or Engine()
    found = with_findings(packed(df, __t=F.col(text)), "__t", engine, "__findings")
    fs = F.col("__findings")
    seq = F.transform(fs, lambda f, i: F.size(F.filter(fs, lambda g, j: (j <= i) & (g["entity"] == f["entity"]))))
    numbered = found.withColumn("__seq", seq)
    reps = F.transform(F.arrays_zip(fs.alias("f"), F.col("__seq").alias("n")), lambda x: replacement(engine, x["f"]["entity"], x["f"]["text"], x["n"]))
    replaced = numbered.withColumn("__reps", reps).withColumn("__masked", spliced(F.col("__t"), fs, F.col("__reps")))
    error = F.coalesce("error", F.when(F.octet_length("__masked") > engine.max_output_bytes, "LimitExceeded"))
    events = F.transform(F.filter(F.arrays_zip(fs.alias("f"), F.col("__reps").alias("r")), lambda x: x["f"]["text"] != x["r"]), lambda x: F.struct(x["f"]["entity"], x["f"]["start"], x["f"]["end"], x["f"]["score"], x["r"].alias("replacement")))
    done = replaced.withColumn("__error", error)
    good = F.col("__error").isNull()
    return unpacked(done, df.columns, masked=F.when(good, F.col("__masked")), events=F.when(good, events).otherwise(_none(EVENTS)).cast(EVENTS), error=F.col("__error"))


def findings(df: DataFrame, engine: Engine | None = None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each resolved finding: the kept columns, entity, start, end (bytes), score and text."""
    found = with_findings(packed(df, __t=F.col(text)), "__t", engine or Engine(), "__findings")
    each = exploded(found, "__row", __f=F.col("__findings"))
    return unpacked(each, list(keep), **{"match" if c == "text" else c: F.col(f"__f.{c}") for c in ("entity", "start", "end", "score", "text")})
