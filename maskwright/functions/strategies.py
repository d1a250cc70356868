"""What stands in for a finding, as column expressions of (entity, text, seq)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered(entity: Column, text: Column, seq: Column) -> Column:
    return F.concat(F.lit("["), entity, F.lit("_"), seq.cast("string"), F.lit("]"))


def mask_middle(entity: Column, text: Column, seq: Column) -> Column:
    """Stars for up to seven code points; of longer texts the first three and the last four stay."""
    n = F.char_length(text)
    kept = F.concat(F.left(text, F.lit(3)), F.repeat(F.lit("*"), n - 7), F.right(text, F.lit(4)))
    return F.when(n <= 7, F.repeat(F.lit("*"), n)).otherwise(kept)


def hashed(entity: Column, text: Column, seq: Column) -> Column:
    return F.left(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(8))


NAMED = {"placeholder": numbered, "redact": numbered, "mask_middle": mask_middle, "hash": hashed}


def replacement(engine, entity: Column, text: Column, seq: Column) -> Column:
    """By each entity's strategy; a strategy is a name above or a function of the three columns."""
    out = numbered(entity, text, seq)
    for name, strategy in engine.strategies.items():
        made = (NAMED[strategy] if isinstance(strategy, str) else strategy)(entity, text, seq)
        if not isinstance(strategy, str):
            made = F.when(F.call_function("is_valid_utf8", made), made).otherwise(F.raise_error(F.lit(f"InvalidUTF8: strategy of {name}")).cast("string"))
        out = F.when(entity == name, made).otherwise(out)
    return out


def reversible(engine, entity: Column) -> Column:
    names = [e for e in engine.entities if engine.strategy(e) == "placeholder"]
    return entity.isin(names)
