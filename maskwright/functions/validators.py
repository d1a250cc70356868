"""Checks on a matched text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(c: Column) -> Column:
    """At least two digits, nothing else, and a Luhn sum that ten divides."""
    digits = c.rlike("^[0-9]{2,}$")
    return F.coalesce(digits & F.call_function("luhn_check", F.when(digits, c)), F.lit(False))


def china_id(c: Column) -> Column:
    """18 characters whose last is the ISO 7064 MOD 11-2 check of the first 17; x may be of either case."""
    weights = F.array(*[F.lit(2 ** (17 - i) % 11) for i in range(17)])
    total = F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda t, i: t + F.substr(c, i, F.lit(1)).try_cast("int") * F.get(weights, i - 1))
    check = F.substr(F.lit("10X98765432"), F.pmod(total, F.lit(11)) + 1, F.lit(1))
    return F.coalesce(c.rlike("^[0-9]{17}[0-9Xx]$") & (check == F.upper(F.right(c, F.lit(1)))), F.lit(False))


def ssn(c: Column) -> Column:
    area, group, serial = F.substring(c, 1, 3), F.substring(c, 5, 2), F.substring(c, 8, 4)
    return c.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def entropy(c: Column) -> Column:
    """Shannon entropy over the UTF-8 bytes, in bits a byte; 0 for an empty text."""
    code = F.hex(F.encode(c, "UTF-8"))
    n = F.octet_length(c)
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(code, 2 * i + 1, F.lit(2)))
    share = lambda b: F.size(F.filter(every, lambda x: x == b)) / n
    total = F.aggregate(F.array_distinct(every), F.lit(0.0), lambda t, b: t - share(b) * F.log2(share(b)))
    return F.when(n > 0, total).otherwise(0.0)


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)^([\"'])(.*)\\1$", "$2")


def score_ok(c: Column) -> Column:
    return c.between(0.0, 1.0) & ~F.isnan(c)
