"""Entities, regions, limits, errors and the engine's configuration, all of which live on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

#: Entity names, the secret family, and the limits' defaults.
ENTITIES = ("PHONE", "EMAIL", "IDCARD", "BANKCARD", "IP", "URL", "LANDLINE", "SSN", "CLOUDKEY", "PRIVATEKEY", "JWT", "GITTOKEN", "SECRET", "KEYWORD")
SECRETS = ("CLOUDKEY", "PRIVATEKEY", "JWT", "GITTOKEN", "SECRET")
UNIVERSAL, CN, US = "universal", "cn", "us"
MAX_CANDIDATES = 3000
MAX_KEYWORDS, MAX_KEYWORD_BYTES = 3000, 64 << 10
MAX_NAME_BYTES, MAX_ENTITY_BYTES = 128, 64
MAX_RESTORE_EVENTS, MAX_REPORT_BYTES = 65_536, 16 << 20


class MaskingError(Exception):
    """Any error of this package."""


class InvalidConfig(MaskingError): ...


class InvalidFinding(MaskingError): ...


class InvalidUTF8(MaskingError): ...


class LimitExceeded(MaskingError): ...


class RegexError(MaskingError): ...


class StreamClosed(MaskingError): ...


class StreamRestoreError(MaskingError): ...


class UnknownEntityType(MaskingError): ...


class InvalidRequest(MaskingError): ...


@dataclass(frozen=True)
class Rule:
    """A recognizer by pattern (Java syntax, ASCII classes); predicate: Column of the match to Column of boolean.

    likely: a cheap condition on the text that every match needs; group: the part of the match that is the finding;
    boundary: matches next to an ASCII digit are dropped, after matching.
    """

    name: str
    entity: str
    pattern: str
    score: float
    region: str = UNIVERSAL
    boundary: bool = False
    predicate: Callable[[Column], Column] | None = None
    likely: Callable[[Column], Column] | None = None
    group: int = 0


@dataclass(frozen=True)
class Recognizer:
    """A recognizer by function: Column of text to Column of array<struct<entity,start,end,score,text>>, e.g. a pandas UDF."""

    name: str
    find: Callable[[Column], Column]
    region: str = UNIVERSAL


@dataclass(frozen=True)
class Engine:
    """Immutable configuration; each with_ method gives a changed copy, the last one wins."""

    recognizers: tuple | None = None
    strategies: dict[str, object] = field(default_factory=dict)
    entities: tuple[str, ...] = ENTITIES
    regions: tuple[str, ...] | None = None
    keywords: tuple[str, ...] = ()
    max_entities: int = 10_000
    max_session_bytes: int = 10 << 20
    max_input_bytes: int = 1 << 20
    max_output_bytes: int = 16 << 20

    def with_recognizers(self, *rules) -> Engine:
        return replace(self, recognizers=tuple(rules))

    def with_keywords(self, *words: str) -> Engine:
        if self.keywords:
            raise InvalidConfig("keywords are set once")
        if not words or any(not w for w in words) or len(words) > MAX_KEYWORDS or sum(len(w.encode()) for w in words) > MAX_KEYWORD_BYTES:
            raise InvalidConfig("keywords must be non-empty, at most 3000, and 64 KiB together")
        if any(len(w.encode()) > self.max_input_bytes for w in words):
            raise InvalidConfig("a keyword is longer than an input may be")
        if len(set(words)) < len(words):
            raise InvalidConfig("a keyword is given twice")
        return replace(self, keywords=words)

    def with_regions(self, *regions: str) -> Engine:
        if any(r not in (CN, US) for r in regions):
            raise InvalidConfig("regions are cn and us; universal rules always hold")
        return replace(self, regions=regions)

    def with_entity_type(self, name: str) -> Engine:
        if not re.fullmatch("[A-Z][A-Z0-9]*", name) or len(name) > MAX_ENTITY_BYTES:
            raise InvalidConfig(f"bad entity name {name!r}")
        return self if name in self.entities else replace(self, entities=(*self.entities, name))

    def with_strategy(self, entity: str, strategy) -> Engine:
        if entity not in self.entities:
            raise UnknownEntityType(entity)
        if entity in SECRETS and strategy == "placeholder":
            raise InvalidConfig("secrets are never reversible")
        return replace(self, strategies={**self.strategies, entity: strategy})

    def with_limits(self, **limits: int) -> Engine:
        if any(v <= 0 for v in limits.values()) or not set(limits) <= {"max_entities", "max_session_bytes", "max_input_bytes", "max_output_bytes"}:
            raise InvalidConfig("limits are positive")
        return replace(self, **limits)

    def strategy(self, entity: str):
        return self.strategies.get(entity, "redact" if entity in SECRETS else "placeholder")

    @property
    def max_seq_digits(self) -> int:
        return len(str(self.max_entities))

    def plan(self) -> list[tuple[int, object]]:
        """(index, recognizer) in order: region pruning, name checks, keywords last. A bundle's rules share an index."""
        from maskwright.operators.rules import DEFAULT, keyword_rule

        listed = DEFAULT if self.recognizers is None else self.recognizers
        names, out = set(), []
        for own in listed:
            bundle = own if isinstance(own, (list, tuple)) else (own,)
            kept = [r for r in bundle if r.region == UNIVERSAL or self.regions is None or r.region in self.regions]
            if not kept:
                continue
            name = "secret" if len(bundle) > 1 else kept[0].name
            if not name or len(name.encode()) > MAX_NAME_BYTES or name == "keyword" or name in names:
                raise InvalidConfig(f"bad or repeated recognizer name {name!r}")
            names.add(name)
            index = len(names) - 1
            out += [(index, r) for r in kept]
        if self.keywords:
            out.append((len(names), keyword_rule(self.keywords)))
        for _, r in out:
            if isinstance(r, Rule) and r.entity not in self.entities:
                raise UnknownEntityType(r.entity)
            if isinstance(r, Rule) and not 0.0 <= r.score <= 1.0:
                raise InvalidFinding(f"{r.name}: score {r.score}")
        return out
