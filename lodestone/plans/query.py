"""Query trees and their simplification, in plain Python on the driver.

Numbers compare by their bits, so that -0.0 and 0.0 stay apart.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, replace
from enum import Enum

from lodestone.errors import IllegalArgument
from lodestone.functions.similarity import f32


class Occur(str, Enum):
    MUST = "must"
    SHOULD = "should"
    MUST_NOT = "must_not"
    FILTER = "filter"


@dataclass(frozen=True)
class Bound:
    """An end of a range: included, excluded, or none at all."""

    value: int | float | None = None
    included: bool = True

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Bound) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())

    def key(self) -> tuple:
        v = struct.pack("<d", self.value) if isinstance(self.value, float) else self.value
        return v, self.included or self.value is None


UNBOUNDED = Bound()


def included(value: int | float) -> Bound:
    return Bound(value)


def excluded(value: int | float) -> Bound:
    return Bound(value, False)


class Query:
    """Any node of a query tree."""

    def boost(self, by: float) -> Query:
        return Boost(self, by)

    def constant_score(self) -> Query:
        return ConstantScore(self)

    def rewrite(self) -> Query:
        """The simplest query that matches and scores the same."""
        before, after = None, self
        while before != after:
            before, after = after, simplified(after)
        return after


@dataclass(frozen=True)
class TermQuery(Query):
    field: str
    term: str


@dataclass(frozen=True)
class PhraseQuery(Query):
    """Terms at fixed distances: ``terms`` are (term, offset)."""

    field: str
    terms: tuple[tuple[str, int], ...] = ()

    def term(self, text: str) -> PhraseQuery:
        """One more term, right after the last."""
        return self.term_at(text, self.terms[-1][1] + 1 if self.terms else 0)

    def term_at(self, text: str, offset: int) -> PhraseQuery:
        return replace(self, terms=(*self.terms, (text, offset)))


@dataclass(frozen=True)
class I64Range(Query):
    field: str
    lower: Bound = UNBOUNDED
    upper: Bound = UNBOUNDED


@dataclass(frozen=True)
class F64Range(Query):
    field: str
    lower: Bound = UNBOUNDED
    upper: Bound = UNBOUNDED


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class MatchNone(Query):
    pass


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float

    def __post_init__(self):
        object.__setattr__(self, "factor", f32(self.factor) if math.isfinite(self.factor) and abs(self.factor) < 3.5e38 else self.factor)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Boost) and struct.pack("<d", self.factor) == struct.pack("<d", other.factor) and self.query == other.query

    def __hash__(self) -> int:
        return hash((self.query, struct.pack("<d", self.factor)))


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query


@dataclass(frozen=True)
class BooleanQuery(Query):
    clauses: tuple[tuple[Query, Occur], ...] = ()
    minimum_should_match: int = 0

    def clause(self, query: Query, occur: Occur) -> BooleanQuery:
        return replace(self, clauses=(*self.clauses, (query, occur)))

    def must(self, query: Query) -> BooleanQuery:
        return self.clause(query, Occur.MUST)

    def should(self, query: Query) -> BooleanQuery:
        return self.clause(query, Occur.SHOULD)

    def must_not(self, query: Query) -> BooleanQuery:
        return self.clause(query, Occur.MUST_NOT)

    def filter(self, query: Query) -> BooleanQuery:
        return self.clause(query, Occur.FILTER)

    def at_least(self, n: int) -> BooleanQuery:
        """Asks for ``n`` of the SHOULD clauses."""
        if n < 0:
            raise IllegalArgument("minimum_should_match must not be negative")
        return replace(self, minimum_should_match=n)

    def of(self, occur: Occur) -> list[Query]:
        return [q for q, o in self.clauses if o == occur]


def simplified(q: Query) -> Query:
    """One pass of simplification over a whole tree."""
    if isinstance(q, Boost):
        inner = simplified(q.query)
        if q.factor == 1 or isinstance(inner, MatchNone):
            return inner
        return Boost(inner.query, f32(inner.factor * q.factor)) if isinstance(inner, Boost) else Boost(inner, q.factor)
    if isinstance(q, ConstantScore):
        inner = simplified(q.query)
        if isinstance(inner, MatchNone):
            return inner
        return ConstantScore(inner.query if isinstance(inner, ConstantScore | Boost) else inner)
    if isinstance(q, PhraseQuery) and len(q.terms) < 2:
        return TermQuery(q.field, q.terms[0][0]) if q.terms else MatchNone()
    return _boolean(q) if isinstance(q, BooleanQuery) else q


def _boolean(q: BooleanQuery) -> Query:
    needed = q.minimum_should_match
    clauses = [(simplified(c), o) for c, o in q.clauses]
    if any(isinstance(c, MatchNone) and o in (Occur.MUST, Occur.FILTER) for c, o in clauses):
        return MatchNone()
    clauses = [(c, o) for c, o in clauses if not isinstance(c, MatchNone)]
    # What only excludes matches nothing.
    if all(o == Occur.MUST_NOT for _, o in clauses) or sum(o == Occur.SHOULD for _, o in clauses) < needed:
        return MatchNone()
    if len(clauses) == 1 and needed <= 1:
        only, occur = clauses[0]
        return Boost(ConstantScore(only), 0.0) if occur == Occur.FILTER else only
    summed = {Occur.MUST} | ({Occur.SHOULD} if needed <= 1 else set())
    # Equal scoring clauses become one, their boosts added in double precision; equal others are kept once,
    # and a filter that an earlier MUST clause implies is not kept at all.
    boosts: dict[tuple[Query, Occur], float] = {}
    for c, o in clauses:
        if o in summed:
            base, by = (c.query, c.factor) if isinstance(c, Boost) else (c, 1.0)
            boosts[base, o] = boosts.get((base, o), 0.0) + by
        elif not (o == Occur.FILTER and (c, Occur.MUST) in boosts):
            boosts.setdefault((c, o), 1.0)
    kept = tuple((c if by == 1 or o not in (Occur.MUST, Occur.SHOULD) else Boost(c, f32(by)), o) for (c, o), by in boosts.items())
    return BooleanQuery(kept, needed)
