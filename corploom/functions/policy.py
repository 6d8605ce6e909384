"""Licence policies, record filters and date intervals as column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression: * and ? stay within one path part, [...] are classes, a backslash quotes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1)
            if end < 0:
                raise ValueError(f"unclosed class in pattern {pattern!r}")
            out.append("[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\":
            i += 1
            if i == len(pattern):
                raise ValueError(f"pattern {pattern!r} ends with a backslash")
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in " _-/" else c)
        i += 1
    return "^" + "".join(out) + "$"


def any_match(value: Column, patterns: list[str]) -> Column:
    """Whether a value matches any of the patterns; a null value is the empty string."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(value, F.lit("")).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


@dataclass(frozen=True)
class Values:
    """Patterns that a value must match (any of include, if given) and must not match (exclude wins)."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def allows(self, *values: Column) -> Column:
        hit = lambda p: reduce(lambda a, b: a | b, [any_match(v, p) for v in values], F.lit(False))
        return ~hit(self.exclude) & (F.lit(True) if not self.include else hit(self.include))


def date_bounds(date: Column) -> tuple[Column, Column]:
    """The half-open interval [start, end) of a year, month, day or instant text; nulls if it is none (month 13, 30 February)."""
    y, m, d = date.rlike(r"^\d{4}$"), date.rlike(r"^\d{4}-\d{2}$"), date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    instant = date.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$")
    day = F.when(y, F.concat(date, F.lit("-01-01"))).when(m, F.concat(date, F.lit("-01"))).when(d, date)
    whole = day.try_cast("timestamp")
    start = F.when(instant, F.upper(date).try_cast("timestamp")).otherwise(whole)
    end = F.when(y, F.add_months(start, 12).cast("timestamp")).when(m, F.add_months(start, 1).cast("timestamp")).when(d, F.date_add(start, 1).cast("timestamp"))
    return start, F.coalesce(end, F.when(instant, start + F.expr("INTERVAL 1 MICROSECOND")))


def date_overlaps(date: Column, begin: str | None, until: str | None) -> Column:
    """Whether the date's interval overlaps that of the bounds; a missing or unreadable date never does."""
    start, end = date_bounds(date)
    ok = start.isNotNull()
    if begin:
        ok &= end > date_bounds(F.lit(begin))[0]
    if until:
        ok &= start < date_bounds(F.lit(until))[1]
    return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class RecordFilter:
    """A record is kept if its main content is as asked (None: whatever it is), it is not excluded, and passes every value and date condition.

    repetitive and boilerplate exclude records whose flag equals the given value; a null flag never excludes.
    """

    licenses: Values = field(default_factory=Values)
    languages: Values = field(default_factory=Values)
    sources: Values = field(default_factory=Values)
    date_from: str | None = None
    date_to: str | None = None
    repetitive: bool | None = None
    boilerplate: bool | None = None
    exclude_licenses: list[str] = field(default_factory=list)
    main_content: bool | None = True

    def validate(self) -> None:
        """Raises ValueError for a filter without any condition, contradictory licences, patterns that cannot be read, and dates out of order."""
        values = (self.licenses, self.languages, self.sources)
        if not (any(v.include or v.exclude for v in values) or self.date_from or self.date_to or self.exclude_licenses or self.repetitive is not None or self.boilerplate is not None or self.main_content is not None):
            raise ValueError("a record filter needs at least one condition")
        if self.exclude_licenses and (self.licenses.include or self.licenses.exclude):
            raise ValueError("excluded licences cannot be combined with a licence filter")
        for p in [p for v in values for p in (*v.include, *v.exclude)] + self.exclude_licenses:
            glob_regex(p)
        for d in (self.date_from, self.date_to):
            if d is not None and not re.match(r"\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2}))?)?)?\Z", d):
                raise ValueError(f"{d!r} is no year, month, day or instant")
        if self.date_from and self.date_to and self.date_from[: len(self.date_to)] > self.date_to[: len(self.date_from)]:
            raise ValueError("the first date is after the last")

    def predicate(self) -> Column:
        c = F.col
        keep = F.lit(True) if self.main_content is None else F.coalesce(c("main_content"), F.lit(True)) == self.main_content
        for flag, value in (("repetitive_content", self.repetitive), ("boilerplate_content", self.boilerplate)):
            if value is not None:
                keep &= ~F.coalesce(c(flag) == value, F.lit(False))
        keep &= ~any_match(c("license"), self.exclude_licenses)
        keep &= self.licenses.allows(c("license")) & self.languages.allows(c("language")) & self.sources.allows(c("source"), c("source_name"))
        if self.date_from or self.date_to:
            keep &= date_overlaps(c("date"), self.date_from, self.date_to)
        return keep


@dataclass(frozen=True)
class FilterPolicy:
    """A filter for all records and further ones for single corpora: a record must pass the first and that of its corpus, if there is one."""

    overall: RecordFilter | None = None
    corpora: dict[str, RecordFilter] = field(default_factory=dict)

    def validate(self, selected: list[str]) -> None:
        """Raises ValueError if there is no filter at all, one of a corpus that is not selected, or one that is not valid itself."""
        if self.overall is None and not self.corpora:
            raise ValueError("a filter policy needs a filter")
        for name in sorted(set(self.corpora) - set(selected)):
            raise ValueError(f"the filter policy names the corpus {name!r}, which is not selected")
        for f in ([self.overall] if self.overall else []) + list(self.corpora.values()):
            f.validate()

    def predicate(self, corpus: Column) -> Column:
        """One predicate over the records; the corpora of the policy are compared, the others pass."""
        keep = self.overall.predicate() if self.overall else F.lit(True)
        for name, f in sorted(self.corpora.items()):
            keep &= F.coalesce(corpus != name, F.lit(True)) | f.predicate()
        return keep
