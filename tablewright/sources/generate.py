"""Synthetic tables: sequences and random columns over a row number.

Every value is an expression of the row number, random ones through a hash of
seed, column and row number. A table is therefore the same for any partitioning
and after a lost executor, and has no size limit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
UNIT_MONTHS = {"months": 1, "years": 12}


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text.strip())


def _has_time(*texts: str | None) -> bool:
    return any(t and ("T" in t or re.search(r"\s\d{2}:\d{2}", t)) for t in texts)


def _uniform(id_: Column, seed: int, position: int) -> Column:
    """A double in [0, 1) with 53 random bits."""
    bits = F.xxhash64(F.lit(int(seed)), F.lit(position), id_).bitwiseAND(F.lit((1 << 53) - 1))
    return bits.cast("double") / F.lit(float(1 << 53))


def _decimals(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def _check_decimals(digits: int) -> None:
    if not 0 <= digits <= 10:
        raise ValueError("decimals must be between 0 and 10")


@dataclass(frozen=True)
class NumberSequence:
    name: str
    start: float
    step: float = 1
    stop: float | None = None
    decimals: int = 0

    def check(self) -> None:
        _check_decimals(self.decimals)
        if self.step == 0:
            raise ValueError("step cannot be zero")
        if self.stop is not None and (self.stop - self.start) * self.step < 0:
            raise ValueError("stop lies behind start for this step")

    def rows(self) -> int | None:
        return None if self.stop is None else math.floor((self.stop - self.start) / self.step + 1e-10) + 1

    def column(self, id_: Column, seed: int, position: int) -> Column:
        value = F.lit(float(self.start)) + F.lit(float(self.step)) * id_
        return F.floor(value + 0.5).cast("long") if self.decimals == 0 else _decimals(value, self.decimals)


@dataclass(frozen=True)
class DateSequence:
    """Months and years overflow: January 31 plus one month is early March."""

    name: str
    start: str
    increment: int = 1
    unit: str = "days"
    stop: str | None = None

    def check(self) -> None:
        if self.unit not in (*UNIT_SECONDS, *UNIT_MONTHS):
            raise ValueError(f"unknown unit: {self.unit}")
        if self.increment == 0:
            raise ValueError("increment cannot be zero")
        if self.stop and (_moment(self.stop) - _moment(self.start)).total_seconds() * self.increment < 0:
            raise ValueError("stop lies behind start for this increment")

    def rows(self) -> int | None:
        if not self.stop:
            return None
        start, stop = _moment(self.start), _moment(self.stop)
        if self.unit in UNIT_SECONDS:
            return math.floor((stop - start).total_seconds() / (UNIT_SECONDS[self.unit] * self.increment)) + 1
        months = (stop.year - start.year) * 12 + stop.month - start.month
        guess = abs(months) // (UNIT_MONTHS[self.unit] * abs(self.increment)) + 1
        forward = self.increment > 0

        def inside(i: int) -> bool:
            at = self._shifted(start, i * UNIT_MONTHS[self.unit] * self.increment)
            return at <= stop if forward else at >= stop

        return next((i + 1 for i in range(guess + 1, -1, -1) if inside(i)), 0)

    @staticmethod
    def _shifted(start: datetime, months: int) -> datetime:
        total = start.year * 12 + start.month - 1 + months
        return start.replace(year=total // 12, month=total % 12 + 1, day=1) + timedelta(days=start.day - 1)

    def column(self, id_: Column, seed: int, position: int) -> Column:
        start = F.lit(_moment(self.start).isoformat()).cast("timestamp_ntz")
        n = id_ * F.lit(self.increment)
        if self.unit in UNIT_SECONDS:
            at = start + F.make_dt_interval(secs=(n * UNIT_SECONDS[self.unit]).cast("decimal(18,6)"))
        else:
            months = (n * UNIT_MONTHS[self.unit]).cast("int")
            day = F.date_add(F.add_months(F.trunc(start, "MM"), months), F.dayofmonth(start) - 1)
            at = day.cast("timestamp_ntz") + (start - F.date_trunc("day", start).cast("timestamp_ntz"))
        with_time = self.unit in ("seconds", "minutes", "hours") or _has_time(self.start, self.stop)
        return at if with_time else at.cast("date")


@dataclass(frozen=True)
class RandomNumber:
    """Uniform in [low, high)."""

    name: str
    low: float
    high: float
    decimals: int = 0

    def check(self) -> None:
        _check_decimals(self.decimals)
        if self.low >= self.high:
            raise ValueError("low must be less than high")

    def rows(self) -> int | None:
        return None

    def column(self, id_: Column, seed: int, position: int) -> Column:
        value = _uniform(id_, seed, position) * F.lit(float(self.high - self.low)) + F.lit(float(self.low))
        return F.floor(value).cast("long") if self.decimals == 0 else _decimals(value, self.decimals)


@dataclass(frozen=True)
class RandomDate:
    name: str
    start: str
    stop: str

    def check(self) -> None:
        if _moment(self.start) >= _moment(self.stop):
            raise ValueError("start must lie before stop")

    def rows(self) -> int | None:
        return None

    def column(self, id_: Column, seed: int, position: int) -> Column:
        span = (_moment(self.stop) - _moment(self.start)).total_seconds()
        start = F.lit(_moment(self.start).isoformat()).cast("timestamp_ntz")
        seconds = F.floor(_uniform(id_, seed, position) * F.lit(span)).cast("decimal(18,6)")
        at = start + F.make_dt_interval(secs=seconds)
        return at if _has_time(self.start, self.stop) else at.cast("date")


@dataclass(frozen=True)
class RandomBoolean:
    name: str
    probability: float = 0.5

    def check(self) -> None:
        if not 0 <= self.probability <= 1:
            raise ValueError("probability must be between 0 and 1")

    def rows(self) -> int | None:
        return None

    def column(self, id_: Column, seed: int, position: int) -> Column:
        return _uniform(id_, seed, position) < F.lit(float(self.probability))


@dataclass(frozen=True)
class RandomCategory:
    name: str
    values: tuple[str, ...]
    weights: tuple[float, ...] | None = None

    def check(self) -> None:
        if not self.values:
            raise ValueError("at least one category value is required")
        if self.weights is not None:
            if len(self.weights) != len(self.values):
                raise ValueError("there must be one weight per value")
            if any(w < 0 for w in self.weights) or sum(self.weights) <= 0:
                raise ValueError("weights must be non-negative and not all zero")

    def rows(self) -> int | None:
        return None

    def column(self, id_: Column, seed: int, position: int) -> Column:
        u = _uniform(id_, seed, position)
        labels = F.array(*[F.lit(v) for v in self.values])
        if self.weights is None:
            return F.get(labels, F.floor(u * len(self.values)).cast("int"))
        total, sums = 0.0, []
        for w in self.weights:
            total += w
            sums.append(F.lit(total))
        passed = F.filter(F.array(*sums), lambda edge: edge <= u * F.lit(total))
        return F.get(labels, F.least(F.size(passed), F.lit(len(self.values) - 1)))


Generator = "NumberSequence | DateSequence | RandomNumber | RandomDate | RandomBoolean | RandomCategory"


def row_count(generators: Sequence[Generator]) -> int | None:
    """Rows up to the ``stop`` of the first generator that has one."""
    return next((max(n, 0) for n in (g.rows() for g in generators) if n is not None), None)


def generate(spark: SparkSession, generators: Sequence[Generator], rows: int | None = None, seed: int = 0) -> DataFrame:
    """A table with one column per generator."""
    if not generators:
        raise ValueError("at least one column generator is required")
    names = [g.name.strip() for g in generators]
    if "" in names or len(set(names)) < len(names):
        raise ValueError("column names must be present and distinct")
    for g in generators:
        g.check()
    n = row_count(generators) if rows is None else rows
    if n is None or n <= 0:
        raise ValueError("give a positive row count, or a stop value to derive it from")
    base = spark.range(n)
    return base.select(*[g.column(F.col("id"), seed, i).alias(g.name) for i, g in enumerate(generators)])
