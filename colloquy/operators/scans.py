"""Scans along ordered rows of a key, without a task per key.

A plain window puts all rows of a key into one task. Here keys with more than LIMIT rows are cut into slices: by quantiles of the first
order column, and where a quantile's part is still too large, evenly within it. A scan runs inside each slice; a slice's summary (its last
value, its sum, its maximum, its number of rows) is one row, and the summaries before a slice give what it starts from. Only summaries, a few rows
per cut key, meet in one task. The bounds of slices are checkpointed, as the rows and their summaries must be cut alike.

Rows of a key that share the value of the first order column stay in one slice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

LIMIT = 2_000_000
QUANTILES = 256
STEP = 16


@dataclass
class Scan:
    """What a scan gives each row inside its slice, what a slice sums up to, how summaries pass on, how both join, and for which row
    (the first or the last one of its slice) what lies beyond decides alone."""

    local: Callable[[Window], Column]
    summary: Callable[[Column], Column]  # of the order as a struct
    carried: Callable[[Column, Window], Column]
    joined: Callable[[Column, Column, Column], Column]  # local, carried, whether the row is that one
    edge: Callable = F.lag


def _all_before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _up_to(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def previous(value: Column) -> Scan:
    """The value of the row before, null for a key's first row."""
    return Scan(lambda w: F.lag(value).over(w), lambda order: F.max_by(F.struct(value.alias("v")), order), lambda s, w: F.lag(s).over(w)["v"], lambda own, before, first: F.when(first, before).otherwise(own))


def following(value: Column) -> Scan:
    """The value of the row behind, null for a key's last row."""
    return Scan(lambda w: F.lead(value).over(w), lambda order: F.min_by(F.struct(value.alias("v")), order), lambda s, w: F.lead(s).over(w)["v"], lambda own, behind, last: F.when(last, behind).otherwise(own), F.lead)


def running_sum(value: Column) -> Scan:
    """Sum up to and with the row."""
    return Scan(lambda w: F.sum(value).over(_up_to(w)), lambda order: F.sum(value), lambda s, w: F.sum(s).over(_all_before(w)), lambda own, before, first: F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0))))


def row_number() -> Scan:
    """From 1."""
    return Scan(lambda w: F.row_number().over(w).cast("long"), lambda order: F.count("*"), lambda s, w: F.sum(s).over(_all_before(w)), lambda own, before, first: own + F.coalesce(before, F.lit(0)))


def highest_before(value: Column) -> Scan:
    """The greatest value of the rows before, null where there is none."""
    return Scan(lambda w: F.max(value).over(_all_before(w)), lambda order: F.max(value), lambda s, w: F.max(s).over(_all_before(w)), lambda own, before, first: F.greatest(own, before))


def last_known(value: Column) -> Scan:
    """The last value up to and with the row that is not null."""
    kept = F.when(value.isNotNull(), F.struct(value.alias("v")))
    return Scan(
        lambda w: F.last(value, True).over(_up_to(w)),
        lambda order: F.max_by(kept, F.when(value.isNotNull(), order)),
        lambda s, w: F.last(s, True).over(_all_before(w))["v"],
        lambda own, before, first: F.coalesce(own, before),
    )


class Sliced:
    """rows cut into slices; scans add columns to them one after the other, without moving them again."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], limit: int | None = None):
        """order: columns, ascending, nulls first; the first one a number, date or timestamp."""
        self.keys, self.order, self.columns = keys, order, rows.columns
        kind = rows.schema[order[0]].dataType.typeName()
        value = F.col(order[0])
        at = (F.unix_micros(value.cast("timestamp")) if kind.startswith(("timestamp", "date")) else value).cast("double")
        limit = limit or LIMIT
        shares = [k / QUANTILES for k in range(1, QUANTILES)]
        cuts = F.percentile_approx(at, F.array(*map(F.lit, shares)), 10_000)
        many = rows.groupBy(*(F.col(k).alias(f"_slice_by_{k}") for k in keys)).agg(F.count("*").alias("_n"), F.min(at).alias("_slice_low"), F.max(at).alias("_slice_high"))
        hot = checkpointed(many.where(F.col("_n") > limit))
        self.cut = not hot.isEmpty()
        if self.cut:
            same = [F.col(k).eqNullSafe(F.col(f"_slice_by_{k}")) for k in keys]
            found = rows.join(hot.select(*(f"_slice_by_{k}" for k in keys), "_n"), _all(same), "left_semi").groupBy(*(F.col(k).alias(f"_slice_by_{k}") for k in keys)).agg(cuts.alias("_slice_cuts"))
            hot = checkpointed(_joined(hot, found, [f"_slice_by_{k}" for k in keys]))
            hot = hot.withColumn("_slice_steps_at", F.filter("_slice_cuts", lambda c, i: i % STEP == STEP - 1))
            rows = _with_slice(rows.join(hot, _all(same), "left"), at, limit)
        else:
            rows = rows.withColumn("_slice", F.lit(0).cast("long")).withColumn("_n", F.lit(None).cast("long"))
        self.rows = rows.select(*self.columns, "_slice", "_n")

    def add(self, name: str, scan: Scan) -> Sliced:
        """The scan's value as a column. It may use columns that scans before have added."""
        own = Window.partitionBy(*self.keys, "_slice", "_n").orderBy(*self.order)  # _n: so that the filter below reaches the scan
        local = self.rows.withColumn("_slice_own", scan.local(own))
        if not self.cut:
            self.rows = local.withColumn(name, F.col("_slice_own")).drop("_slice_own")
        else:
            local = local.withColumn("_slice_edge", scan.edge(F.lit(1)).over(own).isNull())
            ids = [F.col(k).alias(f"_slice_by_{k}") for k in self.keys]
            sums = self.rows.where("_n is not null").groupBy(*ids, F.col("_slice").alias("_slice_at")).agg(scan.summary(F.struct(*self.order)).alias("_slice_sum"))
            along = Window.partitionBy(*(f"_slice_by_{k}" for k in self.keys)).orderBy("_slice_at")
            carry = sums.withColumn("_slice_carried", scan.carried(F.col("_slice_sum"), along)).drop("_slice_sum")
            same = [F.col(k).eqNullSafe(F.col(f"_slice_by_{k}")) for k in self.keys]
            met = local.join(carry, _all([*same, F.col("_slice") == F.col("_slice_at")]), "left")
            self.rows = met.withColumn(name, scan.joined(F.col("_slice_own"), F.col("_slice_carried"), F.col("_slice_edge"))).drop("_slice_own", "_slice_edge", "_slice_carried", "_slice_at", *(f"_slice_by_{k}" for k in self.keys))
        self.columns = [*(c for c in self.columns if c != name), name]
        return self

    def with_column(self, name: str, value: Column) -> Sliced:
        """A column of the row's own columns."""
        self.rows = self.rows.withColumn(name, value)
        self.columns = [*(c for c in self.columns if c != name), name]
        return self

    def result(self) -> DataFrame:
        return self.rows.select(*self.columns)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    renamed = b.select(*(F.col(k).alias(f"{k}_b") for k in keys), *(c for c in b.columns if c not in keys))
    return a.join(renamed, _all([F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys])).drop(*(f"{k}_b" for k in keys))


def _with_slice(rows: DataFrame, at: Column, limit: int) -> DataFrame:
    """rows with _slice: the number of quantiles below, then the even part within two of them. It never falls as the value rises. Quantiles are looked
    through in steps of STEP, then one by one, and their number is a column, as a row would otherwise be held against all of them time and again."""
    cuts = F.col("_slice_cuts")
    under = lambda some: F.size(F.filter(some, lambda c: c < at))
    steps = rows.withColumn("_slice_steps", F.when(F.col("_n").isNotNull(), under(F.col("_slice_steps_at"))))
    found = steps.withColumn("_slice_below", (F.col("_slice_steps") * STEP + under(F.slice(cuts, F.col("_slice_steps") * STEP + 1, STEP))).cast("long"))
    below = F.col("_slice_below")
    low = F.when(below == 0, F.col("_slice_low")).otherwise(F.get(cuts, below.cast("int") - 1))
    high = F.when(below == F.size(cuts), F.col("_slice_high")).otherwise(F.get(cuts, below.cast("int")))
    parts = F.ceil(F.col("_n") / (QUANTILES * limit)).cast("long")
    part = F.when((high > low) & (parts > 1), F.floor((at - low) / (high - low) * parts)).otherwise(0)
    number = F.coalesce(below * (parts + 1) + F.least(F.greatest(part, F.lit(0)), parts), F.lit(-1)).cast("long")
    return found.withColumn("_slice", F.when(F.col("_n").isNull(), F.lit(0).cast("long")).otherwise(number))
