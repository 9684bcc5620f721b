"""Places and running sums in an order, where one group can be too large for a task.

A window sorts a group in one task. Here rows are dealt by ranges of group and order, sorted within a
range and stored; counts or sums of each group in each range, which are few, are added up to what comes before a range.
So a group that is a third of all rows is spread over a third of the tasks. Where a count shows that no group has more
rows than a task sorts with ease, one window by group is less work and gives the same places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.checkpoints import cut

_PART, _NR = "__part", "__nr"


def _ranged(rows: DataFrame, by: list[str], order: list[Column], stored: bool = False) -> DataFrame:
    """rows in ranges of group and order, stored, with the range and an id that ascends within it."""
    keys = [F.col(c) for c in by] + order
    if not stored:
        rows = cut(rows)  # ranges are found by a sample: what makes the rows is not to run twice
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(dealt.select("*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().alias(_NR)))


def _beside(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """rows with what is known of their group's part in their range; a null group is a group."""
    names = {c: f"__by{k}" for k, c in enumerate(by)}
    spans = spans.withColumnsRenamed(names | {_PART: "__in"})
    same = [rows[c].eqNullSafe(spans[n]) for c, n in names.items()]
    return rows.join(spans, reduce(Column.__and__, same, rows[_PART] == spans["__in"])).drop(*names.values(), "__in")


def places(rows: DataFrame, by: list[str], order: list[Column], name: str = "place", total: str | None = None, fits: int = 0) -> DataFrame:
    """rows with their place, from 0, among the rows of their group in the order given, and with `total` the group's rows.

    Rows that are equal in the order get their places in any way, but fixed: the table is stored. Groups of at most `fits` rows
    are sorted by a window, if all are such; by default none is."""
    if fits:
        rows = cut(rows)  # counted, then placed
        most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most <= fits:
            group = Window.partitionBy(*by)
            more = {total: F.count("*").over(group)} if total else {}
            return cut(rows.withColumns({name: (F.row_number().over(group.orderBy(*order)) - 1).cast("long"), **more}))
    ranged = _ranged(rows, by, order, stored=bool(fits))
    spans = ranged.groupBy(*by, _PART).agg(F.min(_NR).alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    before = F.sum("__n").over(group.orderBy(_PART)) - F.col("__n")
    more = [F.sum("__n").over(group).alias(total)] if total else []
    spans = cut(spans.select(*by, _PART, (before - F.col("__first")).alias("__shift"), *more))
    out = _beside(ranged, spans, by)
    return out.withColumn(name, F.col(_NR) + F.col("__shift")).drop(_PART, _NR, "__shift")


def _sums(rows: DataFrame, by: list[str], order: list[Column], value: str) -> tuple[DataFrame, DataFrame]:
    """Stored ranges, and of each group's part in a range its sum, what comes before and the group's total."""
    ranged = _ranged(rows, by, order)
    spans = ranged.groupBy(*by, _PART).agg(F.sum(value).alias("__sum"))
    group = Window.partitionBy(*by)
    before = F.sum("__sum").over(group.orderBy(_PART)) - F.col("__sum")
    return ranged, cut(spans.withColumns({"__before": before, "__total": F.sum("__sum").over(group)}))


def _inside(value: str, by: list[str]) -> Column:
    """The running sum within a range."""
    return F.sum(value).over(Window.partitionBy(*by, _PART).orderBy(_NR).rowsBetween(Window.unboundedPreceding, 0))


def running_sums(rows: DataFrame, by: list[str], order: list[Column], value: str, name: str = "running", total: str = "total") -> DataFrame:
    """rows with the sum of `value` up to and with them in their group's order, and the group's sum.

    Within a range a window adds up; it holds a group's rows of one range, which has the size of a task."""
    ranged, spans = _sums(rows, by, order, value)
    out = _beside(ranged.withColumn("__inside", _inside(value, by)), spans.drop("__sum"), by)
    return out.withColumns({name: F.col("__before") + F.col("__inside"), total: F.col("__total")}).drop(_PART, _NR, "__before", "__inside", "__total")


def drawn(rows: DataFrame, by: list[str], at: str, value: str, u: Column) -> DataFrame:
    """Of each group the first `at`, in its own order, whose running share of `value` is above u: a search in the one range where the share
    passes u. Where rounding leaves none, the last with a value; in a group without any, the last."""
    ranged, spans = _sums(rows, by, [F.col(at)], value)
    passes = F.when((F.col("__before") + F.col("__sum")) / F.nullif("__total", F.lit(0.0)) > u, F.col(_PART))
    group = Window.partitionBy(*by)
    part = F.coalesce(F.min(passes).over(group), F.max(F.when(F.col("__sum") > 0, F.col(_PART))).over(group), F.max(_PART).over(group))
    spans = spans.withColumn("__chosen", part).where(F.col("__chosen") == F.col(_PART))
    rows = _beside(ranged, spans.select(*by, _PART, "__before", "__total"), by).withColumn("__inside", _inside(value, by))
    share = (F.col("__before") + F.col("__inside")) / F.nullif("__total", F.lit(0.0))
    found = F.coalesce(F.min(F.when(share > u, F.col(at))), F.max(F.when(F.col(value) > 0, F.col(at))), F.max(at))
    return rows.groupBy(*by).agg(found.alias(at))
