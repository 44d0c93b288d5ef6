"""Running aggregates over the order of a key's rows, without one task that sees a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

#: Rows, or for times microseconds, of one range.
ROWS, HOURS = 1 << 16, 6 * 3_600_000_000


def _sum(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


_AGG = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
#: How the value of a row's own range goes with that of the ranges before it.
_FOLD = {"max": F.greatest, "min": F.least, "sum": lambda own, prior: _sum(prior, own), "last": F.coalesce}


def before(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], *, ties: tuple[str, ...] = (), span: int | None = None, reverse: bool = False, inclusive: bool = False) -> DataFrame:
    """Adds each of ``values`` (name: (max, min, sum or last, column)) over the rows of the same keys that stand before a row.

    Rows stand in the order of ``order``, a whole number or a time, and then of ``ties``; ``reverse`` takes the
    rows behind instead, ``inclusive`` counts the row itself. Without such rows a value is null.

    ``order`` is cut into ranges of ``span``. Each range is summed up map-side, the values of the ranges before
    are a table of a row per key and range, and rows are sorted within their range only, so a key with a third
    of all rows spreads over as many tasks as it has ranges. Null keys are a key; a null order stands first.
    """
    timed = isinstance(df.schema[order].dataType, (TimestampType, TimestampNTZType))
    number = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order).cast("long")
    rows = df.withColumns({f"__v_{name}": c for name, (_, c) in values.items()} | {"__range": F.floor(number / (span or (HOURS if timed else ROWS)))})
    turn = (lambda c: F.desc_nulls_last(c)) if reverse else (lambda c: F.asc_nulls_first(c))
    ordered = [turn(order), *(turn(t) for t in ties)]

    def total(name: str, how: str) -> Column:
        if how != "last":
            return _AGG[how](f"__v_{name}")
        pick = F.min_by if reverse else F.max_by
        at = F.struct(*(F.col(c) for c in (order, *ties)))
        return pick(F.col(f"__v_{name}"), F.when(F.col(f"__v_{name}").isNotNull(), at))

    sums = rows.groupBy(*keys, "__range").agg(*(total(name, how).alias(f"__s_{name}") for name, (how, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy(turn("__range")).rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "__range"]
    prior = sums.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(names)), *(_AGG[how](f"__s_{name}").over(earlier).alias(f"__p_{name}") for name, (how, _) in values.items()))
    same = F.lit(True)
    for i, c in enumerate(names):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    own = Window.partitionBy(*names).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    # the window first: its shuffle by keys and range serves the join as well
    out = rows.withColumns({f"__o_{name}": _AGG[how](f"__v_{name}").over(own) for name, (how, _) in values.items()}).join(prior, same)
    return out.select(*df.columns, *(_FOLD[how](F.col(f"__o_{name}"), F.col(f"__p_{name}")).alias(name) for name, (how, _) in values.items()))


def position(df: DataFrame, time: str, ties: str, name: str) -> DataFrame:
    """Adds ``name``: the row's place from 1 in order of time and ties, numbered hour by hour; null times come first."""
    rows = df.withColumn("__hour", F.floor(F.unix_timestamp(time) / 3600))
    counts = rows.groupBy("__hour").count()
    prior = counts.select(F.col("__hour").alias("__h"), F.coalesce(F.sum("count").over(Window.orderBy(F.asc_nulls_first("__hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__prior"))
    own = F.row_number().over(Window.partitionBy("__hour").orderBy(F.asc_nulls_first(time), ties))
    return rows.withColumn("__own", own).join(prior, F.col("__hour").eqNullSafe(F.col("__h"))).withColumn(name, F.col("__own") + F.col("__prior")).drop("__hour", "__h", "__own", "__prior")
