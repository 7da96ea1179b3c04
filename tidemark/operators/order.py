"""Running totals in the order of a column, in two levels, so that no task orders all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges at most; otherwise as many as a shuffle has partitions.
MOST_PARTS = 1024
#: Rows that one range holds at least; fewer rows are one task's work.
LEAST_ROWS = 10_000
_RANGED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def part_of(df: DataFrame, column: str) -> Column:
    """A number of the range that a row's value is in. The bounds are one aggregation; values of other than numbers and times are one range."""
    parts = min(MOST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(df.dtypes)[column]
    if not (kind in _RANGED or kind.startswith("decimal")) or parts < 2:
        return F.lit(0)
    n, found = df.agg(F.count(column), F.percentile_approx(column, [i / parts for i in range(1, parts)], 4 * parts)).first()
    wanted = min(parts, -(-n // LEAST_ROWS))  # of evenly spaced bounds an even choice
    found = sorted({found[i * parts // wanted - 1] for i in range(1, wanted)})
    if kind in ("int", "bigint") or kind == "double" and all(map(math.isfinite, found)):
        name, mark = column.replace("`", "``"), "D" if kind == "double" else "L"

        def written(low: int, high: int) -> str:  # one text is much faster to build than as many columns
            if low == high:
                return str(low)
            mid = (low + high) // 2
            return f"CASE WHEN `{name}` > {found[mid]!r}{mark} THEN {written(mid + 1, high)} ELSE {written(low, mid)} END"

        return F.expr(written(0, len(found)))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) > F.lit(found[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(found))


def before(df: DataFrame, order: list[Column | str], value: Column, name: str, by: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds the total of value over the rows that come earlier in the order, whose leading column is `by`, ascending; of rows with the same values of `within`.

    Rows are dealt into ranges of `by`; the table of their totals, a row for each, is the only thing that one task orders. A single value
    of `by` is one range, so the order beyond it is a task's own work.
    """
    dealt = df.withColumns({"_part": part_of(df, by), "_value": value})
    totals = dealt.groupBy(*within, "_part").agg(F.sum("_value").alias("_t"))
    earlier = F.coalesce(F.sum("_t").over(W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_value").over(W.partitionBy(*within, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    summed = dealt.withColumn("_inside", inside).join(F.broadcast(totals.select(*within, "_part", earlier.alias("_earlier"))), [*within, "_part"])
    return summed.withColumn(name, F.col("_earlier") + F.col("_inside")).drop("_part", "_value", "_inside", "_earlier")
