"""Windows over keys of any size: a key's rows are spread over ranges, and what a range needs of others is carried over.

A window partitioned by a key puts all its rows into one task. Here rows are ranged by key and order, the window runs
within the part of a key in a range, and a second, small step carries values from the parts before (or after) it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.runtime import checkpoint

#: Rows of a key beyond which its window is spread.
HOT = 1_000_000
KEY, PART, HALO = "__key", "__part", "__halo"


def crowded(rows: DataFrame, keys: list[str], most: int = HOT) -> bool:
    """Whether a key has more than `most` rows; one aggregation that counts before it shuffles."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).count() > 0


def parted(rows: DataFrame, keys: list[str], order: list, ranges: int | None = None) -> DataFrame:
    """rows with __key (text, null keys included) and __part, the range that a row is in. Equal places are in one range.
    Written once, so that all steps see the same ranges."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    named = rows.withColumn(KEY, F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))))
    ranged = named.repartitionByRange(KEY, *cols) if ranges is None else named.repartitionByRange(ranges, KEY, *cols)
    return checkpoint(ranged.withColumn(PART, F.spark_partition_id()))


def within() -> Window:
    """The window over the part of a key in a range."""
    return Window.partitionBy(KEY, PART)


def carried(parts: DataFrame, name: str, value: Column, combine: Callable[[str], Column], ahead: bool = False) -> DataFrame:
    """parts with name: value (an aggregate) combined over all parts of the key before this one, or ahead of it; null
    where there are none. One row a key and range goes through the second step."""
    each = parts.groupBy(KEY, PART).agg(value.alias(name))
    order = F.desc(PART) if ahead else F.asc(PART)
    before = Window.partitionBy(KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(each.select(KEY, PART, combine(name).over(before).alias(name)), [KEY, PART])


def with_rows_before(parts: DataFrame, order: list, n: int) -> DataFrame:
    """parts with __halo: besides its own rows (false) every part of a key has the n rows before its first (true), or as
    many as there are, whichever parts they are in."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    back = F.row_number().over(within().orderBy(*(c.desc() for c in cols)))
    sizes = parts.groupBy(KEY, PART).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(KEY).orderBy(PART))
    starts = sizes.withColumn("__upto", upto).withColumn("__first", F.col("__upto") - F.col("__n"))  # a row a key and range
    listed = starts.groupBy(KEY).agg(F.collect_list(F.struct(F.col(PART).alias("p"), F.col("__first").alias("f"))).alias("__starts"))
    tails = parts.withColumn("__back", back).where(F.col("__back") <= n).join(starts.select(KEY, PART, "__upto"), [KEY, PART])
    place = F.col("__upto") - F.col("__back")  # from 0 within the key
    after = F.filter("__starts", lambda s: (s["p"] > F.col(PART)) & (s["f"] <= place + n))
    halo = tails.join(listed, KEY).withColumn("__to", F.explode(F.transform(after, lambda s: s["p"])))
    halo = halo.withColumn(PART, F.col("__to")).select(*parts.columns, F.lit(True).alias(HALO))
    return parts.withColumn(HALO, F.lit(False)).unionByName(halo)
