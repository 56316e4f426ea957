"""Splits, strides and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.runtime import checkpoint


def numbered(rows: DataFrame, order: list, name: str = "__rank", groups: int | None = None) -> DataFrame:
    """rows with their 0-based place in a total order, without one task for all.

    Rows are ranged by the order into `groups` parts (None: as many as shuffles have), numbered inside their part, and
    parts are summed up. The ranged rows are written once, so select the columns that are needed before.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(*cols) if groups is None else rows.repartitionByRange(groups, *cols)
    ranged = checkpoint(ranged.withColumn("__part", F.spark_partition_id()))  # the parts must not change between the two uses
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # a row a part
    inner = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*cols)) - 1)
    return inner.join(F.broadcast(before), "__part").withColumn(
        name, (F.col("__before") + F.col("__k")).cast("long"),
    ).drop("__part", "__before", "__k")


def by_session(rows: DataFrame, session: str, identifier: str, number: Column, share: float = 0.1) -> DataFrame:
    """rows with split: the last max(1, half-even round(share * S)) sessions are val; with one session its last rows
    by number, none of a single row. rows are written once, since the plan before may be long."""
    rows = checkpoint(rows)
    sessions = rows.select(session).distinct()
    total = sessions.count()
    if total > 1:
        held = F.greatest(F.lit(1), F.bround(F.lit(total) * share).cast("int"))
        named = numbered(sessions, [session], "__s")
        return rows.join(named, session).withColumn("split", F.when(F.col("__s") >= total - held, "val").otherwise("train")).drop("__s")
    ranks = numbered(rows.withColumn("__number", number), ["__number", identifier])
    n = F.lit(rows.count())
    held = F.when(n <= 1, 0).otherwise(F.greatest(F.lit(1), F.bround(n * share).cast("int")))
    return ranks.withColumn("split", F.when(F.col("__rank") >= n - held, "val").otherwise("train")).drop("__rank", "__number")


def head_tail(rows: DataFrame, order: list[str], share: float = 0.9) -> DataFrame:
    """rows with split: the first int(n * share) are train."""
    ranks = numbered(rows, order)
    n = ranks.agg((F.count("*") * share).cast("long").alias("__cut"))
    return ranks.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("__rank") < F.col("__cut"), "train").otherwise("val")).drop("__rank", "__cut")  # one row


def every_nth(rows: DataFrame, order: list[str], nth: int, most: int | None = None) -> DataFrame:
    """Every nth row from the first, at most `most` of them."""
    kept = numbered(rows, order).where(F.col("__rank") % nth == 0)
    return (kept if most is None else kept.where(F.col("__rank") < nth * most)).drop("__rank")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows by the MD5 of their key and the seed, in order of the key: the same rows on every run and engine."""
    drawn = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.orderBy(drawn, key).limit(n).orderBy(key)
