"""Line deduplication by site-relative frequency: a line on too large a share of its host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import scratch, unused

#: Bytes of boilerplate up to which it is broadcast; beyond, pages and boilerplate are joined on host and salt.
BROADCAST_BYTES = 32 << 20
#: Parts that a host's pages are dealt to in that join.
SALTS = 32


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    return F.struct(F.xxhash64(line).alias("a"), F.crc32(line).alias("b"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = 0.1, least_pages: int = 2) -> DataFrame:
    """host, line: lines on more than `ratio` of the host's pages, and on least_pages at least.

    A page counts once for a line, however often the line stands on it. Blank lines never count. Lines are counted by
    hash first, so that only 16 bytes a line are shuffled; those that pass are counted again by their whole text.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    lines = pages.select("host", F.explode(F.array_distinct(_lines("text"))).alias("line")).where(F.trim("line") != "")
    lines = lines.withColumn("key", _key(F.col("line")))

    def frequent(counted: DataFrame) -> DataFrame:
        near = counted.where(F.col("pages") >= least_pages).alias("c").join(totals.alias("t"), F.expr("c.host <=> t.host"))
        return near.where(F.col("c.pages") > F.lit(ratio) * F.col("t.total")).select("c.*")

    keys = scratch(frequent(lines.groupBy("host", "key").agg(F.count("*").alias("pages"))).select("host", "key"), "line-keys")
    again = lines.alias("l").join(keys.alias("k"), F.expr("l.host <=> k.host AND l.key = k.key"), "left_semi")
    return frequent(again.groupBy("host", "line").agg(F.count("*").alias("pages"))).select("host", "line")


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = 0.1,
    least_pages: int = 2,
    added: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """docs with text_col cleaned, and the numbers of lines and of dropped lines added under the names in `added`.

    A line on one page only is never boilerplate (least_pages is 2), so a host of one page loses nothing; on a host of
    two pages every line that both hold goes. Null hosts form one host. A null text stays null with 0 lines; a text that
    loses every line becomes empty; rows and their order of lines are kept, repeated rows too. Columns named as in
    `added` are replaced, all others pass unchanged; an empty table stays empty. A host has at most (lines a page) /
    ratio boilerplate lines; the table is broadcast only up to BROADCAST_BYTES, else joined with salted hosts.
    """
    found = scratch(boilerplate(docs, host_col, text_col, ratio, least_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.octet_length("line") + 64), F.lit(0))).first()[0]
    drop, host, salt, own, lines, kept = unused(docs.columns, "__drop", "__host", "__salt", "__own", "__lines", "__kept")
    by_host = found.groupBy("host").agg(F.collect_list("line").alias(drop)).withColumnRenamed("host", host)
    same = F.col(host_col).eqNullSafe(F.col(host))
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(by_host), same, "left")
    else:
        salts = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(own, F.pmod(F.xxhash64(text_col), F.lit(SALTS)))
        joined = salted.join(salts, same & (F.col(own) == F.col(salt)), "left").drop(own, salt)
    stay = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(drop), line))
    joined = joined.withColumn(lines, _lines(text_col))
    joined = joined.withColumn(kept, F.when(F.col(drop).isNull(), F.col(lines)).otherwise(stay))
    every = F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines))
    left = F.when(F.col(kept).isNull(), 0).otherwise(F.size(kept))
    out = joined.withColumn(text_col, F.array_join(kept, "\n"))
    out = out.withColumn(added[0], every.cast("bigint")).withColumn(added[1], (every - left).cast("bigint"))
    return out.drop(host, drop, lines, kept)
