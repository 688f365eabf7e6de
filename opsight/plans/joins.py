"""Join shapes the monitored queries need, written with built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """SQL ``column NOT IN (SELECT sub_column FROM sub)`` with its NULL rules.

    A NULL in the sub-query makes every comparison unknown, so nothing
    passes; a NULL probe value passes only when the sub-query is empty.  The
    NULL test is one scalar aggregate; the anti join is a plain hash/sort-merge
    anti join (no null-aware nested loop, so it scales on both sides).
    """
    stats = sub.agg(F.count(F.lit(1)).alias("n"),
                    F.count(sub_column).alias("nn"))
    n, nn = stats.select("n").scalar(), stats.select("nn").scalar()
    keys = sub.select(F.col(sub_column).alias("__k")).filter(F.col("__k").isNotNull()).distinct()
    kept = df.join(keys, df[column] == keys["__k"], "left_anti")
    return kept.filter((n == 0) | ((n == nn) & F.col(column).isNotNull()))


#: Keys up to this many are broadcast as they are (some 24 bytes each); of more, a bitmap is.
BROADCAST_KEYS = 1_000_000
#: Bits of a piece of the bitmap (``bitmap_construct_agg``), and of all its pieces for each key.
PIECE_BITS, BITS_A_KEY = 32768, 16


def without(df: DataFrame, column: str, keys: DataFrame, n: int | None = None, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``keys`` (that column alone, distinct, about ``n``); a NULL is among none.

    Rows of ``df`` may be wide, and most stay, so they are not shuffled for the
    test: few keys are broadcast, of many a bitmap of their hashes.  Only rows
    whose bit is set - those to go, and about one in BITS_A_KEY of the others -
    then meet the keys themselves.
    """
    n = keys.count() if n is None else n
    if n <= most:
        return df.join(F.broadcast(keys), column, "left_anti")
    pieces = -(-n * BITS_A_KEY // PIECE_BITS)
    at = F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(pieces * PIECE_BITS)))
    placed = lambda x: x.withColumn("__at", at).withColumn("__piece", F.expr(f"__at div {PIECE_BITS}"))
    # Hashes agree only between equal types.
    bits = (placed(keys.select(F.col(column).cast(df.schema[column].dataType))).filter("__at IS NOT NULL")
            .groupBy("__piece").agg(F.bitmap_construct_agg(F.expr(f"__at % {PIECE_BITS}")).alias("__bits")))
    met = placed(df).join(F.broadcast(bits), "__piece", "left")
    byte = f"CAST(conv(hex(substring(__bits, CAST(__at % {PIECE_BITS} div 8 + 1 AS INT), 1)), 16, 10) AS INT)"
    maybe = F.expr(f"coalesce(getbit({byte}, CAST(__at % 8 AS INT)) = 1, false)")
    rest = met.filter(maybe).select(df.columns).join(keys, column, "left_anti")
    return met.filter(~maybe).select(rest.columns).unionByName(rest)


def suffix_join(left: DataFrame, left_col: str, right: DataFrame, right_col: str,
                how: str = "inner") -> DataFrame:
    """``left.left_col`` ends with ``right.right_col``, as an equi join.

    The script writes this as ``LIKE '%' || name`` with the ``_`` of table
    names unescaped; the decided intent (SURVEY §1.5) is a literal suffix
    match, i.e. ``endswith``.  Each distinct left name is cut to all its
    suffixes, so the match becomes an equality on the suffix: a shuffle or
    broadcast hash join instead of a nested loop over both sides, and no length
    limit.  A NULL name matches nothing; with ``how="left"`` a row without a
    match comes back once.
    """
    names = left.select(F.col(left_col).alias("__name")).filter(F.length("__name") > 0).distinct()
    cut = (names.withColumn("__n", F.explode(F.sequence(F.lit(1), F.length("__name"))))
           .select("__name", F.expr("right(__name, __n)").alias("__suffix")))
    met = cut.join(right.withColumn("__rk", F.col(right_col)), F.col("__suffix") == F.col("__rk")).drop("__suffix", "__rk")
    return left.join(met, F.col(left_col) == F.col("__name"), how).drop("__name")
