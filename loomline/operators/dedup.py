"""Uniqueness, semi and anti joins, unions that keep the first row of a key.

`first_wins` is one aggregation with a partial phase, so a key that holds a
third of all rows leaves each task as a single row before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline import rules


def first_wins(df: DataFrame, keys: list[str], order: list[str],
               columns: list[str] | None = None) -> DataFrame:
    """The least row of every key: by `order`, then by all remaining columns.

    With `columns`, only these come out, and what is compared after the last of them is
    left before the shuffle: it cannot change them.
    """
    shown = [name for name in df.columns if columns is None or name in columns]
    leading = [name for name in order if name not in keys]
    rest = [name for name in df.columns if name not in keys and name not in leading]
    compared = [*leading, *rest]
    while columns is not None and compared and compared[-1] not in shown:
        compared.pop()
    if not compared:
        return df.dropDuplicates(keys) if columns is None else df.select(*keys).distinct().select(*shown)
    least = df.groupBy(*keys).agg(F.min(F.struct(*compared)).alias("_row"))
    return least.select(*keys, "_row.*").select(*shown)


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of every key, for tables that do refresh."""
    leading = [name for name in order if name not in keys]
    rest = [name for name in df.columns if name not in keys and name not in leading]
    greatest = df.groupBy(*keys).agg(F.max(F.struct(*leading, *rest)).alias("_row"))
    return greatest.select(*keys, "_row.*").select(*df.columns)


def dedup(df: DataFrame, keys: list[str] = rules.DUPLICATE_KEYS,
          order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Distinct on `keys`; columns outside them come from the first row."""
    return first_wins(df, keys, order or [], columns)


GROUP_LIMIT = 1000  # largest rank bound Spark applies below the shuffle
LANES = 64


def topk_per(df: DataFrame, part: list[str], order: list[Column], k: int,
             offset: int = 0, column: str = "rank") -> DataFrame:
    """Ranks `offset + 1 .. offset + k` of every part.

    A bound on the rank reaches below the shuffle (window group limit), so a
    task ships at most that many rows of a part. Spark does so up to a bound of
    1000; beyond it, rows are ranked in lanes first, so that a hot part is
    sorted by many tasks and only the best of each lane meet in one.
    """
    last = offset + k
    if last > GROUP_LIMIT:
        laned = df.withColumn("_lane", F.pmod(F.xxhash64(*df.columns), F.lit(LANES)))
        seat = F.row_number().over(Window.partitionBy(*part, "_lane").orderBy(*order))
        df = laned.withColumn("_seat", seat).where(F.col("_seat") <= last).drop("_lane", "_seat")
    place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    ranked = df.withColumn(column, place).where(F.col(column) <= last)
    if offset:
        ranked = ranked.where(F.col(column) > offset)
    return ranked.withColumn(column, F.col(column).cast("bigint"))


def fresh(df: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not in `known` yet."""
    return df.join(known.select(key), key, "left_anti")


def stored_for(batch: DataFrame, target: DataFrame, key: str = "url") -> DataFrame:
    """Stored rows whose key occurs in the batch."""
    return target.join(batch.select(key), key, "left_semi")


def cached_then_live(cached: DataFrame, live: DataFrame, order: list[str],
                     key: str = "url") -> DataFrame:
    """Stored rows (unique by `key`), then live rows whose key is not stored."""
    new = fresh(first_wins(live, [key], order), cached, key)
    return (
        cached.withColumn("cached", F.lit(True))
        .unionByName(new.withColumn("cached", F.lit(False)))
    )


def fallback_union(primary: DataFrame, secondary: DataFrame, group: list[str],
                   key: str, order: list[str],
                   min_rows: int = rules.MIN_PRIMARY_RESULTS) -> DataFrame:
    """Primary rows, and secondary rows of groups where primary found too few.

    Both sides are distinct by `key` within a group, primary rows first.
    """
    found = first_wins(primary, [*group, key], order)
    enough = found.groupBy(*group).count().where(F.col("count") >= min_rows)
    extra = first_wins(secondary, [*group, key], order)
    extra = extra.join(enough.select(*group), group, "left_anti")
    extra = extra.join(found.select(*group, key), [*group, key], "left_anti")
    return (
        found.withColumn("fallback", F.lit(False))
        .unionByName(extra.withColumn("fallback", F.lit(True)))
    )
