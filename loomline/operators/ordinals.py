"""Positions in a sorted result, without sorting it in one task.

Rows are range-partitioned by the sort order, numbered inside each partition,
and shifted by the number of rows in the partitions before it. A hot group is
spread over as many partitions as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from loomline import rules
from loomline.staging import CODEC, stage

PART, SEAT = "_part", "_seat"
ROW_BITS = 33  # low bits of monotonically_increasing_id hold the row of a partition


def number_rows(df: DataFrame, order: list[Column], by: list[str] | None = None,
                column: str = "position", start: int = 1) -> DataFrame:
    """Dense numbers in `order`, restarting for every value of `by`."""
    by = by or []
    sorting = [*[F.col(name) for name in by], *order]
    seat = F.monotonically_increasing_id()
    seated = stage(
        df.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
        .withColumn(SEAT, seat)
        .withColumn(PART, F.shiftright(SEAT, ROW_BITS).cast("int")),
        "seated", CODEC,
    )
    groups = [F.struct(*by).alias("_group")] if by else [F.lit(0).alias("_group")]
    blocks = seated.groupBy(*groups, PART).agg(
        F.min(SEAT).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = (
        Window.partitionBy("_group").orderBy(PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = stage(
        blocks.select(
            "_group", PART,
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
            .alias("_shift"),
        ),
        "shifts",
    )
    numbered = seated.select("*", *groups).join(shifts, ["_group", PART])
    return numbered.withColumn(column, F.col(SEAT) + F.col("_shift") + start).select(
        *df.columns, column
    )


def page(df: DataFrame, order: list[Column], number: int,
         size: int = rules.PAGE_SIZE) -> DataFrame:
    """One page of a result in order, pages counted from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_boundaries(df: DataFrame, order: list[str], size: int = rules.PAGE_SIZE) -> DataFrame:
    """The first key of every page of `df` in ascending `order`, nulls first.

    `skip` counts the rows with that very key that stand on earlier pages. Rows are ranked
    in range partitions; what comes out is one row per page, so a result needs no number
    per row and no page needs its predecessors.
    """
    ranked = number_rows(df.select(*order), [F.col(name) for name in order], start=0)
    firsts = ranked.groupBy(*order).agg(
        F.min("position").alias("_from"), F.max("position").alias("_to"))
    page_of = lambda at: F.floor(at / size)
    opened = F.sequence(page_of(F.col("_from") + size - 1), page_of(F.col("_to")))
    starts = firsts.where(page_of(F.col("_from") + size - 1) <= page_of(F.col("_to")))
    return starts.select("*", F.explode(opened).alias("_page")).select(
        (F.col("_page") + 1).alias("page"), *order,
        (F.col("_page") * size - F.col("_from")).alias("skip"),
    )


def seek_page(df: DataFrame, order: list[str], boundaries: DataFrame, number: int,
              size: int = rules.PAGE_SIZE) -> DataFrame:
    """Page `number` (from 1) of `df` in ascending `order`, found by its boundary keys.

    The range of the first column reaches the scan, so of a table that lies in order only
    the files of the page are read. Which of the rows equal in all of `order` a page shows
    is open, as with any paging; `order` should tell rows apart.
    """
    ends = {row["page"]: row for row in boundaries.where(F.col("page").isin(number, number + 1)).collect()}
    first, after = ends.get(number), ends.get(number + 1)
    if first is None:
        return df.limit(0)
    key = F.struct(*order)

    def bound(row: Row) -> Column:
        return F.struct(*[F.lit(row[name]).cast(df.schema[name].dataType).alias(name) for name in order])

    rows, lead = df.where(key >= bound(first)), F.col(order[0])
    if first[order[0]] is not None:
        rows = rows.where(lead >= F.lit(first[order[0]]))
    if after is not None:
        rows = rows.where(key <= bound(after))
        top = lead.isNull() if after[order[0]] is None else lead <= F.lit(after[order[0]])
        rows = rows.where(top if first[order[0]] is not None else top | lead.isNull())
    return rows.orderBy(*order).offset(first["skip"]).limit(size)


def page_count(df: DataFrame, size: int = rules.PAGE_SIZE) -> DataFrame:
    """Rows and pages of a result; an empty one still has a page."""
    pages = F.greatest(F.ceil(F.col("items") / size), F.lit(1)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("items")).withColumn("pages", pages)


def card_number(position: Column) -> Column:
    """A position as shown on a card, three digits at least."""
    shown = position.cast("string")
    return F.lpad(shown, F.greatest(F.length(shown), F.lit(3)), F.lit("0"))
