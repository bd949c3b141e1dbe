"""Which texts contain which pieces, by grams of up to three letters.

A piece can only be in a text that has all its grams. So a wanted set of pieces follows its
rarest gram, and only texts with that gram are looked into; where one of its grams is in no
text there is nothing to look into. Texts give a row per different gram of theirs, never a
row per piece of every length, and a gram that is everywhere is followed only by those who
have no other.

`create_grams` keeps the grams of a table, by gram bucket, and its different texts, by shelf,
so that a search reads the buckets of its grams and the shelves of its candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.staging import stage

SIZES = (1, 2, 3)
BUCKETS = 256


def grams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """The different runs of these lengths in a text."""
    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - size + 1)
        found = F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))
        return F.when(F.length(text) >= size, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(size) for size in sizes]))


def piece_grams(piece: Column) -> Column:
    """The longest grams of a piece; a short piece is its own."""
    whole = F.array(piece)
    return F.when(F.length(piece) > max(SIZES), grams(piece, SIZES[-1:])).otherwise(whole)


def bucket(value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Grams:
    """Stored grams and texts of a table."""

    spark: SparkSession
    path: str
    buckets: int

    def postings(self, buckets: list[int]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/grams")
        return rows.where(F.col("bucket").isin(buckets)).select("gram", "text_id")

    def texts(self, shelves: list[int]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/texts")
        return rows.where(F.col("shelf").isin(shelves))


def create_grams(rows: DataFrame, path: str, text: str = "text", buckets: int = BUCKETS) -> Grams:
    """Store the different texts of a table and the grams of each."""
    texts = stage(
        rows.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
        .withColumn("text_id", F.monotonically_increasing_id()), "texts")
    (texts.withColumn("shelf", bucket(F.col("text_id"), buckets)).hint("rebalance", "shelf")
     .write.partitionBy("shelf").parquet(f"{path}/texts"))
    (texts.select("text_id", F.explode(grams(F.col("text"))).alias("gram"))
     .withColumn("bucket", bucket(F.col("gram"), buckets)).hint("rebalance", "bucket")
     .sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams"))
    return Grams(rows.sparkSession, path, buckets)


def led(wanted: DataFrame, postings: DataFrame, text: str) -> DataFrame:
    """`key, parts, text`: each key with the texts of its rarest gram. `wanted`: key, parts."""
    asked = stage(wanted.select("key", "parts", F.explode(
        F.array_distinct(F.flatten(F.transform("parts", piece_grams)))).alias("gram")), "asked-grams")
    held = postings.join(asked.select("gram").distinct(), "gram")
    counts = stage(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("first")
    leads = stage(
        asked.join(counts, "gram", "left").groupBy("key", "parts").agg(first)
        .where("first.n > 0").select("key", "parts", "first.gram"), "leading-grams")
    return leads.join(postings, "gram").select("key", "parts", text)


def holds(text: str = "text") -> Column:
    return F.forall("parts", lambda part: F.contains(F.col(text), part))


def containing(wanted: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """`key, text`: the different texts that contain all parts of a key."""
    listed = stage(
        texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
        .select("text", F.explode(grams(F.col("text"))).alias("gram")), "text-grams")
    return led(wanted, listed, "text").where(holds()).select("key", "text")


def search_grams(index: Grams, wanted: DataFrame) -> DataFrame:
    """The same from stored grams: reads the buckets asked for and the candidates' shelves."""
    asked = wanted.select(F.explode(F.flatten(F.transform("parts", piece_grams))).alias("gram"))
    places = asked.select(bucket(F.col("gram"), index.buckets).alias("bucket")).distinct()
    buckets = [row.bucket for row in places.collect()]  # at most all of them
    found = stage(led(wanted, index.postings(buckets), "text_id").withColumn(
        "shelf", bucket(F.col("text_id"), index.buckets)), "candidates")
    shelves = [row.shelf for row in found.select("shelf").distinct().collect()]
    return found.join(index.texts(shelves), ["shelf", "text_id"]).where(holds()).select("key", "text")
