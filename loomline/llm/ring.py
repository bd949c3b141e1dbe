"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

A row's key hashes to a place on the ring and belongs to the next virtual node
clockwise. Every shard has a load bound; rows beyond it continue clockwise to
the next shard with room. With bounds that add up to the number of rows, counts
end at most one apart, and only overflowing rows leave their home shard.

The rows of one arc (the places before a virtual node) are numbered in ring
order, by range partitions, so an arc that holds a third of all rows is spread
over many tasks. All overflow is then decided on counts per arc: an arc is cut
into pieces of consecutive numbers, each piece goes to one shard. The counts are
at most `shards * virtual_nodes` numbers, however many rows there are.

Null texts count as empty. Rows equal in every column are numbered next to each
other in any order. An empty table gives an empty result. Other columns of the
input are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.tables import full_text, literal_array, literal_rows
from loomline.operators.ordinals import number_rows
from loomline.staging import stage

PLACES = 1 << 14
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES,
         places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order; adding a shard keeps the rest."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            place = xxhash.xxh64_intdigest(f"{shard}/{node}") % places
            taken.setdefault(place, shard)
    return sorted(taken.items())


def clockwise(nodes: list[tuple[int, int]], arc: int) -> list[int]:
    """All shards in the order in which they are met from an arc's node onwards."""
    order: list[int] = []
    for step in range(len(nodes)):
        shard = nodes[(arc + step) % len(nodes)][1]
        if shard not in order:
            order.append(shard)
    return order


def pieces(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[dict]:
    """Cut every arc's numbers 0..count-1 into pieces, each with a shard and its first slot.

    In each round every piece left goes to its first shard clockwise that has room.
    A shard with less room than asked for takes what fits and passes the rest on,
    so a round that leaves anything over closes a shard: at most `shards` rounds.
    """
    total = sum(counts.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    filled = [0] * shards
    order = {arc: clockwise(nodes, arc) for arc in counts}
    left = {arc: (0, count) for arc, count in sorted(counts.items()) if count}
    out: list[dict] = []
    while left:
        asked = {arc: next(s for s in order[arc] if filled[s] < room[s]) for arc in left}
        rest: dict[int, tuple[int, int]] = {}
        for arc, (low, high) in left.items():
            shard = asked[arc]
            taken = min(high - low, room[shard] - filled[shard])
            if taken:
                out.append({"arc": arc, "low": low, "high": low + taken, "shard": shard,
                            "first": filled[shard]})
                filled[shard] += taken
            if low + taken < high:
                rest[arc] = (low + taken, high)
        left = rest
    return out


def place_of(key: Column, places: int = PLACES) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(places)).cast("int")


def assign(docs: DataFrame, shards: int = 8, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; equal texts share a place."""
    nodes = ring(shards, virtual_nodes)
    spots = [place for place, _ in nodes]
    arcs = [bisect_left(spots, place) % len(spots) for place in range(PLACES)]
    text = full_text()
    point = F.xxhash64(text)
    keyed = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            point.alias("point"),
            F.element_at(literal_array(arcs, "int"), place_of(point) + 1).alias("arc"),
            F.monotonically_increasing_id().alias("row"),  # splits rows equal in text and doc_id
        ),
        "ring-keys",
    )
    counts = {row["arc"]: row["count"] for row in keyed.groupBy("arc").count().collect()}
    parts = literal_rows(
        docs.sparkSession, pieces(counts, nodes, shards),
        "arc int, low long, high long, shard int, first long",
    )
    seat = F.col("seat")
    seated = number_rows(
        keyed, [F.col("point"), F.col("doc_id"), F.col("row")], by=["arc"], column="seat", start=0
    )
    # At most virtual nodes x shards pieces x shards rows: the bound of this broadcast.
    placed = seated.join(F.broadcast(parts), "arc").where(
        (seat >= F.col("low")) & (seat < F.col("high"))
    )
    return placed.select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("first") + seat - F.col("low")).alias("slot"),
    )


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The assignment with the law it keeps: row counts at most one apart."""
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
