"""Exact duplicates by Grace hash partitioning and tables that compare complete contents.

Texts are equal when they are identical without the characters of `[\\x20\\x09-\\x0D]`.

1. Every scan task puts its texts into an open-addressing table and, whenever the table is
   full, writes one record per distinct content with the rows that have it. A content that a
   third of all rows share so leaves a task as one record per table, not one per row.
2. The records are the first spill file. They are dealt into buckets by the leading bits of
   their content's hash; a bucket that fits (`LIMIT` bytes) is loaded into one table, which
   compares complete contents, never hashes alone. The buckets that do not fit are written
   to the next spill file and dealt by further bits, until all fit. Records that share one
   hash cannot be dealt by it: they are dealt by record, each part keeps one record per
   content, and those left go on to the next spill file.
3. Sizes and the row that stays are summed per record, then per content; records and their
   rows are joined back by number. No text takes part in this.

Spill files are tables in the shared folder, so a lost executor repeats its own tasks only.
`LIMIT` bounds what a task holds, up to two texts that are larger than it themselves.

Of equal texts the row with the most code points in the original text stays, then the one
with the smallest id (null last), then the least checksum of the text; of rows equal in all
that, any one. Null texts are empty. Rows of a group that has ids only null have keep_id
null, and one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.tables import free_name, full_text
from loomline.staging import stage

BLANKS = b" \t\n\x0b\x0c\r"
TABLE_BYTES, TABLE_ROWS = 32 << 20, 1 << 16  # what a scan task gathers before it writes
LIMIT = 16 << 20
AIM = 4 << 20  # mean bytes of a bucket, so that hashing alone rarely fills one
HASH_BITS = 64


class ContentTable:
    """Open addressing with linear probing; an entry is met by its hash and whole content."""

    def __init__(self, room: int = 1 << 10):
        self.slots = [-1] * room
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def _slot(self, hash: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = hash & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hash and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return at

    def place(self, hash: int, content: bytes) -> int:
        """The number of the entry that has this content; a new one if there is none."""
        at = self._slot(hash, content)
        if self.slots[at] < 0:
            self.slots[at] = len(self.contents)
            self.hashes.append(hash)
            self.contents.append(content)
            if 2 * len(self.contents) > len(self.slots):
                self._grow()
            return len(self.contents) - 1
        return self.slots[at]

    def _grow(self) -> None:
        room = 4 * len(self.slots)
        self.slots, mask = [-1] * room, room - 1
        for entry, hash in enumerate(self.hashes):  # all differ: the first free slot will do
            at = hash & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def record_schema(id_type: str) -> str:
    return (f"hash long, content binary, digest binary, "
            f"members array<struct<id: {id_type}, chars: long, mark: long>>")


def combined(table_bytes: int, table_rows: int):
    """Tasks over (id, text): a record per content and full table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digests, members, size, rows = ContentTable(), [], [], 0, 0

        def records() -> pa.RecordBatch:
            ends = [0]
            for group in members:
                ends.append(ends[-1] + len(group))
            flat = list(zip(*[row for group in members for row in group]))
            fields = pa.StructArray.from_arrays(
                [pa.array(values, kind) for values, kind in
                 zip(flat, (id_type, pa.int64(), pa.int64()))], ["id", "chars", "mark"])
            return pa.RecordBatch.from_arrays(
                [pa.array(table.hashes, pa.int64()), pa.array(table.contents, pa.binary()),
                 pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, fields)],
                ["hash", "content", "digest", "members"])

        for batch in batches:
            id_type = batch.column(0).type
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                content = data.translate(None, BLANKS)
                digest = hashlib.sha256(content).digest()
                entry = table.place(int.from_bytes(digest[:8], "big", signed=True), content)
                if entry == len(members):
                    members.append([])
                    digests.append(digest)
                    size += len(content)
                chars = len(data.decode("utf-8", "surrogatepass"))
                members[entry].append((id, chars, zlib.crc32(data)))
                rows += 1
                if size >= table_bytes or rows >= table_rows:
                    yield records()
                    table, digests, members, size, rows = ContentTable(), [], [], 0, 0
        if rows:
            yield records()
    return run


def content_records(docs: DataFrame, id: str, text: str, table_bytes: int = TABLE_BYTES,
                    table_rows: int = TABLE_ROWS) -> DataFrame:
    """hash, content, digest, members (id, chars, mark) and the number of the record."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), full_text(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(combined(table_bytes, table_rows), record_schema(kind))
    return stage(found.withColumn("record", F.monotonically_increasing_id()), "grace-records")


def same_contents(group: pa.Table) -> pa.Table:
    """record, first: every record of a bucket with the least one of its content."""
    table, entries, least = ContentTable(), [], []
    numbers = group["record"].to_pylist()
    for number, hash, content in zip(numbers, group["hash"].to_pylist(), group["content"]):
        entry = table.place(hash, content.as_py())
        entries.append(entry)
        if entry == len(least):
            least.append(number)
        least[entry] = min(least[entry], number)
    firsts = [least[entry] for entry in entries]
    return pa.table({"record": pa.array(numbers, pa.int64()), "first": pa.array(firsts, pa.int64())})


def bucket_of(bits: int) -> Column:
    return F.shiftrightunsigned("hash", HASH_BITS - bits) if bits else F.lit(0).cast("long")


def first_records(records: DataFrame, limit: int = LIMIT, aim: int = AIM) -> DataFrame:
    """record, first: the same `first` for records of the same content and no others."""
    spill, bits, rounds = records.select("record", "hash", "content"), 0, []
    while True:
        size = spill.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
        more = max(1, math.ceil(math.log2(max(size, 1) / aim))) if bits or size > aim else 0
        bits = min(bits + more, HASH_BITS)
        dealt = spill.withColumn("bucket", bucket_of(bits))
        sizes = dealt.groupBy("bucket").agg(
            F.sum(F.octet_length("content")).alias("bytes"), F.count(F.lit(1)).alias("n"),
            (F.min("hash") == F.max("hash")).alias("one_hash"))
        over = stage(sizes.where((F.col("bytes") > limit) & (F.col("n") > 2)), "grace-over")
        if over.isEmpty():
            rounds.append(dealt.groupBy("bucket").applyInArrow(same_contents, "record long, first long"))
            break
        # Records of one hash are dealt by record, two or more to a part.
        parts = F.least(F.ceil(2 * F.col("bytes") / limit), F.ceil(F.col("n") / 2))
        marked = dealt.join(over.select("bucket", "one_hash", parts.alias("parts")), "bucket", "left")
        waits = ~F.coalesce("one_hash", F.lit(True))
        part = F.coalesce(F.pmod(F.xxhash64("record", F.lit(len(rounds))), F.col("parts")), F.lit(-1))
        tried = marked.where(~waits).withColumn("part", part)
        done = stage(tried.groupBy("bucket", "part").applyInArrow(
            same_contents, "record long, first long"), "grace-round")
        rounds.append(done)
        left = tried.where("part >= 0").join(
            done.where("record = first").select("record"), "record", "left_semi")
        columns = ["record", "hash", "content"]
        spill = stage(marked.where(waits).select(*columns).unionByName(left.select(*columns)),
                      "grace-spill")
    return resolved(rounds)


def resolved(rounds: list[DataFrame]) -> DataFrame:
    """Follow a record's first through the later rounds."""
    found = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = found.select(F.col("record").alias("first"), F.col("first").alias("final"))
        ahead = earlier.join(later, "first", "left").select(
            "record", F.coalesce("final", "first").alias("first"))
        found = ahead.unionByName(found.join(earlier.select("record"), "record", "left_anti"))
    return found


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = LIMIT,
                 aim: int = AIM, table_bytes: int = TABLE_BYTES,
                 table_rows: int = TABLE_ROWS) -> DataFrame:
    """`id, keep_id, group_size, kept, text_sha256` for every row of `docs`."""
    records = content_records(docs, id, text, table_bytes, table_rows)
    firsts = stage(first_records(records, limit, aim), "grace-firsts")
    ranked = F.transform("members", lambda row, at: F.struct(
        (-row["chars"]).alias("shortness"), row["id"].isNull().alias("no_id"), row["id"].alias("id"),
        row["mark"].alias("mark"), F.col("record").alias("record"), at.alias("at")))
    summed = records.select("record", F.size("members").cast("long").alias("rows"),
                            F.array_min(ranked).alias("best"))
    groups = summed.join(firsts, "record").groupBy("first").agg(
        F.sum("rows").alias("group_size"), F.min("best").alias("best"))
    known = firsts.join(groups, "first").select(
        "record", "group_size", F.col("best.id").alias("keep_id"),
        F.col("best.record").alias("best_record"), F.col("best.at").alias("best_at"))
    joined = records.select("record", "digest", "members").join(known, "record")
    rows = joined.select("*", F.posexplode("members").alias("at", "row"))
    kept = (F.col("record") == F.col("best_record")) & (F.col("at") == F.col("best_at"))
    return rows.select(
        F.col("row.id").alias(id), "keep_id", "group_size", kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of every group, with all its columns; rows are told apart by a number."""
    number = free_name(docs, "row")
    numbered = stage(docs.withColumn(number, F.monotonically_increasing_id()), "grace-rows")
    kept = exact_groups(numbered, number, text).where("kept").select(number)
    return numbered.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def duplicates_report(docs: DataFrame) -> DataFrame:
    return exact_groups(docs)
