"""Operator 3: exact deduplication by Grace hash partitioning.

1. Each map task resolves its own copies in an open-addressing table that
   compares complete content, so a group of copies, however large, leaves a
   task as one row with a count (the text travels once for each task).
2. The bytes of distinct texts are summed by hash prefix. Buckets over
   `bucket_bytes` are split by the next bits of the hash, again and again,
   until each fits: the recursive partitioning, on bucket sizes, so that
   texts are written to Spark's shuffle files once, at their final depth.
3. Each bucket is streamed through an open-addressing table as in 1, which
   holds each distinct text once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import ids_and_text, materialise

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


class ContentTable:
    """Open addressing with linear probing; keys are complete byte strings, found by a 64-bit hash and then compared."""

    def __init__(self, slots: int = 1024):
        self.hashes = np.zeros(slots, np.uint64)
        self.entries = np.full(slots, -1, np.int64)
        self.contents: list[bytes] = []
        self.bytes = 0

    def _place(self, h: int, content: bytes) -> tuple[int, int]:
        mask = len(self.entries) - 1
        at = h & mask
        while (entry := int(self.entries[at])) >= 0:
            if int(self.hashes[at]) == h and self.contents[entry] == content:
                return at, entry
            at = (at + 1) & mask
        return at, -1

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        at, entry = self._place(h, content)
        if entry >= 0:
            return entry, False
        entry = len(self.contents)
        self.hashes[at], self.entries[at] = h, entry
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.entries):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        used = np.flatnonzero(self.entries >= 0)
        hashes, entries, slots = self.hashes[used], self.entries[used], 2 * len(self.entries)
        self.hashes, self.entries = np.zeros(slots, np.uint64), np.full(slots, -1, np.int64)
        mask = slots - 1
        for h, e in zip(hashes.tolist(), entries.tolist(), strict=True):
            at = h & mask
            while self.entries[at] >= 0:
                at = (at + 1) & mask
            self.hashes[at], self.entries[at] = h, e


def resolve_locally(docs: DataFrame, task_bytes: int = 32_000_000) -> DataFrame:
    """A row for each row of `docs` with the representative of its text in its map task.

    row_id numbers rows (task and place), rep_id is the row_id of the task's
    first copy; the text itself stands only in that copy's row. A table that
    holds over `task_bytes` is begun anew, so a task may have several copies.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        table, reps, digests = ContentTable(), [], []
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for value in batch.column("text"):
                text = _SPACE.sub(b" ", value.as_buffer().to_pybytes())
                row, seen = (task << 40) + seen, seen + 1
                digest = hashlib.sha256(text).digest()
                entry, new = table.find_or_add(int.from_bytes(digest[:8], "little"), text)
                if new:
                    reps.append(row)
                    digests.append(digest.hex())
                for column, x in zip(out, (row, reps[entry], int.from_bytes(digest[:8], "little", signed=True), digests[entry], len(text) if new else None, text if new else None), strict=True):
                    column.append(x)
                if table.bytes > task_bytes:
                    table, reps, digests = ContentTable(), [], []
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "row_id", "rep_id", "hash", "text_sha256", "size", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(resolve, f"doc_id {kind}, row_id long, rep_id long, hash long, text_sha256 string, size long, content binary")


def buckets(contents: DataFrame, bucket_bytes: int, fan_out_bits: int = 8, depths: int = 8) -> DataFrame:
    """Adds `bucket`, the hash prefix at the depth where its bytes fit `bucket_bytes`.

    Sizes (a column of their own: the texts aren't read for this) are summed
    level by level; only buckets that don't fit are split further. Those of a level are at most the corpus's bytes over
    `bucket_bytes`, and are joined, not collected. Copies of one text can't be
    split; after step 1 there is one for each task, and they are streamed.
    """
    contents = contents.withColumn("bucket", F.shiftrightunsigned("hash", 64 - fan_out_bits).cast("string"))
    for depth in range(2, depths + 1):
        large = contents.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")).where((F.col("bytes") > bucket_bytes) & (F.col("low") < F.col("high"))).select("bucket", F.lit(True).alias("large"))
        if large.isEmpty():
            break
        digit = F.shiftrightunsigned("hash", 64 - depth * fan_out_bits).bitwiseAND((1 << fan_out_bits) - 1)
        contents = contents.join(large, "bucket", "left").withColumn("bucket", F.when(F.col("large"), F.concat_ws(".", "bucket", digit.cast("string"))).otherwise(F.col("bucket"))).drop("large")
    return contents


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64_000_000) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of blanks and of the
    characters 9 to 13 is replaced by one space; a null text counts as empty.
    keep_id is the smallest doc_id of the group (nulls count as largest);
    of repeated rows with that id, exactly one is kept. Other columns are
    dropped; an empty table gives an empty result.
    """
    local = materialise(resolve_locally(ids_and_text(docs, id_col, text_col)), "grace-rows")
    found = local.groupBy("rep_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first"))
    contents = buckets(local.where("size is not null").select("rep_id", "hash", "size", "content"), bucket_bytes)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, reps, now = ContentTable(), [], None
        for batch in batches:
            group = []
            for bucket, rep, h, value in zip(batch.column("bucket").to_pylist(), batch.column("rep_id").to_pylist(), batch.column("hash").to_pylist(), batch.column("content"), strict=True):
                if bucket != now:  # the rows of a bucket stand together; the last bucket's table goes
                    table, reps, now = ContentTable(), [], bucket
                entry, new = table.find_or_add(h & 0xFFFFFFFFFFFFFFFF, value.as_buffer().to_pybytes())
                if new:
                    reps.append(rep)
                group.append(reps[entry])
            yield pa.RecordBatch.from_arrays([batch.column("rep_id"), pa.array(group, pa.int64())], ["rep_id", "group_id"])

    dealt = contents.drop("size").repartition("bucket").sortWithinPartitions("bucket")
    groups = dealt.mapInArrow(resolve, "rep_id long, group_id long")
    by_rep = groups.join(found, "rep_id")
    totals = by_rep.groupBy("group_id").agg(F.sum("n").alias("group_size"), F.min("first").alias("first"))
    reps = by_rep.select("rep_id", "group_id").join(totals, "group_id").select("rep_id", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"))
    rows = local.select("doc_id", "row_id", "rep_id", "text_sha256").join(reps, "rep_id")
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
