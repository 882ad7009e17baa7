"""Operator 2: best-fit packing of token sequences by linear grouping.

1. One pass tokenizes each text, cuts only what is longer than a sequence, and
   numbers the pieces of each length within its task. The pieces (a few
   numbers each, no ids) are written to the shared folder.
2. Pieces of one length are interchangeable, so the packing is planned on the
   histogram of lengths, which has at most `capacity` rows whatever the size
   of the corpus. Large lengths are put into groups of equal cardinality and
   rounded up to their group's largest; configurations of these few sizes are
   chosen, each by a knapsack that fills a sequence best; actual lengths then
   replace the rounded ones, and small lengths go best-fit into what is left.
3. The plan is a list of runs (length, first rank, count, first sequence, items
   a sequence, offset), broadcast with a size bounded by the same histogram;
   each piece finds its run by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarmesh.llm.shared import ids_and_text, materialise, slices_by_bytes
from polarmesh.llm.token_counts import RecentlyUsed, load

# Below this, lower-casing looks at no neighbour and no two characters compose.
_LATIN = 0x250
_low = [chr(c) for c in range(_LATIN) if ord(chr(c).lower()[0]) < _LATIN and len(chr(c).lower()) == 1]
_LETTERS = "".join(c for c in _low if unicodedata.category(c)[0] == "L")
_DIGITS = "".join(c for c in _low if unicodedata.category(c)[0] == "N")

#: A text with one of these is encoded whole: separators that Unicode versions class differently, what may start a special token, and all that isn't of the above.
UNSURE = re.compile("[^" + re.escape("".join(c for c in _low if c not in "<\x1c\x1d\x1e\x1f")) + "]")

#: The vocabulary's own pre-tokens of a lower-cased text: endings after an apostrophe, letters, one digit, other signs.
_UNITS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")

# Characters that stand for bytes in a byte-level vocabulary: the byte's own if it is printable, else those from 256 on, in order.
_printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_by_byte = {b: chr(b) for b in _printable} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(_printable)))}
_BYTE_LEVEL = {ord(c): "".join(_by_byte[b] for b in c.encode()) for c in _low}


class UnitEncoder:
    """Ids, as little-endian 32-bit bytes, of texts whose vocabulary never joins two pre-tokens.

    Ids of pre-tokens come from a cache that ends with its task; those that it
    doesn't hold are merged by the library.
    """

    def __init__(self, path: str, cache_bytes: int = 20_000_000):
        self.tokenizer = load(path)
        self.cache = RecentlyUsed(cache_bytes)

    def _merge(self, units: list[str]) -> list[bytes]:
        """Ids of pre-tokens: the library's merges alone, as nothing is left to normalise or split."""
        tokenize = self.tokenizer.model.tokenize
        return [np.array([x.id for x in tokenize(u.translate(_BYTE_LEVEL))], "<u4").tobytes() for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if UNSURE.search(t)}
        split = [() if i in whole else _UNITS.findall(t.lower()) for i, t in enumerate(texts)]
        known = self.cache.of(set().union(*split), self._merge)
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each text: doc_id, piece, start, length, ids_crc32, and where the piece was made (task, local_rank)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, made = UnitEncoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 1_000_000):
                rows, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(part.column("text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        n = len(own) // 4
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        rank.append(made[n])
                        made[n] += 1
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    source = ids_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, local_rank long")


def _fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each size that fill one sequence best, with the largest that is left among them."""
    take = np.zeros(len(sizes), np.int64)
    top = int(np.flatnonzero(left)[0])
    take[top] = 1
    room = capacity - int(sizes[top])
    reach = np.full(room + 1, -1, np.int64)  # the item that first reached this fill
    before = np.zeros(room + 1, np.int64)
    reach[0] = len(sizes)
    for g in range(top, len(sizes)):
        s, n = int(sizes[g]), int(left[g]) - (g == top)
        for _ in range(min(n, room // s if s else 0)):
            can = np.flatnonzero((reach[: room + 1 - s] >= 0) & (reach[s:] < 0))
            if not len(can):
                break
            # items of one size are added one at a time, so a fill reached here has used this size at most as often as there are rounds
            reach[can + s], before[can + s] = g, can
        if reach[room] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        take[reach[at]] += 1
        at = int(before[at])
    return np.minimum(take, left)


#: What counts as large, as shares of a sequence; at 1 all are packed best-fit. The split that needs the fewest sequences is taken.
LARGE = (1 / 16, 1 / 4, 1 / 2, 1)


def plan(histogram: dict[int, int], capacity: int, groups: int = 96, shares: tuple[float, ...] = LARGE) -> tuple[pd.DataFrame, int]:
    """Runs (length, first_rank, count, first_sequence, per_sequence, offset) that place all items, and the number of sequences."""
    return min((_plan(histogram, capacity, groups, share) for share in shares), key=lambda p: p[1])


def _plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> tuple[pd.DataFrame, int]:
    out, n_sequences = [], 0
    rank = dict.fromkeys(histogram, 0)
    bins: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, number)

    def put(length: int, count: int, first: int, per: int, offset: int) -> None:
        out.append((length, rank[length], count, first, per, offset))
        rank[length] += count

    big = sorted((x for x in histogram if x > capacity * large), reverse=True)
    total = sum(histogram[x] for x in big)
    if total:
        # linear grouping: ranks of equal number, from the longest; a length may lie in two groups
        each = -(-total // groups)
        queues: list[list[list[int]]] = [[]]
        room = each
        for length in big:
            n = histogram[length]
            while n:
                if not room:
                    queues.append([])
                    room = each
                k = min(n, room)
                queues[-1].append([length, k])
                n, room = n - k, room - k
        sizes = np.array([q[0][0] for q in queues])
        left = np.array([sum(k for _, k in q) for q in queues])
        while left.any():
            take = _fill(sizes, left, capacity)
            used = np.flatnonzero(take)
            times = int((left[used] // take[used]).min())
            left[used] -= take[used] * times
            # substitution: the same number of sequences, cut where an actual length changes
            slots = [g for g in used for _ in range(int(take[g]))]
            todo = times
            while todo:
                # slots of one group draw one after another from its queue, longest first
                wanted: dict[int, int] = {}
                for g in slots:
                    wanted[g] = wanted.get(g, 0) + 1
                run = todo
                for g, k in wanted.items():
                    run = min(run, max(1, queues[g][0][1] // k))
                at = 0
                for g, k in wanted.items():
                    if queues[g][0][1] >= k * run:
                        length = queues[g][0][0]
                        put(length, k * run, n_sequences, k, at)
                        at += k * length
                        queues[g][0][1] -= k * run
                    else:  # one sequence that takes items of more than one actual length
                        for _ in range(k):
                            while not queues[g][0][1]:
                                queues[g].pop(0)
                            length = queues[g][0][0]
                            put(length, 1, n_sequences, 1, at)
                            at += length
                            queues[g][0][1] -= 1
                    while queues[g] and not queues[g][0][1]:
                        queues[g].pop(0)
                if at < capacity:
                    bins.setdefault(capacity - at, []).append((n_sequences, run))
                n_sequences += run
                todo -= run
    rooms = sorted(bins)
    for length in sorted((x for x in histogram if x <= capacity * large), reverse=True):
        n = histogram[length]
        while n:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                per = capacity // length
                rooms.append(capacity)
                bins[capacity] = [(n_sequences, -(-n // per))]
                n_sequences += -(-n // per)
                continue
            room = rooms[k]
            first, number = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(k)
            per = room // length
            full = min(number, n // per)
            rest = []
            if full:
                put(length, full * per, first, per, capacity - room)
                n -= full * per
                rest.append((room - per * length, first, full))
            if full < number:
                if n and n < per:
                    put(length, n, first + full, n, capacity - room)
                    rest.append((room - n * length, first + full, 1))
                    n, full = 0, full + 1
                if full < number:
                    rest.append((room, first + full, number - full))
            for r, f, m in rest:
                if r:
                    if r not in bins:
                        bins[r] = []
                        bisect.insort(rooms, r)
                    bins[r].append((f, m))
    columns = ["length", "first_rank", "count", "first_sequence", "per_sequence", "offset"]
    return pd.DataFrame(out, columns=columns, dtype="int64").sort_values(["length", "first_rank"], ignore_index=True), n_sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", groups: int = 96) -> DataFrame:
    """Places every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole texts are tokenized; a null text counts as empty and is the end id
    alone. Null ids stay null; repeated rows are packed each; other columns
    are dropped; an empty table gives an empty result. Ties (pieces of one
    length) are placed in the order of their task and row.
    """
    made = materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity, groups)
    shared = docs.sparkSession.sparkContext.broadcast({int(k): v.to_numpy() for k, v in runs.groupby("length")})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length = shared.value
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            rank = (frame["before"] + frame["local_rank"]).to_numpy()
            for length, rows in frame.groupby("length").indices.items():
                run = by_length[int(length)]
                own = run[np.searchsorted(run[:, 1], rank[rows], "right") - 1]
                k = rank[rows] - own[:, 1]
                sequence[rows] = own[:, 3] + k // own[:, 4]
                offset[rows] = own[:, 5] + k % own[:, 4] * length
            yield frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    kind = made.schema["doc_id"].dataType.simpleString()
    return made.join(firsts, ["task", "length"]).mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
