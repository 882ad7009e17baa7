"""Operator 11: how the vocabulary of each source differs from the other sources of its language.

A language's terms that stand in enough of its documents are kept. They are
dealt to units of bounded size, sorted in UTF-8 order within each, and coded
as integers by `searchsorted` in sorted arrays; tasks count codes of a group
by `bincount`. A unit's counts make one dense matrix, sources by terms, from
which come its share of the distance of each pair of sources and its terms
that a source uses more than its language does. As ids keep the order of
UTF-8, the lower id wins a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarmesh.llm.shared import materialise, slices_by_bytes, small_batches
from polarmesh.llm.textops import LOWER, utf8

_bytes = np.arange(256)
IS_TERM = ((_bytes >= 0x41) & (_bytes <= 0x5A)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
#: Terms of a unit at most, about.
UNIT_TERMS = 1 << 14
SLICE_BYTES = 4_000_000


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.LargeStringArray, np.ndarray]:
    """Of all texts: each term's index among the distinct terms, these, and each term's text."""
    inside = IS_TERM[data]
    first = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
    counts = np.concatenate([[0], np.cumsum(first)])[offsets]
    low = LOWER[data[inside]]
    ends = np.append(np.flatnonzero(first[inside]), len(low)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(low)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, np.repeat(np.arange(len(offsets) - 1), np.diff(counts))


def counted(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below `bound`, ascending, and how often each stands."""
    if bound <= 8 * len(keys):
        n = np.bincount(keys, minlength=bound)
        there = np.flatnonzero(n)
        return there, n[there]
    return np.unique(keys, return_counts=True)


def padded(values: pa.LargeStringArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The values in classes of width 8, 16, 32 ...: the width, the indexes of its values, and these with zeros behind."""
    data, offsets = utf8(values)
    length = np.diff(offsets)
    width = np.maximum(3, np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out = np.zeros((len(at), 1 << w), np.uint8)
        column = np.arange(1 << w)
        here = column < length[at, None]
        out[here] = data[(offsets[at, None] + column)[here]]
        # no term holds a zero byte, so that comparing padded bytes is comparing terms
        yield 1 << int(w), at, out.view(">u8").ravel().astype(np.uint64) if w == 3 else out.view(f"S{1 << w}").ravel()


class Dictionary:
    """The kept terms of some units: for each language and width a sorted array, with each term's unit and id."""

    def __init__(self, kept: pa.Table):
        langs = kept.column("lang").combine_chunks().dictionary_encode()
        terms = kept.column("term").cast(pa.large_string()).combine_chunks()
        unit, id_ = (kept.column(c).to_numpy() for c in ("unit", "id"))
        code = langs.indices.to_numpy(zero_copy_only=False)
        self.arrays: dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(code == k)
            classes = self.arrays.setdefault(lang, {})
            for width, at, keys in padded(terms.take(pa.array(own))):
                order = np.argsort(keys, kind="stable")
                classes[width] = keys[order], unit[own[at]][order].astype(np.int64), id_[own[at]][order].astype(np.int64)

    def find(self, lang: str, values: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The unit and the id of each term; -1 for terms that aren't kept."""
        unit, id_ = np.full(len(values), -1, np.int64), np.full(len(values), -1, np.int64)
        classes = self.arrays.get(lang, {})
        for width, at, keys in padded(values) if classes else ():
            if width in classes:
                known, units, ids = classes[width]
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[place] == keys
                unit[at[same]], id_[at[same]] = units[place[same]], ids[place[same]]
        return unit, id_


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, docs: in how many documents of its language each term stands. Tasks count by language before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                codes, distinct, text = terms(*utf8(part.column("text")))
                if not len(codes):
                    continue
                size = len(distinct)
                once = np.unique(text * size + codes)
                lang, names = _codes(part.column("lang"))
                keys, n = counted(lang[once // size] * size + once % size, len(names) * size)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(keys // size)), distinct.take(pa.array(keys % size)).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "term", "docs"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def term_counts(docs: DataFrame, kept: Dictionary) -> DataFrame:
    """lang, source, unit, id, n: how often each kept term stands in each group; terms that don't stand there have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices_by_bytes(batch, "text", SLICE_BYTES):
                codes, distinct, text = terms(*utf8(part.column("text")))
                lang, langs = _codes(part.column("lang"))
                source, sources = _codes(part.column("source"))
                group = (lang * len(sources) + source)[text]
                order = np.argsort(group, kind="stable")
                groups, starts = np.unique(group[order], return_index=True)
                for g, mine in zip(groups, np.split(codes[order], starts[1:]), strict=True) if len(groups) else ():
                    there, n = counted(mine, len(distinct))
                    name = langs[int(g) // len(sources)].as_py()
                    unit, id_ = own.find(name, distinct.take(pa.array(there)))
                    hit = unit >= 0
                    m = int(hit.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.string()).take(pa.array(np.zeros(m, np.int64))), sources.take(pa.array(np.full(m, g % len(sources)))), pa.array(unit[hit].astype(np.int32)), pa.array(id_[hit].astype(np.int32)), pa.array(n[hit], pa.int64())],
                        ["lang", "source", "unit", "id", "n"],
                    )

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, unit int, id int, n long")
    return found.groupBy("lang", "source", "unit", "id").agg(F.sum("n").alias("n"))


def shares(count: np.ndarray, total: np.ndarray | int, kept: int, smoothing: int, thousands: int) -> np.ndarray:
    """1 + floor(1000**thousands * (count + smoothing) / (total + smoothing * kept)), exact.

    The quotient is made three digits at a time, so that nothing exceeds a
    thousand times the divisor.
    """
    divisor = np.asarray(total, np.int64) + smoothing * kept
    whole, rest = np.divmod(np.asarray(count, np.int64) + smoothing, divisor)
    for _ in range(thousands):
        digits, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digits
    return 1 + whole


OUT = "lang string, source string, part string, item string, value long"


def source_divergence(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, thousands: int = 3, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cells: int = 4_000_000, block_bytes: int = 64_000_000) -> DataFrame:
    """lang, source, part, item, value, rank for all groups (lang, source) of `docs`.

    Part `pair`: the sum, over all kept terms of the language, of the
    difference between the shares of this source and of the source `item`.
    Part `term`: the `top` kept terms whose share here exceeds that in the
    language, with the difference. Shares are integers: 1 + floor(scale *
    (count + smoothing) / (all counts + smoothing * kept terms)), the scale
    being 1000**thousands. Ranks start at 1 in each group and part; ties go
    to the item first in UTF-8 order.

    Nulls in any of the three columns count as empty; an empty language or
    source is one like others. Groups without terms, and all groups of
    languages that keep no term (pairs of value 0), have their rows. Repeated
    rows count each; ids and other columns aren't read; long texts are read
    whole; an empty table gives an empty result.

    At scale: kept terms go to tasks as broadcasts of about `block_bytes` at
    most; beyond it the texts are read once for each such block. A unit's
    matrix has about `cells` cells at most. Nothing is gathered by language or
    source alone before it is counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*(F.coalesce(F.col(old).cast("string"), F.lit("")).alias(new) for old, new in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    groups = materialise(docs.select("lang", "source").distinct(), "audit-groups")
    kept = materialise(document_counts(docs).where(F.col("docs") >= least_docs).select("lang", "term"), "audit-kept")
    # each language has a unit at least, so that one without terms has its pairs
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    room = F.least(F.lit(UNIT_TERMS), F.greatest(F.lit(1), F.expr(f"{cells} div sources")))
    langs = materialise(langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / room)).cast("int").alias("units")), "audit-langs")

    size = kept.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dictionary = kept.join(langs, "lang").withColumn("unit", F.pmod(F.xxhash64("term"), F.col("units")).cast("int"))
    dictionary = dictionary.withColumn("id", (F.row_number().over(Window.partitionBy("lang", "unit").orderBy("term")) - 1).cast("int"))
    dictionary = dictionary.select("lang", "unit", "id", "term", F.pmod(F.xxhash64("lang", "unit", F.lit(5)), F.lit(blocks)).cast("int").alias("block"))
    dictionary = materialise(dictionary, "audit-dictionary")
    counts = None
    for block in range(blocks):
        found = materialise(term_counts(docs, Dictionary(dictionary.where(F.col("block") == block).toArrow())), "audit-counts")
        counts = found if counts is None else counts.unionByName(found)

    # N of each group and language, and one row for each group in each unit of its language
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    totals = materialise(totals, "audit-totals")
    langs = langs.join(totals.groupBy("lang").agg(F.sum("own").alias("all")), "lang")
    nothing = {k: F.lit(None).cast(v).alias(k) for k, v in {"source": "string", "id": "int", "n": "long", "own": "long", "all": "long", "kept": "long", "term": "string"}.items()}
    order = ["lang", "unit", "source", "id", "n", "own", "all", "kept", "term"]

    def rows(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c) if c in df.columns else nothing[c] for c in order))

    members = totals.join(langs, "lang").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    found = rows(members).unionByName(rows(counts)).unionByName(rows(dictionary)).groupBy("lang", "unit").applyInArrow(lambda unit: _compare(unit, smoothing, thousands, top), OUT)
    found = materialise(found, "audit-units")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    best = found.where("part = 'term'").unionByName(pairs.select(*found.columns))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return best.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _compare(unit: pa.Table, smoothing: int, thousands: int, top: int) -> pa.Table:
    """Of one unit: the part of each pair's distance, the lower source first, and each source's terms that may be among its `top`."""
    lang = unit.column("lang")[0].as_py()
    source, id_, own, term = (unit.column(c) for c in ("source", "id", "own", "term"))
    members = unit.filter(own.is_valid())
    members = members.take(pa.compute.sort_indices(members.column("source")))
    names = members.column("source").cast(pa.large_string()).combine_chunks()
    kept, whole = members.column("kept")[0].as_py(), members.column("all")[0].as_py()
    words = unit.filter(term.is_valid())
    words = words.take(pa.compute.sort_indices(words.column("id"))).column("term").cast(pa.large_string()).combine_chunks()
    sparse = unit.filter(unit.column("n").is_valid())
    width = len(words)
    row = pa.compute.index_in(sparse.column("source").cast(pa.large_string()), value_set=names).to_numpy()
    count = np.zeros((len(names), width), np.int64)
    count[row, sparse.column("id").to_numpy()] = sparse.column("n").to_numpy()
    p = shares(count, members.column("own").to_numpy()[:, None], kept, smoothing, thousands) if width else count
    q = shares(count.sum(axis=0), whole, kept, smoothing, thousands) if width else count.sum(axis=0)
    a, b, value, part, item = [], [], [], [], []
    for k in range(len(names)):
        rest = np.arange(k + 1, len(names))
        a.append(np.full(len(rest), k))
        b.append(rest)
        value.append(np.abs(p[k + 1 :] - p[k]).sum(axis=1))
    first = pa.concat_arrays([names.take(pa.array(np.concatenate(a)))])
    second = names.take(pa.array(np.concatenate(b)))
    for k in range(len(names)):
        more = np.flatnonzero((count[k] > 0) & (p[k] > q))
        gain = (p[k] - q)[more]
        chosen = np.lexsort((more, -gain))[:top]
        part.append(np.full(len(chosen), k))
        item.append(more[chosen])
        value.append(gain[chosen])
    n_pairs, n_terms = len(first), sum(map(len, item))
    columns = [
        pa.array([lang], pa.string()).take(pa.array(np.zeros(n_pairs + n_terms, np.int64))),
        pa.concat_arrays([first, names.take(pa.array(np.concatenate(part)))]).cast(pa.string()),
        pa.array(["pair", "term"]).take(pa.array(np.repeat([0, 1], [n_pairs, n_terms]))),
        pa.concat_arrays([second, words.take(pa.array(np.concatenate(item)))]).cast(pa.string()),
        pa.array(np.concatenate(value), pa.int64()),
    ]
    return pa.Table.from_arrays(columns, ["lang", "source", "part", "item", "value"])
