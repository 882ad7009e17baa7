"""Operator 10: benchmark decontamination by a stored, distributed positional inverted index.

1. The benchmark's words are counted over all training documents, which ranks
   the terms of each window by rarity.
2. The index holds, for the two rarest terms of every window, their postings:
   a row for each (term, document), with all positions. It is written to the
   shared folder and dealt by (term, salt); a term with very many postings has
   several salts.
3. The lists are intersected by joins, rarest term first: a posting less its
   term's offset in the item is the start the item would have in the document;
   starts that a window's two rarest terms agree on are candidates.
4. Candidates are read in the documents' texts, word by word, so that results
   are exact whatever the hashes. For proximity matches, all words of a window
   are looked for around its rarest term.

Only bitmaps of fixed size (GATE_BITS) and the hot terms (10,000 at most) are
broadcast; neither documents nor the benchmark come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import ids_and_text, materialise, slices_by_bytes
from polarmesh.llm.textops import utf8, words

#: A bitmap of a set of terms has 2 to this power bits, whatever the set's size: one that fills it filters less, and loses nothing.
GATE_BITS = 20
MASK = (1 << GATE_BITS) - 1
#: No more terms than this are ever hot: each has at least this part of all counted words.
HOT_TERMS = 10_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

HIT = "array<struct<start: int, length: int, item_id: string>>"
NEAR = "array<struct<at: int, item_id: string>>"


def words_of(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return WORD.findall(text.translate(_LOWER))


def gate_of(terms: DataFrame):
    """A broadcast bitmap over the low bits of the hashes in `term`; at most 2**GATE_BITS / 64 rows come to the driver."""
    place = F.col("term").bitwiseAND(F.lit(MASK))
    rows = terms.select(F.shiftright(place, 6).alias("block"), F.expr("shiftleft(1L, cast(term & 63L as int))").alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("bits")).collect()
    blocks = np.zeros(1 << GATE_BITS - 6, np.int64)
    for r in rows:
        blocks[r["block"]] = r["bits"]
    return terms.sparkSession.sparkContext.broadcast(np.unpackbits(blocks.view(np.uint8), bitorder="little").view(bool))


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct items, numbered: item, item_id, text."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialise(rows.distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")


def item_terms(items: DataFrame) -> DataFrame:
    """The words of all items: item, q (place), term (hash)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                hashes, by_text = words(*utf8(part.column("text")))
                n = np.diff(by_text)
                q = np.arange(len(hashes)) - np.repeat(by_text[:-1], n)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(q.astype(np.int32)), pa.array(hashes.view(np.int64))], ["item", "q", "term"])

    return items.select("item", "text").mapInArrow(split, "item long, q int, term long")


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of each of `terms` in all of `docs`: term, n. Counts are added up slice by slice before they are shuffled."""
    gate = gate_of(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gate.value
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 1_000_000):
                hashes = words(*utf8(part.column("text")))[0]
                found, n = np.unique(hashes[own[(hashes & np.uint64(MASK)).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.distinct().join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def windows(places: DataFrame, size: int) -> DataFrame:
    """The windows of each item that has words: item, n_words, windows array<struct<o, q1, q2>>, the places of the two rarest terms of the window that begins at o.

    `places` has item, q, term, n (the term's frequency); of equally rare
    terms the earlier comes first. A window of one word has it twice.
    """
    whole = places.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("q", "n"))).alias("w"))
    n = F.least(F.lit(size), F.size("w"))

    def rarest(o):
        ranked = F.array_sort(F.transform(F.slice("w", o + 1, n), lambda x: F.struct(x["n"].alias("n"), x["q"].alias("q"))))
        return F.struct(o.alias("o"), ranked[0]["q"].alias("q1"), F.coalesce(F.get(ranked, F.lit(1))["q"], ranked[0]["q"]).alias("q2"))

    return whole.select("item", F.size("w").alias("n_words"), F.transform(F.sequence(F.lit(0), F.size("w") - n), rarest).alias("windows"))


def indexed(docs: DataFrame, anchors: DataFrame, hot: dict[int, int]) -> DataFrame:
    """One row for each row of `docs`: row_id, doc_id, n_words, postings array<struct<term, salt, positions>> of the anchors, and the text if there are any."""
    gate, salts = gate_of(anchors), docs.sparkSession.sparkContext.broadcast(hot)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_term, task, made = gate.value, salts.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 1_000_000):
                hashes, by_text = words(*utf8(part.column("text")))
                at = np.flatnonzero(own[(hashes & np.uint64(MASK)).astype(np.int64)])
                text = np.searchsorted(by_text, at, "right") - 1
                order = np.lexsort((hashes[at], text))
                at, text = at[order], text[order]
                terms = hashes[at].view(np.int64)
                first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.zeros(0, np.int64)
                row = (task << 40) + made + np.arange(len(part))
                made += len(part)
                salt = [int(r % of_term[t]) if t in of_term else 0 for t, r in zip(terms[first].tolist(), row[text[first]].tolist(), strict=True)] if of_term else np.zeros(len(first))
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array((at - by_text[text]).astype(np.int32)))
                inner = pa.StructArray.from_arrays([pa.array(terms[first]), pa.array(salt, pa.int32()), positions], ["term", "salt", "positions"])
                ends = np.searchsorted(text[first], np.arange(len(part) + 1)).astype(np.int32)
                held = pa.array(np.diff(ends) > 0)
                texts = part.column("text").filter(held).take(pa.array(np.cumsum(np.diff(ends) > 0) - 1, mask=np.diff(ends) == 0)) if len(part) else part.column("text")
                yield pa.RecordBatch.from_arrays([pa.array(row), part.column("doc_id"), pa.array(np.diff(by_text)), pa.ListArray.from_arrays(pa.array(ends), inner), texts], ["row_id", "doc_id", "n_words", "postings", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(post, f"row_id long, doc_id {kind}, n_words long, postings array<struct<term: long, salt: int, positions: array<int>>>, text string")


def _runs(doc: list[str], item: list[str], shift: int, size: int) -> Iterator[tuple[int, int]]:
    """Runs (start in the document, length) of at least a window in which item[q] is doc[q + shift]."""
    least, run = min(size, len(item)), 0
    stop = min(len(item), len(doc) - shift)
    for q in range(max(0, -shift), stop + 1):
        if q < stop and item[q] == doc[q + shift]:
            run += 1
            continue
        if run >= least:
            yield q - run + shift, run
        run = 0


def phrase_hits(candidates: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Hits in each document with candidates (row_id, candidates array<struct<shift, item_id, text>>): row_id, hits; candidates are compared word by word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                doc, own = words_of(text), set()
                items = {t: words_of(t) for t in {c["text"] for c in found}}
                for c in found:
                    own.update((start, length, c["item_id"]) for start, length in _runs(doc, items[c["text"]], c["shift"], size))
                hits.append([dict(zip(("start", "length", "item_id"), h, strict=True)) for h in sorted(own)])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item_id", pa.string())])))], ["row_id", "hits"])

    return rows.join(candidates, "row_id").select("row_id", "text", "candidates").mapInArrow(read, f"row_id long, hits {HIT}")


def near_hits(candidates: DataFrame, rows: DataFrame, size: int, span: int) -> DataFrame:
    """Proximity matches in each document with candidates (row_id, candidates array<struct<item_id, text, places array<struct<o, p>>>>): row_id, near."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                doc, own = words_of(text), set()
                for c in found:
                    item = words_of(c["text"])
                    for x in c["places"]:
                        around = set(doc[max(0, x["p"] - span) : x["p"] + span + 1])
                        if around.issuperset(item[x["o"] : x["o"] + size]):
                            own.add((x["p"], c["item_id"]))
                near.append([{"at": p, "item_id": i} for p, i in sorted(own)])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(near, pa.list_(pa.struct([("at", pa.int32()), ("item_id", pa.string())])))], ["row_id", "near"])

    return rows.join(candidates, "row_id").select("row_id", "text", "candidates").mapInArrow(read, f"row_id long, near {NEAR}")


def match_items(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int | None = None, salt_rows: int = 50_000) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, hits array<struct<start, length, item_id>>, near array<struct<at, item_id>>.

    A hit is a run of words of an item, as long as it goes on, that holds at
    least one window: `size` consecutive words of the item (all its words if
    it has fewer). With `span`, `near` also lists the positions of a window's
    rarest word around which all its words lie within that distance, in any
    order. A null text has no words; a null item id counts as the string
    "null"; repeated rows give a row each; other columns are dropped; a
    benchmark without words, or an empty table, gives empty arrays or no rows.
    A term with over `salt_rows` occurrences is dealt to several tasks.
    """
    source = ids_and_text(docs, id_col, text_col)
    items = benchmark_items(benchmark, item_col, item_text_col)
    terms = materialise(item_terms(items), "item-terms")
    frequency = materialise(term_frequencies(source, terms.select("term")), "term-frequencies")
    placed = materialise(windows(terms.join(frequency, "term"), size), "windows")
    each = placed.select("item", F.explode("windows").alias("w"))
    anchors = each.select("item", F.explode(F.array("w.q1", "w.q2")).alias("q")).distinct().join(terms, ["item", "q"])
    total = frequency.agg(F.sum("n")).first()[0] or 0
    salts = F.least(F.ceil(F.col("n") / salt_rows), F.lit(4096)).cast("int")
    by_term = frequency.select("term", F.when(F.col("n") > max(salt_rows, total // HOT_TERMS), salts).otherwise(F.lit(1)).alias("salts"))
    hot = {r["term"]: r["salts"] for r in by_term.where("salts > 1").collect()}  # fewer than HOT_TERMS, as each has more than that part of the total
    anchors = materialise(anchors.join(by_term, "term").select("term", "item", "q", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "anchors")

    rows = materialise(indexed(source, anchors.select("term"), hot), "documents-indexed")
    postings = rows.select("row_id", F.explode("postings").alias("p")).select("p.term", "p.salt", "row_id", "p.positions")
    index = materialise(postings.repartition("term", "salt").sortWithinPartitions("term", "salt", "row_id"), "postings")
    met = index.join(anchors, ["term", "salt"]).select("row_id", "item", "q", F.explode("positions").alias("p"))

    agreed = met.groupBy("row_id", "item", (F.col("p") - F.col("q")).alias("shift")).agg(F.collect_set("q").alias("places")).join(placed.select("item", "windows"), "item")
    both = F.exists("windows", lambda w: F.array_contains("places", w["q1"]) & F.array_contains("places", w["q2"]))
    found = agreed.where(both).select("row_id", "item", "shift").join(items, "item")
    candidates = found.groupBy("row_id").agg(F.collect_list(F.struct("shift", "item_id", "text")).alias("candidates"))
    texts = rows.where(F.col("text").isNotNull()).select("row_id", "text")
    out = rows.select("row_id", "doc_id", "n_words").join(phrase_hits(candidates, texts, size), "row_id", "left")
    near = F.array().cast(NEAR)
    if span:
        by_place = each.select("item", F.col("w.o").alias("o"), F.col("w.q1").alias("q"))
        around = met.join(by_place, ["item", "q"]).groupBy("row_id", "item").agg(F.collect_set(F.struct("o", "p")).alias("places")).join(items, "item")
        close = around.groupBy("row_id").agg(F.collect_list(F.struct("item_id", "text", "places")).alias("candidates"))
        out = out.join(near_hits(close, texts, size, span), "row_id", "left")
        near = F.coalesce("near", near)
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast(HIT)).alias("hits"), near.alias("near"))


def contamination(matches: DataFrame, share: int = 20) -> DataFrame:
    """Digest of `match_items`: doc_id, n_words, n_hit (words inside any hit), n_items, items_sha256, contaminated (share * n_hit >= n_words and n_hit > 0)."""
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end"))

    def cover(state, hit):
        stop = (hit["start"] + hit["length"]).cast("long")
        new = F.greatest(F.lit(0).cast("long"), stop - F.greatest(hit["start"].cast("long"), state["end"]))
        return F.struct((state["covered"] + new).alias("covered"), F.greatest(state["end"], stop).alias("end"))

    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    out = matches.select("doc_id", "n_words", F.aggregate(F.array_sort("hits"), zero, cover)["covered"].alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
