"""Operator 7: near-duplicates by improved consistent weighted sampling.

A text is a weighted set of shingles (five words); a shingle weighs its term
frequency times a smoothed inverse document frequency.

1. Document frequencies of all shingles of all documents are counted in a
   count-mean-min sketch of fixed size: each task adds its documents' distinct
   shingles to two rows of counters, and the tasks' sketches are added by
   Spark in two rounds. It is the only thing that is broadcast.
2. Each text gets `bands * rows` consistent weighted samples (Ioffe 2010: two
   sets agree in a sample with a probability of their weighted Jaccard
   similarity). Texts of equal words are one node from here on.
3. Nodes that agree in all samples of a band share a bucket. In each bucket
   the members are compared with its leader, the member that shares most with
   others; those that are not of its class by then, through any links, form
   the bucket of the next round. Such pairs are verified on the texts by
   weighted Jaccard similarity, dealt by (leader, salt): a leader, however
   popular, meets its partners in many tasks.
4. After `star_rounds`, what isn't of its bucket's largest class is joined with
   all that stands in such buckets by prefix filtering, which is exact: two
   sets of a similarity of 0.8 share a shingle among the rarest of each, those
   that precede 0.8 of its weight. So unlike texts meet nothing, however many
   share a passage; only rows that share such a shingle, and whose weights
   allow the similarity, get their texts, and these are compared class by
   class, block by block, each unit returning only links that join classes.
5. Links make classes by minimum labels with pointer jumping, as joins.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import ids_and_text, materialise, slices_by_bytes
from polarmesh.llm.textops import mix, shingles, utf8, words

SHINGLE = 5
SKETCH_BITS = 18
SKETCH_BLOCKS = 32
#: A prefix shingle knows this many before it: if two texts share one of those, they met there.
RECENT = 8
TABLE = 4096


def distinct(hashes: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (sorted in each), their counts, and the offset of each text among them."""
    n = np.diff(by_text)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, text))
    h = hashes[order]
    first = np.ones(len(h), bool)
    if len(h):
        first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(at, append=len(h))
    return h[at], counts, np.concatenate([[0], np.cumsum(first)])[by_text]


class Sketch:
    """Two rows of counters; `idf` gives the smoothed inverse document frequency of shingles."""

    def __init__(self, counters: np.ndarray, documents: int):
        self.counters, self.documents, self.total = counters, max(documents, 1), counters[0].sum()

    @staticmethod
    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(30)) & mask).astype(np.int64)

    def weights(self, h: np.ndarray, counts: np.ndarray, share: float = 0.2) -> np.ndarray:
        """tf * (1 - share + share * idf), idf being log(1 + N / df) over log(1 + N).

        The bounded share keeps a passage that many near-copies have in common
        from losing all its weight against the words that differ.
        """
        width = 1 << SKETCH_BITS
        found = [c[p] - (self.total - c[p]) / (width - 1) for c, p in zip(self.counters, self.places(h), strict=True)]
        df = np.clip(np.minimum(*found), 1, self.documents)
        return (counts * (1 - share + share * np.log1p(self.documents / df) / np.log1p(self.documents))).astype(np.float32)


def document_frequencies(docs: DataFrame) -> Sketch:
    """The sketch of all rows of `docs` (text). A task sends `SKETCH_BLOCKS` rows, the driver gets as many."""
    width = 1 << SKETCH_BITS
    size = 2 * width // SKETCH_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, n = np.zeros((2, width), np.int64), 0
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 1_000_000):
                h = distinct(*shingles(*words(*utf8(part.column("text"))), SHINGLE))[0]
                n += len(part)
                for c, p in zip(counters, Sketch.places(h), strict=True):
                    c += np.bincount(p, minlength=width)
        if n:
            task = TaskContext.get().partitionId()
            yield _rows(counters.reshape(SKETCH_BLOCKS, size), n, task >> 5)

    def _rows(blocks, n, part):
        return pa.RecordBatch.from_arrays([pa.array([part] * SKETCH_BLOCKS, pa.int64()), pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([n] * SKETCH_BLOCKS, pa.int64()), pa.array([b.astype("<i8").tobytes() for b in blocks], pa.binary())], ["part", "block", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for part, block, n, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "n", "counts")), strict=True):
                own = np.frombuffer(counts, "<i8")
                at = sums.setdefault((part, block), [0, np.zeros(len(own), np.int64)])
                at[0] += n
                at[1] += own
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tobytes() for k in keys], pa.binary())], ["part", "block", "n", "counts"])

    schema = "part long, block int, n long, counts binary"
    by_part = docs.select("text").mapInArrow(count, schema).repartition("part", "block").mapInArrow(add, schema)
    rows = by_part.withColumn("part", F.lit(0).cast("long")).repartition("block").mapInArrow(add, schema).collect()
    if not rows:
        return Sketch(np.zeros((2, width), np.int64), 0)
    blocks = {r["block"]: np.frombuffer(r["counts"], "<i8") for r in rows}
    return Sketch(np.concatenate([blocks[k] for k in range(SKETCH_BLOCKS)]).reshape(2, width), rows[0]["n"])


class Sampler:
    """Improved consistent weighted sampling; r, c ~ Gamma(2, 1) and beta ~ U(0, 1) come from tables drawn once, indexed by a shingle's hash."""

    def __init__(self, samples: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.r = rng.gamma(2, 1, (TABLE, samples)).astype(np.float32)
        self.beta = rng.random((TABLE, samples), np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (TABLE, samples))).astype(np.float32)

    def signatures(self, h: np.ndarray, weights: np.ndarray, by_text: np.ndarray, chunk: int = 8192) -> np.ndarray:
        """One row of `samples` 32-bit samples for each text; zeros for a text without shingles."""
        n = np.diff(by_text)
        best = np.full((len(n), self.samples), np.iinfo(np.int64).max)
        text = np.repeat(np.arange(len(n)), n)
        log_w = np.log(weights).astype(np.float32)
        low = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), chunk):
            own = slice(at, at + chunk)
            i = (h[own] & np.uint64(TABLE - 1)).astype(np.int64)
            j = ((h[own] >> np.uint64(12)) & np.uint64(TABLE - 1)).astype(np.int64)
            r, beta = self.r[i], self.beta[i]
            t = np.floor(log_w[own, None] / r + beta)
            log_a = self.log_c[j] - r * (t - beta) - r
            ids = low[own, None] ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            key = ((log_a * 1048576).astype(np.int64) << 32) | ids
            texts = text[own]
            starts = np.flatnonzero(np.diff(texts, prepend=-1))
            rows = texts[starts]
            best[rows] = np.minimum(best[rows], np.minimum.reduceat(key, starts, axis=0))
        out = (best & 0xFFFFFFFF).astype(np.uint32)
        out[n == 0] = 0
        return out


def weighted_sets(texts: pa.Array, sketch: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, counts, by_text = distinct(*shingles(*words(*utf8(texts)), SHINGLE))
    return h, sketch.weights(h, counts), by_text


def weighed(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A set's sorted shingles, their weights, and its whole weight; copies, so that they don't hold other texts' arrays."""
    return h.copy(), w.copy(), float(w.sum(dtype=np.float64))


def alike(one: tuple, other: tuple, threshold: float) -> bool:
    """Whether two weighed sets have a weighted Jaccard similarity of at least `threshold`."""
    if not len(one[0]) or not len(other[0]):
        return False
    if min(one[2], other[2]) < threshold * max(one[2], other[2]) * (1 - 1e-9):
        return False  # what they share is at most the smaller weight
    at = np.minimum(np.searchsorted(one[0], other[0]), len(one[0]) - 1)
    same = one[0][at] == other[0]
    shared = float(np.minimum(one[1][at[same]], other[1][same]).sum(dtype=np.float64))
    return shared >= threshold * (one[2] + other[2] - shared)


def sampled(docs: DataFrame, sketch, bands: int, rows: int, seen_texts: int = 50_000) -> DataFrame:
    """One row for each document: row_id, doc_id, rep, c1, c2 (hashes of its words), n_words, keys, text.

    rep is the row_id of the first row with the same words in its task (its
    own, if it has no words); only that row has the band keys and the text. A
    task remembers `seen_texts` texts, then begins anew.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sampler = sketch.value, Sampler(bands * rows)
        task, at, seen = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 500_000):
                data, offsets = utf8(part.column("text"))
                hashes, by_text = words(data, offsets)
                n = np.diff(by_text)
                place = np.arange(len(hashes)) - np.repeat(by_text[:-1], n)
                mixed = mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mixed, mix(mixed ^ np.uint64(0x5851F42D4C957F2D)))]
                c1, c2 = ((s[by_text[1:]] - s[by_text[:-1]]).view(np.int64) for s in sums)
                row = (task << 40) + at + np.arange(len(n))
                rep = row.copy()
                for k, key in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                    if n[k]:
                        rep[k] = seen.setdefault(key, int(row[k]))
                new = (rep == row) & (n > 0)
                if len(seen) > seen_texts:
                    seen.clear()
                h, made = shingles(hashes, by_text, SHINGLE)
                chosen = np.repeat(new, np.diff(made))
                h, counts, made = distinct(h[chosen], np.concatenate([[0], np.cumsum(np.diff(made)[new])]))
                signature = sampler.signatures(h, own.weights(h, counts), made)
                keys = signature.reshape(len(signature), bands, rows).astype(np.uint64)
                key = np.zeros(keys.shape[:2], np.uint64)
                for k in range(rows):
                    key = mix(key * np.uint64(31) + keys[:, :, k] + np.uint64(1))
                index = np.full(len(n), -1)
                index[new] = np.arange(int(new.sum()))
                take = pa.array(index, mask=~new)
                band_list = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), part.column("doc_id"), pa.array(rep), pa.array(c1), pa.array(c2), pa.array(n), band_list.take(take), part.column("text").filter(pa.array(new)).take(take)],
                    ["row_id", "doc_id", "rep", "c1", "c2", "n_words", "keys", "text"],
                )
                at += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sample, f"row_id long, doc_id {kind}, rep long, c1 long, c2 long, n_words long, keys array<long>, text string")


def verify(pairs: DataFrame, texts: DataFrame, sketch, threshold: float, share_of_task: int = 256) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) have a weighted Jaccard similarity of at least `threshold`.

    A node's text travels to where it is a `b`, and, as `a`, to up to 4096
    tasks, each of which streams a salt's share of its partners past it.
    """
    shares = pairs.groupBy("a").agg(F.least(F.ceil(F.count("*") / share_of_task), F.lit(4096)).cast("int").alias("salts"))
    firsts = shares.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("partner"))
    partners = pairs.join(shares, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("partner"))
    dealt = texts.hint("merge").join(firsts.unionByName(partners), "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "partner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = sketch.value, None
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 500_000):
                h, w, by_text = weighted_sets(part.column("text"), own)
                a, b, found = part.column("a").to_pylist(), part.column("node").to_pylist(), []
                for k, partner in enumerate(part.column("partner").to_pylist()):
                    mine = weighed(h[by_text[k] : by_text[k + 1]], w[by_text[k] : by_text[k + 1]])
                    if not partner:
                        now = mine
                    elif alike(now, mine, threshold):
                        found.append((a[k], b[k]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return dealt.select("a", "node", "partner", "text").mapInArrow(compare, "a long, b long")


def prefix(h: np.ndarray, w: np.ndarray, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one set: the places of its rarest shingles that precede `threshold` of its weight, rarest first, and the weight from each on.

    The order hangs on the shingles alone. If two sets' first common shingle
    came later in one of them, what they share would weigh too little.
    """
    order = np.lexsort((h, -rarity))
    left = np.cumsum(w[order][::-1], dtype=np.float64)[::-1]
    n = int(np.count_nonzero(left >= threshold * left[0] * (1 - 1e-6))) if len(h) else 0
    return order[:n], left[:n]


def prefixes(nodes: DataFrame, sketch, threshold: float) -> DataFrame:
    """One row for each prefix shingle of each text (node, root, rest, text): node, root, rest, x, weight (of the whole set), left (from x on), recent (the RECENT prefix shingles before x, in 32 bits; null where there are fewer)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sketch.value
        for batch in batches:
            for part in slices_by_bytes(batch, "text", 500_000):
                h, w, by_text = weighted_sets(part.column("text"), own)
                rarity = own.weights(h, np.ones(len(h), np.int64))
                cuts = [prefix(h[a:b], w[a:b], rarity[a:b], threshold) for a, b in itertools.pairwise(by_text.tolist())]
                n = [len(at) for at, _ in cuts]
                place = np.concatenate([at + k for (at, _), k in zip(cuts, by_text.tolist(), strict=False)] or [np.zeros(0, np.int64)])
                left = np.concatenate([x for _, x in cuts] or [np.zeros(0)])
                weight = np.repeat([x[0] if len(x) else 0.0 for _, x in cuts], n)
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                xs = h[place].view(np.int64)
                rank = np.arange(len(xs)) - np.repeat(np.cumsum([0, *n[:-1]]), n) if n else np.zeros(0, np.int64)
                back = np.arange(1, RECENT + 1)
                before = (xs ^ (xs >> 32)).astype(np.int32)[np.maximum(np.arange(len(xs))[:, None] - back, 0)] if len(xs) else np.zeros((0, RECENT), np.int32)
                recent = pa.FixedSizeListArray.from_arrays(pa.array(before.ravel(), mask=(rank[:, None] < back).ravel()), RECENT).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("node", "root", "rest")), pa.array(xs), pa.array(weight), pa.array(left), recent], ["node", "root", "rest", "x", "weight", "left", "recent"])

    return nodes.select("node", "root", "rest", "text").mapInArrow(cut, "node long, root long, rest boolean, x long, weight double, left double, recent array<int>")


def residual_links(buckets: DataFrame, texts: DataFrame, sketch, threshold: float, block: int = 512) -> DataFrame:
    """Links between the classes that meet in a bucket (band, key, node, root), as many as join them; `texts` has node, text.

    Of two members of different classes, one isn't of the bucket's largest
    class. These, the rest, are joined with all nodes of such buckets by their
    prefix shingles and a step of the weight, each node (x, step) against the
    classes there, so that no pairs of nodes are made. What a rest node may be
    like is then compared class by class: a unit is a block of rest nodes and a
    block of the class's members, and a rest node is done with its first link.
    """
    by_class = buckets.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    mixed = by_class.groupBy("band", "key").agg(F.sum("n").alias("m"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("top")).where("m > top")
    nodes = buckets.join(mixed, ["band", "key"]).groupBy("node", "root").agg(F.max(F.col("root") != F.col("largest")).alias("rest"))
    cut = materialise(prefixes(nodes.join(texts.hint("merge"), "node"), sketch, threshold), "prefixes")

    slack = 1 + 1e-6
    step = lambda w: F.floor(F.log(w) / F.log(F.lit(1.1))).cast("int")
    members = cut.withColumn("step", step(F.col("weight")))
    # of the shingles before x, those that all members of the class have at that place
    alike_at = [F.when((F.min(F.col("recent")[k]) == F.max(F.col("recent")[k])) & (F.count(F.col("recent")[k]) == F.count("*")), F.min(F.col("recent")[k])) for k in range(RECENT)]
    classes = members.groupBy("x", "step", "root").agg(F.max("left").alias("class_left"), F.min("weight").alias("class_weight"), F.min("rest").alias("all_rest"), F.array_compact(F.array(*alike_at)).alias("class_recent")).withColumnRenamed("root", "unit")
    low = F.col("weight") * threshold / slack
    high = F.least(F.col("weight") / threshold, F.col("left") * (1 + threshold) / threshold - F.col("weight")) * slack  # what is shared weighs at most `left`
    asked = cut.where(F.col("rest")).select("node", "root", "x", "weight", "left", F.array_compact("recent").alias("recent"), low.alias("low"), high.alias("high")).where("high >= low")
    asked = asked.withColumn("step", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))))
    enough = F.least("left", "class_left") * (1 + threshold) * slack >= threshold * (F.col("weight") + F.col("class_weight"))
    once = ~F.col("all_rest") | (F.col("root") < F.col("unit"))  # else the class's members ask for this node's class
    # a node and a class that share an earlier shingle met there already, as all that is asked there is less strict
    first = ~F.arrays_overlap("recent", "class_recent")
    met = materialise(asked.join(classes, ["x", "step"]).where((F.col("root") != F.col("unit")) & enough & once & first).select("node", "x", "step", "unit"), "met")

    rest = met.select("unit", "node").distinct()
    every = members.join(met.select("x", "step", F.col("unit").alias("root")).distinct(), ["x", "step", "root"]).select(F.col("root").alias("unit"), "node").distinct()
    blocks = lambda df, name: df.groupBy("unit").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = materialise(blocks(rest, "rest_blocks").join(blocks(every, "all_blocks"), "unit"), "units")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rest.join(sizes, "unit").select("unit", place("rest_blocks").alias("i"), each("all_blocks").alias("j"), "node", F.lit(True).alias("rest"))
    every = every.join(sizes, "unit").select("unit", each("rest_blocks").alias("i"), place("all_blocks").alias("j"), "node", F.lit(False).alias("rest"))
    cells = rest.unionByName(every).join(texts.hint("merge"), "node").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")

    def links_of(unit: pa.Table) -> list[tuple[int, int]]:
        sets, ahead = [], []
        for batch in unit.select(["text"]).to_batches():
            for part in slices_by_bytes(batch, "text", 500_000):
                h, w, by_text = weighted_sets(part.column("text"), sketch.value)
                rarity = sketch.value.weights(h, np.ones(len(h), np.int64))
                for a, b in itertools.pairwise(by_text.tolist()):
                    sets.append(weighed(h[a:b], w[a:b]))
                    ahead.append(h[a:b][prefix(h[a:b], w[a:b], rarity[a:b], threshold)[0]].tolist())
        nodes, rest = unit.column("node").to_pylist(), unit.column("rest").to_pylist()
        having: dict[int, list[int]] = {}
        for k, xs in enumerate(ahead):
            for x in () if rest[k] else xs:
                having.setdefault(x, []).append(k)
        out = []
        for k in (k for k, r in enumerate(rest) if r):
            shared = Counter(m for x in ahead[k] for m in having.get(x, ()))
            partner = next((m for m, _ in shared.most_common() if alike(sets[k], sets[m], threshold)), None)
            if partner is not None:
                out.append((min(nodes[k], nodes[partner]), max(nodes[k], nodes[partner])))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        held_back = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held_back is None else pa.concat_tables([held_back, rows])
            keys = [rows.column(c).to_numpy() for c in ("unit", "i", "j")]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])).tolist()
            yield made([link for at, stop in itertools.pairwise(starts) for link in links_of(rows.slice(at, stop - at))])
            held_back = rows.slice(starts[-1])
        if held_back is not None:
            yield made(links_of(held_back))

    return cells.select("unit", "i", "j", "rest", "node", "text").mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Classes of linked nodes: node, root (the least node of the class)."""
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        roots = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialise(lower.join(roots, "root", "left").select("node", "was", F.least("root", F.coalesce("above", "root")).alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where(F.col("root") != F.col("was")).isEmpty():
            return labels


def near_dedup(docs: DataFrame, threshold: float = 0.8, bands: int = 16, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 2) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id, class_size, n_links, kept.

    class_id is the least doc_id of the class (nulls count as largest);
    class_size counts its rows; n_links is the number of links that were
    verified between the row's text and different texts (enough to tell the
    class; pairs within a class need not all be compared); exactly one row of a class,
    one with that doc_id, is kept. Rows whose words are equal (in order) are
    of one class; a text without words, null or empty, is a class of its own.
    A text of fewer than five words is one shingle. Other columns are dropped;
    an empty table gives an empty result.

    A pair that shares a band (at a similarity of 0.8, all but two in ten
    thousand do) is compared unless links found before have made it one class.
    """
    spark = docs.sparkSession
    source = ids_and_text(docs, id_col, text_col)
    sketch = spark.sparkContext.broadcast(document_frequencies(source))
    every = materialise(sampled(source, sketch, bands, rows), "sampled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    # copies within a task are counted there, so that the rows of no text, however many copies it has, meet in one task
    reps = every.groupBy("rep").agg(F.count("*").alias("n"), first, *[F.min(c).alias(c) for c in ("c1", "c2", "n_words")])
    # rows without words differ by their row_id; of rows with equal words, the first of the least rep is the node
    alone = F.when(F.col("n_words") == 0, F.col("rep")).otherwise(F.lit(-1))
    reps = materialise(reps.withColumn("alone", alone), "reps")
    nodes = materialise(reps.groupBy("c1", "c2", "alone").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.when(F.col("alone") < 0, F.col("rep"))).alias("node")), "nodes")
    held = every.where(F.col("keys").isNotNull()).join(nodes.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    members = materialise(held.select(F.col("row_id").alias("node"), "keys"), "node-keys").select("node", F.col("node").alias("root"), F.posexplode("keys").alias("band", "key"))

    def with_leaders(rows: DataFrame) -> DataFrame:
        """Buckets of at least two, with their leader as `a`: the member whose buckets are largest together, of equals the least.

        What many are copies of shares more bands with them than they do with
        each other, so it leads, and its copies are linked by one comparison each.
        """
        sizes = rows.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
        full = materialise(rows.join(sizes, ["band", "key"]), "buckets")
        scored = full.join(full.groupBy("node").agg(F.sum("m").alias("score")), "node")
        leaders = scored.groupBy("band", "key").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("a"))
        return materialise(full.drop("m").join(leaders, ["band", "key"]), "led-buckets")

    buckets = met = with_leaders(members)
    # the texts of all that are in some bucket are gathered once, by the same plan at every size
    texts = every.where(F.col("text").isNotNull()).select(F.col("row_id").alias("node"), "text").hint("merge").join(buckets.select("node").distinct(), "node", "left_semi")
    texts = materialise(texts, "texts")
    links = labels = None
    for turn in range(star_rounds):
        if buckets.isEmpty():
            break
        pairs = buckets.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
        found = materialise(verify(materialise(pairs, "pairs"), texts, sketch, threshold), "links")
        links = materialise(found if links is None else links.unionByName(found).distinct(), "all-links")
        labels = components(links)
        # what is of the leader's class by now, through whatever links, needs no more comparisons
        classes = labels.select("node", "root")
        told = buckets.drop("root").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
        told = told.join(labels.select(F.col("node").alias("a"), F.col("root").alias("a_root")), "a", "left")
        rest = told.where(F.col("root") != F.coalesce("a_root", "a")).select("band", "key", "node", "root")
        if turn + 1 < star_rounds:
            buckets = with_leaders(materialise(rest, "rest"))
    if not met.isEmpty():
        classes = met.select("band", "key", "node", "root")
        if labels is not None:
            classes = classes.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = materialise(residual_links(materialise(classes, "classes"), texts, sketch, threshold), "links")
        links = materialise(found if links is None else links.unionByName(found).distinct(), "all-links")
        labels = components(links)
    if links is None:
        by_node = nodes.select("c1", "c2", "alone", "n", "first", F.lit(0).cast("long").alias("n_links"), F.coalesce("node", "alone").alias("root"))
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        by_node = nodes.join(labels, "node", "left").join(degree, "node", "left").select("c1", "c2", "alone", "n", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node", "alone").alias("root"))
    by_node = materialise(by_node, "node-classes")
    classes = by_node.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"))
    told = by_node.select("c1", "c2", "alone", "n_links", "root").join(classes, "root").select("c1", "c2", "alone", "n_links", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.row_id").alias("keep_row"))
    by_rep = reps.select("rep", "c1", "c2", "alone").join(told, ["c1", "c2", "alone"]).drop("c1", "c2", "alone")
    out = every.select("row_id", "doc_id", "rep").join(by_rep, "rep")
    return out.select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("n_links").cast("long").alias("n_links"), (F.col("row_id") == F.col("keep_row")).alias("kept"))
