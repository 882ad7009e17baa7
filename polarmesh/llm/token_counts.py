"""Operator 1: token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table of the lengths, in tokens, of frequent
pre-tokens: those that the tokenizer's own vocabulary holds as entries. Its
size is bounded by the vocabulary. Tier two is a cache in each Python worker;
pre-tokens found in neither are encoded by the library, in one batch for each
slice of rows. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import ids_and_text, slices_by_bytes

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Separators that Unicode versions class differently; a text with one is encoded whole by the library.
UNSURE = regex.compile("[\x1c-\x1f\x85᠎​  ]")

_tokenizers: dict = {}


class RecentlyUsed:
    """A dictionary in two generations, each of about `limit_bytes` as Python holds them.

    What is used moves to the young one, which becomes the old one when it is
    full: what was used last stays, and the size is bounded in bytes.
    """

    ENTRY = 200  # bytes of a dictionary's entry and of two objects beside their contents

    def __init__(self, limit_bytes: int):
        self.limit, self.young, self.old, self.held = limit_bytes, {}, {}, 0

    def of(self, keys: set, make: Callable[[list], Iterable]) -> dict:
        """A dictionary that holds all of `keys`; `make` gives the values of those that aren't held."""
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        new = keys.difference(self.young)
        found = {k: self.old[k] for k in new if k in self.old}
        missing = list(new.difference(found))
        found.update(zip(missing, make(missing), strict=True))
        self.young.update(found)
        self.held += sum(map(len, found)) + self.ENTRY * len(found) + sum(len(v) for v in found.values() if isinstance(v, bytes))
        return self.young


def load(path: str):
    """The tokenizer of a .json file, once for each process, on one thread."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def frequent_lengths(path: str) -> dict[str, int]:
    """Length in tokens of each vocabulary entry that is one whole pre-token."""
    tokenizer, pattern = load(path), regex.compile(PATTERN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = [tokenizer.decode([i]) for i in sorted(tokenizer.get_vocab().values())]
    texts = [t for t in dict.fromkeys(texts) if "�" not in t and t not in special and pattern.fullmatch(t) and not UNSURE.search(t)]
    return dict(zip(texts, (len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)), strict=True))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 30_000_000) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Texts are read whole. A null text counts as empty and has 0 tokens; a null
    id stays null; repeated rows each give a row; other columns are dropped,
    so their names can't clash; an empty table gives an empty result. A text
    that holds the string of a special token, or a separator on which Unicode
    versions differ, is encoded whole by the library.
    A task's cache has two generations of `cache_bytes` each at most.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, find = load(tokenizer_path), regex.compile(PATTERN).findall
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        common, cache = frequent.value, RecentlyUsed(cache_bytes)

        def lengths(texts: list[str]) -> Iterator[int]:
            return map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False))

        for batch in batches:
            for part in slices_by_bytes(batch, "text", 1_000_000):
                texts = part.column("text").to_pylist()
                whole = {i for i, t in enumerate(texts) if any(s in t for s in special) or UNSURE.search(t)}
                split = [() if i in whole else find(t) for i, t in enumerate(texts)]
                seen = set().union(*split) if split else set()
                rare = cache.of({t for t in seen if t not in common}, lengths)
                known = {t: common[t] if t in common else rare[t] for t in seen}
                counts = [sum(map(known.__getitem__, s)) for s in split]
                for i in whole:
                    counts[i] = len(tokenizer.encode(texts[i], add_special_tokens=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = ids_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = source.drop("text").schema.add("n_tokens", "long")
    return source.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
