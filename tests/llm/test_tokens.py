"""Token counts and packing against the library and an exact round trip."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from polarmesh.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_librarys(corpus, odd_docs):
    tokenizer = token_counts.load(BYTES)
    for docs in (corpus, odd_docs):
        texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
        want = Counter()
        for (i, t), k in texts.items():
            n = len(tokenizer.encode(t, add_special_tokens=False))
            want[i, len(t.encode()), n, n > 1024] += k
        got = Counter(map(tuple, token_counts.token_counts(docs, BYTES, cache_bytes=20_000).collect()))
        assert got == want


def test_counts_of_nothing(no_docs):
    out = token_counts.token_counts(no_docs, BYTES)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def check_packing(rows, docs, capacity):
    tokenizer = token_counts.load(WORDS)
    want = Counter()
    for i, t in ((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[i, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_round_trip(corpus, odd_docs, capacity):
    for docs in (corpus, odd_docs):
        n, total = check_packing(packing.pack(docs, WORDS, capacity).collect(), docs, capacity)
        least = -(-total // capacity)
        assert n <= max(least + 8, 1.03 * least)


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(50, 500))
    lengths = rng.integers(1, capacity + 1, 3000) if seed % 2 else np.minimum(capacity, 1 + rng.geometric(8 / capacity, 3000))
    histogram = dict(Counter(lengths.tolist()))
    runs, n = packing.plan(histogram, capacity, groups=30)
    used, placed = Counter(), Counter()
    for length, first, count, sequence, per, offset in runs.itertuples(index=False):
        assert first == placed[length]
        placed[length] += count
        for k in range(count):
            used[sequence + k // per] += length
    assert placed == Counter(histogram)
    assert len(used) == n and max(used.values()) <= capacity
    sizes = sorted(lengths.tolist(), reverse=True)
    bins = []  # first fit decreasing, for comparison
    for s in sizes:
        for i, b in enumerate(bins):
            if b + s <= capacity:
                bins[i] += s
                break
        else:
            bins.append(s)
    assert n <= 1.03 * len(bins) + 2


def test_ids_of_odd_strings_are_the_librarys():
    rng = np.random.default_rng(4)
    tokenizer, encoder = token_counts.load(WORDS), packing.UnitEncoder(WORDS, cache_bytes=100_000)
    latin, odd = "".join(map(chr, range(0x250))), "aB 's't'll'LL1½ <|endoftext|>\x1c\x85\xa0ßİȺÉe\u0301Σς漢\u200b\t\n“"
    for signs in (latin, odd, latin + odd):
        for _ in range(3):
            texts = ["".join(rng.choice(list(signs), rng.integers(0, 50))) for _ in range(400)]
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.cache.held < 200_000


def test_recently_used_is_bounded_and_right():
    cache = token_counts.RecentlyUsed(10_000)
    asked = []
    for k in range(200):
        keys = {f"common{j}" for j in range(5)} | {f"rare{k}-{j}" for j in range(10)}
        found = cache.of(keys, lambda new: asked.extend(new) or [x.encode() for x in new])
        assert all(found[x] == x.encode() for x in keys)
        assert len(cache.young) + len(cache.old) < 150
    assert len(asked) == len(set(asked))
