import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def pieces_of(rows, capacity):
    """(doc_id, piece, start, length, crc) by the library."""
    out = []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        out += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def check(docs_of, rows, capacity=1024, **kw):
    """Every piece once, and gapless sequences within the capacity; returns the number of sequences and the bound."""
    got = packing.packed_documents(docs_of([r[:2] for r in rows]), PATH, 2, capacity, **kw).collect()
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(pieces_of([r[:2] for r in rows], capacity))
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in got) // capacity)


def test_odd_rows(docs_of, odd_rows):
    check(docs_of, [*odd_rows, (None, "no id"), (None, "no id"), (None, None)])


def test_many_short_documents_fill_their_sequences(docs_of):
    draw = random.Random(3)
    rows = [(i, "word " * draw.randrange(900)) for i in range(600)]
    used, least = check(docs_of, rows)
    assert used <= least * 1.01 + 1


def test_shards_and_levels(docs_of):
    draw = random.Random(4)
    rows = [(i, "a b " * draw.randrange(25)) for i in range(3000)]
    few, least = check(docs_of, rows, 64, shard_rows=128)
    assert few <= least * 1.02 + 1
    assert few <= check(docs_of, rows, 64, shard_rows=128, search=packing.Search(islands=1, generations=0, epochs=1))[0] + 5


def test_one_id_and_copies_spread_over_shards(docs_of):
    rows = [(7, "the same text")] * 3000 + [(None, "none")] * 500
    used, least = check(docs_of, rows, 64, shard_rows=256)
    assert used <= least * 1.05 + 1


def test_lengths_at_the_capacity(docs_of):
    rows = [(n, "a" + " a" * (n - 2) if n > 1 else "") for n in (1, 2, 15, 16, 17, 31, 32, 33, 48, 49)]
    check(docs_of, rows, 16)


def test_empty_table(docs_of):
    assert packing.packing_table(docs_of([]), PATH, 2).collect() == []


def least_sequences(lengths, capacity):
    """By trying all ways, the longest piece's sequence first."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for k in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + least_sequences([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_search_reaches_the_least_number(seed):
    draw = random.Random(seed)
    lengths = [draw.randrange(1, 20) for _ in range(7)]
    packer, rng = packing.Packer(np.array(lengths), 20), np.random.default_rng(seed)
    best = packer.evolve([packer.first(None), packer.first(rng), packer.first(rng)], packing.Search(generations=20), rng)[0]
    least = least_sequences(sorted(lengths, reverse=True), 20)
    assert packer.least <= least == best.max() + 1


def test_children_are_packings_that_keep_what_is_injected():
    rng = np.random.default_rng(2)
    packer = packing.Packer(rng.integers(1, 60, 400), 100)
    a, b = packer.first(rng), packer.first(rng)
    groups = {frozenset(np.flatnonzero(a == k).tolist()) for k in range(a.max() + 1)}
    kept = 0
    for _ in range(50):
        child = packer.cross(a, b, rng)
        assert set(child.tolist()) == set(range(child.max() + 1)) and (packer.fills(child) <= 100).all()
        kept += sum(frozenset(np.flatnonzero(child == k).tolist()) in groups for k in range(child.max() + 1))
    assert kept > 50


def test_islands_never_lose_their_elite():
    rng = np.random.default_rng(3)
    packer = packing.Packer(rng.integers(25, 70, 500), 100)
    first = [packer.first(rng) for _ in range(4)]
    best = max(map(packer.fitness, first))
    assert packer.fitness(packer.evolve(first, packing.Search(generations=30), rng)[0]) > best


def test_best_fit_takes_the_fullest_sequence():
    fit = packing.BestFit(10)
    for number, room in enumerate((9, 4, 6, 4)):
        fit.open(number, room)
    assert [fit.put(4), fit.put(4), fit.put(4), fit.put(3), fit.put(9), fit.put(1)] == [3, 1, 2, 0, -1, 2]
