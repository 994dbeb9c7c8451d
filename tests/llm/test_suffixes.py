import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffixes
from ledgerloom.llm.suffixes import WINDOW


def brute(rows):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        for k in range(len(b) - WINDOW + 1):
            seen[b[k : k + WINDOW]] += 1
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - WINDOW + 1):
            if seen[b[k : k + WINDOW]] > 1:
                gone[k : k + WINDOW] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs_of, rows):
    got = sorted(map(tuple, suffixes.suffix_table(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)
    return got


def make(n=60, seed=1):
    draw = random.Random(seed)
    words = lambda m: " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 9))) for _ in range(m))
    passages = [words(m) for m in (30, 36, 45, 120)]
    rows = []
    for i in range(n):
        text = words(draw.randrange(1, 120))
        for _ in range(draw.choice([0, 0, 1, 2])):
            p = draw.choice(passages)
            k = draw.randrange(len(text))
            text = text[:k] + (p if draw.random() < 0.6 else p[draw.randrange(40) :]) + text[k:]
        rows.append((i, text))
    for i in range(n, n + 15):
        text = rows[draw.randrange(n)][1]
        rows.append((i, text if draw.random() < 0.4 else text.replace("a", "b", 1)))
    rows += [(900, "und " * 300), (901, "x" * 700), (902, words(80) + "ab" * 300 + words(5)), (903, (words(60) + " ") * 2)]
    draw.shuffle(rows)
    return rows


def test_by_brute_force(docs_of):
    got = check(docs_of, make())
    assert sum(r[2] > 0 for r in got) > 20


def test_hot_keys_get_longer_keys(docs_of, monkeypatch):
    """Refinements come through suffix arrays too: with a bound of 1,000 and of 0 bytes every key is hot."""
    sizes = []
    whole = suffixes.sorted_spans
    monkeypatch.setattr(suffixes, "sorted_spans", lambda units, size: sizes.append(units.count()) or whole(units, size))
    monkeypatch.setattr(suffixes, "HOT_BYTES", 1000)
    check(docs_of, make(seed=2))
    assert len(sizes) == 3 and sizes[-1] > 0
    monkeypatch.setattr(suffixes, "HOT_BYTES", 0)
    check(docs_of, make(30, seed=3))
    assert len(sizes) == 6 and sizes[3] == 0


def test_longer_keys_follow_from_the_window():
    """Equal windows have equal longer keys, whatever the piece around them."""
    draw = np.random.default_rng(8)
    for depth in (0, 1, 3, 8):
        core = bytes(draw.integers(97, 101, 420, np.uint8))
        key = int(suffixes.hash_runs(suffixes.sums_of(np.frombuffer(core, np.uint8)), np.array([190]), suffixes.KMER).view(np.int64)[0])
        told = []
        for a, b in ((40, 390), (100, 360)):
            first, n, longer = suffixes.wider_keys(core[a:b], key, depth)
            spread = np.repeat(longer, n)
            told.append({core[a + i : a + i + WINDOW]: k for i, k in enumerate(spread.tolist())})
            if depth == 8:
                assert (n == 1).all()
        common = set(told[0]) & set(told[1])
        assert len(common) == 61 and all(told[0][w] == told[1][w] for w in common)


def test_many_shards(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    check(docs_of, make(seed=4))


def test_odd_rows(docs_of, odd_rows):
    rows = [(i, t[:3000] if t else t) for i, t in odd_rows]
    check(docs_of, [*rows, (None, "no id " * 50), (None, "no id " * 50), (30, "y" * 199), (31, "q" + "z1" * 99 + "w")])
    assert suffixes.suffix_table(docs_of([])).count() == 0


def test_very_long_text(docs_of):
    text = "a b c d e f g h i j " * 9000
    (got,) = suffixes.suffix_table(docs_of([(1, text)])).collect()
    assert (got.n_bytes, got.n_removed, got.n_spans) == (len(text), len(text), 1)


@pytest.mark.parametrize("unit", ["a", "ab, ", "one word ", "a line that is repeated over and over, with a number 7\n"])
def test_periodic_texts_over_the_bound_of_hot_keys(docs_of, monkeypatch, unit):
    """Pieces above HOT_BYTES and texts of several segments, alone and beside texts that share some of it."""
    monkeypatch.setattr(suffixes, "HOT_BYTES", 4000)
    monkeypatch.setattr(suffixes, "SEGMENT", 5000)
    long = unit * (23_000 // len(unit))
    check(docs_of, [(1, long)])
    check(docs_of, [(1, "start " + long), (2, unit * (7000 // len(unit)) + "end"), (3, "other " * 20 + unit * 30), (4, "none")])


def test_progressions_hold_every_place_once():
    draw = random.Random(4)
    for _ in range(300):
        places = np.array(sorted(draw.sample(range(60), draw.randrange(1, 30))))
        found = suffixes.progressions(places)
        assert [a + i * s for a, s, n in found for i in range(n)] == places.tolist()
    assert suffixes.progressions(np.arange(5, 500, 3)) == [(5, 3, 165)]


def test_many_rows_of_one_id(docs_of):
    draw = random.Random(3)
    passages = ["".join(draw.choice("abcdefg ") for _ in range(260)) for _ in range(4)]
    for ids in ([9], [None], [None, 4]):
        rows = [(ids[i % len(ids)], "".join(draw.choice("abcdefg ") for _ in range(draw.randrange(20))) + (draw.choice(passages) if i % 3 == 0 else "")) for i in range(3000)]
        got = check(docs_of, rows)
        assert sum(r[2] > 0 for r in got) > 500


def test_clashing_names(docs_of):
    rows = make(20, 6)
    docs = docs_of(rows)
    for c in ("id", "name", "size", "k", "c", "n", "at", "gone", "key"):
        docs = docs.withColumn(c, docs.text)
    assert sorted(map(tuple, suffixes.suffix_table(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("letters", [1, 2, 4, 200, 3000])
@pytest.mark.parametrize("size", [1, 2, 3, 50, 400])
def test_suffix_array_by_sorting(letters, size):
    draw = np.random.default_rng(size + letters)
    for _ in range(10):
        s = np.concatenate((draw.integers(1, letters + 1, size), [0])).astype(np.int32)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_array(s).tolist() == want


def test_recursion_is_entered_twice(monkeypatch):
    calls = []
    whole = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s: calls.append(len(s)) or whole(s))
    draw = np.random.default_rng(5)
    s = np.concatenate((np.tile(draw.integers(1, 5, 300), 6), [0])).astype(np.int32)
    assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert len(calls) >= 3 and all(b < a for a, b in zip(calls, calls[1:]))


def test_both_ways_of_inducing_agree():
    draw = np.random.default_rng(6)
    s = np.concatenate((draw.integers(1, 4, 900), [0])).astype(np.int32)
    small = suffixes.types_of(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = np.array(sorted(lms, key=lambda i: s[i:].tolist()))
    assert suffixes.induce_by_arrays(s, small, lms).tolist() == suffixes.induce_by_lists(s, small, lms).tolist()


def test_common_prefixes(monkeypatch):
    monkeypatch.setattr(suffixes, "CHAIN", 16)
    draw = np.random.default_rng(7)
    data = np.tile(draw.integers(0, 3, 150).astype(np.uint8), 6)
    data[draw.integers(0, len(data), 12)] = 9
    array = sorted(range(len(data)), key=lambda i: data[i:].tolist())
    before = np.full(len(data), -1)
    before[array[1:]] = array[:-1]
    at = np.flatnonzero(before >= 0)
    got = suffixes.common_prefixes(data, at, before[at], len(data) - np.maximum(at, before[at]))
    for i, j, n in zip(at, before[at], got):
        true = next((k for k in range(len(data) - max(i, j)) if data[i + k] != data[j + k]), len(data) - max(i, j))
        assert n == true or (n >= WINDOW and true >= WINDOW)
