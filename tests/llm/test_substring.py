import hashlib
import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm import substring
from ledgerloom.llm.substring import COVER, PERIOD, WINDOW


def brute(rows):
    low = lambda i: -(2**63) if i is None else i
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - WINDOW + 1):
            key = tuple(words[k : k + WINDOW])
            first[key] = min(first.get(key, low(i)), low(i))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            if first[tuple(words[k : k + WINDOW])] < low(i):
                gone.update(range(k, k + WINDOW))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs_of, rows, monkeypatch=None):
    got = sorted(map(tuple, substring.substring_table(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)
    return got


def make(n=120, seed=1):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(4000)}"
    passages = [[word() for _ in range(m)] for m in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(draw.randrange(0, 150))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            p = draw.choice(passages)
            a = draw.randrange(len(p) - 20)
            k = draw.randrange(len(words) + 1)
            words[k:k] = p if draw.random() < 0.6 else p[a:]
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(words)))
    for i in range(n, n + 30):
        words = rows[draw.randrange(n)][1].split()
        if words and draw.random() < 0.6:
            words[draw.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    draw.shuffle(rows)
    return rows


def test_cover_is_complete():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_by_brute_force(docs_of):
    got = check(docs_of, make())
    assert sum(r[2] > 0 for r in got) > 20


def test_hot_passages(docs_of, monkeypatch):
    monkeypatch.setattr(substring, "COUNTERS", 64)
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{draw.randrange(99999)}" for _ in range(draw.randrange(40))] + passage + [f"w{draw.randrange(99999)}" for _ in range(9)])) for i in range(700)]
    check(docs_of, rows)


def test_odd_rows(docs_of, odd_rows):
    check(docs_of, [*odd_rows, (None, "a b c d e f g h i j " * 300), (20, "a b c d e f g h i j " * 6), (5, "j " * 80), (21, "j " * 80)])
    assert substring.substring_table(docs_of([])).count() == 0


def test_counters_never_lose_a_frequent_key():
    draw = np.random.default_rng(1)
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(50):
        new = np.concatenate((draw.integers(0, 2**60, 300, np.uint64), np.full(30, 7, np.uint64)))
        keys, counts = substring.merge_counters(np.concatenate((keys, new)), np.concatenate((counts, np.ones(len(new), np.int64))), 64)
    assert counts[keys == 7][0] >= 50 * 30 - 50 * 330 // 64


def many_rows_of_one_id(ids, n=3000, seed=9):
    """Rows of few ids whose texts differ, with passages that other ids share."""
    draw = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(4)]
    rows = []
    for i in range(n):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(3, 9))]
        if i % 3 == 0:
            words += draw.choice(passages)
        rows.append((ids[i % len(ids)], " ".join(words)))
    return rows


def test_many_rows_of_one_id(docs_of):
    got = check(docs_of, [*many_rows_of_one_id([9]), (3, " ".join(f"p1_{i}" for i in range(60)))])
    assert sum(r[2] > 0 for r in got) > 100
    check(docs_of, [*many_rows_of_one_id([None]), (3, " ".join(f"p1_{i}" for i in range(60)))])
    check(docs_of, many_rows_of_one_id([None, 4, 5], seed=2))


def test_groups_over_many_batches():
    draw = np.random.default_rng(4)
    rows = sorted((int(h), int(i), 0, 0, k) for k, (h, i) in enumerate(zip(draw.zipf(1.6, 3000) % 50, draw.integers(0, 30, 3000))))
    rows += [(60, 1, 0, 0, k) for k in range(40)] + [(61, 1, 0, 0, 1), (61, 2, 0, 0, 1)]
    want = sorted(r[1:] for r in rows if len({q[1] for q in rows if q[0] == r[0]}) > 1)
    types = {"h": pa.int64(), "id": pa.int64(), "name": pa.int64(), "size": pa.int32(), "pos": pa.int32()}
    for step in (1, 7, 64, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + step]), types.values())], names=list(types)) for i in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in substring.of_more_documents(batches) for r in b.to_pylist()]
        assert sorted(got) == want


def test_clashing_names(spark, docs_of):
    rows = make(40, 3)
    docs = docs_of(rows)
    for c in ("id", "name", "size", "places", "starts", "rest", "h", "pos", "least"):
        docs = docs.withColumn(c, docs.text)
    assert sorted(map(tuple, substring.substring_table(docs).collect()), key=str) == brute(rows)
