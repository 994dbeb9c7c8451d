import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import hmm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        ts = tokens(text)
        out.append((i, held(i), len(ts), sum(c[t] > 0 for t in ts), total, sum(math.log10((c[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)))
    return sorted(out, key=str)


def check(docs_of, rows):
    got = sorted(map(tuple, hmm.score_table(docs_of(rows)).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert math.isfinite(g[6]) and g[6] <= 1e-9
    return got


def corpus(n=500, seed=1):
    draw = random.Random(seed)
    tongues = [[a + b for a in "abcdefgh" for b in s] for s in ("xyz", "klmno", "pqr")]
    return [(i, " ".join(draw.choice(tongues[i % 3]) if draw.random() < 0.95 else f"Rare{draw.randrange(10**6)}" for _ in range(draw.randrange(5, 120)))) for i in range(n)]


def test_counts_by_brute_force_and_better_than_base(docs_of):
    got = check(docs_of, corpus())
    held = [g for g in got if g[1]]
    assert len(held) > 25
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_rare_words_come_by_join(docs_of, monkeypatch):
    monkeypatch.setattr(hmm, "TOP", 40)
    check(docs_of, corpus(200, 2) + [(3, "twice Rare1 q"), (3, "twice Rare1 q")])


def test_odd_rows(docs_of, odd_rows):
    check(docs_of, [*odd_rows, (None, "No id"), (None, None)])
    check(docs_of, [])
    lone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    check(docs_of, [(lone, "nothing to learn from")])


def random_model(seed, classes):
    draw = np.random.default_rng(seed)
    k = hmm.STATES
    return hmm.Hmm(draw.dirichlet(np.ones(k)), draw.dirichlet(np.ones(k), k), draw.dirichlet(np.ones(classes), k).T)


def test_forward_is_the_sum_over_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 3)
    m = random_model(1, 4)
    texts = [[0, 3, 1, 2], [2], [1, 1, 0]]
    first = np.cumsum([0] + [len(t) for t in texts])
    got = hmm.forward(m, np.concatenate(texts), first)
    for t, g in zip(texts, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for a, b, c in zip(path, path[1:], t[1:]):
                p *= m.move[a, b] * m.emit[c, b]
            total += p
        assert g == pytest.approx(math.log(total))


def small_sizes(monkeypatch, run):
    for name, value in (("STATES", 3), ("OWN", 5), ("TAILS", 2), ("RUN", run), ("RUNS", 7), ("PRIOR", 0.0)):
        monkeypatch.setattr(hmm, name, value)


def texts_of_all_lengths(seed=5, n=40):
    draw = np.random.default_rng(seed)
    texts = [draw.integers(0, 7 if draw.random() < 0.5 else 3, draw.integers(1, 60)) for _ in range(n)]
    return np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))), texts


def brute_counts(m, text):
    """Forward-backward over a whole text, without scaling."""
    k, n = len(m.start), len(text)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    alpha[0] = m.start * m.emit[text[0]]
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] @ m.move) * m.emit[text[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = m.move @ (m.emit[text[t + 1]] * beta[t + 1])
    p = alpha[-1].sum()
    gamma = alpha * beta / p
    moves = sum((np.outer(alpha[t], m.emit[text[t + 1]] * beta[t + 1]) * m.move / p for t in range(n - 1)), np.zeros((k, k)))
    emit = np.zeros((7, k))
    np.add.at(emit, text, gamma)
    return gamma[0], moves, emit, math.log(p)


@pytest.mark.parametrize("run", [4, 9, 100])
def test_counts_over_whole_texts(monkeypatch, run):
    """Texts longer than a run give the counts and the likelihood of one recursion over the whole text."""
    small_sizes(monkeypatch, run)
    flat, first, texts = texts_of_all_lengths()
    m = random_model(2, 7)
    got = hmm.expect(m, flat, first)
    want = [sum(parts) for parts in zip(*(brute_counts(m, t) for t in texts))]
    for g, w in zip(got, want):
        assert np.allclose(g, w, rtol=1e-9)
    assert got[3] == pytest.approx(hmm.forward(m, flat, first).sum())


def test_baum_welch_never_lowers_the_likelihood(monkeypatch):
    small_sizes(monkeypatch, 8)
    flat, first, texts = texts_of_all_lengths(6)
    m, last = random_model(2, 7), -np.inf
    for _ in range(8):
        start, move, emit, now = hmm.expect(m, flat, first)
        assert now == pytest.approx(hmm.forward(m, flat, first).sum()) and now >= last - 1e-9
        last = now
        assert start.sum() == pytest.approx(len(texts)) and move.sum() == pytest.approx(len(flat) - len(texts)) and emit.sum() == pytest.approx(len(flat))
        m = hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_shared_out_texts_are_those_of_a_model_without_moves(monkeypatch):
    small_sizes(monkeypatch, 8)
    flat, first, _ = texts_of_all_lengths(7, 20)
    m = random_model(3, 7)
    m.move = np.eye(3)
    for g, w in zip(hmm.share_out(m, flat, first), hmm.expect(m, flat, first)):
        assert np.allclose(g, w)


def test_many_rows_of_one_id(docs_of):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    held = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 10 == 0)
    for ids in ([held], [None], [held, None, 3]):
        check(docs_of, [(ids[i % len(ids)], " ".join(draw.choices(words, k=draw.randrange(1, 6)) + [f"x{draw.randrange(10**6)}"])) for i in range(3000)])


def test_rare_words_of_many_rows_of_one_id(docs_of, monkeypatch):
    monkeypatch.setattr(hmm, "TOP", 40)
    draw = random.Random(4)
    check(docs_of, [(None, f"w{draw.randrange(300)} x{draw.randrange(900)}") for i in range(3000)])


def test_clashing_names(docs_of):
    rows = corpus(60, 3)
    docs = docs_of(rows)
    for c in ("id", "name", "size", "held_out", "h", "c", "n", "rare", "classes"):
        docs = docs.withColumn(c, docs.text)
    assert [tuple(r)[:5] for r in sorted(hmm.score_table(docs).collect())] == [w[:5] for w in sorted(brute(rows))]


def test_hash_index():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 2**64, 5000, np.uint64)) & ~np.uint64(0xF0)
    keys = np.unique(keys)
    index = hmm.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    other = draw.integers(0, 2**64, 5000, np.uint64) | np.uint64(0xF0)
    assert (index.find(other) == -1).all()
