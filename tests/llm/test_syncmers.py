import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import syncmers


def chain(*values):
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text):
    h = [chain(w) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    s = [chain(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(h) - 4):
        inner = s[i : i + 4]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chain(s[i], s[i + 2], h[i + 4])))
    return out


def brute_sketch(text):
    return sorted({v % (1 << 32) for _, v in brute_anchors(text)})[:64] or [chain(text) % (1 << 32)]


def brute_likeness(a, b):
    least = sorted(set(a) | set(b))[:64]
    return len([v for v in least if v in a and v in b]) / len(least)


def brute(rows):
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], chain(r[1] or "")))
    out = []
    for (i, text), (_, nxt) in zip(order, order[1:] + order[:1]):
        text, nxt = text or "", nxt or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, e, n = brute_sketch(text), brute_sketch(edited), brute_sketch(nxt)
        show = lambda s: "".join(f"{v:08x}" for v in s)
        placed, other = set(brute_anchors(text)), set(brute_anchors(edited))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e), len(placed), len(placed & other), brute_likeness(a, e), brute_likeness(a, n)))
    return out


def check(docs_of, rows):
    got = sorted((tuple(r[:5]) + tuple(r[7:]) + tuple(r[5:7]) for r in syncmers.fingerprints(docs_of(rows)).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    for g, w in zip(got, want):
        assert g[7:] == pytest.approx(w[7:])
    return got


def random_rows(n, seed=1):
    draw = random.Random(seed)
    return [(draw.randrange(10**6), " ".join(draw.choice(["ö", "word", "and", "tail", "x" * 40]) + str(draw.randrange(99)) for _ in range(draw.randrange(200)))) for _ in range(n)]


def test_by_brute_force(docs_of):
    check(docs_of, random_rows(300))


def test_odd_rows(docs_of, odd_rows):
    check(docs_of, [*odd_rows, (None, "no id"), (None, None), (2**63 - 1, "last"), (-5, "minus 😀😀😀")])


def test_many_rows_of_one_id(docs_of):
    """An id that most rows share is cut into ranges by the hash of the text."""
    draw = random.Random(7)
    for hot in (None, 5):
        rows = [(hot if draw.random() < 0.8 else draw.randrange(100), f"text {draw.randrange(10**6)} of a few words to tell apart") for _ in range(3000)]
        got = check(docs_of, rows)
        assert any(0 < g[6] < g[5] for g in got) or all(g[5] < 3 for g in got)
        known = docs_of(rows).selectExpr("coalesce(doc_id, -9223372036854775808) as id")
        edges = syncmers.range_edges(known, 64)
        assert len(edges) > 50 and edges == sorted(set(edges))


def test_clashing_names(docs_of):
    rows = random_rows(40, 6)
    docs = docs_of(rows)
    for c in ("id", "name", "range", "guard", "next", "copy", "head", "edited", "sketch"):
        docs = docs.withColumn(c, docs.text)
    assert sorted(r.edited_sha256 for r in syncmers.fingerprints(docs).collect()) == sorted(w[2] for w in brute(rows))


def test_few_rows(docs_of):
    check(docs_of, [])
    check(docs_of, [(4, "only one document here")])
    check(docs_of, [(4, "a b"), (9, "c d e f g h i j k")])


def test_anchors_are_context_free(docs_of):
    draw = random.Random(3)
    passage = " ".join(f"w{draw.randrange(999)}" for _ in range(60))
    texts = [passage, f"some other words before {passage} and after it"]
    df = syncmers.with_anchors(docs_of(list(enumerate(texts))), "text", "anchors").orderBy("doc_id")
    alone, inside = ([(a.place, a.hash) for a in r.anchors] for r in df.collect())
    assert alone == brute_anchors(passage)
    assert {(p + 4, h) for p, h in alone} <= set(inside)
    assert "Python" not in df._jdf.queryExecution().toString() and F is not None


def test_query_compares_whole_anchor_sets(spark, docs_of, tmp_path):
    from ledgerloom.llm.queries import op2_syncmers

    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage = [word() for _ in range(300)]
    texts = {i: " ".join([word() for _ in range(5000)] + passage + [word() for _ in range(5000)]) for i in range(4)} | {9: "", 10: "a b c"}
    docs_of(list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: {v % (1 << 32) for _, v in brute_anchors(t)} or {chain(t) % (1 << 32)} for i, t in texts.items()}
    ids = list(texts)
    got = {r.doc_id: r for r in op2_syncmers(spark, str(tmp_path)).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        other = {v % (1 << 32) for _, v in brute_anchors(edited)} or {chain(edited) % (1 << 32)}
        assert got[i].fingerprint == "".join(f"{v:08x}" for v in sorted(sets[i]))
        assert got[i].edited_fingerprint == "".join(f"{v:08x}" for v in sorted(other))
        assert got[i].near_edited == pytest.approx(len(sets[i] & other) / len(sets[i] | other))
        assert got[i].near_next == pytest.approx(len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
    assert all(len(sets[i]) > 4000 and got[i].near_next > 0 for i in range(3))
