import functools
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest

from ledgerloom.llm import auction, conversations

SCHEMA = "conv_id long, turn long, role string, text string, audit string, n long"
THEN = {"0": "u", "s": "u", "u": "a", "a": "u"}


def least(rows):
    """(cost, audit) by trying every edit; rows are (initial, must go, truncated)."""
    sys.setrecursionlimit(100_000)

    @functools.lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows):
            if state in "0a":
                found.append((0, ""))
        else:
            head, bad, cut = rows[i]

            def take(cost, letter, state):
                c, s = best(i + 1, state, 0)
                found.append((c + cost, letter + s))

            take(3, "D", state)
            if not bad:
                if head == THEN[state] or head == "s" and state == "0":
                    take(cut, "K", head)
                take(2 + cut, "R", THEN[state])
        if inserts < 2:
            c, s = best(i, THEN[state], inserts + 1)
            found.append((c + 2, "I" + s))
        return min(found) if found else (10**9, "")

    return best(0, "0", 0)


def want(rows):
    """The contract over (conv_id, turn, role, text) rows."""
    convs = {}
    for conv_id, turn, role, text in rows:
        own = convs.setdefault(conv_id, [])
        spelled = lambda x: " " if x is None else str(x)
        role, text = spelled(role), spelled(text)
        k = zlib.crc32(f"{spelled(conv_id)}:{spelled(turn)}".encode()) % 20
        if k == 0:
            continue
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        own += [row] * (1 + (k == 3))
    out = []
    for conv_id, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for turn, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(own, own[1:]))
        cost, audit = least(tuple((r[1][:1], f in ("blank", "duplicate"), int(f == "truncated")) for r, f in zip(own, faults)))
        fixed, state, rest = [], "0", iter(own)
        for e in audit:
            if e == "I":
                state = THEN[state]
                fixed.append(({"u": "user", "a": "assistant"}[state], ""))
                continue
            _, role, text = next(rest)
            if e == "D":
                continue
            state = role[:1] if e == "K" else THEN[state]
            fixed.append((role if e == "K" else {"u": "user", "a": "assistant"}[state], text))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def convs_of(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(parts)

    return make


def check(convs_of, rows, **kw):
    got = [tuple(r) for r in conversations.repair_table(convs_of(rows), **kw).collect()]
    assert order(got) == order(want(rows))
    return got


def drawn(conv_id, n, draw, texts=40):
    """Mostly alternating rows with odd ones between."""
    roles = ["user", "assistant", "system", "tool", None, "", "Umpire", "u", "späm"]
    said = lambda: draw.choice(["Yes.", "No", f"Text {draw.randrange(texts)}.", f"And {draw.randrange(texts)}!", " ", "", None, "Done?  \n", "… ", "x\x0b"]) if draw.random() < 0.5 else f"Row {draw.randrange(10**6)}."
    return [(conv_id, t if draw.random() < 0.95 else draw.choice([None, 0, t]), ["user", "assistant"][t % 2] if draw.random() < 0.8 else draw.choice(roles), said()) for t in range(n)]


def test_random_conversations(convs_of):
    draw = random.Random(4)
    rows = [r for c in range(400) for r in drawn(c * 7, draw.randrange(1, 12), draw)]
    got = check(convs_of, rows)
    assert set("".join(r[7] for r in got)) == set("DIKR")


def test_conversations_over_chunks(convs_of):
    draw = random.Random(5)
    rows = [r for c in range(12) for r in drawn(c, draw.choice([1, 3, 40, 90, 150]), draw)]
    want_rows = check(convs_of, rows, most_lines=20, chunk_lines=7)
    assert max(len(r[7]) for r in want_rows) > 100
    check(convs_of, rows, most_lines=60, chunk_lines=64)


def test_one_conversation_holds_all(convs_of, spark):
    draw = random.Random(6)
    rows = drawn(3, 700, draw, texts=5)
    check(convs_of, rows, chunk_lines=50)


def test_nulls_ties_and_repeats(convs_of):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 5, "user", "same."), (2, 5, "user", "same."), (2, 5, "user", "other"), (9, 1, "assistant", "x" * 300_000)]
    check(convs_of, rows)
    check(convs_of, [(7, 3, "user", "again.")] * 3000 + [(7, 4, "assistant", "once.")] * 2)
    check(convs_of, [(None, None, "user", None)] * 50)


def test_conversation_that_is_dropped_whole(convs_of):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = check(convs_of, [(c, 0, "user", "Hi.") for c in gone])
    assert {r[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(convs_of, spark):
    assert conversations.repair_table(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows_are_legal(convs_of):
    draw = random.Random(8)
    rows = conversations.cleaned(convs_of([r for c in range(60) for r in drawn(c, 9, draw)]))
    report, fixed = conversations.repair(rows)
    by: dict = {}
    for r in sorted(fixed.collect(), key=lambda r: (r.conv_id, r.part, r.pos, r.item)):
        by.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by.values())
    assert report.count() == 60


@pytest.mark.parametrize("seed", range(3))
def test_auction_against_all_edits(seed):
    draw = random.Random(seed)
    items, told = [], []
    for _ in range(200):
        n = draw.choice([0, 1, 2, 3, 5, 8]) if draw.random() < 0.9 else draw.choice([31, 32, 33, 65, 300])
        rows = [(draw.choice("xsua"), draw.random() < 0.2, draw.randrange(2)) for _ in range(n)]
        told.append(rows)
        items.append(auction.rows_of([" sua".find(h) if h != "x" and not f else 0 for h, f, _ in rows], [f for _, f, _ in rows], [bool(c) and not f for _, f, c in rows], [1] * n, end=True))
    found = auction.solved(items, np.tile(auction.END, (len(items), 1)))
    for rows, item, one in zip(told, items, found):
        assert (one[0].cost, auction.spelled(item, one[0].edits, 0)[0]) == least(tuple(rows))


def test_prices_are_an_optimal_dual():
    rows = auction.rows_of([2, 2, 3, 0], [False, False, False, True], [False, True, False, False], [1, 1, 1, 1], end=True)
    lattices = auction.row_lattices(auction.stacked([rows], 8), auction.END[None])
    cost = lattices.auction(np.array([0]), 0)
    price, ends = lattices.price, lattices.to
    assert (price[: lattices.total, None] <= np.minimum(lattices.cost + price[ends], auction.FAR)).all()
    assert cost[0] == price[0] and lattices.tight()[0].any()
