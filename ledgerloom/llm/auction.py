"""Least-cost repairs by the auction algorithm for shortest paths, for many small lattices at once.

A lattice has a layer of four states before each row and one after the last.  The states are what the roles so far allow:
nothing said yet, a system row, a user row, an assistant row.  Arcs have integer costs: delete, insert (within a layer),
keep and change the role.  For each lattice the algorithm keeps one path from its origin and a price for each node with
``price[i] <= cost[i, j] + price[j]``: the path's end is extended along its best arc where that holds with equality, or
else its price is raised to the best value and the path contracts by one node.  All lattices of a batch take a step at a
time.  At the end the prices are an optimal dual: every arc of every shortest path is tight, and the lexicographically
least one is traced along tight arcs that still lead to the goal.

Raising prices takes steps in proportion to a path's length times its excess cost, so rows are cut into blocks of
``BLOCK``.  A block's 4 x 4 matrix of distances comes from auctions with one goal and four origins, whose prices are kept
from one to the next; a chain of matrices is a lattice of the same kind, cut into blocks in its turn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE = range(4)
#: Initials of the edits in the order of their numbers, which is also their order as text.
LETTERS = "DIKR"
COST_DELETE, COST_INSERT, COST_REROLE, COST_TRUNCATED = 3, 2, 2, 1
#: The state after a user or assistant row that is put or made to follow each state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after keeping a row with initial none, s, u, a in each state; -1: not allowed.
KEPT = np.array([[-1, -1, -1, -1], [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1]])
FAR = 1 << 50
BLOCK = 32
#: Costs of ending in each state.
END = np.array([0, FAR, FAR, 0], np.int64)
BATCH = 1024


@dataclass
class Rows:
    """Rows of a lattice: initial (0 none, 1 s, 2 u, 3 a), whether a row must go, is truncated, allows inserts before it,
    and of how many equal rows it stands for (rows that must go; 0: an end without a row)."""

    head: np.ndarray
    forced: np.ndarray
    truncated: np.ndarray
    inserts: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.head)

    def part(self, a: int, b: int) -> Rows:
        return Rows(*(x[a:b] for x in (self.head, self.forced, self.truncated, self.inserts, self.weight)))


def rows_of(head, forced, truncated, weight, end: bool) -> Rows:
    """Rows with inserts allowed before each, and with ``end`` after the last."""
    more = 1 if end else 0
    pad = lambda x, v, kind: np.concatenate((np.asarray(x, kind), np.full(more, v, kind)))
    return Rows(pad(head, 0, np.int64), pad(forced, True, bool), pad(truncated, False, bool), np.ones(len(head) + more, bool), pad(weight, 0, np.int64))


def stacked(parts: list[Rows], size: int) -> Rows:
    """Rows of equal lattices, a line each; what is missing to ``size`` rows costs nothing and allows nothing."""
    def fill(values, kind, rest):
        out = np.full((len(parts), size), rest, kind)
        for line, v in zip(out, values):
            line[: len(v)] = v
        return out

    return Rows(fill([p.head for p in parts], np.int64, 0), fill([p.forced for p in parts], bool, True), fill([p.truncated for p in parts], bool, False), fill([p.inserts for p in parts], bool, False), fill([p.weight for p in parts], np.int64, 0))


class Lattices:
    """Lattices of equal size: for each node the four arcs' ends and costs, and prices that satisfy the bound.

    Node numbers are (lattice, layer, state) in row order; the goals come last.
    """

    def __init__(self, to: np.ndarray, cost: np.ndarray, least: np.ndarray, end: np.ndarray):
        """to, cost: (n, layers, 4 states, 4 arcs), ends as node numbers within the lattice; least: a lower bound of each
        layer's cost; end: (n, 4) costs of ending."""
        n, layers = cost.shape[:2]
        self.n, self.layers = n, layers
        base = (np.arange(n) * (layers + 1) * 4)[:, None, None, None]
        last = np.full((n, 1, 4, 4), FAR, np.int64)
        last[:, 0, :, 0] = end
        self.cost = np.concatenate((cost, last), axis=1).reshape(-1, 4)
        goals = np.broadcast_to((n * (layers + 1) * 4 + np.arange(n))[:, None, None, None], (n, 1, 4, 4))
        self.to = np.concatenate((to + base, goals), axis=1).reshape(-1, 4)
        self.total = n * (layers + 1) * 4
        reach = self.leading(self.cost < FAR)
        behind = np.zeros((n, layers + 1), np.int64)
        behind[:, :-1] = np.cumsum(least[:, ::-1], axis=1)[:, ::-1]
        low = np.minimum(behind + end.min(axis=1)[:, None], FAR)
        self.price = np.where(reach, np.repeat(low, 4, axis=1).ravel(), FAR)
        self.price = np.concatenate((self.price, np.zeros(n, np.int64)))

    def leading(self, arcs: np.ndarray) -> np.ndarray:
        """Nodes from which the goal is reached along the given arcs."""
        found = np.zeros(self.total + self.n, bool)
        found[self.total :] = True
        node = np.arange(self.total).reshape(self.n, self.layers + 1, 4)
        for layer in range(self.layers, -1, -1):
            own = node[:, layer].ravel()
            for _ in range(3):  # up to two inserts before an arc to the next layer
                found[own] = (arcs[own] & found[self.to[own]]).any(axis=1)
        return found[: self.total]

    def origin(self, which: np.ndarray, state) -> np.ndarray:
        return which * (self.layers + 1) * 4 + state

    def auction(self, which: np.ndarray, state) -> np.ndarray:
        """Shortest distance to the goal from a state of the first layer, for the lattices numbered ``which``."""
        first = self.origin(which, np.broadcast_to(state, which.shape))
        parent = np.full(self.total + self.n, -1, np.int64)
        now = first[self.price[first] < FAR]
        while len(now):
            ends = self.to[now]
            value = np.minimum(self.cost[now] + self.price[ends], FAR)
            best = value.argmin(axis=1)
            low = value[np.arange(len(now)), best]
            raised = low > self.price[now]
            self.price[now[raised]] = low[raised]
            back = parent[now]
            step = ends[np.arange(len(now)), best]
            onward = ~raised
            parent[step[onward]] = now[onward]
            now = np.where(raised, np.where(back >= 0, back, now), step)
            now = now[(now < self.total) & (self.price[np.minimum(now, self.total - 1)] < FAR)]
        return self.price[first]

    def tight(self) -> np.ndarray:
        """Arcs of shortest paths: those without slack that lead to the goal along such arcs."""
        ends = self.to
        arcs = (self.cost < FAR) & (self.price[: self.total, None] == self.cost + self.price[ends])
        lead = np.concatenate((self.leading(arcs), np.ones(self.n, bool)))
        return arcs & lead[ends]


def row_lattices(rows: Rows, end: np.ndarray) -> Lattices:
    """Lattices of stacked rows; arcs in the order of LETTERS."""
    n, size = rows.head.shape
    free = ~rows.forced[:, :, None]
    bad = np.where(rows.truncated, COST_TRUNCATED, 0)[:, :, None]
    kept = KEPT[rows.head]
    cost = np.full((n, size, 4, 4), FAR, np.int64)
    cost[..., DELETE] = (COST_DELETE * rows.weight)[:, :, None]
    cost[..., INSERT] = np.where(rows.inserts[:, :, None], COST_INSERT, FAR)
    cost[..., KEEP] = np.where(free & (kept >= 0), bad, FAR)
    cost[..., REROLE] = np.where(free, COST_REROLE + bad, FAR)
    layer = (np.arange(size) * 4)[None, :, None]
    to = np.empty((n, size, 4, 4), np.int64)
    to[..., DELETE] = layer + 4 + np.arange(4)
    to[..., INSERT] = layer + NEXT
    to[..., KEEP] = layer + 4 + np.maximum(kept, 0)
    to[..., REROLE] = layer + 4 + NEXT
    return Lattices(to, cost, np.where(rows.forced, COST_DELETE * rows.weight, np.where(rows.truncated, COST_TRUNCATED, 0)), end)


def chain_lattices(matrices: np.ndarray, end: np.ndarray) -> Lattices:
    """Lattices whose arcs are the distances of (n, layers, 4, 4) matrices."""
    n, layers = matrices.shape[:2]
    to = np.broadcast_to((np.arange(layers) * 4 + 4)[None, :, None, None] + np.arange(4), matrices.shape)
    return Lattices(to, matrices, np.minimum(matrices.min(axis=(2, 3)), FAR), end)


def distances(make, n: int) -> np.ndarray:
    """(n, 4, 4): from each first state to each last one; ``make`` gives the lattices for given costs of ending."""
    out = np.full((n, 4, 4), FAR, np.int64)
    for goal in range(4):
        end = np.full((n, 4), FAR, np.int64)
        end[:, goal] = 0
        lattices = make(end)
        for state in range(4):
            out[:, state, goal] = lattices.auction(np.arange(n), state)
    return out


IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def grouped(matrices: np.ndarray) -> np.ndarray:
    """(n, layers, 4, 4) as (n * groups, BLOCK, 4, 4), filled up by matrices that change nothing."""
    n, layers = matrices.shape[:2]
    groups = -(-layers // BLOCK)
    rest = np.broadcast_to(IDENTITY, (n, groups * BLOCK - layers, 4, 4))
    return np.concatenate((matrices, rest), axis=1).reshape(n * groups, BLOCK, 4, 4)


def through(matrices: np.ndarray) -> np.ndarray:
    """The (4, 4) matrix of a chain of (layers, 4, 4)."""
    matrices = matrices[None]
    while matrices.shape[1] > 1:
        parts = grouped(matrices)
        matrices = distances(lambda end: chain_lattices(parts, end), len(parts))[None]
    return matrices[0, 0]


def ahead(matrices: np.ndarray, end: np.ndarray, states=(START, SYSTEM, USER, ASSISTANT)) -> tuple[np.ndarray, np.ndarray]:
    """For chains (n, layers, 4, 4): the distance to go after each layer from each state on a shortest path, FAR for states
    on none, and the distance from each first state in ``states``."""
    n, layers = matrices.shape[:2]
    if layers <= BLOCK:
        lattices = chain_lattices(matrices, end)
        first = np.full((n, 4), FAR, np.int64)
        for state in states:
            first[:, state] = lattices.auction(np.arange(n), state)
        used = lattices.tight().any(axis=1)
        price = np.where(used, lattices.price[: lattices.total], FAR).reshape(n, layers + 1, 4)
        return price[:, 1:], first
    parts = grouped(matrices)
    groups = len(parts) // n
    upper, first = ahead(distances(lambda e: chain_lattices(parts, e), len(parts)).reshape(n, groups, 4, 4), end, states)
    inner, _ = ahead(parts, upper.reshape(n * groups, 4))
    return inner.reshape(n, groups * BLOCK, 4)[:, :layers], first


def block_matrices(blocks: list[Rows]) -> np.ndarray:
    """Distances through each block of up to BLOCK rows."""
    out = [distances(lambda end, r=stacked(blocks[i : i + BATCH], BLOCK): row_lattices(r, end), len(blocks[i : i + BATCH])) for i in range(0, len(blocks), BATCH)]
    return np.concatenate(out) if out else np.zeros((0, 4, 4), np.int64)


def cut(rows: Rows) -> list[Rows]:
    return [rows.part(i, i + BLOCK) for i in range(0, len(rows), BLOCK)]


def rows_through(rows: Rows) -> np.ndarray:
    """The (4, 4) matrix of rows of any number."""
    return through(block_matrices(cut(rows)))


@dataclass
class Repair:
    """Least cost, edits (numbers of LETTERS, one for a group of equal rows) and last state of a path."""

    cost: int
    edits: bytes
    last: int


def blocks_solved(blocks: list[Rows], end: np.ndarray, states) -> list[dict[int, Repair]]:
    """Repairs of blocks of up to BLOCK rows for each first state that has one."""
    out: list[dict[int, Repair]] = [{} for _ in blocks]
    sizes = np.array([len(b) for b in blocks])
    low = 0
    for size in (4, 8, 16, BLOCK):
        chosen = np.flatnonzero((sizes > low) & (sizes <= size))
        low = size
        for i in range(0, len(chosen), BATCH):
            which = chosen[i : i + BATCH]
            lattices = row_lattices(stacked([blocks[k] for k in which], size), end[which])
            own = np.arange(len(which))
            cost = {s: lattices.auction(own, s) for s in states}
            tight = lattices.tight()
            for s in states:
                # Along tight arcs, the least letter first; a path ends behind the last row of its own.
                some = np.flatnonzero(cost[s] < FAR)
                now, stop = lattices.origin(some, s), sizes[which[some]]
                steps = []
                while True:
                    layer = now // 4 % (size + 1)
                    going = layer < stop
                    if not going.any():
                        break
                    pick = tight[now].argmax(axis=1)
                    steps.append(np.where(going, pick, 255).astype(np.uint8))
                    now = np.where(going, lattices.to[now, pick], now)
                lines = np.stack(steps, axis=1) if steps else np.zeros((len(some), 0), np.uint8)
                for k, line, last in zip(some.tolist(), lines, (now % 4).tolist()):
                    out[which[k]][s] = Repair(int(cost[s][k]), line[line < 255].tobytes(), last)
    return out


def solved(items: list[Rows], end: np.ndarray, states=(START,)) -> list[dict[int, Repair]]:
    """Cheapest edits of each item from each first state, the least as text among equally cheap ones.

    ``end``: (n, 4) costs of ending in each state.  Items of more than one block get the prices at their blocks' ends from
    the chain of their matrices first.
    """
    short = [i for i, r in enumerate(items) if len(r) <= BLOCK]
    out: list[dict[int, Repair]] = [{} for _ in items]
    for i, found in zip(short, blocks_solved([items[i] for i in short], end[short], states)):
        out[i] = found if len(items[i]) else {s: Repair(int(end[i, s]), b"", s) for s in states if end[i, s] < FAR}
    long = [i for i, r in enumerate(items) if len(r) > BLOCK]
    blocks = [cut(items[i]) for i in long]
    matrices = block_matrices([b for own in blocks for b in own])
    at = np.concatenate(([0], np.cumsum([len(own) for own in blocks]))).astype(int)
    # Chains of up to equal powers of two go together.
    by_size: dict[int, list[int]] = {}
    for k, own in enumerate(blocks):
        by_size.setdefault((len(own) - 1).bit_length(), []).append(k)
    for power, ks in by_size.items():
        size = max(len(blocks[k]) for k in ks)
        chain = np.broadcast_to(IDENTITY, (len(ks), size, 4, 4)).copy()
        for line, k in zip(chain, ks):
            line[: len(blocks[k])] = matrices[at[k] : at[k + 1]]
        after, first = ahead(chain, end[[long[k] for k in ks]], states)
        ends = np.concatenate([a[: len(blocks[k])] for a, k in zip(after, ks)])
        pieces = blocks_solved([b for k in ks for b in blocks[k]], ends, (START, SYSTEM, USER, ASSISTANT))
        place = 0
        for k, cost in zip(ks, first):
            own = pieces[place : place + len(blocks[k])]
            place += len(own)
            for s in states:
                if cost[s] >= FAR:
                    continue
                state, edits = s, []
                for piece in own:
                    edits.append(piece[state].edits)
                    state = piece[state].last
                out[long[k]][s] = Repair(int(cost[s]), b"".join(edits), state)
    return out


def spelled(rows: Rows, edits: bytes, state: int) -> tuple[str, list[tuple[int, int]]]:
    """The letters of the edits, and what they leave: (row, or -1 for an insert; its state), in order."""
    letters, left, at = [], [], 0
    head, weight = rows.head.tolist(), rows.weight.tolist()
    for e in edits:
        if e == INSERT:
            state = int(NEXT[state])
            left.append((-1, state))
            letters.append("I")
            continue
        if e == DELETE:
            letters.append("D" * weight[at])
        else:
            state = int(KEPT[head[at], state]) if e == KEEP else int(NEXT[state])
            left.append((at, state if e == REROLE else -1))
            letters.append(LETTERS[e])
        at += 1
    return "".join(letters), left
