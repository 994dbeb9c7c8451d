"""Suffix-array dedup: removes every byte covered by a 200-byte string that starts more than once in the corpus.

Every window of 200 bytes has a key, the least hash of its 48-byte substrings.  Equal windows have equal keys, so each
maximal run of windows of one key (a *piece*: the run's bytes) can be judged beside the other pieces of that key:

1. Keys are counted over all texts; pieces of keys that stand once end here.  One text of each group of whole copies
   stands for the others.
2. Equal pieces are one (their windows repeat by themselves).  Keys are dealt to shards of about ``SHARD_BYTES`` of
   distinct pieces, and each shard gets a suffix array by induced sorting: suffixes are classed as larger (L) or
   smaller (S) than the next, the substrings between leftmost-smaller places are sorted by induction and named, the
   string of names is sorted by the same function (recursion), and the whole array is induced from it.
3. Permuted common prefixes: each window in text order has its predecessor in the array; where the pair before it
   moved on by one, its common prefix is one less (only the others are compared, eight bytes at a time).  A common
   prefix of 200 bytes or more repeats.
4. A key with over ``HOT_BYTES`` of distinct pieces is refined first: its windows get longer keys, the key's substring
   widened towards the larger side of the window, so that a piece falls into a few runs of windows of one longer key.
   Longer keys are shards' units like any other, and equal windows still meet in one.  The last refinement's key is
   the whole window, so no unit can stay large.

Only narrow tables and the distinct pieces are stored between the steps.  A row is known by its id, the 64-bit hash of
its text and the text's size, so any number of rows may share an id.  Hashes have 64 bits; n pieces that are compared
by hash are mistaken with odds of about n^2 / 2^65.

Defined results: a null text is the empty text; texts under 200 bytes lose nothing; repeated rows are copies of each
other; a null id is an id of its own; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import _RANDOM, mix64, pieces, powers, stored, utf8
from ledgerloom.llm.substring import KEY, KEY_TYPE, keys_of, numbered

WINDOW, KMER = 200, 48
SPAN = WINDOW - KMER + 1  # substrings in a window
SHARD_BYTES, HOT_BYTES = 1 << 20, 256 << 10
#: Windows of a longer text that are worked off at a time; pieces end there.
SEGMENT = 1 << 20
#: Steps by which the keys of hot pieces are widened, one refinement after the other; after 8 a key is a whole window.
DEPTHS = (3, 8)
#: Symbols up to which buckets are worked off with arrays, and pairs in a row that share one comparison.
ARRAY_SYMBOLS, CHAIN = 1024, 2048
_BASE = 0xA0761D6478BD642F


def sums_of(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of bytes follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def hash_runs(sums: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    return mix64((sums[at + length] - sums[at]) * powers(pow(_BASE, -1, 1 << 64), len(sums))[at])


def slide(values: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``span`` values."""
    n, have = len(values) - span + 1, 1
    while have * 2 <= span:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:n], values[span - have : span - have + n])


class Windows:
    """The windows of a batch of texts: runs of equal keys as key, text, first window (in the text) and number.

    ``tied`` marks runs in which the key's substring may stand twice, so that windows may repeat within the run.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = utf8(texts)
        self.sums = sums_of(self.data)
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.keys, self.doc, self.at, self.n, self.tied = none.astype(np.uint64), none, none, none, none.astype(bool)
        if n < WINDOW:
            return
        kmers = hash_runs(self.sums, np.arange(n - KMER + 1), KMER)
        keys = slide(kmers, SPAN, np.minimum)
        doc = np.searchsorted(self.offsets, np.arange(len(keys)), "right") - 1
        valid = np.arange(len(keys)) + WINDOW <= self.offsets[1:][doc]
        starts = np.flatnonzero(valid & np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1])))
        ends = np.flatnonzero(valid & np.concatenate(((keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | ~valid[1:], [True]))) + 1
        self.keys, self.doc, self.n = keys[starts], doc[starts], ends - starts
        self.at = starts - self.offsets[self.doc]
        most = np.zeros(n - KMER + 1 + SPAN - 1, np.uint64)
        most[SPAN - 1 : SPAN - 1 + len(keys)] = np.where(valid, keys, np.uint64(0))
        places = np.flatnonzero(kmers == slide(most, SPAN, np.maximum))
        twice = places[:-1][kmers[places[:-1]] == kmers[places[1:]]]
        self.tied = np.searchsorted(twice, ends - 1 + SPAN) > np.searchsorted(twice, starts)

    def contents(self) -> np.ndarray:
        """Hash of the bytes of each run."""
        return hash_runs(self.sums, self.offsets[self.doc] + self.at, self.n + WINDOW - 1)


def types_of(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S)."""
    rises, level = s[:-1] < s[1:], s[:-1] == s[1:]
    place = np.where(level, len(s), np.arange(len(s) - 1))
    after = np.minimum.accumulate(place[::-1])[::-1]
    return np.concatenate((rises[after], [True]))


def induce_by_arrays(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """``induce`` for few symbols: places of one bucket that are known at the same time are worked off together."""
    sizes = np.bincount(s)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    present = np.flatnonzero(sizes).tolist()
    array = np.full(len(s), -1, np.int64)
    head, tail = starts.tolist(), ends.tolist()
    first = s[lms]
    by = np.argsort(first, kind="stable")
    cut = np.searchsorted(first[by], np.arange(len(sizes) + 1))
    grouped = lms[by]

    def push(block, want):
        before = block[block > 0] - 1
        before = before[small[before] == want]
        if not len(before):
            return
        symbols = s[before]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        edges = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(symbols)]
        for a, b in zip(edges, edges[1:]):
            c = int(symbols[a])
            if want:
                array[tail[c] - (b - a) : tail[c]] = before[a:b][::-1]
                tail[c] -= b - a
            else:
                array[head[c] : head[c] + b - a] = before[a:b]
                head[c] += b - a

    for c in present:
        done = int(starts[c])
        while done < head[c]:
            block, done = array[done : head[c]].copy(), head[c]
            push(block, False)
        push(grouped[cut[c] : cut[c + 1]], False)
    array[0] = len(s) - 1
    tail[int(s[-1])] = int(starts[int(s[-1])])
    for c in reversed(present):
        done = int(ends[c])
        while tail[c] < done:
            block, done = array[tail[c] : done][::-1].copy(), tail[c]
            push(block, True)
        push(array[starts[c] : head[c]][::-1].copy(), True)
    return array


def induce_by_lists(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """``induce`` for many symbols, whose buckets are too small for arrays."""
    n = len(s)
    ends = np.cumsum(np.bincount(s))
    head, tail = (ends - np.bincount(s)).tolist(), ends.tolist()
    # For each place the symbol before it where that is an L (S), else -1; place n stands for a cell not yet filled.
    shared = np.arange(-1, len(ends)).astype(object)
    before_l, before_s = (shared[np.concatenate(([0], np.where(small[:-1] == want, s[:-1] + 1, 0), [0]))].tolist() for want in (False, True))
    array = np.full(n, n, np.int64)
    first = s[lms]
    by = np.argsort(first, kind="stable")
    count = np.bincount(first, minlength=len(ends))
    array[ends[first[by]] - np.cumsum(count)[first[by]] + np.arange(len(lms))] = lms[by]
    array = array.tolist()
    for i in array:  # grows ahead of the reader
        c = before_l[i]
        if c >= 0:
            array[head[c]] = i - 1
            head[c] += 1
    for j in range(n - 1, -1, -1):
        i = array[j]
        c = before_s[i]
        if c >= 0:
            tail[c] -= 1
            array[tail[c]] = i - 1
    return np.array(array, np.int64)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the order of the leftmost-S suffixes ``lms`` induces: L from the left, S from the right."""
    return (induce_by_arrays if int(s.max()) < ARRAY_SYMBOLS else induce_by_lists)(s, small, lms)


def names_by_symbols(s: np.ndarray, lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each substring of ``length`` symbols, by one symbol after the other."""
    base = len(s) + 1
    rank = np.unique(s[lms], return_inverse=True)[1]
    level = np.arange(len(lms))  # those whose rank others share
    for k in range(1, int(length.max()) + 1):
        level = level[np.bincount(rank)[rank[level]] > 1]
        if not len(level):
            break
        # A substring that has ended is an S at its last place, where a longer one is an L: it comes after that.
        symbol = np.where(length[level] > k, s[np.minimum(lms[level] + k, len(s) - 1)], base - 1)
        wide = rank.astype(np.int64) * base
        wide[level] += symbol
        rank = np.unique(wide, return_inverse=True)[1]
    return rank


def names_by_induction(s: np.ndarray, small: np.ndarray, lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each substring of ``length`` symbols, by induction from their first symbols alone."""
    array = induce(s, small, lms)
    number = np.full(len(s), -1, np.int64)
    number[lms] = np.arange(len(lms))
    order = number[array]
    order = order[order >= 0]
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix64(s.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(s)), out=sums[1:])
    content = hash_runs(sums, lms, length)
    fresh = np.concatenate(([False], (content[order[1:]] != content[order[:-1]]) | (length[order[1:]] != length[order[:-1]])))
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(fresh)
    return names


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order; its last symbol is the least, and alone."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = types_of(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # Name the substrings from one leftmost-S place to the next in their order.
    length = np.concatenate((np.diff(lms) + 1, [1]))
    if int(s.max()) < ARRAY_SYMBOLS or length.max() > 64:
        names = names_by_induction(s, small, lms, length)
    else:
        names = names_by_symbols(s, lms, length)
    # Where names repeat, the string of names, which ends in a least name of its own, tells the order.
    order = np.argsort(names) if int(names.max()) + 1 == len(names) else suffix_array(names)
    return induce(s, small, lms[order])


def common_prefixes(data: np.ndarray, at: np.ndarray, before: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at each pair of places, ``at`` rising, up to ``most`` bytes.

    A pair that follows on the one before it (both places one on) has a prefix one less; only the others, and after
    ``CHAIN`` such pairs one more, are compared.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    follows = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (before[1:] == before[:-1] + 1)))
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(follows, 0, place))
    start = np.where(follows, start + (place - start) // CHAIN * CHAIN, place)
    first = np.flatnonzero(start == place)
    words = np.concatenate((data, np.zeros(16, np.uint8)))
    words = np.ndarray(len(words) - 7, "<u8", words, strides=(1,))
    known, left = np.zeros(len(first), np.int64), np.arange(len(first))
    limit = np.minimum(most[first], CHAIN + WINDOW)
    while len(left):
        a, b = at[first[left]] + known[left], before[first[left]] + known[left]
        differ = words[a] ^ words[b]
        same = differ == 0
        ended = differ[~same]
        known[left[~same]] += np.bitwise_count((ended & (~ended + np.uint64(1))) - np.uint64(1)) // 8
        left = left[same]
        known[left] += 8
        left = left[known[left] < limit[left]]
    value = np.zeros(n, np.int64)
    value[first] = np.minimum(known, limit)
    return np.maximum(0, np.minimum(value[start] - (place - start), most))


def repeated_windows(parts: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its windows start more than once among all pieces."""
    sizes = np.array([len(p) for p in parts])
    flat = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    s = np.zeros(len(flat) + 1, np.int32)
    s[:-1] = flat.astype(np.int32) + 2
    s[ends] = 1  # between pieces; a window never holds it
    array = suffix_array(s)
    end = np.concatenate((np.repeat(ends, sizes + 1), [0]))  # of the piece at each place
    valid = end - np.arange(len(s)) >= WINDOW
    ranked = array[valid[array]]
    # Predecessors in text order: the windows of one content stand together in the array.
    before = np.full(len(s), -1, np.int64)
    before[ranked[1:]] = ranked[:-1]
    at = np.flatnonzero(before >= 0)
    reach = at[common_prefixes(flat, at, before[at], np.minimum(end[at] - at, end[before[at]] - before[at])) >= WINDOW]
    out = np.zeros(len(s), bool)
    out[reach] = True
    out[before[reach]] = True
    return [out[e - n : e - WINDOW + 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def cut(text: bytes, at: np.ndarray, n: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs and what is left, for runs of ``n`` windows that start at ``at``."""
    size = len(text)
    if not len(at):
        return size, 0, 0, text
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n - 1 + WINDOW, -1)
    gone = np.cumsum(edges[:-1]) > 0
    return size, int(gone.sum()), len(intervals(gone)[0]), np.frombuffer(text, np.uint8)[~gone].tobytes()


def wider_keys(piece: bytes, key: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and longer key of each run of windows of a piece of ``key``.

    Beginning with the first place of the key's substring in a window, each step adds half of the bytes that are left
    of the window, rounded up, on the side where more are left.
    """
    data = np.frombuffer(piece, np.uint8)
    sums = sums_of(data)
    n = len(data) - WINDOW + 1
    places = np.flatnonzero(hash_runs(sums, np.arange(len(data) - KMER + 1), KMER).view(np.int64) == key)
    window = np.arange(n)
    a = places[np.searchsorted(places, window)] - window
    b = a + KMER
    for _ in range(depth):
        left, right = a, WINDOW - b
        more = (left + right + 1) // 2
        a, b = np.where(left >= right, a - more, a), np.where(left >= right, b, b + more)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a + window) != 0) | (np.diff(b + window) != 0))))
    longer = hash_runs(sums, (a + window)[first], (b - a)[first]) ^ np.uint64(key & (1 << 64) - 1)
    return first, np.diff(np.concatenate((first, [n]))), mix64(longer + np.uint64(depth)).view(np.int64)


def raw(text) -> bytes:
    return text.as_buffer().to_pybytes()


def segments(texts: pa.Array):
    """The texts with place 0; one long text of its own as consecutive parts, which overlap so that each window is in one."""
    if len(texts) != 1 or (size := texts[0].as_buffer().size) <= SEGMENT + WINDOW - 1:
        yield texts, 0
        return
    for at in range(0, size - WINDOW + 1, SEGMENT):
        part = texts[0].as_buffer().slice(at, min(SEGMENT + WINDOW - 1, size - at))
        yield pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, part.size], pa.int32()).buffers()[1], part]), at


def progressions(places: np.ndarray) -> list[tuple[int, int, int]]:
    """Rising places as (first, step, number)."""
    if len(places) == 1:
        return [(int(places[0]), 0, 1)]
    step = np.diff(places)
    change = np.append(np.flatnonzero(step[1:] != step[:-1]) + 1, len(step))
    out, i, k = [], 0, 0
    while i < len(places):
        if i == len(step):
            out.append((int(places[i]), 0, 1))
            break
        while change[k] <= i:
            k += 1
        end = int(change[k])
        out.append((int(places[i]), int(step[i]), end - i + 1))
        i = end + 1
    return out


def piece_table(rows: DataFrame) -> DataFrame:
    """``k, c, n, tied, KEY, at``: key, content, number of windows and place of every piece of every text."""

    def run(batches):
        for batch in pieces(batches):
            for texts, base in segments(batch.column("text")):
                w = Windows(texts)
                yield pa.RecordBatch.from_pydict({"k": w.keys.view(np.int64), "c": w.contents().view(np.int64), "n": w.n.astype(np.int32), "tied": w.tied.astype(np.int32), **keys_of(batch, w.doc), "at": (w.at + base).astype(np.int32)})

    return rows.select(*KEY, "text").mapInArrow(run, f"k long, c long, n int, tied int, {KEY_TYPE}, at int")


def whole_copies(rows: DataFrame) -> DataFrame:
    """``KEY, stands`` of the texts of 200 bytes or more that more than one row has; the least id stands for the others."""
    known = rows.select(*KEY).where(F.col("size") >= WINDOW)
    groups = known.groupBy("name", "size").agg(F.count("*").alias("rows"), F.min("id").alias("least")).where("rows > 1")
    groups = stored(groups.select(F.col("name").alias("n"), F.col("size").alias("s"), "least"), "copied")
    joined = known.join(groups, (F.col("name") == F.col("n")) & (F.col("size") == F.col("s")))
    return stored(joined.select(*KEY, (F.col("id") == F.col("least")).alias("stands")).distinct(), "copies")


def piece_bytes(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``k, u, c, n, times, piece``: the bytes of chosen pieces (``k, c, n, times, first``), one occurrence of each."""

    def extract(batches):
        for batch in pieces(batches):
            out: dict[str, list] = {c: [] for c in ("k", "u", "c", "n", "times", "piece")}
            for text, chosen in zip(batch.column("text"), batch.column("chosen")):
                data = raw(text)
                for p in chosen.as_py():
                    row = (p["k"], p["k"], p["c"], p["n"], p["times"], data[p["at"] : p["at"] + p["n"] + WINDOW - 1])
                    for to, value in zip(out.values(), row):
                        to.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    at = chosen.select("first.*", "k", "c", "n", "times")
    listed = at.groupBy(*KEY).agg(F.collect_set(F.struct("at", "k", "c", "n", "times")).alias("chosen"))
    return rows.select(*KEY, "text").join(listed, [*KEY]).select("text", "chosen").mapInArrow(extract, "k long, u long, c long, n int, times long, piece binary")


def widened(units: DataFrame, depth: int) -> DataFrame:
    """The units cut by longer keys: ``k, u, c, n, piece`` of each run, with unit, content and places of where it is from.

    Equal runs of a piece are one row and its bytes are cut out once; their places are progressions (first, step, number),
    so that periodic pieces of any length take few rows.
    """

    def run(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        names = ("k", "u", "c", "n", "piece", "of_u", "of_c", "at", "step", "number")
        for batch in batches:
            for i in range(batch.num_rows):
                k, u, c = (batch.column(x)[i].as_py() for x in ("k", "u", "c"))
                piece = raw(batch.column("piece")[i])
                first, n, longer = wider_keys(piece, k, depth)
                content = hash_runs(sums_of(np.frombuffer(piece, np.uint8)), first, n + WINDOW - 1).view(np.int64)
                order = np.lexsort((first, n, content))
                first, n, longer, content = first[order], n[order], longer[order], content[order]
                edges = [0, *(np.flatnonzero((content[1:] != content[:-1]) | (n[1:] != n[:-1])) + 1).tolist(), len(n)]
                rows = []
                for a, b in zip(edges, edges[1:]):
                    cut_out = piece[first[a] : first[a] + n[a] + WINDOW - 1]
                    for at, step, number in progressions(first[a:b]):
                        rows.append((k, longer[a], content[a], n[a], cut_out, u, c, at, step, number))
                        cut_out = None
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=list(names))

    out = "k long, u long, c long, n int, piece binary, of_u long, of_c long, at int, step int, number int"
    return units.select("k", "u", "c", "piece").mapInArrow(run, out)


def sorted_spans(units: DataFrame, size: int) -> DataFrame:
    """``u, c, at, n``: runs of windows of each unit's pieces that stand more than once in its shard."""

    def sort_shard(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("u", "ascending"), ("c", "ascending")])
        found = [intervals(f) for f in repeated_windows([raw(p) for p in shard.column("piece")])]
        row = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
        at, n = (np.concatenate([f[i] for f in found]).astype(np.int32) for i in (0, 1))
        return pa.table({"u": shard.column("u").to_numpy()[row], "c": shard.column("c").to_numpy()[row], "at": at, "n": n})

    shards = int(size // SHARD_BYTES + 1)
    dealt = units.select("u", "c", "piece").withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(sort_shard, "u long, c long, at int, n int")


def unit_spans(units: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """``u, c, at, n``: repeated runs of windows of all units (``k, u, c, n, times, piece``), hot ones by longer keys."""
    bytes_of = units.groupBy("u").agg(F.sum(F.octet_length("piece")).alias("bytes"))
    sizes = bytes_of.agg(F.sum(F.when(F.col("bytes") <= HOT_BYTES, F.col("bytes"))).alias("cold"), F.max("bytes").alias("most")).first()
    again = units.where("times > 1").select("u", "c", F.lit(0).alias("at"), "n")
    if not depths or (sizes.most or 0) <= HOT_BYTES:
        total = bytes_of.agg(F.sum("bytes")).first()[0] or 0
        return again.unionByName(sorted_spans(units, total))
    hot = stored(bytes_of.where(F.col("bytes") > HOT_BYTES).select(F.col("u").alias("hot")), "hot")
    found = sorted_spans(units.join(hot, F.col("u") == F.col("hot"), "left_anti"), sizes.cold or 0)
    cut_up = stored(widened(units.join(hot, F.col("u") == F.col("hot"), "left_semi"), depths[0]), "widened")
    finer = cut_up.groupBy("u", "c", "n").agg(F.first("k").alias("k"), F.sum("number").alias("times"), F.first("piece", ignorenulls=True).alias("piece"))
    spans = stored(unit_spans(stored(finer, "finer"), depths[1:]).withColumnsRenamed({"u": "v", "c": "d", "at": "start", "n": "m"}), "spans")
    told = cut_up.join(spans, (F.col("u") == F.col("v")) & (F.col("c") == F.col("d")))
    # Where the runs of a progression touch, they cover what one run over all of them covers.
    place = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"))
    at, over = F.col("at") + F.col("start"), (F.col("number") - 1) * F.col("step")
    each = F.transform(F.sequence(F.lit(0), F.col("number") - 1), lambda i: place(at + i * F.col("step"), F.col("m")))
    covered = F.when(F.col("step") <= F.col("m") + (WINDOW - 1), F.array(place(at, over + F.col("m")))).otherwise(each)
    told = told.select(F.col("of_u").alias("u"), F.col("of_c").alias("c"), F.inline(covered))
    return again.unionByName(found).unionByName(told)


def removed_windows(rows: DataFrame) -> DataFrame:
    """``KEY, gone``: for every text that loses bytes, its runs of repeated windows."""
    runs = stored(piece_table(rows), "runs")
    copies = whole_copies(rows)
    repeated = runs.groupBy("k").agg(F.sum(F.col("tied") + 1).alias("times")).where("times > 1")
    repeated = stored(repeated.select(F.col("k").alias("key")), "keys")
    others = copies.where("not stands").select(*KEY)
    occur = stored(runs.join(repeated, F.col("k") == F.col("key")).drop("key").join(others, [*KEY], "left_anti"), "pieces")
    one = occur.groupBy("k", "c", "n").agg(F.count("*").alias("times"), F.max("tied").alias("tied"), F.min(F.struct(*KEY, "at")).alias("first"))
    one = stored(one, "kinds")
    each = one.groupBy("k").agg(F.count("*").alias("kinds"), F.max("times").alias("most"), F.max("tied").alias("ties"))
    # A key of one kind of piece needs no comparison where that occurs again (its windows repeat) or holds its key once.
    each = stored(each.where("kinds > 1 or (most = 1 and ties > 0)").select(F.col("k").alias("key")), "compared")
    chosen = one.join(each, F.col("k") == F.col("key"), "left_semi")
    units = stored(piece_bytes(rows, chosen), "units")
    again = one.where("times > 1").select(F.col("k").alias("u"), "c", F.lit(0).alias("at"), "n")
    spans = stored(unit_spans(units, DEPTHS).unionByName(again).distinct().withColumnsRenamed({"c": "d", "at": "start", "n": "m"}), "spans")
    told = occur.join(spans, (F.col("k") == F.col("u")) & (F.col("c") == F.col("d")))
    told = told.select(*KEY, (F.col("at") + F.col("start")).alias("at"), F.col("m").alias("n"))
    told = told.unionByName(copies.select(*KEY, F.lit(0).alias("at"), (F.col("size") - (WINDOW - 1)).alias("n")))
    return stored(told.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("gone")), "removed")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left) of every row."""
    rows = numbered(docs)

    def finish(batches):
        for batch in pieces(batches):
            results = []
            for text, found in zip(batch.column("text"), batch.column("gone")):
                at, n = (x.to_numpy().astype(np.int64) for x in found.values.flatten()) if found.is_valid else (np.zeros(0, np.int64),) * 2
                results.append(cut(raw(text), at, n))
            sizes, removed, spans, kept = zip(*results)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    joined = rows.join(removed_windows(rows), [*KEY], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
