"""SimHash near-duplicates with vantage-point trees.

A fingerprint has a bit for each bit place that is set in over half of the hashes of a text's word shingles.  Equal
fingerprints are one node first, so copies cost nothing later.  Pairs of nodes within ``radius`` bits are found by
trees of vantage points:

* the bits are cut into ``blocks``, and ``together`` blocks make a group of bits: two fingerprints within ``radius``
  bits differ little in at least one group (by nothing in 3 of 5 blocks for a radius of 2), so each group has a tree of
  its own over the Hamming distance within the group.  Groups of 38 bits keep shards small at billions of rows;
* a tree deals fingerprints by their distances to ``pivots`` vantage points.  By the triangle inequality the distances
  of a pair to one vantage point differ by at most the group's radius.  Where it is 0, a pair always meets in one shard;
  else a fingerprint also goes to the shards whose distances lie within that radius (overlapping boundaries);
* a shard compares its members exactly by a local vantage-point tree and yields only the links of a spanning forest
  of its members, never all pairs (all shards of up to 16 members are compared at once instead).  Shards over
  ``shard_rows`` members are cut into parts by a hash and every pair of parts is a shard of its own, so no task
  holds an unbounded shard and none is skipped.

Components come from alternating large-star and small-star steps over the links, stored after each step.

Defined results: a null text is the empty text; a text without words has fingerprint zero and links like any other;
repeated rows are copies; rows of one id are documents of their own; a row without an id links like any other and takes
the least id of its component, which is null where all its rows have none; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import pieces, stored, text_of, width
from ledgerloom.llm.substring import KEY, KEY_TYPE, LEAST_ID, numbered

_PLACES = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``shingle`` words of a text, ASCII lower case, joined by one blank."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return out


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    return int(np.bitwise_or.reduce((bit_counts(hashes) * 2 > len(hashes)).astype(np.uint64) << _PLACES))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as an array of one signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column("text")], np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp array<long>")


def group_masks(bits: int, blocks: int, together: int) -> list[list[int]]:
    """For each group of ``together`` blocks, a mask for each 64-bit word; blocks are consecutive bits, as equal as can be."""
    edges = [bits * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [[(sum(group) >> (64 * i)) & 0xFFFFFFFFFFFFFFFF for i in range(bits // 64)] for group in combinations(block, together)]


def group_radius(radius: int, blocks: int, together: int) -> int:
    """Bits by which a pair within ``radius`` bits differs at most in the group that differs least."""
    return 0 if radius <= blocks - together else radius * together // blocks


def vantage_keys(points: np.ndarray, blocks: int, together: int, pivots: int, reach: int) -> np.ndarray:
    """Shard keys of fingerprints (n x words, unsigned): group and distances to its vantage points, as one integer.

    The vantage points are fixed pseudo-random fingerprints.  With a group radius of ``reach`` over 0, every key whose
    distances differ by at most that is given too; a row of the result has all keys of a fingerprint.
    """
    words = points.shape[1]
    draw = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, (pivots, words), np.uint64)
    masks = group_masks(64 * words, blocks, together)
    base = max(sum(m.bit_count() for m in mask) for mask in masks) + 2 * reach + 1
    if len(masks) * base**pivots >= 1 << 63:
        raise ValueError("too many vantage points for a 64-bit key")
    around = np.arange(-reach, reach + 1)
    out = []
    for b, mask in enumerate(masks):
        used = [i for i, m in enumerate(mask) if m]
        bits = np.array([mask[i] for i in used], np.uint64)
        keys = np.full((len(points), 1), b, np.int64)
        for p in draw[:, used]:
            far = np.bitwise_count((points[:, used] ^ p) & bits).sum(axis=1, dtype=np.int64) + reach
            near = far[:, None] + around
            keys = (keys[:, :, None] * base + near[:, None, :]).reshape(len(points), -1)
        out.append(keys)
    return np.concatenate(out, axis=1)


def matrix(lists: pa.Array) -> np.ndarray:
    """Equal-length lists of signed integers as rows of unsigned ones."""
    return lists.flatten().to_numpy().view(np.uint64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.uint64)


def tree_links(points: np.ndarray, radius: int, leaf: int = 64) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of points (n x words, unsigned) within ``radius`` bits.

    A vantage-point tree by medians: a subtree is searched only where the triangle bound leaves it in reach; points
    that are known to be connected already are not linked again.
    """
    n = len(points)
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []

    def join(i, near):
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))

    def distance(i, members):
        return np.bitwise_count(points[members] ^ points[i]).sum(axis=1)

    # Each entry: points to compare among themselves, or with others (whose pairs among themselves are elsewhere).
    work = [(np.arange(n), np.zeros(0, np.int64))]
    while work:
        own, other = work.pop()
        if len(own) <= leaf or len(own) + len(other) <= 4 * leaf:
            for k, i in enumerate(own.tolist()):
                rest = np.concatenate((own[k + 1 :], other))
                join(i, rest[distance(i, rest) <= radius])
            continue
        pivot, own = int(own[0]), own[1:]
        d_own, d_other = distance(pivot, own), distance(pivot, other)
        join(pivot, own[d_own <= radius])
        join(pivot, other[d_other <= radius])
        middle = int(np.median(d_own))
        near, far = d_own <= middle, d_own > middle
        if far.any() and near.any():
            # A far point within the radius of the boundary is compared with the near side too.
            edge = own[far & (d_own <= middle + radius)]
            work.append((own[near], np.concatenate((edge, other[d_other <= middle + radius]))))
            work.append((own[far], other[d_other > middle - radius]))
        else:
            for k, i in enumerate(own.tolist()):
                rest = np.concatenate((own[k + 1 :], other))
                join(i, rest[distance(i, rest) <= radius])
    return links


def shard_links(keys: np.ndarray, names: np.ndarray, points: np.ndarray, radius: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within shards; rows of a shard stand together.  keys: the number of each row's shard, rising.

    Rows of shards of up to ``small`` members are compared over all shards at once; larger ones have a tree each.
    """
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((first, [len(keys)])))
    of = np.repeat(size, size)
    left, right = [], []
    for lag in range(1, min(small, int(size.max(initial=1)))):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & (of[lag:] <= small))
        i = i[np.bitwise_count(points[i] ^ points[i + lag]).sum(axis=1, dtype=np.int64) <= radius]
        left.append(i)
        right.append(i + lag)
    for a, n in zip(first[size > small].tolist(), size[size > small].tolist()):
        found = np.array(tree_links(points[a : a + n], radius), np.int64).reshape(-1, 2) + a
        left.append(found[:, 0])
        right.append(found[:, 1])
    if not left:
        return names[:0], names[:0]
    return names[np.concatenate(left)], names[np.concatenate(right)]


def near_links(nodes: DataFrame, radius: int, blocks: int, together: int, pivots: int, shard_rows: int = 128) -> DataFrame:
    """Links ``a, b`` between nodes (``node long, fp array<long>``, distinct fingerprints) within ``radius`` bits."""
    reach = group_radius(radius, blocks, together)

    def deal(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                keys = vantage_keys(matrix(part.column("fp")), blocks, together, pivots, reach)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel(), "node": np.repeat(part.column("node").to_numpy(), keys.shape[1])})

    dealt = nodes.select("node", "fp").mapInArrow(deal, "key long, node long")
    counts = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "shard")
    # Most shards have one member and end here; the rest know how many parts they need.
    held = dealt.join(counts, F.col("key") == F.col("shard")).withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    held = held.join(nodes.select(F.col("node").alias("own"), "fp"), F.col("node") == F.col("own"))
    held = held.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    # A member goes to every pair of parts that holds its own: (p, q) with p <= q.
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("p"), F.greatest(q, F.col("part")).alias("q")))
    held = held.select("key", "node", "fp", F.explode(pairs).alias("pair")).select("key", "pair.p", "pair.q", "node", "fp")
    held = held.repartition(width(nodes), "key", "p", "q").sortWithinPartitions("key", "p", "q", "node")

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table]).combine_chunks()
            if not table.num_rows:
                continue
            shard = np.stack([table.column(c).to_numpy() for c in ("key", "p", "q")])
            number = np.concatenate(([0], np.cumsum((shard[:, 1:] != shard[:, :-1]).any(axis=0))))
            whole = int(np.searchsorted(number, number[-1]))  # the last shard may go on in the next batch
            kept = table.slice(whole)
            if whole:
                yield links_of(table.slice(0, whole), number[:whole])
        if kept is not None and kept.num_rows:
            yield links_of(kept, np.zeros(kept.num_rows, np.int64))

    def links_of(table, number):
        a, b = shard_links(number, table.column("node").to_numpy(), matrix(table.column("fp").combine_chunks()), radius)
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    return held.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the least node that each linked node reaches, by large-star and small-star steps.

    Both steps of a round take one job and two exchanges, since repeated links go where the links of a node meet anyway.
    Links that moved are marked, so the last round is known without comparing it with the one before.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    around = Window.partitionBy("u")
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        # large star: larger neighbours of u move to the least of u and its neighbours
        large = edges.join(low, edges.v == low.w).select("u", F.col("m").alias("v"), (F.col("m") != F.col("v")).alias("moved"))
        # small star: u and its smaller neighbours move to the least of those; the row of that one becomes u's own link
        large = large.repartition("u").groupBy("u", "v").agg(F.max("moved").alias("moved"))
        least = large.withColumns({"m": F.min("v").over(around), "moved": F.max("moved").over(around)})
        own = F.col("v") == F.col("m")
        edges = stored(least.select(F.when(own, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | ~own).alias("moved")), "links")
        if edges.where("moved").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 5, together: int = 3, pivots: int = 10) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    A fingerprint of 64 bits is its own name among the nodes, so rows of one id, or without one, stay apart; the least id
    is a value that each fingerprint brings to its component.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")[0]), "nodes")
    found = components(near_links(nodes, radius, blocks, together, pivots)).withColumnRenamed("node", "own")
    named = nodes.join(found, F.col("node") == F.col("own"), "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    named = stored(named, "classes")
    ids = named.groupBy(F.col("class").alias("c")).agg(F.min("least").alias("component_id"))
    classes = stored(named.join(ids, F.col("class") == F.col("c")).select(F.col("node").alias("own"), "component_id"), "classes")
    return fps.join(classes, F.col("fp")[0] == F.col("own")).select("doc_id", "fp", "component_id")


def simhash_table(docs: DataFrame) -> DataFrame:
    """Three-word shingles, 64 bits, linked at two or fewer differing bits."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: Two documents are similar from this Jaccard similarity of their shingle sets on, as a fraction.
SIMILAR = (4, 5)
SHINGLE = 5
#: 64-bit words of a parity map.
MAP_WORDS = 8


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, rising."""
    return np.unique(shingle_hashes(text, SHINGLE))


def set_name(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42) - (1 << 63)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set by (count among ``common``, hash), so many that any two similar sets share one.

    Similar sets have ceil(0.8 n) members in common at least, n the size of either, so n - ceil(0.8 n) + 1 are enough
    under any order that is the same for all sets.  ``common`` (rising) only moves frequent shingles to the end.
    """
    n, (up, down) = len(hashes), SIMILAR
    if not n:
        return hashes
    least = n + (-n * up // down) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))]
    return hashes[:least]


def parity_map(hashes: np.ndarray, words: int = MAP_WORDS) -> np.ndarray:
    """Whether an odd number of hashes falls on each bit: two maps differ in no more bits than their sets in members."""
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def full_map(hashes: np.ndarray) -> bytes:
    """A parity map of a bit or more for each member; its length is a power of two."""
    return parity_map(hashes, max(MAP_WORDS, 1 << (max(1, len(hashes)) - 1 >> 6).bit_length())).tobytes()


def map_distance(a: bytes, b: bytes) -> int:
    """Differing bits of two full maps, the longer one folded to the length of the other."""
    x, y = (np.frombuffer(m, np.uint64) for m in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(m.reshape(-1, size), axis=0) for m in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(rows: DataFrame, sample: int = 65_536, least: int = 4, most: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, rising, and their counts.  Results do not depend on them, time does.

    Passages that a ten-thousandth of the texts share are found by a sample of this size, whatever the number of rows.
    """

    def run(batches):
        for batch in pieces(batches):
            sets = [shingle_set(t.as_buffer().to_pybytes()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"h": np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)})

    every = max(1, rows.count() // sample)
    # Copies of a text count once, so that large groups of copies do not push passages out.
    some = rows.where(F.pmod(F.xxhash64("name", F.lit(5)), F.lit(every)) == 0).select("name", "size", "text").dropDuplicates(["name", "size"]).select("text")
    # Stored, since the shuffle files of all the sample's shingles would stay beside those of later steps.
    counted = stored(some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least), "common")
    top = counted.orderBy(F.desc("n")).limit(most).collect()
    found = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r.n for r in top], np.int64)[order]


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``KEY, node, fp, n, map, full, keys``: name, fingerprint, size, parity maps and prefix of every row's shingle set."""
    common, counts = common_shingles(rows)

    def run(batches):
        for batch in pieces(batches):
            sets = [shingle_set(t.as_buffer().to_pybytes()) for t in batch.column("text")]
            keys = [prefix(s, common, counts).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: batch.column(c) for c in KEY},
                    "node": pa.array([set_name(s) for s in sets], pa.int64()),
                    "fp": pa.array(np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "map": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * MAP_WORDS), pa.array(np.concatenate([parity_map(s) for s in sets] or [np.zeros(0, np.int64)]))),
                    "full": pa.array([full_map(s) for s in sets], pa.binary()),
                    "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys or [np.zeros(0, np.int64)]))),
                }
            )

    return rows.select(*KEY, "text").mapInArrow(run, f"{KEY_TYPE}, node long, fp long, n long, map array<long>, full binary, keys array<long>")


def may_be_similar(n_a, n_b, differ):
    """Whether sizes and differing bits of the parity maps allow similarity; never false for a similar pair."""
    up, down = SIMILAR
    return (n_a * down >= n_b * up) & (n_b * down >= n_a * up) & (differ * (down + up) <= (n_a + n_b) * (down - up))


def member_sets(used: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``own, members``: the shingle sets of the nodes in ``used``, made anew from one row that has each."""

    def run(batches):
        for batch in pieces(batches):
            sets = [shingle_set(t.as_buffer().to_pybytes()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"own": batch.column("node"), "members": pa.array(sets, pa.list_(pa.int64()))})

    # Rows that repeat it in every column of the key are dropped.
    used = used.join(nodes.select("node", "row.*"), "node")
    texts = rows.select(*KEY, "text").join(used, [*KEY]).dropDuplicates(["node"]).select("node", "text")
    return stored(texts.mapInArrow(run, "own long, members array<long>"), "sets")


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose shingle sets are similar, by the sets themselves."""

    def near(batches):
        for batch in batches:
            n_a, n_b, full_a, full_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "full_a", "full_b"))
            ok = [may_be_similar(x, y, map_distance(v, w)) for x, y, v, w in zip(n_a, n_b, full_a, full_b)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("full").alias(f"full_{c}"))
    pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(near, "a long, b long"), "pairs")
    sets = member_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, rows)
    side = lambda c: sets.select(F.col("own").alias(c), F.col("members").alias(f"{c}_members"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared, sizes = F.size(F.array_intersect("a_members", "b_members")), F.size("a_members") + F.size("b_members")
    return both.where(shared * (SIMILAR[0] + SIMILAR[1]) >= sizes * SIMILAR[0]).select("a", "b").distinct()


class Forest:
    """Names in trees: ``join`` tells whether two names were in different ones and makes them one."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, i: int) -> int:
        root = self.root
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)
        return i != j


def rest_pairs(number: np.ndarray, part: np.ndarray, n: np.ndarray, classes: np.ndarray, maps: np.ndarray, small: int = 16):
    """Places of the pairs of a shard that are of different classes and may be similar, a few at a time.

    Rows of a shard (``number``, rising) stand together by ``part``; if it has two parts, pairs within one are left to
    the shard of that part alone.
    """
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    size = np.diff(np.concatenate((first, [len(number)])))
    of = np.repeat(size, size)
    two = np.repeat(part[first] != part[first + size - 1], size)

    def test(i, j):
        ok = (classes[i] != classes[j]) & (~two[i] | (part[i] != part[j]))
        i, j = i[ok], j[ok]
        ok = may_be_similar(n[i], n[j], np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64))
        return zip(i[ok].tolist(), j[ok].tolist())

    for lag in range(1, min(small, int(size.max(initial=1)))):
        i = np.flatnonzero((number[lag:] == number[:-lag]) & (of[lag:] <= small))
        yield from test(i, i + lag)
    for a, m in zip(first[size > small].tolist(), size[size > small].tolist()):
        for k in range(a, a + m - 1):
            j = np.arange(k + 1, a + m)
            yield from test(np.full(len(j), k), j)


def in_parts(held: DataFrame, nodes_width: int) -> DataFrame:
    """Members (``key, parts, node`` and more) at every pair of parts (``p, q`` with p <= q) of their shard that holds their own ``part``."""
    held = held.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("p"), F.greatest(q, F.col("part")).alias("q")))
    rest = [c for c in held.columns if c not in ("key", "parts")]
    held = held.select("key", F.explode(both).alias("pair"), *rest).select("key", "pair.p", "pair.q", *rest)
    return held.repartition(nodes_width, "key", "p", "q").sortWithinPartitions("key", "p", "q", "part", "node")


def whole_shards(batches):
    """Tables of whole shards (``key, p, q``) and the number of each row's shard in its table; at most one shard more than a batch is held."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        if not table.num_rows:
            continue
        shard = np.stack([table.column(c).to_numpy() for c in ("key", "p", "q")])
        number = np.concatenate(([0], np.cumsum((shard[:, 1:] != shard[:, :-1]).any(axis=0))))
        whole = int(np.searchsorted(number, number[-1]))  # the last shard may go on in the next batch
        kept = table.slice(whole)
        if whole:
            yield table.slice(0, whole), number[:whole]
    if kept is not None and kept.num_rows:
        yield kept, np.zeros(kept.num_rows, np.int64)


def fingerprint_pairs(nodes: DataFrame, radius: int = 2, blocks: int = 5, together: int = 3, pivots: int = 10) -> DataFrame:
    """Pairs ``a, b`` of nodes that SimHash links: the first of each fingerprint with its others, and first ones within ``radius`` bits."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    near = near_links(firsts.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), radius, blocks, together, pivots)
    near = near.distinct().withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    for c in ("a", "b"):
        near = near.join(firsts.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c)), f"fp_{c}")
    equal = nodes.select("node", "fp").join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return near.select("a", "b").unionByName(equal)


def classed_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, class`` of all nodes by the links so far."""
    classes = components(links).withColumnRenamed("node", "own")
    named = nodes.join(classes, F.col("node") == F.col("own"), "left")
    return stored(named.select("node", F.coalesce("component", "node").alias("class")), "classes")


def class_stars(classed: DataFrame) -> DataFrame:
    """Links ``a, b`` of every node with its class, which stand for all links that made it."""
    return classed.where("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b"))


def open_shards(held: DataFrame, classed: DataFrame, turn: int) -> DataFrame:
    """``shard, hub, hub_class``: shards whose members are of more than one class, and one member drawn by the turn."""
    each = held.join(classed.select("node", "class"), "node")
    found = each.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "class")).alias("hub"))
    return found.where("low <> high").select(F.col("key").alias("shard"), F.col("hub.node").alias("hub"), F.col("hub.class").alias("hub_class"))


def hub_pairs(held: DataFrame, classed: DataFrame, turn: int) -> DataFrame:
    """For each node the hub of another class that it shares most shards with: a pair a node at most."""
    each = held.join(classed.select("node", "class"), "node").join(open_shards(held, classed, turn), F.col("key") == F.col("shard")).where("class <> hub_class")
    shared = each.groupBy("node", "hub").agg(F.count("*").alias("times"))
    return shared.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best")).select(F.col("best.hub").alias("a"), F.col("node").alias("b"))


def class_links(held: DataFrame, classed: DataFrame, nodes: DataFrame, shard_rows: int) -> DataFrame:
    """Links ``a, b`` between classes that have the components of all pairs of a shard that may be similar by their maps.

    A task links its classes as a forest, over all of its shards, so it makes fewer links than it has members.
    """
    rest = held.join(open_shards(held, classed, 0), F.col("key") == F.col("shard")).select("key", "node", F.ceil(F.col("members") / shard_rows).cast("int").alias("parts"))
    rest = rest.join(classed, "node").join(nodes.select("node", "n", "map", "full"), "node")

    def run(batches):
        forest = Forest()
        for table, number in whole_shards(batches):
            part, n, names = (table.column(c).to_numpy() for c in ("part", "n", "class"))
            roots = np.array([forest.find(c) for c in names.tolist()], np.int64)
            full, a, b = table.column("full"), [], []
            for x, y in rest_pairs(number, part, n, roots, matrix(table.column("map").combine_chunks())):
                # Short maps let all pairs of long texts pass, full ones hardly any that is not similar.
                u, v = int(names[x]), int(names[y])
                if forest.find(u) != forest.find(v) and may_be_similar(n[x], n[y], map_distance(full[x].as_py(), full[y].as_py())):
                    forest.join(u, v)
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_parts(rest, width(nodes)).mapInArrow(run, "a long, b long")


def set_links(members: DataFrame, partitions: int, shard_rows: int, shard_hashes: int = 1 << 20) -> DataFrame:
    """Links ``a, b`` between similar members of one group (``key, node, class, n, members``), by their sets, in a forest."""
    sizes = members.groupBy(F.col("key").alias("own_key")).agg(F.greatest(F.ceil(F.count("*") / shard_rows), F.ceil(F.sum("n") / shard_hashes), F.lit(1)).cast("int").alias("parts"))
    rest = members.join(sizes, F.col("key") == F.col("own_key")).drop("own_key")

    def run(batches):
        for table, number in whole_shards(batches):
            part, n, names, classes = (table.column(c).to_numpy() for c in ("part", "n", "node", "class"))
            lists = table.column("members").combine_chunks()
            sets = np.split(lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            maps, full = np.stack([parity_map(s) for s in sets]).view(np.uint64), [full_map(s) for s in sets]
            forest, a, b = Forest(), [], []
            for x, y in rest_pairs(number, part, n, classes, maps):
                u, v = int(classes[x]), int(classes[y])
                if forest.find(u) == forest.find(v) or not may_be_similar(n[x], n[y], map_distance(full[x], full[y])):
                    continue
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if shared * sum(SIMILAR) >= (n[x] + n[y]) * SIMILAR[0]:
                    forest.join(u, v)
                    a.append(names[x])
                    b.append(names[y])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_parts(rest, partitions).mapInArrow(run, "a long, b long")


def similar_links(rows: DataFrame, sets: DataFrame, shard_rows: int = 128, turns: int = 2) -> DataFrame:
    """Links ``a, b`` between names of shingle sets that have the components of all pairs of similar sets.

    SimHash comes first: sets whose fingerprints are near are compared and linked where they are similar.  Similar sets
    whose fingerprints are not near enough are found by shards, one for each shingle of a prefix, in which every similar
    pair meets: each member is compared with a hub of its shards in turns.  Classes that are not connected by all that,
    but have a pair in a shard that may be similar by its maps, make groups; within a group the sets themselves decide.
    Tasks compare pairs and yield forests only, so rows grow with the members, not with their pairs.
    """
    kept = [F.first(c).alias(c) for c in ("fp", "n", "map", "full", "keys")]
    nodes = stored(sets.groupBy("node").agg(F.min(F.struct(*KEY)).alias("row"), *kept), "nodes")
    classed = classed_nodes(nodes, confirmed(fingerprint_pairs(nodes), nodes, rows))

    dealt = nodes.select(F.explode("keys").alias("key"), "node")
    counts = dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").withColumnRenamed("key", "shard")
    held = stored(dealt.join(counts, F.col("key") == F.col("shard")).select("key", "node", "members"), "held")
    for turn in range(turns):
        near = stored(hub_pairs(held, classed, turn), "pairs")
        classed = classed_nodes(nodes, class_stars(classed).unionByName(confirmed(near, nodes, rows)))

    groups = components(class_links(held, classed, nodes, shard_rows)).select(F.col("node").alias("linked"), F.col("component").alias("key"))
    groups = groups.unionByName(groups.select(F.col("key").alias("linked"), "key")).distinct()
    members = stored(classed.join(groups, F.col("class") == F.col("linked")).select("key", "node", "class"), "members")
    sizes = nodes.select(F.col("node").alias("sized"), "n")
    members = members.join(sizes, F.col("node") == F.col("sized")).join(member_sets(members.select("node"), nodes, rows), F.col("node") == F.col("own"))
    return class_stars(classed).unionByName(set_links(members.select("key", "node", "class", "n", "members"), width(nodes), shard_rows))


def similar_documents(docs: DataFrame) -> DataFrame:
    """``KEY, class`` of every row, linked at a Jaccard similarity of 0.8 or more.

    Similarity is that of the sets of five-word shingles and decided by the sets.  Candidates come from SimHash and then
    from a prefix of each set that two similar sets always share, so no pair is missed, however many documents there are.
    """
    rows = numbered(docs)
    sets = stored(shingle_sets(rows), "fingerprints")
    found = stored(components(similar_links(rows, sets)), "classes").withColumnRenamed("node", "own")
    return sets.select(*KEY, "node").join(found, F.col("node") == F.col("own"), "left").select(*KEY, F.coalesce("component", "node").alias("class"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of least id of each class of similar documents; among rows of one id that with the least hash of its text.

    Rows of one id with different texts are different documents, and a missing id comes after all others.
    """
    rank = F.struct((F.col("id") == LEAST_ID).alias("late"), *KEY)
    kept = similar_documents(docs).groupBy("class").agg(F.min(rank).alias("one")).select("one.id", "one.name", "one.size")
    keys = numbered(docs, [docs[f"`{c}`"] for c in docs.columns]).drop("doc_id", "text")
    return keys.join(kept, [*KEY], "left_semi").dropDuplicates([*KEY]).select("rest.*")
