"""Packing documents into sequences of bounded length by a grouping genetic algorithm on islands.

Each text is encoded once and becomes pieces of at most ``capacity`` tokens, the first of which may be shorter.  Pieces of
full length are sequences of their own.  The others are dealt to shards of about ``shard_rows`` pieces by a hash of their
row number, so no source, id or group of copies can fill one.  Every shard has ``islands``: populations of packings
that start from best fit in falling and in disturbed orders.  A generation makes children by

* injecting whole sequences of one parent, best filled first, into the other,
* dropping the other's sequences that hold a piece twice then, and
* putting the displaced pieces back by best fit, longest first.

After each epoch an island's elite moves to the next island of its shard by a join.  The best packing of a shard is kept;
its sequences that leave no more than ``waste`` tokens stand, and the others migrate whole to fewer shards, where they are
the first packing of a new search, as long as that lessens them.  So what is left over of all shards meets in the end in
shards that find better matches for it, and no step needs more sequences than the one before.

Defined results: a null text is the empty text, which is its end id only; repeated rows, rows of one id and rows without
one are documents of their own; an empty table gives an empty table; other columns of the input are left out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, text_of
from ledgerloom.llm.token_files import encoder

PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Search:
    """How long islands search: populations, children a generation, generations an epoch, epochs."""

    islands: int = 2
    population: int = 4
    children: int = 4
    generations: int = 6
    epochs: int = 2
    seed: int = 13


class BestFit:
    """Sequences by the room they have left, so that the fullest one that takes a piece is found at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # a bit for each amount of room that some sequence has

    def open(self, number: int, room: int) -> None:
        if room:
            self.with_room[room].append(number)
            self.rooms |= 1 << room

    def put(self, length: int) -> int:
        """The number of the sequence that takes a piece, or -1 where none can."""
        fits = self.rooms >> length
        if not fits:
            return -1
        room = length + (fits & -fits).bit_length() - 1
        numbers = self.with_room[room]
        number = numbers.pop()
        if not numbers:
            self.rooms ^= 1 << room
        self.open(number, room - length)
        return number


class Packer:
    """Packings of one shard: an array with each piece's sequence number, numbered from 0 without gaps."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.least = self.lower_bound()

    def lower_bound(self) -> int:
        """Sequences that any packing needs: all tokens, or pieces that cannot share one and what they leave no room for."""
        x, cap = np.sort(self.lengths), self.capacity
        sums = np.concatenate(([0], np.cumsum(x)))
        best = -(-int(sums[-1]) // cap)
        half = int(np.searchsorted(x, cap // 2, "right"))
        # Pieces over cap - k have one each without any piece of k or more; k from the pieces up to half.
        for k in np.unique(x[:half]).tolist():
            big, low = int(np.searchsorted(x, cap - k, "right")), int(np.searchsorted(x, k))
            middle, room = len(x) - half - (len(x) - big), 0
            room = middle * cap - int(sums[big] - sums[half])
            best = max(best, (len(x) - big) + middle + max(0, -(-(int(sums[half] - sums[low]) - room) // cap)))
        return max(best, len(x) - half)

    def fills(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, weights=self.lengths).astype(np.int64)

    def fitness(self, packing: np.ndarray) -> tuple[int, int]:
        """Fewer sequences are better, then less even ones: the sum of squares of what they hold."""
        fill = self.fills(packing)
        return -len(fill), int((fill * fill).sum())

    def fit(self, packing: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        """Best fit of displaced pieces, longest first, into the sequences of the others; closes gaps in the numbers."""
        out = np.full(len(packing), -1, np.int64)
        stay = np.ones(len(packing), bool)
        stay[displaced] = False
        used, out[stay] = np.unique(packing[stay], return_inverse=True)
        fill = np.bincount(out[stay], weights=self.lengths[stay], minlength=len(used)).astype(np.int64)
        fit = BestFit(self.capacity)
        for number, room in enumerate((self.capacity - fill).tolist()):
            fit.open(number, room)
        count, placed = len(used), []
        for length in self.lengths[displaced].tolist():
            number = fit.put(length)
            if number < 0:
                number, count = count, count + 1
                fit.open(number, self.capacity - length)
            placed.append(number)
        out[displaced] = placed
        return out

    def first(self, rng: np.random.Generator | None) -> np.ndarray:
        """Best fit of all pieces in falling order, or in one that chance disturbs."""
        noise = rng.normal(0, self.capacity * rng.uniform(0.01, 0.15), len(self.lengths)) if rng is not None else 0
        return self.fit(np.full(len(self.lengths), -1), np.argsort(-(self.lengths + noise), kind="stable"))

    def cross(self, giver: np.ndarray, taker: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A child: some of the giver's well-filled sequences whole into the taker; a few of the taker's with room dissolve too."""
        fill, own = self.fills(giver), self.fills(taker)
        well = np.flatnonzero(fill >= np.quantile(fill, rng.uniform(0.3, 0.95)))
        inside = np.zeros(len(fill), bool)
        inside[rng.choice(well, min(len(well), int(rng.integers(1, 20))), replace=False)] = True
        moved = inside[giver]
        broken = np.zeros(len(own), bool)
        broken[taker[moved]] = True
        room = np.flatnonzero(own < self.capacity)
        broken[rng.choice(room, min(len(room), int(rng.integers(1, 4))), replace=False)] = True
        child = np.where(moved, giver + len(own), taker)
        displaced = np.flatnonzero(broken[taker] & ~moved)
        noise = rng.normal(0, self.capacity * rng.choice([0, 0.03, 0.1]), len(displaced))
        return self.fit(child, displaced[np.argsort(-(self.lengths[displaced] + noise), kind="stable")])

    def done(self, packing: np.ndarray) -> bool:
        return int(packing.max(initial=-1)) + 1 <= self.least

    def evolve(self, population: list[np.ndarray], search: Search, rng: np.random.Generator) -> list[np.ndarray]:
        """An epoch; the population best first.  It ends early when its best packing is proved to be a least one."""
        rank = lambda some: sorted(some, key=self.fitness, reverse=True)[: search.population]
        population = rank(population)
        for _ in range(search.generations):
            if self.done(population[0]):
                break
            pairs = [rng.permutation(len(population))[:2] for _ in range(search.children)]
            population = rank(population + [self.cross(population[p[0]], population[p[-1]], rng) for p in pairs])
        return population


def encoded_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, dtype: str) -> DataFrame:
    """The pieces of every document, numbered by task and place; written once, so that the numbers stand."""

    def run(batches):
        enc = encoder(path, dtype)
        end, row = np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, dtype).astype("<u4")
                n = len(ids)
                starts = [0, *range((n - 1) % capacity + 1, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    for column, v in zip(out, (row, doc_id, k, a, b - a, zlib.crc32(ids[a:b].data))):
                        column.append(v)
                    row += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[c.split()[0] for c in PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, PIECE)


STATE = ["shard", "island", "lengths", "old", "population", "guest"]
EVOLVED = "shard long, island int, lengths array<long>, population array<binary>, sequences long, squares long"


def evolved(islands: DataFrame, capacity: int, search: Search, epoch: int) -> DataFrame:
    """An epoch of every island (STATE; ``old``: the sequence that each piece comes from, where it has one)."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in STATE}
                lengths = row["lengths"].values.to_numpy()
                packer = Packer(lengths, capacity)
                shard, island = row["shard"].as_py(), row["island"].as_py()
                rng = np.random.Generator(np.random.PCG64([search.seed, shard, island, epoch]))
                if row["population"].is_valid:
                    population = [np.frombuffer(b, np.int32).astype(np.int64) for b in [*row["population"].as_py(), row["guest"].as_py()] if b is not None]
                else:
                    population = [packer.first(None)]
                    if row["old"].is_valid:
                        population.append(np.unique(row["old"].values.to_numpy(), return_inverse=True)[1])
                    if not packer.done(population[0]):
                        population += [packer.first(rng) for _ in range(search.population - 1)]
                population = packer.evolve(population, search, rng)
                least, squares = packer.fitness(population[0])
                raw = [p.astype(np.int32).tobytes() for p in population]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([island], pa.int32()), pa.array([lengths], pa.list_(pa.int64())), pa.array([raw], pa.list_(pa.binary())), pa.array([-least]), pa.array([squares])],
                    names=["shard", "island", "lengths", "population", "sequences", "squares"],
                )

    return islands.select(*STATE).mapInArrow(run, EVOLVED)


def best_packings(dealt: DataFrame, capacity: int, search: Search) -> DataFrame:
    """``shard, packing``: for each shard the best packing that an island found, for its pieces in order of row."""
    shards = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "length", "old"))).alias("own"))
    own = lambda c: F.transform("own", lambda p: p[c]).alias(c)
    old = F.when(F.get("own", F.lit(0))["old"].isNotNull(), own("old")).alias("old")
    start = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(search.islands - 1))).alias("island"), own("length").alias("lengths"), old)
    start = start.withColumns({"population": F.lit(None).cast("array<binary>"), "guest": F.lit(None).cast("binary")})
    # Islands of one shard are tasks of their own.
    now = stored(evolved(start.repartition("shard", "island"), capacity, search, 0), "islands")
    for epoch in range(1, search.epochs):
        guests = now.select(F.col("shard").alias("s"), ((F.col("island") + 1) % search.islands).alias("i"), F.col("population")[0].alias("guest"))
        met = now.withColumn("old", F.lit(None).cast("array<long>")).join(guests, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i")))
        now = stored(evolved(met, capacity, search, epoch), "islands")
    rank = F.struct("sequences", -F.col("squares"), "island")
    return now.groupBy("shard").agg(F.min_by(F.col("population")[0], rank).alias("packing"))


PLACED = f"{PIECE}, old long, sequence_id long, offset long, room long"


def packed_level(dealt: DataFrame, capacity: int, search: Search) -> DataFrame:
    """A level's pieces with sequence (named by its least row), place in it, and the room that the sequence leaves."""

    def place(pieces: pa.Table, best: pa.Table) -> pa.Table:
        pieces = pieces.drop_columns(["shard"]).sort_by("row")
        packing = np.frombuffer(best.column("packing")[0].as_py(), np.int32)
        length, row = pieces.column("length").to_numpy(), pieces.column("row").to_numpy()
        order = np.argsort(packing, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.flatnonzero(np.diff(packing[order], prepend=-1))
        offset, name = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        size = np.diff(np.append(first, len(row)))
        offset[order] = before - np.repeat(before[first], size)
        name[order] = np.repeat(row[order][first], size)
        room = capacity - np.bincount(packing, weights=length).astype(np.int64)[packing]
        for c, v in (("sequence_id", name), ("offset", offset), ("room", room)):
            pieces = pieces.append_column(c, pa.array(v))
        return pieces

    best = best_packings(dealt, capacity, search)
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, PLACED)


def pack(pieces: DataFrame, capacity: int, search: Search = Search(), shard_rows: int = 4096, waste: int = 4, shrink: float = 0.8) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces must be a stored table with unique ``row``."""
    done = [pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})]
    rest = pieces.where(F.col("length") < capacity).withColumn("old", F.lit(None).cast("long"))
    count, level = rest.count(), 0
    while count:
        shards = -(-count // shard_rows)
        # Pieces are dealt one by one first, then with all of their sequence.
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("old", "row"), F.lit(level)), F.lit(shards)))
        made = stored(packed_level(dealt, capacity, search), "packed")
        rest = made.where(F.col("room") > waste).select(*[c.split()[0] for c in PIECE.split(", ")], F.col("sequence_id").alias("old"))
        left = rest.count() if shards > 1 else 0
        again = 0 < left <= shrink * count
        done.append((made.where(F.col("room") <= waste) if again else made).drop("room", "old"))
        count, level = left if again else 0, level + 1
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out


def packed_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, search: Search = Search(), dtype: str = "<u2", shard_rows: int = 4096) -> DataFrame:
    """Every piece of every document with its sequence and place; ``dtype`` must hold every id of the vocabulary."""
    pieces = stored(encoded_pieces(docs, path, end_id, capacity, dtype), "pieces")
    return pack(pieces, capacity, search, shard_rows)


def packing_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    out = packed_documents(docs, path, end_id)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
