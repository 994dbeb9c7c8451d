"""A hidden Markov language model over word classes, trained by Baum-Welch on the whole training part of a corpus.

Tokens are the words of a text in ASCII lower case and one end.  The ``own`` most frequent words (8,192) are classes
of their own; every other word belongs to one of ``TAILS`` classes by its last three bytes.  The model gives a text

    P(text) = sum over state paths of  prod  A[z', z] * B[z, class(w)] * q(w | class(w))

where q is 1 for a class of its own and else (c + 0.1) / (C + 0.1 * (V + 1)) from the word's count c, the class's
total C and its V distinct words in the training tokens, so that unseen words have a share too.  The sum over paths is
the scaled forward recursion over the whole text.

Word counts come from a pre-aggregated group over all training texts.  Every text is then stored once as the classes of
its tokens.  Starting values come from a few rounds in which each text as a whole belongs to a state (a mixture), then
come rounds of Baum-Welch, until the likelihood settles or ``rounds`` are over.  Each round runs over every training
token: a partition yields the expected counts of its texts and these are summed by class.  Texts are never cut: a long
one is worked off in runs of ``RUN`` tokens side by side, and the runs' transfer matrices carry the forward and
backward values over their edges exactly.  Counts of frequent words (at most ``TOP``) are broadcast; the others reach
their documents by a join on the word's hash (64 bits).

Defined results: a null text is the empty text, whose only token is the end; a null id counts as the empty text for
the split; repeated rows score alike; without training texts every count is 0; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import crc_mod, mix64, pieces, stored, utf8, word_hashes, word_spans
from ledgerloom.llm.substring import KEY, KEY_TYPE, numbered

STATES, OWN, TAILS, TOP = 8, 8192, 2048, 1 << 17
#: Tokens of a run and runs that are worked off at once.
RUN, RUNS = 64, 4096
END = 0x0123456789ABCDEF
PRIOR = 50.0


class Tokens:
    """Hash and tail class of every token of a batch, an end after each text's words."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        starts, ends, first = word_spans(data, offsets)
        n = len(texts)
        self.first = first + np.arange(n + 1)
        size = int(self.first[-1])
        self.hashes, self.tails = np.full(size, END, np.uint64), np.zeros(size, np.int32)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
        self.hashes[at] = word_hashes(data, starts, ends)
        last = np.zeros(len(starts), np.uint64)
        for k in (1, 2, 3):
            place = ends - k
            last = last << np.uint64(8) | np.where(place >= starts, data[np.maximum(place, 0)], 0).astype(np.uint64) if len(data) else last
        self.tails[at] = (mix64(last) % np.uint64(TAILS)).astype(np.int32)


class HashIndex:
    """Place of a 64-bit key among given distinct keys, or -1; open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = keys & self.mask
        while len(left):
            free = self.places[slot[left]] < 0
            want, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.places[want], self.keys[want] = put, keys[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        out = self.places[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + np.uint64(1)) & self.mask
            out[wrong] = self.places[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


@dataclass
class Vocabulary:
    """The frequent words by falling count, the totals, and each tail class's denominator."""

    keys: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    tail_total: np.ndarray
    tail_distinct: np.ndarray

    def __post_init__(self):
        self.index = HashIndex(self.keys)
        self.own = min(OWN, len(self.keys))
        self.tail_log = np.log10(self.tail_total + 0.1 * (self.tail_distinct + 1))
        self.count_log = np.log10(self.counts + 0.1)

    def classes(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class of every token and its place among the frequent words (or -1)."""
        place = self.index.find(tokens.hashes)
        return np.where((place >= 0) & (place < self.own), place, OWN + tokens.tails), place

    @property
    def base(self) -> float:
        return math.log10(self.total + 0.1 * (self.distinct + 1))


def word_counts(train: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``h, tail, c`` for every distinct token of the training texts."""

    def run(batches):
        held: list = []
        size = 0

        def summed():
            h, first, inverse = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            tail = np.concatenate([x[1] for x in held])[first]
            c = np.bincount(inverse, np.concatenate([x[2] for x in held]), len(h)).astype(np.int64)
            return h, tail, c

        for batch in pieces(batches):
            t = Tokens(batch.column("text"))
            held.append((t.hashes, t.tails, np.ones(len(t.hashes), np.int64)))
            size += len(t.hashes)
            if size > most:
                held = [summed()]
                size = len(held[0][0])
                if size > most // 2:
                    yield counted(*held.pop())
                    size = 0
        if held:
            yield counted(*summed())

    def counted(h, tail, c):
        return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "tail": tail, "c": c})

    parts = train.select("text").mapInArrow(run, "h long, tail int, c long")
    return stored(parts.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c")), "words")


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count from which on a word is among the frequent ones."""
    step = F.floor(F.log2("c") * 8).cast("int")
    # At most 64 * 8 rows: how many words have counts of each step.
    bins = sorted(((r.step, r.words, r.tokens, r.least) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("least")).collect()), reverse=True)
    held, least = 0, 1 << 62
    for _, words, _, low in bins:
        if held + words > TOP:
            break
        held, least = held + words, low
    top = counts.where(F.col("c") >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])  # at most TOP rows
    tails = counts.where(F.col("c") < least).groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    total, distinct = np.zeros(TAILS), np.zeros(TAILS)
    total[tails["tail"].to_numpy(int)], distinct[tails["tail"].to_numpy(int)] = tails.c.to_numpy(float), tails.v.to_numpy(float)
    mid = top.iloc[OWN:]
    np.add.at(total, mid["tail"].to_numpy(int), mid.c.to_numpy(float))
    np.add.at(distinct, mid["tail"].to_numpy(int), 1)
    out = Vocabulary(top.h.to_numpy().astype(np.int64).view(np.uint64), top.c.to_numpy().astype(np.int64), sum(b[2] for b in bins), sum(b[1] for b in bins), total, distinct)
    return out, least


@dataclass
class Hmm:
    """Start and move probabilities and, for each class, its probability in each state (classes x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Hmm:
    """Probabilities from expected counts; classes are drawn towards their shares of all tokens."""
    emit = (emit + PRIOR * shares[:, None]) / (emit.sum(axis=0) + PRIOR)
    return Hmm((start + 1) / (start.sum() + STATES), (move + 1) / (move.sum(axis=1, keepdims=True) + STATES), emit)


def runs_of(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of up to RUN tokens of the texts, and for each text the number of runs before it (n+1 values)."""
    per = -(-np.diff(first) // RUN)
    runs = np.concatenate(([0], np.cumsum(per)))
    nth = np.arange(runs[-1]) - np.repeat(runs[:-1], per)
    return np.repeat(first[:-1], per) + nth * RUN, runs


def padded(classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """RUN x n classes of the given runs, with the class after the last one where a run has ended."""
    place = start[None, :] + np.arange(RUN)[:, None]
    return np.where(place < end[None, :], classes[np.minimum(place, max(0, len(classes) - 1))], OWN + TAILS)


def transfers(model: Hmm, emit: np.ndarray, obs: np.ndarray) -> np.ndarray:
    """For each run the matrix that takes the state before its first token to that of its last, scaled."""
    n = obs.shape[1]
    out = np.repeat(np.eye(STATES)[None], n, axis=0) * emit[obs[0]][:, None, :]
    for t in range(1, RUN):
        out = (out.reshape(-1, STATES) @ model.move).reshape(n, STATES, STATES) * emit[obs[t]][:, None, :]
        if t % 8 == 7:
            out /= out.sum(axis=(1, 2), keepdims=True)
    return out / out.sum(axis=(1, 2), keepdims=True)


def run_edges(model: Hmm, matrices: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run: the state before its first token, the state of the token before it, and the backward value at its end.

    Runs of one text follow each other; the k-th runs of all texts are worked off together.
    """
    total = int(runs[-1])
    before, previous, after = np.tile(model.start, (total, 1)), np.zeros((total, STATES)), np.ones((total, STATES))
    per = np.diff(runs)
    for k in range(1, int(per.max(initial=0))):
        at = runs[:-1][per > k] + k
        state = np.einsum("ni,nij->nj", before[at - 1], matrices[at - 1])
        previous[at] = state / state.sum(axis=1, keepdims=True)
        before[at] = previous[at] @ model.move
    for k in range(1, int(per.max(initial=0))):
        at = runs[1:][per > k] - 1 - k
        value = np.einsum("nij,nj->ni", matrices[at + 1], after[at + 1]) @ model.move.T
        after[at] = value / value.sum(axis=1, keepdims=True)
    return before, previous, after


def expect(model: Hmm, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and class emissions over whole texts, and their natural log likelihood."""
    emit = np.vstack((model.emit, np.ones((1, STATES))))
    start, runs = runs_of(classes, first)
    total = len(start)
    end = np.minimum(start + RUN, np.repeat(first[1:], np.diff(runs)))
    blocks = [slice(i, min(i + RUNS, total)) for i in range(0, total, RUNS)]
    if int(np.diff(runs).max(initial=0)) > 1:
        matrices = np.concatenate([transfers(model, emit, padded(classes, start[b], end[b])) for b in blocks])
    else:
        matrices = np.zeros((total, STATES, STATES))
    before, previous, after = run_edges(model, matrices, runs)
    heads = np.zeros(total, bool)
    heads[runs[:-1][np.diff(runs) > 0]] = True
    starts, moves, counts, likely_sum = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((OWN + TAILS + 1, STATES)), 0.0
    for b in blocks:
        obs = padded(classes, start[b], end[b])
        n = obs.shape[1]
        likely, alpha, scale = emit[obs], np.empty((RUN, n, STATES)), np.empty((RUN, n, 1))
        state = before[b] * likely[0]
        for t in range(RUN):
            if t:
                state = (alpha[t - 1] @ model.move) * likely[t]
            scale[t] = state.sum(axis=1, keepdims=True)
            alpha[t] = state / scale[t]
        likely_sum += float(np.log(scale[obs < OWN + TAILS]).sum())
        # Backward values are 1 past the end of a text, and from the next run's else; their sum with alpha is 1.
        beta = after[b] / (alpha[-1] * after[b]).sum(axis=1, keepdims=True)
        gamma = alpha  # overwritten from the end, each step after its last use
        for t in range(RUN - 1, -1, -1):
            ahead = likely[t] * beta / scale[t]
            gamma[t] = alpha[t] * beta
            if t:
                moves += (alpha[t - 1] * (obs[t] < OWN + TAILS)[:, None]).T @ ahead
                beta = ahead @ model.move.T
        moves += (previous[b] * ~heads[b][:, None]).T @ ahead
        starts += gamma[0][heads[b]].sum(axis=0)
        flat, weights = obs.ravel(), gamma.reshape(-1, STATES)
        counts += np.stack([np.bincount(flat, weights[:, k], OWN + TAILS + 1) for k in range(STATES)], axis=1)
    return starts, moves * model.move, counts[:-1], likely_sum


def share_out(model: Hmm, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``expect`` for a model whose texts never leave the state they start in: each text belongs to a state as a whole."""
    logs = np.vstack((np.log(model.emit), np.zeros((1, STATES))))
    score = np.add.reduceat(logs[classes], first[:-1]) + np.log(model.start)
    top = score.max(axis=1, keepdims=True)
    weight = np.exp(score - top)
    likely = top[:, 0] + np.log(weight.sum(axis=1))
    weight /= weight.sum(axis=1, keepdims=True)
    lengths = np.diff(first)
    spread = np.repeat(weight, lengths, axis=0)
    counts = np.stack([np.bincount(classes, spread[:, k], OWN + TAILS) for k in range(STATES)], axis=1)
    return weight.sum(axis=0), np.diag((weight * (lengths - 1)[:, None]).sum(axis=0)), counts, float(likely.sum())


def first_model(shares: np.ndarray) -> Hmm:
    """Starting values: each state prefers a fixed pseudo-random half of the classes."""
    draw = np.random.default_rng(3)
    emit = shares[:, None] * draw.uniform(0.5, 1.5, (len(shares), STATES))
    return Hmm(np.full(STATES, 1 / STATES), np.eye(STATES), emit / emit.sum(axis=0))


def forward(model: Hmm, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each text's classes by the scaled forward recursion, all texts side by side."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
    out, state = np.zeros(len(order)), None
    for t, n in enumerate(live.tolist()):
        state = model.start * model.emit[classes[starts]] if t == 0 else (state[:n] @ model.move) * model.emit[classes[starts[:n] + t]]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        out[:n] += np.log(scale)
    back = np.empty(len(order))
    back[order] = out
    return back


def token_parts(batches, most: int = 1 << 18):
    """Batches of coded texts cut into slices of about ``most`` tokens, with their classes and the texts' first tokens."""
    for batch in batches:
        lists = batch.column("classes")
        first = lists.offsets.to_numpy().astype(np.int64)
        classes = lists.flatten().to_numpy().astype(np.int64)
        first = first - first[0]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(first, first[at] + most, "right")) - 1)
            yield batch.slice(at, end - at), classes[first[at] : first[end]], first[at : end + 1] - first[at]
            at = end


def train_round(coded: DataFrame, model: Hmm, step) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The sums of ``step`` (``expect`` or ``share_out``) over all texts."""
    shared = coded.sparkSession.sparkContext.broadcast(model)  # a fixed 0.7 MB

    def count(batches):
        start, move, emit, likely = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((OWN + TAILS, STATES)), 0.0
        for _, classes, first in token_parts(batches):
            a, b, c, d = step(shared.value, classes, first)
            start, move, emit, likely = start + a, move + b, emit + c, likely + d
        # Rows of emissions that occur, then the moves, the starts and the likelihood.
        seen = np.flatnonzero(emit.any(axis=1))
        values = np.concatenate((emit[seen], move, start[None], np.full((1, STATES), likely)))
        keys = np.concatenate((seen, OWN + TAILS + np.arange(STATES + 2))).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"k": keys} | {f"s{i}": np.ascontiguousarray(values[:, i]) for i in range(STATES)})

    names = [f"s{i}" for i in range(STATES)]
    parts = coded.select("classes").mapInArrow(count, "k int, " + ", ".join(f"{s} double" for s in names))
    got = parts.groupBy("k").agg(*[F.sum(s).alias(s) for s in names]).toPandas()  # a row for each class and state
    table = np.zeros((OWN + TAILS + STATES + 2, STATES))
    table[got.k.to_numpy(int)] = got[names].to_numpy(float)
    return table[-2], table[-2 - STATES : -2], table[: OWN + TAILS], float(table[-1, 0])


def train(coded: DataFrame, shares: np.ndarray, rounds: int, mixture_rounds: int, settled: float) -> Hmm:
    """Mixture rounds from fixed starting values, then Baum-Welch until the likelihood gains less than ``settled``."""
    model = first_model(shares)
    for _ in range(mixture_rounds):
        start, _, emit, _ = train_round(coded, model, share_out)
        model = Hmm((start + 1) / (start.sum() + STATES), model.move, estimate(start, model.move, emit, shares).emit)
    move = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
    np.fill_diagonal(move, 0.95)
    model, last = Hmm(model.start, move, model.emit), -math.inf
    for _ in range(rounds):
        start, move, emit, likely = train_round(coded, model, expect)
        model = estimate(start, move, emit, shares)
        if likely - last < settled * abs(likely):
            break
        last = likely
    return model


def coded_texts(rows: DataFrame, vocab) -> DataFrame:
    """Every text as the classes of its tokens, with the sums that need frequent words only and the other words' hashes."""

    def code(batches):
        for batch in pieces(batches):
            t, v, n = Tokens(batch.column("text")), vocab.value, batch.num_rows
            classes, place = v.classes(t)
            known, tail = place >= 0, classes >= OWN
            count_log = np.where(known, v.count_log[np.maximum(place, 0)] if len(v.keys) else 0.0, 0.0)
            tail_log = np.where(tail, v.tail_log[np.maximum(classes - OWN, 0)], 0.0)
            add = lambda weights: np.bincount(t.doc, weights, n)
            rare = np.concatenate(([0], np.cumsum(np.bincount(t.doc[~known], minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: batch.column(c) for c in ("doc_id", "held_out", *KEY)},
                    "n_tokens": np.diff(t.first),
                    "known": add(known).astype(np.int64),
                    "base": add(count_log) - np.diff(t.first) * v.base,
                    "inner": add(np.where(tail, count_log, 0.0) - tail_log),
                    "classes": pa.ListArray.from_arrays(pa.array(t.first.astype(np.int32)), pa.array(classes.astype(np.int32))),
                    "rare": pa.ListArray.from_arrays(pa.array(rare), pa.array(t.hashes[~known].view(np.int64))),
                }
            )

    schema = f"doc_id long, held_out boolean, {KEY_TYPE}, n_tokens long, known long, base double, inner double, classes array<int>, rare array<long>"
    return rows.select("doc_id", "held_out", *KEY, "text").mapInArrow(code, schema)


def rare_sums(coded: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """``KEY, rare_log, rare_known``: what the words that are not frequent add to a text."""
    words = coded.where(F.size("rare") > 0).select(*KEY, "rare").dropDuplicates([*KEY])
    words = words.select(*KEY, F.explode("rare").alias("h")).groupBy(*KEY, "h").agg(F.count("*").alias("n"))
    words = words.join(counts.where(F.col("c") < least).select(F.col("h").alias("w"), "c"), F.col("h") == F.col("w"), "left")
    c = F.coalesce("c", F.lit(0))
    return words.groupBy(*KEY).agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("rare_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))


def score_table(docs: DataFrame, held_out_of: int = 10, rounds: int = 30, mixture_rounds: int = 3, settled: float = 1e-3) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Training ends with the first Baum-Welch round that gains less than the share ``settled`` of the log-likelihood.
    """
    spark = docs.sparkSession
    rows = numbered(docs).withColumn("held_out", crc_mod("doc_id", held_out_of) == 0)
    counts = word_counts(rows.where("not held_out"))
    vocab, least = vocabulary(counts)
    own = vocab.counts[:OWN]
    shares = np.concatenate((own + 0.1, np.full(OWN - len(own), 0.1), vocab.tail_total + 0.1))
    coded = stored(coded_texts(rows, spark.sparkContext.broadcast(vocab)), "coded")  # at most TOP words
    trained = train(coded.where("not held_out"), shares / shares.sum(), rounds, mixture_rounds, settled)
    model = spark.sparkContext.broadcast(trained)
    rare = stored(rare_sums(coded, counts, least), "rare")

    def score(batches):
        for batch, classes, first in token_parts(batches, most=1 << 20):
            path = forward(model.value, classes, first) / math.log(10)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "classes"} | {"path": path})

    kept = coded.select("doc_id", "held_out", *KEY, "n_tokens", "known", "base", "inner", "classes")
    scored = kept.mapInArrow(score, f"doc_id long, held_out boolean, {KEY_TYPE}, n_tokens long, known long, base double, inner double, path double")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return scored.join(rare, [*KEY], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + rare_known).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log).alias("base_score"),
        (F.col("path") + F.col("inner") + rare_log).alias("score"),
    )
