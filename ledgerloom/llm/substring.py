"""Substring dedup over words with difference-cover anchors.

A window is ``window`` consecutive words (50).  A word goes if a window covers it whose word sequence also starts in a
document with a smaller id; windows are judged on the input.

For a difference cover ``D`` modulo ``period`` any two places ``i`` and ``j`` have a shift below the period that brings
both onto cover places.  So two equal windows share an anchor, a run of ``window - period + 1`` words that starts at a
cover place in both documents:

1. Anchors are hashed at cover places only (6 of 31) and grouped by hash; those that stand in one document alone end
   here.  Very frequent anchors (found by mergeable counters of bounded size) need no grouping: they are known to
   repeat, and leaving them out keeps the groups small; a group is read as a stream, whatever its size.
2. Anchors that repeat extend to the windows that contain them.  Those windows alone get hashes of their own; the least
   id of each hash is found by a pre-aggregated group, stored, and joined back (a hot window is then one that Spark
   can split over tasks).
3. Documents whose whole word sequence is that of a smaller id are settled before step 2, so groups of copies cost one
   document.

Only narrow tables are stored between the steps; the texts meet the places of their windows once at the end.  A row is
known by its id, the 64-bit hash of its text and the text's size, so any number of rows may share an id.

Hashes have 64 bits; two different windows are taken as equal with odds of n^2 / 2^65 over n candidate windows.

Defined results: a null text has no words; texts of fewer words than a window lose none; a null id counts as smaller
than all others; rows of equal id are not compared with each other, repeated rows get the same result; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import mix64, pieces, powers, stored, text_of, utf8, width, word_hashes, word_spans

WINDOW = 50
#: A perfect difference cover: every residue is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
COUNTERS = 4096
_A, _B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class Words:
    """The words of a batch of texts: hashes, and sums from which any run's hash follows."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = utf8(texts)
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.counts = np.diff(self.first)

    def runs(self, at: np.ndarray, length: np.ndarray | int, base: int) -> np.ndarray:
        """Hash of the run of ``length`` words from each place ``at`` (places count over the batch)."""
        n = len(self.hashes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * powers(base, n), out=sums[1:])
        return mix64((sums[at + length] - sums[at]) * powers(pow(base, -1, 1 << 64), n + 1)[at])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and place in the document of every anchor."""
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        place = np.arange(len(self.hashes)) - self.first[doc]
        at = np.flatnonzero(_IN_COVER[place % PERIOD] & (self.counts[doc] - place >= ANCHOR) & (self.counts[doc] >= WINDOW))
        return self.runs(at, ANCHOR, _A), doc[at], place[at]


def merge_counters(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum equal keys and keep ``most`` counters, less the largest count left out: no key loses more than n / most."""
    keys, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
    if len(keys) > most:
        cut = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        kept = counts > cut
        keys, counts = keys[kept], counts[kept] - cut
    return keys, counts


#: Stands for a missing id: below all others.
LEAST_ID = -(2**63)


def id_of(col: str) -> Column:
    """An id without null."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LEAST_ID))


#: What tells rows apart: the id without null, the hash of the text and its bytes.  Rows that agree in all are repeats.
KEY = ("id", "name", "size")
KEY_TYPE = "id long, name long, size int"


def numbered(docs: DataFrame, carry: list[Column] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``KEY`` and ``text`` without null."""
    rest = [F.struct(*carry).alias("rest")] if carry else []
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_of("doc_id").alias("id"), F.xxhash64(text).alias("name"), F.octet_length(text).alias("size"), text.alias("text"), *rest)


def keys_of(batch: pa.RecordBatch, rows: np.ndarray) -> dict:
    """The key columns of the given rows of a batch."""
    return {c: batch.column(c).to_numpy()[rows] for c in KEY}


def survey(rows: DataFrame) -> DataFrame:
    """One row a document (kind 0: key, hash and number of its words) and one a counter (kind 1: anchor, count)."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in pieces(batches):
            words = Words(batch.column("text"))
            whole = words.runs(words.first[:-1], words.counts, _B) + words.counts.astype(np.uint64)
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({"kind": np.zeros(n, np.int32), **{c: batch.column(c) for c in KEY}, "h": whole.view(np.int64), "n": words.counts})
            found = words.anchors()[0]
            keys, counts = merge_counters(np.concatenate((keys, found)), np.concatenate((counts, np.ones(len(found), np.int64))), COUNTERS)
        n = len(keys)
        zero = np.zeros(n, np.int64)
        yield pa.RecordBatch.from_pydict({"kind": np.ones(n, np.int32), "id": zero, "name": zero, "size": zero.astype(np.int32), "h": keys.view(np.int64), "n": counts})

    return rows.select(*KEY, "text").mapInArrow(run, f"kind int, {KEY_TYPE}, h long, n long")


def of_more_documents(batches):
    """``KEY, pos`` of the rows (sorted by hash, then key) whose hash has more than one key.

    A group may go on over many batches: only the rows of its first key are held until another key shows up.
    """
    held, h_held, key_held, more = [], None, None, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h = batch.column("h").to_numpy()
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in KEY])
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        several = (keys[:, first] != keys[:, last]).any(axis=0)
        if h_held == h[0]:
            several[0] |= more or tuple(keys[:, 0]) != key_held or tuple(keys[:, last[0]]) != key_held
            if several[0]:
                yield from held
                held = []
        if h_held != h[0] or len(first) > 1:
            held = []  # the last group starts in this batch
            key_held = tuple(keys[:, first[-1]])
        h_held, more = h[-1], bool(several[-1])
        kept = np.repeat(several, last - first + 1)
        rows = batch.select([*KEY, "pos"])
        if kept.any():
            yield rows.filter(pa.array(kept))
        if not more:
            held.append(rows.slice(int(first[-1])))


def repeated_anchors(rows: DataFrame, hot: frozenset[int]) -> DataFrame:
    """``KEY, pos`` of every anchor, other than the hot ones, whose hash stands in more than one document."""
    skip = np.array(sorted(hot), np.int64)

    def emit(batches):
        for batch in pieces(batches):
            hashes, doc, place = Words(batch.column("text")).anchors()
            hashes = hashes.view(np.int64)
            kept = np.flatnonzero(~np.isin(hashes, skip))
            yield pa.RecordBatch.from_pydict({"h": hashes[kept], **keys_of(batch, doc[kept]), "pos": place[kept].astype(np.int32)})

    dealt = rows.select(*KEY, "text").mapInArrow(emit, f"h long, {KEY_TYPE}, pos int")
    dealt = dealt.repartition(width(rows), "h").sortWithinPartitions("h", *KEY)
    return dealt.mapInArrow(of_more_documents, f"{KEY_TYPE}, pos int")


def kept_words(text: bytes, starts: np.ndarray) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the kept words joined by a blank; starts: of removed windows."""
    words = text.split()
    if not len(starts):
        return len(words), 0, b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    keep = np.cumsum(edges[:-1]) == 0
    return len(words), len(words) - int(keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def window_places(at: np.ndarray, n: int) -> np.ndarray:
    """Places of the windows of a text of ``n`` words that hold an anchor that starts at one of ``at``."""
    edges = np.zeros(n + PERIOD + 1, np.int64)
    np.add.at(edges, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(edges, at + 1, -1)
    return np.flatnonzero(np.cumsum(edges)[: n - WINDOW + 1] > 0)


def candidate_windows(rows: DataFrame, facts: DataFrame, hot: frozenset[int]) -> DataFrame:
    """``h, KEY, pos`` of every window that holds a repeated or hot anchor; copies (place -1) have none."""
    skip = np.array(sorted(hot), np.int64)

    def emit(batches):
        for batch in pieces(batches):
            words = Words(batch.column("text"))
            hashes, doc, place = words.anchors()
            known = np.isin(hashes.view(np.int64), skip)
            by_doc = np.searchsorted(doc[known], np.arange(batch.num_rows + 1))
            hot_places = place[known]
            found = []
            for i, places in enumerate(batch.column("places")):
                at = places.values.to_numpy().astype(np.int64) if places.is_valid else np.zeros(0, np.int64)
                copy = (at == -1).any()
                at = np.concatenate((at, hot_places[by_doc[i] : by_doc[i + 1]]))
                found.append(np.zeros(0, np.int64) if copy or not len(at) else window_places(at, int(words.counts[i])))
            doc = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            h = words.runs(words.first[doc] + at, WINDOW, _B).view(np.int64)
            yield pa.RecordBatch.from_pydict({"h": h, **keys_of(batch, doc), "pos": at.astype(np.int32)})

    # Without hot anchors, texts that no fact speaks of are not needed.
    joined = rows.select(*KEY, "text").join(facts, [*KEY], "left" if hot else "inner")
    return joined.select(*KEY, "text", "places").mapInArrow(emit, f"h long, {KEY_TYPE}, pos int")


def removed_windows(rows: DataFrame) -> DataFrame:
    """``KEY, starts``: places of the windows that also start in a smaller id; -1 alone for copies of a smaller id."""
    seen = stored(survey(rows), "survey")
    counters = seen.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n"))
    total = counters.agg(F.sum("n")).first()[0] or 0
    # At most COUNTERS keys can have this share of what was counted, so the list is bounded.
    hot = frozenset(r.h for r in counters.where(F.col("n") >= max(256, total // COUNTERS)).collect())
    whole = seen.where(f"kind = 0 and n >= {WINDOW}").select(*KEY, "h", "n")
    least = whole.groupBy("h", "n").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    least = stored(least, "copied").withColumnsRenamed({"h": "w", "n": "words"})
    copies = whole.join(least, (F.col("h") == F.col("w")) & (F.col("n") == F.col("words"))).where("id > least").select(*KEY, F.lit(-1).alias("pos"))
    facts = repeated_anchors(rows, hot).unionByName(copies).groupBy(*KEY).agg(F.collect_set("pos").alias("places"))
    windows = stored(candidate_windows(rows, stored(facts, "anchors"), hot), "windows")
    first = windows.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    first = stored(first.select(F.col("h").alias("w"), "least"), "repeated")
    gone = windows.join(first, F.col("h") == F.col("w")).where("id > least").select(*KEY, "pos")
    return stored(gone.unionByName(copies).groupBy(*KEY).agg(F.collect_set("pos").alias("starts")), "removed")


def remove_repeats(docs: DataFrame, carry: list[Column] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words joined by blanks) for every row.

    With ``carry`` the struct ``rest`` of those columns goes along, which saves joining them back, and ``kept`` is the
    text as it is where no word is removed.
    """
    rows = numbered(docs, carry)
    rest, as_it_is = ["rest"] if carry else [], bool(carry)
    rest_type = f", rest {dict(rows.dtypes)['rest']}" if carry else ""

    def finish(batches):
        for batch in pieces(batches):
            n, removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                raw = text.as_buffer().to_pybytes()
                gone_at = starts.values.to_numpy().astype(np.int64) if starts.is_valid else np.zeros(0, np.int64)
                if len(gone_at) and gone_at.min() < 0:
                    words = len(raw.split())
                    out = words, words, b""
                elif as_it_is and not len(gone_at):
                    out = len(raw.split()), 0, raw
                else:
                    out = kept_words(raw, gone_at)
                for to, value in zip((n, removed, kept), out):
                    to.append(value)
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in rest})

    joined = rows.join(removed_windows(rows), [*KEY], "left").select("doc_id", "text", "starts", *rest)
    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string" + rest_type)


def substring_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
