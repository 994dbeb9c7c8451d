"""Document fingerprints from closed syncmers, in DataFrame functions alone.

The symbols of a text are its words, long ones cut into pieces of 16 characters.  A k-mer (5 symbols) is a closed
syncmer if the least hash of its inner substrings (2 symbols) stands first or last.  Whether it is chosen depends on
the k-mer alone, not on what surrounds it, so two texts choose the same anchors wherever they share a passage:
``anchors`` gives them with their places.  A fingerprint is the distinct anchor hashes of the whole text (32 bits each,
rising), written as hexadecimal digits; likeness is the Jaccard similarity of both sets.  With ``size`` a fingerprint
has the least so many hashes only, and likeness is the share of common ones among the ``size`` least of both together.
Anchors also match by position: ``n_in_place`` counts those of a text that stand at the same place in its edited text.

The next document in id order comes from one exchange of the texts: rows are cut into ranges of id and text hash (an id
that many rows share is cut by the hash alone), the first row of a range also goes to the range before it, that of the
first range to the last one, and a window runs within each range.

Defined results: a null text is the empty text; a text without a syncmer has the hash of the whole text as its one
anchor and none in place; null ids come first, rows of equal id are ordered by the hash of their text; the only document
of a table is its own next one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of, width

SYMBOL = r"[^\x20\x09-\x0D]{1,16}"
K, S = 5, 2
SIZE = 64
LEAST_ID = -(2**63)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of struct(place of the first symbol, hash) of every closed syncmer of ``text``."""
    symbols, hashes, inner = f"{out}_symbols", f"{out}_hashes", f"{out}_inner"
    df = df.withColumn(symbols, F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)))
    df = df.withColumn(hashes, F.transform(symbols, lambda w: F.xxhash64(w))).drop(symbols)
    pairs = F.when(F.size(hashes) >= S, F.transform(F.sequence(F.lit(0), F.size(hashes) - S), lambda i: F.xxhash64(*[F.col(hashes)[i + j] for j in range(S)])))
    df = df.withColumn(inner, pairs)
    last = K - S
    at = lambda i, j: F.col(inner)[i + j]
    edge = lambda i: F.least(at(i, 0), at(i, last)) <= F.least(*[at(i, j) for j in range(1, last)])
    whole = lambda i: F.xxhash64(at(i, 0), at(i, S), F.col(hashes)[i + K - 1])
    places = F.when(F.size(hashes) >= K, F.filter(F.sequence(F.lit(0), F.size(hashes) - K), edge))
    found = F.transform(places, lambda i: F.struct(i.alias("place"), whole(i).alias("hash")))
    return df.withColumn(out, F.coalesce(found, F.expr("cast(array() as array<struct<place: int, hash: bigint>>)"))).drop(hashes, inner)


def with_sketch(df: DataFrame, text: str, out: str, size: int | None = SIZE) -> DataFrame:
    """Adds ``out``: the ``size`` least distinct anchor hashes of ``text`` modulo 2^32, or all of them, rising.

    ``out_placed`` has a hash of place and anchor for each anchor.
    """
    df = with_anchors(df, text, f"{out}_anchors")
    values = F.transform(f"{out}_anchors", lambda a: F.pmod(a["hash"], F.lit(1 << 32)))
    values = F.sort_array(F.array_distinct(values))
    placed = F.transform(f"{out}_anchors", lambda a: F.xxhash64(a["place"], a["hash"]))
    df = df.withColumns({f"{out}_values": values if size is None else F.slice(values, 1, size), f"{out}_placed": placed}).drop(f"{out}_anchors")
    alone = F.array(F.pmod(F.xxhash64(text), F.lit(1 << 32)))
    return df.withColumn(out, F.when(F.size(f"{out}_values") > 0, F.col(f"{out}_values")).otherwise(alone)).drop(f"{out}_values")


def fingerprint_text(sketch: str) -> Column:
    """A sketch as eight hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def likeness(a: str, b: str, size: int | None = SIZE) -> Column:
    """Jaccard similarity of the anchor sets behind two sketches, an estimate where those are cut to ``size``."""
    if size is None:
        common = F.size(F.array_intersect(a, b))
        return common / (F.size(a) + F.size(b) - common)
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    common = F.array_intersect(least, F.array_intersect(F.col(a), F.col(b)))
    return F.size(common) / F.size(least)


def range_edges(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """At most ``ranges`` edges (id, hash) between ranges of about equal numbers of rows, in order.

    An id that stands for several of the quantiles is cut into as many parts by the hash of the text.
    """
    found = rows.agg(F.percentile_approx("id", F.array(*[F.lit(k / ranges) for k in range(ranges)]), 20 * ranges).alias("edges")).first().edges or []
    times = {v: found.count(v) for v in found}
    return [(v, LEAST_ID + (k << 64) // n) for v, n in sorted(times.items()) for k in range(n)][1:]


def with_next(rows: DataFrame, ranges: int) -> tuple[DataFrame, Window]:
    """Adds ``next``, the text of the next row by (id, hash of the text); rows of other ranges are marked by ``guard``.

    Returns the rows with the window, so that more can be taken from the next row without another exchange.
    """
    rows = rows.withColumn("name", F.xxhash64("text"))
    edges = range_edges(rows, ranges)
    depth = max(1, len(edges).bit_length())
    pair = lambda v, q: F.struct(F.lit(v).cast("long").alias("id"), F.lit(q).cast("long").alias("name"))
    table = F.array(*[pair(*e) for e in edges + [(2**63 - 1, 2**63 - 1)] * ((1 << depth) - len(edges))])
    # Number of edges at or below the row, by binary search.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(depth))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.struct("id", "name"), at + step).otherwise(at))
    rows = rows.withColumn("range", F.least(place, F.lit(len(edges))))
    # The first row of each range that has rows, at most ``ranges`` of them.
    heads = sorted((r.range, *r.head) for r in rows.groupBy("range").agg(F.min(F.struct("id", "name")).alias("head")).collect())
    known = {r: (i, n, heads[k - 1][0], int(k == 0)) for k, (r, i, n) in enumerate(heads)}
    head = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(("id", "name", "to", "turn"), known.get(r, (0, 0, -1, 0)))]) for r in range(len(edges) + 1)])
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guard"), F.lit(0).alias("turn"))
    rows = rows.withColumn("head", F.get(head, F.col("range")))
    guard = F.struct(F.col("head.to").cast("int").alias("range"), F.lit(True).alias("guard"), F.col("head.turn").cast("int").alias("turn"))
    copies = F.array_compact(F.array(own, F.when((F.col("head.id") == F.col("id")) & (F.col("head.name") == F.col("name")), guard)))
    rows = rows.withColumn("copy", F.explode(copies)).select("doc_id", "id", "name", "text", "copy.range", "copy.guard", "copy.turn")
    window = Window.partitionBy("range").orderBy("turn", "id", "name", "guard")
    return rows.withColumn("next", F.lead("text").over(window)), window


def fingerprints(docs: DataFrame, size: int | None = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), text_of().alias("text"))
    rows, window = with_next(rows, ranges=8 * width(docs))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "edited": edited}).drop("next")
    rows = with_sketch(rows, "text", "sketch", size)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(window)).where("not guard").drop("text")
    rows = with_sketch(rows, "edited", "edited_sketch", size)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text("sketch").alias("fingerprint"),
        fingerprint_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch", size).alias("near_edited"),
        likeness("sketch", "next_sketch", size).alias("near_next"),
        F.size("sketch_placed").cast("long").alias("n_anchors"),
        F.size(F.array_intersect("sketch_placed", "edited_sketch_placed")).cast("long").alias("n_in_place"),
    )
