"""Fill-in-middle transformation by displacement scatter.

A text is cut at two places into prefix, middle and suffix, and its parts are written in another order with markers
between them.  Texts are worked off as the UTF-8 bytes of a whole batch:

* cuts are counted in code points and looked up in the places where code points begin;
* a difference array over the batch's bytes gets the change of displacement at the start of each part; its running sum
  is the shift of every byte from input to output, and one scatter builds all outputs of the batch;
* the inverse scans the outputs for markers, builds the shifts from restored to transformed bytes in the same way, and
  one gather restores all texts.

Cuts and forms follow from a digest of the id alone, so reruns agree and no row depends on another.  There is no
shuffle; a slice of a batch holds about 256 KB of text or one longer text.

Defined results: a null text is the empty text, which stays plain; a null id is the empty string in the digest; repeated
rows give repeated results; an empty table gives an empty table; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import pieces, text_of, utf8

PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
#: Markers of prefix, suffix and middle (fixed values of the format); each is three ASCII bytes ``<x>``.
LETTERS = b"PSM"
MARK = 3


@dataclass(frozen=True)
class Rates:
    """Percentages of texts that are rearranged, and of those that put the suffix first."""

    rearranged: int = 90
    suffix_first: int = 20
    salt: str = "1"


def digests(ids: list, salt: str) -> np.ndarray:
    """The first four unsigned 32-bit groups of the sha256 of ``salt:id``, a row for each id."""
    raw = b"".join(hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first byte of every marker that lies within one text, and the number of its text."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    at = at[np.isin(data[at + 1], np.frombuffer(LETTERS, np.uint8))]
    text = np.searchsorted(offsets, at, "right") - 1
    within = at + MARK <= offsets[text + 1]
    return at[within], text[within]


def shifts(starts: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """The displacement of each of ``size`` bytes: ``moves[k]`` from place ``starts[k]`` on; starts rise, equal ones are empty parts."""
    diff = np.zeros(size + 1, np.int64)
    np.add.at(diff, starts, np.diff(moves, prepend=0))
    return np.cumsum(diff[:-1])


def cut_points(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each text, its two cuts in code points, and the cuts' places in the batch's bytes (2 x n)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets)
    n = np.diff(first)
    drawn = h[:, :2] % (n + 1)[:, None]
    low, high = drawn.min(axis=1), drawn.max(axis=1)
    place = np.concatenate((lead, [len(data)]))
    return n, low, high, np.stack([np.where(c < n, place[np.minimum(first[:-1] + c, len(lead))], offsets[1:]) for c in (low, high)])


def rearranged(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs' bytes and offsets."""
    begin, end = offsets[:-1], offsets[1:]
    low, high = cuts
    moved = form != PLAIN
    out = np.concatenate(([0], np.cumsum(end - begin + 3 * MARK * moved)))
    start = out[:-1]
    pre, mid, suf = low - begin, high - low, end - high
    spm = form == SPM
    # Where each part begins in the output: prefix, middle, suffix.
    to_pre = start + np.where(moved, MARK + np.where(spm, suf + MARK, 0), 0)
    to_mid = np.where(moved, start + pre + suf + 3 * MARK, start + pre)
    to_suf = np.where(moved, start + MARK + np.where(spm, 0, pre + MARK), start + pre + mid)
    parts = np.stack((begin, low, high), axis=1).ravel()
    moves = np.stack((to_pre - begin, to_mid - low, to_suf - high), axis=1).ravel()
    made = np.empty(int(out[-1]), np.uint8)
    made[np.arange(len(data)) + shifts(parts, moves, len(data))] = data
    for letter, at in zip(LETTERS, (to_pre, to_suf, to_mid)):
        at = at[moved] - MARK
        made[at], made[at + 1], made[at + 2] = ord("<"), letter, ord(">")
    return made, out


def put_back(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that were rearranged: bytes and offsets, from the outputs and their forms alone.

    A rearranged text holds no marker, and a marker's first byte is no other marker's last, so each output has exactly
    the three that were written.
    """
    begin, end = offsets[:-1], offsets[1:]
    moved = form != PLAIN
    at, text = marks(data, offsets)
    at, text = at[moved[text]], text[moved[text]]
    count = np.bincount(text, minlength=len(form))
    if (count[moved] != len(LETTERS)).any():
        raise ValueError("a rearranged text must have one marker of each kind")
    place = np.tile(begin, (3, 1))  # of the first byte after each marker: prefix, suffix, middle
    for row, letter in enumerate(LETTERS):
        own = data[at + 1] == letter
        place[row, text[own]] = at[own] + MARK
    from_pre, from_suf, from_mid = place
    spm = form == SPM
    pre = np.where(moved, np.where(spm, from_mid, from_suf) - MARK - from_pre, end - begin)
    mid = np.where(moved, end - from_mid, 0)
    suf = np.where(moved, np.where(spm, from_pre, from_mid) - MARK - from_suf, 0)
    out = np.concatenate(([0], np.cumsum(pre + mid + suf)))
    start = out[:-1]
    parts = np.stack((start, start + pre, start + pre + mid), axis=1).ravel()
    moves = np.stack((from_pre - start, from_mid - start - pre, from_suf - start - pre - mid), axis=1).ravel()
    return data[np.arange(int(out[-1])) + shifts(parts, moves, int(out[-1]))], out


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


FILLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every text with its parts rearranged, or plain.

    ``n`` is the number of code points; the parts' sizes are null for plain texts.
    """

    def run(batches):
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            h = digests(batch.column("doc_id").to_pylist(), rates.salt)
            n, low, high, cuts = cut_points(data, offsets, h)
            marked = np.zeros(len(n), bool)
            marked[marks(data, offsets)[1]] = True
            plain = (n == 0) | marked | (h[:, 2] % 100 >= rates.rearranged)
            form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < rates.suffix_first, SPM, PSM))
            made, out = rearranged(data, offsets, cuts, form)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "form": pa.array(FORMS[form], pa.string()),
                    "prefix_chars": pa.array(low, pa.int64(), mask=plain),
                    "middle_chars": pa.array(high - low, pa.int64(), mask=plain),
                    "output": strings(made, out),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, FILLED)


def restore(filled: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` and ``restored``, the text rebuilt from ``output`` and ``form``."""

    def run(batches):
        for batch in pieces(batches, "output"):
            form = np.searchsorted(FORMS, np.array(batch.column("form").to_pylist(), FORMS.dtype))
            data, out = put_back(*utf8(batch.column("output")), form)
            yield pa.RecordBatch.from_arrays([*batch.columns, strings(data, out)], names=[*batch.schema.names, "restored"])

    return filled.mapInArrow(run, f"{FILLED}, restored string")


def middle_table(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Digests of every output and of the text restored from it."""
    both = restore(fill_in_middle(docs, rates))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
