"""Lossless WebP: media columns of byte payloads, and a decoder for whole VP8L streams.

The decoder reads prefix codes, meta prefix groups, back-references and the colour cache, inverts the predictor,
cross-colour, subtract-green and palette transforms and returns an array of ARGB pixels.  Streams of the encoder, and
others that use no more than it does, are decoded many at a time (``webp_batch``); the rest pixel by pixel, here.

A payload is stored as rows of 64 RGB pixels, 192 bytes each; payloads of more than 32 rows become several files, one
after the other, so that a long text is as many images as any other bytes of its size.

Defined results: a null or empty text is one row of blanks; equal texts give equal bytes; repeated rows give
repeated results; an empty table gives an empty table; columns beyond ``doc_id`` and ``text`` are left out.  Damaged
streams (ended early, incomplete codes, references to before the first pixel) raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import webp_batch
from ledgerloom.llm.common import pieces, stored, text_of
from ledgerloom.llm.webp_batch import CACHE_FACTOR, CROSS_COLOUR, LENGTH_ORDER, NEIGHBOURS, PREDICTOR, SUBTRACT_GREEN

ROW_PIXELS, ROW_BYTES, MAX_ROWS = 64, 192, 32


class BitReader:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.have = data, 0, 0, 0

    def read(self, n: int) -> int:
        if self.have < n:
            self.word |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.have
            self.at += 8
            self.have += 64
        out = self.word & ((1 << n) - 1)
        self.word >>= n
        self.have -= n
        if 8 * self.at - self.have > 8 * len(self.data):
            raise ValueError("a stream ends early")
        return out


class Prefix:
    """A canonical prefix code, from the code length of each symbol."""

    def __init__(self, lengths: list[int]):
        self.symbols = [s for s, n in enumerate(lengths) if n]
        self.only = self.symbols[0] if len(self.symbols) == 1 else None
        self.lengths, self.table = lengths, None

    def build(self) -> None:
        code, found = 0, {}
        for n in range(1, 16):
            for s in self.symbols:
                if self.lengths[s] == n:
                    found[(n, code)] = s
                    code += 1
            code <<= 1
        self.table = found

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.build()
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            s = self.table.get((n, code))
            if s is not None:
                return s
        raise ValueError("bad prefix code")


def read_prefix(bits: BitReader, alphabet: int) -> Prefix:
    lengths = [0] * max(alphabet, 256)  # one or two symbols by themselves have up to 8 bits
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    return read_lengths(bits, alphabet, Prefix(own), left)


def read_lengths(bits: BitReader, alphabet: int, code: Prefix, left: int) -> Prefix:
    """Code lengths, with their runs, of at most ``left`` stored entries."""
    lengths = [0] * alphabet
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            last = s or last
            i += 1
        elif s == 16:
            n = 3 + bits.read(2)
            lengths[i : i + n] = [last] * n
            i += n
        else:
            i += 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
    return Prefix(lengths[:alphabet])


def extra(bits: BitReader, prefix: int) -> int:
    """The value of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def read_pixels(bits: BitReader, w: int, h: int, main: bool) -> np.ndarray:
    """An entropy-coded image of w x h ARGB pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tile, groups_at, n_groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tw = -(-w >> tile)
        groups_at = (read_pixels(bits, tw, -(-h >> tile), False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        n_groups = max(groups_at) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[read_prefix(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(n_groups)]
    n = w * h
    out, cache = [0] * n, [0] * cache_size
    at, shift, put = 0, 32 - cache_bits, 0
    while at < n:
        g = groups[groups_at[(at // w >> tile) * tw + (at % w >> tile)]] if groups_at else groups[0]
        s = g[0].read(bits)
        if s < 256:
            red = g[1].read(bits)
            blue = g[2].read(bits)
            out[at] = g[3].read(bits) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = extra(bits, s - 256)
            far = extra(bits, g[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEIGHBOURS[far - 1]
                far = max(1, x + y * w)
            if far > at or length > n - at:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - far]
            at += length
        else:
            while put < at:
                cache[(CACHE_FACTOR * out[put] & 0xFFFFFFFF) >> shift] = out[put]
                put += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB values as an array of four bytes each: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def predict(mode: int, left, top, right, corner):
    """The predicted pixel, as four ints, from its left, top, top-right and top-left neighbours."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner))
        by_top = sum(abs(m - c) for m, c in zip(left, corner))
        return left if by_left < by_top else top
    if mode == 12:
        return [min(255, max(0, m + t - c)) for m, t, c in zip(left, top, corner)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(half(left, top), corner)]
    return [0, 0, 0, 255]


def invert_predictor(pixels: np.ndarray, w: int, h: int, tile: int, modes: np.ndarray) -> np.ndarray:
    out = channels(pixels.reshape(h, w)).tolist()
    tw = -(-w >> tile)
    mode_of = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    for y in range(h):
        row = out[y]
        for x in range(w):
            if y == 0:
                p = row[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                p = out[y - 1][0]
            else:
                above = out[y - 1]
                p = predict(mode_of[(y >> tile) * tw + (x >> tile)], row[x - 1], above[x], above[x + 1] if x + 1 < w else row[0], above[x - 1])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p)]
    return np.array(out, np.uint8).reshape(-1, 4).view("<u4").reshape(-1)


def invert_cross_colour(pixels: np.ndarray, w: int, h: int, tile: int, elements: np.ndarray) -> np.ndarray:
    out = channels(pixels.reshape(h, w)).copy()
    tw = -(-w >> tile)
    at = (np.arange(h)[:, None] >> tile) * tw + (np.arange(w)[None, :] >> tile)
    each = channels(elements)[at].view(np.int8).astype(np.int32)
    delta = lambda a, b: (a * b.view(np.int8).astype(np.int32)) >> 5
    green = np.ascontiguousarray(out[..., 1])
    red = ((out[..., 2] + delta(each[..., 0], green)) & 255).astype(np.uint8)
    blue = (out[..., 0] + delta(each[..., 1], green) + delta(each[..., 2], red)) & 255
    out[..., 2], out[..., 0] = red, blue
    return out.reshape(-1, 4).view("<u4").reshape(-1)


def invert_green(pixels: np.ndarray) -> np.ndarray:
    out = channels(pixels).copy()
    out[:, 2] += out[:, 1]
    out[:, 0] += out[:, 1]
    return out.view("<u4").reshape(-1)


def invert_palette(pixels: np.ndarray, w: int, h: int, packing: int, table: np.ndarray) -> np.ndarray:
    """w: the width after unpacking; ``packing`` is the power of two of indices to a pixel."""
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if packing:
        each = 8 >> packing
        shifts = (np.arange(1 << packing) * each).astype(np.uint32)
        index = (index.reshape(h, -1, 1) >> shifts) & np.uint32((1 << each) - 1)
        index = index.reshape(h, -1)[:, :w].reshape(-1)
    whole = np.concatenate((table, np.zeros(256 - len(table), np.uint32)))
    return whole[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """h x w ARGB pixels of a VP8L chunk's data."""
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            image = read_pixels(bits, -(-now >> tile), -(-h >> tile), False)
            undo.append((invert_predictor if kind == PREDICTOR else invert_cross_colour, (now, h, tile, image)))
        elif kind == SUBTRACT_GREEN:
            undo.append((invert_green, ()))
        else:
            size = bits.read(8) + 1
            table = np.cumsum(channels(read_pixels(bits, size, 1, False)), axis=0, dtype=np.uint8).reshape(-1).view("<u4")
            packing = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((invert_palette, (now, h, packing, table)))
            now = -(-now >> packing)
    pixels = read_pixels(bits, now, h, True)
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    return pixels.reshape(h, w)


def streams_of(media: bytes) -> list[bytes]:
    """The VP8L streams of WebP files that stand one after the other."""
    at, out = 0, []
    while at < len(media):
        if len(media) - at < 20:
            raise ValueError("a file ends early")
        riff, size, webp, kind, n = struct.unpack_from("<4sI4s4sI", media, at)
        if (riff, webp, kind) != (b"RIFF", b"WEBP", b"VP8L") or at + 8 + size > len(media) or n + 12 > size:
            raise ValueError("not a simple lossless WebP file")
        out.append(media[at + 20 : at + 20 + n])
        at += 8 + size
    return out


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The images (height x width ARGB pixels) of VP8L streams, by many at a time where all they use is known there."""
    left, out = list(range(len(streams))), [None] * len(streams)
    while left:
        try:
            for i, image in zip(left, webp_batch.decode_streams([streams[i] for i in left])):
                out[i] = image
            break
        except webp_batch.Unknown as found:
            others = {left[k] for k in found.rows.tolist()}
            for i in others:
                out[i] = decode_vp8l(streams[i])
            left = [i for i in left if i not in others]
    return out


def payload_of(text: bytes) -> bytes:
    """The text padded by blanks to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The WebP files of each payload, one after the other."""
    rows = np.array([len(p) // ROW_BYTES for p in payloads])
    files = -(-rows // MAX_ROWS)
    ends = np.cumsum(files)
    heights = np.full(int(ends[-1]), MAX_ROWS)
    heights[ends - 1] = rows - (files - 1) * MAX_ROWS
    images = webp_batch.encode_images(np.frombuffer(b"".join(payloads), np.uint8), heights, ROW_PIXELS)
    return [b"".join(images[a:b]) for a, b in zip((ends - files).tolist(), ends.tolist())]


def decode_media(media: list[bytes]) -> list[list[np.ndarray]]:
    """The images of each row's files."""
    streams = [streams_of(m) for m in media]
    images = iter(decode_streams([s for own in streams for s in own]))
    return [[next(images) for _ in own] for own in streams]


def samples_of(images: list[np.ndarray]) -> np.ndarray:
    """RGB samples of images, one after the other."""
    return np.concatenate([channels(p)[..., 2::-1].reshape(-1) for p in images])


def feature_of(samples: np.ndarray) -> str:
    """Rows, the sum and sum of squares of each channel, and which of the 64 columns are brighter than the mean."""
    rows = samples.reshape(-1, ROW_BYTES).astype(np.float64)
    each, square = rows.sum(axis=0), np.einsum("ij,ij->j", rows, rows)
    sums, squares = (x.reshape(-1, 3).sum(axis=0).astype(np.int64).tolist() for x in (each, square))
    columns = each.reshape(-1, 3).sum(axis=1)
    brighter = np.packbits(columns * ROW_PIXELS > columns.sum()).tobytes().hex()
    return f"{len(rows)}:{','.join(map(str, sums))}:{','.join(map(str, squares))}:{brighter}"


def slices(batches, column: str, most: int, rows: int = 2048):
    """Batches of about ``most`` bytes of a column and at most ``rows`` rows."""
    for part in pieces(batches, column, most):
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def media_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text as lossless WebP bytes."""

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            raw = [text.as_buffer().to_pybytes() for text in batch.column("text")]
            media = encode_payloads([payload_of(r) for r in raw])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame) -> DataFrame:
    """The media table, written to the shared folder and read back."""
    return stored(media_table(docs), "media")


def pixel_table(table: DataFrame) -> DataFrame:
    """``doc_id, image, height, width, pixels``: every image of a media table as an array of ARGB pixels, row by row."""

    def run(batches):
        for batch in slices(batches, "media", 2 << 20):
            out: dict[str, list] = {c: [] for c in ("doc_id", "image", "height", "width", "pixels")}
            images = decode_media([m.as_buffer().to_pybytes() for m in batch.column("media")])
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), images):
                for k, pixels in enumerate(own):
                    for to, value in zip(out.values(), (doc_id, k, *pixels.shape, pixels.reshape(-1).view(np.int32))):
                        to.append(value)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    return table.select("doc_id", "media").mapInArrow(run, "doc_id long, image int, height int, width int, pixels array<int>")


def read_media(table: DataFrame) -> DataFrame:
    """Decode the stored bytes: the payload's size and digests, the media's size and digest, and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in slices(batches, "media", 2 << 20):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            media = [m.as_buffer().to_pybytes() for m in batch.column("media")]
            for raw, images in zip(media, decode_media(media)):
                samples = samples_of(images)
                payload = samples.tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(samples))
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | out)

    return table.mapInArrow(run, schema)
