"""Lossless WebP for many images at once: an encoder, and a decoder that reads one symbol of every image at a step.

The encoder works on images of up to 64 x 64 pixels.  Each gets a palette where it has few colours (at most 256, each
standing twice on average), else its pixels as they are.  Runs of pixels that stood before become back-references,
other pixels whose colour the colour cache holds become cache symbols, the rest literals.  Every channel has a prefix
code of its own, of least total length among those of at most ``LIMIT`` bits (nearly so where that bound binds).

The decoder holds the bit position of every image in an array and looks symbols up in tables of ``LIMIT`` bits.
Streams that use what it does not know (predictors, colour transforms, groups of prefix codes, longer codes) are told
apart by their headers and left to the pixel-by-pixel decoder.
"""

from __future__ import annotations

import struct

import numpy as np

from ledgerloom.llm.common import mix64

#: Fixed values of the format: order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: the 120 near neighbours (columns left, rows up) that short distance codes mean.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0),
    (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1),
    (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5),
    (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7),
    (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Fixed values of the format.
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS = 256, 24
#: Bits of the longest prefix code that is written, and that the table lookup knows.
LIMIT, LENGTH_LIMIT = 10, 7
#: Shortest back-reference, and bits of the colour cache of images of at least so many pixels.
MIN_COPY, CACHE_BITS, CACHE_FROM = 3, 8, 256
STRIDES = (LITERALS + LENGTHS + (1 << CACHE_BITS), 256, 256, 256, 40)

u64 = np.uint64


def reversed_bits(n: int) -> np.ndarray:
    """The numbers of ``n`` bits, each with its bits in reverse order."""
    values = np.arange(1 << n)
    out = np.zeros_like(values)
    for i in range(n):
        out |= (values >> i & 1) << (n - 1 - i)
    return out


_REVERSED = [reversed_bits(n) for n in range(LIMIT + 1)]


def merge_depths(counts: np.ndarray) -> np.ndarray:
    """Code length of every used symbol of every row of counts, by merging the two least in all rows at once.

    Leaves in order of count and merged nodes in order of making are two queues; a step takes the lesser head twice.
    """
    rows, width = counts.shape
    used = (counts > 0).sum(axis=1)
    by = np.argsort(-used, kind="stable")
    inf = np.int64(1) << np.int64(60)
    key = np.where(counts > 0, counts, inf)[by]
    order = np.argsort(key, axis=1, kind="stable")
    m, most = used[by], int(used.max(initial=0))
    leaf = np.concatenate((np.take_along_axis(key, order, axis=1)[:, :most], np.full((rows, 1), inf)), axis=1)
    node = np.full((rows, most + 1), inf)
    of_leaf, of_node = np.zeros((rows, most + 1), np.int64), np.zeros((rows, most + 1), np.int64)
    at_leaf, at_node = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    live_at = np.searchsorted(-m, -np.arange(2, most + 1), "right")  # rows with more than k + 1 symbols come first
    for k, live in enumerate(live_at.tolist()):
        row = np.arange(live)
        total = np.zeros(live, np.int64)
        for _ in range(2):
            i, j = at_leaf[:live], at_node[:live]
            a, b = leaf[row, i], node[row, j]
            from_leaf = a <= b
            total += np.where(from_leaf, a, b)
            pick = np.flatnonzero(from_leaf)
            of_leaf[pick, i[pick]] = k
            at_leaf[pick] += 1
            pick = np.flatnonzero(~from_leaf)
            of_node[pick, j[pick]] = k
            at_node[pick] += 1
        node[:live, k] = total
    depth = np.zeros((rows, most + 1), np.int64)
    for k in range(most - 3, -1, -1):
        live = int(live_at[k + 1]) if k + 1 < len(live_at) else 0
        row = np.arange(live)
        depth[row, k] = depth[row, of_node[row, k]] + 1
    sorted_lengths = np.take_along_axis(depth, of_leaf[:, :most], axis=1) + 1
    sorted_lengths[np.arange(most)[None, :] >= m[:, None]] = 0
    out = np.zeros((rows, width), np.int64)
    place = np.zeros((rows, width), np.int64)
    np.put_along_axis(place, order[:, :most], sorted_lengths, axis=1)
    out[by] = place
    return out


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of at most ``limit`` bits; small counts are raised where the best code would be longer."""
    out = merge_depths(counts)
    low = 1
    while True:
        wrong = np.flatnonzero(out.max(axis=1) > limit)
        if not len(wrong):
            return out
        low *= 2
        raised = np.where(counts[wrong] > 0, np.maximum(counts[wrong], low), 0)
        out[wrong] = merge_depths(raised)


def canonical(lengths: np.ndarray, limit: int):
    """Used symbols of every row in order of code: row, symbol, length as stored, bits as written, and first table place."""
    row, symbol = np.nonzero(lengths)
    length = lengths[row, symbol]
    order = np.argsort(row * 16 + length, kind="stable")
    row, symbol, length = row[order], symbol[order], length[order]
    alone = np.bincount(row, minlength=len(lengths))[row] == 1
    bits = np.where(alone, 0, length)
    share = np.int64(1) << (limit - bits)
    before = np.cumsum(share) - share
    start = before - before[np.searchsorted(row, row)]
    return row, symbol, length, bits, share, start


def tables(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For every row the symbol (times 16) and bits that the next ``limit`` bits of a stream mean."""
    row, symbol, _, bits, share, _ = canonical(lengths, limit)
    if (np.bincount(row, share, len(lengths)) != 1 << limit).any():
        raise ValueError("a prefix code is not complete")
    return np.repeat((symbol << 4 | bits).astype(np.int32), share).reshape(len(lengths), -1)[:, _REVERSED[limit]]


def codes(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and bits of every symbol of every row, as the stream has them (lowest bit first)."""
    row, symbol, _, bits, _, start = canonical(lengths, limit)
    code, size = np.zeros(lengths.shape, np.int64), np.zeros(lengths.shape, np.int64)
    code[row, symbol] = _REVERSED[limit][np.minimum(start, (1 << limit) - 1)]
    size[row, symbol] = bits
    return code & ((1 << size) - 1), size


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and these bits of lengths or distances from 1 on."""
    v = values - 1
    high = np.zeros(len(v), np.int64)
    big = v >= 4
    high[big] = np.floor(np.log2(v[big] + 0.5)).astype(np.int64) - 1
    return np.where(big, 2 * high + 2 + (v >> high & 1), v), high, np.where(big, v & ((1 << high) - 1), 0)


def distance_codes(width: int) -> np.ndarray:
    """Code of each distance below 4,096 + 1 in an image of the width."""
    out = np.arange(4097) + 120
    for k, (x, y) in reversed(list(enumerate(NEIGHBOURS))):
        far = max(1, x + y * width)
        if far < len(out):
            out[far] = k + 1
    return out


def earlier(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place before each one that has its key (a small number), if its value is the same there too; else -1."""
    order = np.argsort(keys, kind="stable")  # linear for keys of 16 bits
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return np.where((out >= 0) & (values[np.maximum(out, 0)] == values), out, -1)


class Tokens:
    """Bit strings (image, order within the image, value, bits) that are put together at the end."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, image, phase, value, bits):
        n = len(value)
        self.parts.append(tuple(np.broadcast_to(np.asarray(x, np.int64), n) for x in (image * 16 + phase, value, bits)))

    def streams(self, images: int) -> list[bytes]:
        place, value, bits = (np.concatenate(x) for x in zip(*self.parts))
        used = np.flatnonzero(bits)
        place, value, bits = place[used], value[used], bits[used]
        order = np.argsort(place.astype(np.uint16) if images <= 4096 else place, kind="stable")  # linear for 16 bits
        image, value, bits = place[order] >> 4, value[order].astype(u64), bits[order]
        sizes = np.bincount(image, bits, images).astype(np.int64)
        whole = (sizes + 7) // 8
        first = np.concatenate(([0], np.cumsum(whole)))
        ends = np.cumsum(bits)
        at = ends - bits - np.concatenate(([0], np.cumsum(sizes)))[image] + 8 * first[image]
        words = np.zeros(int(first[-1]) // 4 + 4)
        for part, shift in ((value & u64(0xFFFFFFFF), 0), (value >> u64(32), 32)):
            word = (at + shift) >> 5
            moved = part << (at & 31).astype(u64)
            words += np.bincount(word, (moved & u64(0xFFFFFFFF)).astype(float), len(words))
            words += np.bincount(word + 1, (moved >> u64(32)).astype(float), len(words))
        out = words.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def put_images(out: Tokens, pixels: np.ndarray, first: np.ndarray, image: np.ndarray, widths: np.ndarray, phase: int, main: bool, cache: bool) -> None:
    """Entropy-code images (pixels one after the other) as bits of ``image`` from ``phase`` on."""
    n = len(first) - 1
    sizes = np.diff(first)
    unit = np.repeat(np.arange(n), sizes)
    place = np.arange(len(pixels))
    cached = (sizes >= CACHE_FROM) if cache else np.zeros(n, bool)
    # Runs of pixels that stood before: pairs of pixels, then maximal runs of pairs at one distance.
    after = np.concatenate((pixels[1:], pixels[:1]))
    pair = pixels.astype(u64) << u64(32) | after.astype(u64)
    # Pairs meet by 16 bits of their hash; where two share these, at worst a back-reference is not seen.
    back = earlier((mix64(pair) >> u64(48)).astype(np.uint16), pair)
    back = np.where((place + 1 < first[1:][unit]) & (back >= first[:-1][unit]), back, -1)
    far = np.where(back >= 0, place - back, 0)
    head = np.flatnonzero((far > 0) & np.concatenate(([True], far[1:] != far[:-1])))
    tail = np.flatnonzero((far > 0) & np.concatenate((far[1:] != far[:-1], [True]))) + 1
    touches = np.concatenate((head[1:], [len(pixels) + 1]))[: len(tail)] == tail
    length = tail - head + ~touches
    chosen = length >= MIN_COPY
    head, length = head[chosen], length[chosen]
    covered = np.zeros(len(pixels) + 1, np.int64)
    covered[head] += 1
    np.subtract.at(covered, head + length, 1)
    covered = np.cumsum(covered[:-1]) > 0
    slot = (pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)
    hit = (earlier(slot.astype(np.uint8), pixels) >= first[:-1][unit]) & cached[unit] & ~covered
    literal = np.flatnonzero(~covered & ~hit)
    hit = np.flatnonzero(hit)
    # Symbols of each channel: green (with lengths and cache slots), red, blue, alpha, distance.
    distance = np.zeros(len(head), np.int64)
    for w in np.unique(widths):
        own = widths[unit[head]] == w
        distance[own] = distance_codes(int(w))[far[head[own]]]
    long_p, long_n, long_x = prefix_of(length)
    far_p, far_n, far_x = prefix_of(distance)
    lit = [(pixels[literal] >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
    symbols = [
        (np.concatenate((unit[literal], unit[head], unit[hit])), np.concatenate((lit[0], LITERALS + long_p, LITERALS + LENGTHS + slot[hit].astype(np.int64)))),
        *[(unit[literal], s) for s in lit[1:]],
        (unit[head], far_p),
    ]
    alphabets = [LITERALS + LENGTHS + np.where(cached, 1 << CACHE_BITS, 0), *[np.full(n, a) for a in STRIDES[1:]]]
    out.add(image, phase, cached.astype(np.int64) | np.where(cached, CACHE_BITS << 1, 0), np.where(cached, 5, 1) + main)
    books = []
    for (of, symbol), stride, alphabet in zip(symbols, STRIDES, alphabets):
        counts = np.bincount(of * stride + symbol, minlength=n * stride).reshape(n, stride)
        counts[:, 0] += counts.sum(axis=1) == 0  # a channel that no pixel needs has symbol 0
        lengths = code_lengths(counts, LIMIT)
        phase += 1
        put_lengths(out, lengths, alphabet, image, phase)
        books.append(codes(lengths, LIMIT))

    def joined(parts):
        """One value and its bits of several (value, bits), lowest first."""
        value, bits = np.zeros(len(parts[0][0]), np.int64), np.zeros(len(parts[0][0]), np.int64)
        for v, b in parts:
            value, bits = value | v << bits, bits + b
        return value, bits

    book = lambda k, of, symbol: (books[k][0][of, symbol], books[k][1][of, symbol])
    value, bits = np.zeros(len(pixels), np.int64), np.zeros(len(pixels), np.int64)
    value[literal], bits[literal] = joined([book(k, unit[literal], lit[k]) for k in range(4)])
    value[hit], bits[hit] = book(0, unit[hit], LITERALS + LENGTHS + slot[hit].astype(np.int64))
    value[head], bits[head] = joined([book(0, unit[head], LITERALS + long_p), (long_x, long_n), book(4, unit[head], far_p), (far_x, far_n)])
    out.add(image[unit], phase + 1, value, bits)


def put_lengths(out: Tokens, lengths: np.ndarray, alphabet: np.ndarray, image: np.ndarray, phase: int) -> None:
    """Store the code lengths of every row: one symbol by itself, more as lengths and runs of zeros under a code."""
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=len(lengths))
    single = used == 1
    lone = symbol[single[row]]
    out.add(image[single], phase, 0b101 | lone << 3, np.full(len(lone), 11))
    keep = ~single[row]
    row, symbol = row[keep], symbol[keep]
    if not len(row):
        return
    rows = np.flatnonzero(~single)
    # Zeros before each used symbol, and after the last one of a row.
    fresh = np.concatenate(([True], row[1:] != row[:-1]))
    zeros = symbol - np.where(fresh, 0, np.concatenate(([0], symbol[:-1])) + 1)
    last = np.flatnonzero(np.concatenate((fresh[1:], [True])))
    at = np.insert(row, last + 1, row[last])
    zeros = np.insert(zeros, last + 1, alphabet[row[last]] - symbol[last] - 1)
    value = np.insert(lengths[row, symbol], last + 1, -1)
    full, rest = zeros // 138, zeros % 138
    # Up to three full runs, the rest of a run, a second single zero, the length.
    kind = np.stack([np.where(full > k, 18, -1) for k in range(3)] + [np.where(rest >= 11, 18, np.where(rest >= 3, 17, np.where(rest > 0, 0, -1))), np.where(rest == 2, 0, -1), value], axis=1)
    extra = np.zeros(kind.shape, np.int64)
    extra[:, :3] = 127
    extra[:, 3] = np.where(rest >= 11, rest - 11, np.where(rest >= 3, rest - 3, 0))
    at, kind, extra = np.repeat(at, 6), kind.reshape(-1), extra.reshape(-1)
    seen = kind >= 0
    at, kind, extra = at[seen], kind[seen], extra[seen]
    extra_bits = np.where(kind == 18, 7, np.where(kind == 17, 3, 0))
    extra = np.where(extra_bits > 0, extra, 0)
    own = code_lengths(np.bincount(at * 19 + kind, minlength=len(lengths) * 19).reshape(-1, 19), LENGTH_LIMIT)
    code, size = codes(own, LENGTH_LIMIT)
    stored = own[rows][:, LENGTH_ORDER]
    count = np.maximum(4, 19 - np.argmax(stored[:, ::-1] > 0, axis=1))
    out.add(image[rows], phase, (count - 4) << 1, np.full(len(rows), 5))
    which = np.repeat(np.arange(len(rows)), 19)
    inside = np.tile(np.arange(19), len(rows)) < count[which]
    out.add(image[rows][which], phase, stored.reshape(-1), np.where(inside, 3, 0))
    out.add(image[rows], phase, np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64))
    out.add(image[at], phase, code[at, kind] | extra << size[at, kind], size[at, kind] + extra_bits)


def encode_images(samples: np.ndarray, heights: np.ndarray, width: int) -> list[bytes]:
    """WebP files of images of RGB samples (rows of ``width`` pixels, image after image) with the given heights."""
    rgb = samples.reshape(-1, 3).astype(np.uint32)
    pixels = np.uint32(0xFF000000) | rgb[:, 0] << np.uint32(16) | rgb[:, 1] << np.uint32(8) | rgb[:, 2]
    n = len(heights)
    sizes = heights * width
    first = np.concatenate(([0], np.cumsum(sizes)))
    image = np.repeat(np.arange(n), sizes)
    out = Tokens()
    every = np.arange(n)
    out.add(every, 0, 0x2F | (width - 1) << 8 | (heights - 1) << 22, np.full(n, 40))
    # An image has at least as many colours as 12-bit hashes of them; where these are few, the colours are counted.
    seen = np.zeros(n << 12, bool)
    seen[image << 12 | ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(20)).astype(np.int64)] = True
    least = seen.reshape(n, -1).sum(axis=1)
    maybe = (least <= 256) & (2 * least <= sizes)
    among = np.flatnonzero(maybe[image])
    colours, found = np.unique(image[among].astype(np.int64) << 32 | pixels[among], return_inverse=True)
    owner = colours >> 32
    count = np.bincount(owner, minlength=n)
    start = np.concatenate(([0], np.cumsum(count)))
    small = maybe & (count <= 256) & (2 * count <= sizes)
    # Palettes: the transform, its colours as differences, then the indices, several in a pixel where there are few.
    chosen = np.flatnonzero(small)
    if len(chosen):
        out.add(chosen, 1, 1 | PALETTE << 1 | (count[chosen] - 1) << 3, np.full(len(chosen), 11))
        own = small[owner]
        table = (colours[own] & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)
        heads = np.concatenate(([0], np.cumsum(count[chosen])))
        diff = table - np.concatenate((np.zeros((1, 4), np.uint8), table[:-1]))
        diff[heads[:-1]] = table[heads[:-1]]
        put_images(out, diff.reshape(-1).view("<u4"), heads, chosen, count[chosen], 2, False, False)
    out.add(every, 9, np.zeros(n, np.int64), np.ones(n, np.int64))
    local = np.zeros(len(pixels), np.int64)
    local[among] = found - start[image[among]]
    packing = np.where(small, np.where(count <= 2, 3, np.where(count <= 4, 2, np.where(count <= 16, 1, 0))), 0)
    for pack in range(4):
        for palette in (True, False):
            group = np.flatnonzero((packing == pack) & (small == palette))
            if not len(group):
                continue
            member = np.zeros(n, bool)
            member[group] = True
            own = slice(None) if len(group) == n else member[image]
            if palette:
                packed = (local[own].reshape(-1, width >> pack, 1 << pack) << np.arange(1 << pack) * (8 >> pack)).sum(axis=2).reshape(-1)
                values = np.uint32(0xFF000000) | (packed << 8).astype(np.uint32)
            else:
                values = pixels[own]
            heads = np.concatenate(([0], np.cumsum(sizes[group] >> pack)))
            put_images(out, values, heads, group, np.full(len(group), width >> pack), 9, True, not palette)
    files = []
    for data in out.streams(n):
        pad = len(data) & 1
        files.append(struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + b"\0" * pad)
    return files


class Unknown(Exception):
    """Rows of a batch whose streams are for the other decoder."""

    def __init__(self, rows):
        super().__init__("streams for the pixel-by-pixel decoder")
        self.rows = rows


class Reader:
    """Bit positions in many streams that stand one after the other in a buffer."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.buffer = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
        self.words = np.ndarray(len(self.buffer) - 7, "<u8", self.buffer, strides=(1,))
        ends = np.cumsum(sizes)
        self.at, self.end = 8 * (ends - sizes), 8 * ends

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position on; beyond the buffer's end the last ones again."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (at & 7).astype(u64)

    def read(self, rows: np.ndarray, bits) -> np.ndarray:
        bits = np.broadcast_to(np.asarray(bits, np.int64), len(rows))
        out = self.peek(self.at[rows]) & ((u64(1) << bits.astype(u64)) - u64(1))
        self.at[rows] += bits
        return out.astype(np.int64)


def need(rows: np.ndarray, known: np.ndarray) -> None:
    if not known.all():
        raise Unknown(rows[~known])


def read_lengths(bits: Reader, rows: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The code lengths of one channel of every row."""
    n = len(rows)
    out = np.zeros((n, int(alphabet.max(initial=1)) + 1), np.int64)
    every = np.arange(n)
    simple = bits.read(rows, 1) == 1
    own = every[simple]
    if len(own):
        two = bits.read(rows[own], 1) == 1
        wide = bits.read(rows[own], 1)
        out[own, bits.read(rows[own], 1 + 7 * wide)] = 1
        out[own[two], bits.read(rows[own[two]], 8)] = 1
    own = every[~simple]
    if len(own):
        left_rows = rows[own]
        count = 4 + bits.read(left_rows, 4)
        lengths = np.zeros((len(own), 19), np.int64)
        for k, symbol in enumerate(LENGTH_ORDER):
            inside = count > k
            lengths[inside, symbol] = bits.read(left_rows[inside], 3)
        need(left_rows, lengths.any(axis=1))
        table = tables(lengths, LENGTH_LIMIT)
        left = alphabet[own].copy()
        bounded = np.flatnonzero(bits.read(left_rows, 1))
        if len(bounded):
            left[bounded] = 2 + bits.read(left_rows[bounded], 2 + 2 * bits.read(left_rows[bounded], 3))
        at, last, live = np.zeros(len(own), np.int64), np.full(len(own), 8), np.arange(len(own))
        found: list[tuple] = []
        while len(live):
            window = bits.peek(bits.at[left_rows[live]])
            entry = table[live, (window & u64(127)).astype(np.int64)]
            size, symbol = entry & 15, entry >> 4
            extra = np.where(symbol == 16, 2, np.where(symbol == 17, 3, np.where(symbol == 18, 7, 0)))
            more = ((window >> size.astype(u64)) & ((u64(1) << extra.astype(u64)) - u64(1))).astype(np.int64)
            bits.at[left_rows[live]] += size + extra
            plain = symbol < 16
            value = np.where(plain, symbol, np.where(symbol == 16, last[live], 0))
            times = np.where(plain, 1, np.where(symbol == 18, 11, 3) + more)
            last[live] = np.where(plain & (symbol > 0), symbol, last[live])
            put = value > 0
            found.append((own[live[put]], at[live[put]], times[put], value[put]))
            at[live] += times
            left[live] -= 1
            live = live[(at[live] < alphabet[own[live]]) & (left[live] > 0)]
        row, start, times, value = (np.concatenate(x) for x in zip(*found))
        owner = np.repeat(np.arange(len(row)), times)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        out[row[owner], np.minimum(start[owner] + offset, out.shape[1] - 1)] = value[owner]
    return out[:, :-1]


#: Extra bits and least value of lengths or distances of each prefix.
_EXTRA = np.array([max(0, (p - 2) >> 1) for p in range(40)])
_LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << _EXTRA[p]) + 1 for p in range(40)])


def extra_of(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _EXTRA[prefix], _LEAST[prefix]


def read_images(bits: Reader, rows: np.ndarray, widths: np.ndarray, heights: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of an entropy-coded image of every row, one after the other, and the first pixel of each."""
    n = len(rows)
    cached = bits.read(rows, 1) == 1
    cache_bits = np.zeros(n, np.int64)
    cache_bits[cached] = bits.read(rows[cached], 4)
    if main:
        need(rows, bits.read(rows, 1) == 0)
    books, wide = [], []  # a table for each channel, as wide as its longest code
    for k in range(5):
        alphabet = LITERALS + LENGTHS + np.where(cached, 1 << cache_bits, 0) if k == 0 else np.full(n, STRIDES[k])
        lengths = read_lengths(bits, rows, alphabet)
        most = lengths.max(axis=1)
        need(rows, (most <= LIMIT) & (most > 0))
        wide.append(int(most.max()))
        books.append(tables(lengths, wide[-1]).reshape(-1))
    sizes = widths * heights
    first = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(first[-1]), np.uint32)
    stride = 1 << int(cache_bits.max(initial=0))
    cache = np.zeros(n * stride if cached.any() else 1, np.uint32)
    shift = (32 - cache_bits).astype(np.uint32)
    far_x, far_y = (np.array([0, *v]) for v in zip(*NEIGHBOURS))
    at, end, live = first[:-1].copy(), first[1:], np.arange(n)
    masks = [u64((1 << w) - 1) for w in wide]
    position = bits.at[rows]
    limit = bits.end[rows]

    def remember(row, pixel):
        own = cached[row]
        row, pixel = row[own], pixel[own]
        cache[row * stride + ((pixel * np.uint32(CACHE_FACTOR)) >> shift[row])] = pixel

    while len(live):
        pos = position[live]
        window = bits.peek(pos)
        entry = books[0][(live << wide[0]) + (window & masks[0]).view(np.int64)]
        used, symbol = entry & 15, entry >> 4
        window = window >> used.astype(u64)
        pixel = np.zeros(len(live), np.uint32)
        literal = symbol < LITERALS
        k = slice(None) if literal.all() else np.flatnonzero(literal)
        value, own, eaten = symbol[k].astype(np.uint32) << np.uint32(8), window[k], used[k]
        row = live[k]
        for book, place in ((1, 16), (2, 0), (3, 24)):
            entry = books[book][(row << wide[book]) + (own & masks[book]).view(np.int64)]
            size = entry & 15
            value |= (entry >> 4).astype(np.uint32) << np.uint32(place)
            own = own >> size.astype(u64)
            eaten = eaten + size
        pixel[k] = value
        used[k] = eaten
        steps = 1
        if not isinstance(k, slice):
            k = np.flatnonzero(symbol >= LITERALS + LENGTHS)
            pixel[k] = cache[live[k] * stride + symbol[k] - (LITERALS + LENGTHS)]
            k = np.flatnonzero((symbol >= LITERALS) & (symbol < LITERALS + LENGTHS))
            if len(k):
                row, own = live[k], window[k]
                more, least = extra_of(symbol[k] - LITERALS)
                length = least + (own & ((u64(1) << more.astype(u64)) - u64(1))).astype(np.int64)
                own = own >> more.astype(u64)
                entry = books[4][(row << wide[4]) + (own & masks[4]).view(np.int64)]
                size = entry & 15
                own = own >> size.astype(u64)
                bits_far, least = extra_of(entry >> 4)
                code = least + (own & ((u64(1) << bits_far.astype(u64)) - u64(1))).astype(np.int64)
                used[k] += more + size + bits_far
                near = np.minimum(code, 120)
                far = np.where(code > 120, code - 120, np.maximum(1, far_x[near] + far_y[near] * widths[row]))
                if (far > at[row] - first[row]).any() or (length > end[row] - at[row]).any():
                    raise ValueError("a back-reference leaves the image")
                owner = np.repeat(np.arange(len(k)), length)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
                copied = out[at[row][owner] - far[owner] + step % far[owner]]
                out[at[row][owner] + step] = copied
                remember(row[owner], copied)
                steps = np.ones(len(live), np.int64)
                steps[k] = length
                single = np.ones(len(live), bool)
                single[k] = False
                out[at[live[single]]] = pixel[single]
                remember(live[single], pixel[single])
        if isinstance(steps, int):
            out[at[live]] = pixel
            if len(cache) > 1:
                remember(live, pixel)
        pos = pos + used
        if (pos > limit[live]).any():
            raise ValueError("a stream ends early")
        position[live] = pos
        at[live] += steps
        live = live[at[live] < end[live]]
    bits.at[rows] = position
    return out, first


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels (height x width) of VP8L streams; raises ``Unknown`` with the rows that need the other decoder."""
    bits = Reader(streams)
    n = len(streams)
    rows = np.arange(n)
    head = bits.read(rows, 40)
    if ((head & 0xFF) != 0x2F).any() or (head >> 37 & 7).any() or (bits.at > bits.end).any():
        raise ValueError("not a VP8L stream")
    widths, heights = (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1
    changed = bits.read(rows, 1) == 1
    kind = np.zeros(n, np.int64)
    kind[changed] = bits.read(rows[changed], 2)
    need(rows, ~changed | (kind == PALETTE))
    palette = rows[changed]
    packing = np.zeros(n, np.int64)
    table = starts = None
    if len(palette):
        count = bits.read(palette, 8) + 1
        values, starts = read_images(bits, palette, count, np.ones(len(palette), np.int64), False)
        diff = values.astype("<u4").view(np.uint8).reshape(-1, 4).astype(np.int64)
        total = np.cumsum(diff, axis=0)
        total -= np.repeat(np.concatenate((np.zeros((1, 4), np.int64), total))[starts[:-1]], count, axis=0)
        table = np.concatenate(((total & 255).astype(np.uint8).reshape(-1).view("<u4"), np.zeros(1, np.uint32)))
        packing[palette] = np.where(count <= 2, 3, np.where(count <= 4, 2, np.where(count <= 16, 1, 0)))
        need(palette, bits.read(palette, 1) == 0)
    now = -(-widths >> packing)
    pixels, first = read_images(bits, rows, now, heights, True)
    out = [pixels[a:b].reshape(h, w) for a, b, h, w in zip(first[:-1], first[1:], heights, now)]
    for k, i in enumerate(palette.tolist()):
        index, pack = (out[i] >> np.uint32(8)) & np.uint32(255), int(packing[i])
        if pack:
            each = 8 >> pack
            index = ((index[:, :, None] >> (np.arange(1 << pack) * each).astype(np.uint32)) & np.uint32((1 << each) - 1)).reshape(len(index), -1)[:, : widths[i]]
        inside = index < count[k]
        out[i] = np.where(inside, table[np.where(inside, starts[k] + index, len(table) - 1)], np.uint32(0))
    return out
