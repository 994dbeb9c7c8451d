import hashlib
import heapq
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import webp, webp_batch

# A plain encoder of whole streams, with every part of the format.


class BitWriter:
    """Bits to a byte string, lowest first."""

    def __init__(self):
        self.word, self.n = 0, 0

    def write(self, value, n):
        self.word |= int(value) << self.n
        self.n += n

    def bytes(self):
        return self.word.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts, alphabet):
    lengths = [0] * alphabet
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    if len(heap) == 1:
        lengths[heap[0][2][0]] = 1
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], k := k + 1, a[2] + b[2]))
    return lengths


def canonical(lengths):
    out, code = {}, 0
    for n in range(1, 16):
        for s, m in enumerate(lengths):
            if m == n:
                out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
                code += 1
        code <<= 1
    if len(out) == 1:
        out = {s: (0, 0) for s in out}
    return out


def put_code(w, lengths):
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (used or [0])[0] < 256:
        w.write(0b101, 3)
        w.write((used or [0])[0], 8)
        return
    w.write(0, 1)
    w.write(15, 4)
    for s in webp.LENGTH_ORDER:
        w.write(4 if s < 16 else 0, 3)
    w.write(0, 1)
    for n in lengths:
        w.write(int(f"{n:04b}"[::-1], 2), 4)


def prefix_of(value):
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), n, v & ((1 << n) - 1)


def put_image(w, pixels, width, main, cache_bits=0, copies=False, tile=0):
    """Literals, copies of earlier runs and cache hits; with ``tile`` two groups of codes in turn."""
    pixels = [int(p) for p in pixels]
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    tokens, cache, seen, i = [], {}, {}, 0
    while i < len(pixels):
        key, n = tuple(pixels[i : i + 3]), 0
        at = seen.get(key)
        if copies and at is not None:
            while i + n < len(pixels) and n < 4096 and pixels[i + n] == pixels[at + n]:
                n += 1
        slot = (webp.CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if n >= 3:
            x, y = (i - at) % width, (i - at) // width
            near = [k for k, (a, b) in enumerate(webp.NEIGHBOURS) if (a, b) == (x, y)]
            tokens.append((i, "copy", n, near[0] + 1 if near else i - at + 120))
        elif slot is not None and cache.get(slot) == pixels[i]:
            tokens.append((i, "cache", slot, 0))
            n = 1
        else:
            tokens.append((i, "lit", pixels[i], 0))
            n = 1
        for k in range(i, i + n):
            if cache_bits:
                cache[(webp.CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            seen[tuple(pixels[k : k + 3])] = k
        i += n
    group = lambda i: 0
    if main:
        w.write(1 if tile else 0, 1)
        if tile:
            w.write(tile - 2, 3)
            tw, th = -(-width >> tile), -(-(len(pixels) // width) >> tile)
            put_image(w, [(k % 2) << 8 for k in range(tw * th)], tw, False)
            group = lambda i: ((i // width >> tile) * tw + (i % width >> tile)) % 2
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    n_groups = 2 if tile else 1
    counts = [[Counter() for _ in range(5)] for _ in range(n_groups)]
    for i, kind, a, b in tokens:
        c = counts[group(i)]
        if kind == "lit":
            for k, s in ((0, a >> 8), (1, a >> 16), (2, a), (3, a >> 24)):
                c[k][s & 255] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + prefix_of(a)[0]] += 1
            c[4][prefix_of(b)[0]] += 1
    codes = []
    for c in counts:
        codes.append([])
        for k in range(5):
            if len(c[k]) == 1 and next(iter(c[k])) >= 256:
                c[k][0] += 1
            lengths = code_lengths(c[k] or Counter({0: 1}), sizes[k])
            put_code(w, lengths)
            codes[-1].append(canonical(lengths))
    for i, kind, a, b in tokens:
        c = codes[group(i)]
        if kind == "lit":
            for k, s in ((0, a >> 8), (1, a >> 16), (2, a), (3, a >> 24)):
                w.write(*c[k][s & 255])
        elif kind == "cache":
            w.write(*c[0][280 + a])
        else:
            for k, v in ((0, a), (4, b)):
                p, n, bits = prefix_of(v)
                w.write(*c[k][p + 256 * (k == 0)])
                w.write(bits, n)


def stream(pixels, transforms=(), **kw):
    h, width = pixels.shape
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(h - 1, 14)
    w.write(1, 4)
    flat, now = pixels.reshape(-1).astype(np.uint32), width
    for kind, *args in transforms:
        w.write(1, 1)
        w.write(kind, 2)
        if kind == webp.SUBTRACT_GREEN:
            c = webp.channels(flat).copy()
            c[:, 0] -= c[:, 1]
            c[:, 2] -= c[:, 1]
            flat = c.reshape(-1).view("<u4")
        elif kind == webp.PREDICTOR:
            tile = 2
            tw, th = -(-now >> tile), -(-h >> tile)
            modes = np.array([(k + args[0]) % 14 << 8 for k in range(tw * th)], np.uint32)
            w.write(0, 3)
            put_image(w, modes, tw, False)
            c, out = webp.channels(flat.reshape(h, now)).astype(int), []
            for y in range(h):
                for x in range(now):
                    if y == 0:
                        p = c[y, x - 1] if x else [0, 0, 0, 255]
                    elif x == 0:
                        p = c[y - 1, 0]
                    else:
                        right = c[y - 1, x + 1] if x + 1 < now else c[y, 0]
                        p = webp.predict(int(modes[(y >> 2) * tw + (x >> 2)] >> 8), *(v.tolist() for v in (c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])))
                    out.append((c[y, x] - np.array(p)) & 255)
            flat = np.array(out, np.uint8).reshape(-1).view("<u4")
        elif kind == webp.CROSS_COLOUR:
            tw, th = -(-now >> 2), -(-h >> 2)
            rng = np.random.default_rng(1)
            elements = rng.integers(0, 1 << 24, tw * th, np.uint32)
            w.write(0, 3)
            put_image(w, elements, tw, False)
            c = webp.channels(flat.reshape(h, now)).copy()
            s8 = lambda v: int(v) - 256 * (v > 127)
            for y in range(h):
                for x in range(now):
                    e = int(elements[(y >> 2) * tw + (x >> 2)])
                    b, g, r = (int(v) for v in c[y, x, :3])
                    b -= (s8(e >> 8 & 255) * s8(g) >> 5) + (s8(e >> 16 & 255) * s8(r) >> 5)
                    r -= s8(e & 255) * s8(g) >> 5
                    c[y, x, 0], c[y, x, 2] = b & 255, r & 255
            flat = c.reshape(-1).view("<u4")
        else:
            table = np.unique(flat)
            w.write(len(table) - 1, 8)
            diffs = np.diff(webp.channels(table), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            put_image(w, diffs.reshape(-1).view("<u4"), len(table), False)
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index, each = np.searchsorted(table, flat).reshape(h, now), 8 >> pack
            now2 = -(-now >> pack)
            packed = np.zeros((h, now2), np.uint32)
            for x in range(now):
                packed[:, x >> pack] |= (index[:, x] << (each * (x % (1 << pack)))).astype(np.uint32)
            flat, now = (packed << 8).reshape(-1).astype(np.uint32), now2
    w.write(0, 1)
    put_image(w, flat, now, True, **kw)
    return w.bytes()


def picture(h, w, colours, seed=0):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 2**32, colours, np.uint32)
    rows = table[rng.integers(0, colours, (h, w))]
    rows[h // 2 :] = rows[: h - h // 2]
    return rows


CASES = [
    ((), {}),
    ((), {"cache_bits": 4}),
    ((), {"copies": True}),
    ((), {"copies": True, "cache_bits": 6, "tile": 2}),
    (((webp.SUBTRACT_GREEN,),), {}),
    (((webp.CROSS_COLOUR,),), {}),
    (((webp_batch.PALETTE,),), {"copies": True}),
    *[(((webp.PREDICTOR, k),), {}) for k in range(14)],
    (((webp.PREDICTOR, 3), (webp.CROSS_COLOUR,), (webp.SUBTRACT_GREEN,)), {"copies": True, "cache_bits": 3}),
    (((webp_batch.PALETTE,), (webp.PREDICTOR, 5)), {}),
]


@pytest.mark.parametrize("transforms,kw", CASES)
@pytest.mark.parametrize("colours", [2, 3, 11, 90])
def test_decoder_inverts_every_part(transforms, kw, colours):
    pixels = picture(13, 21, colours)
    assert np.array_equal(webp.decode_vp8l(stream(pixels, transforms, **kw)), pixels)


def test_one_colour():
    pixels = np.full((5, 7), 0xFF102030, np.uint32)
    assert np.array_equal(webp.decode_vp8l(stream(pixels)), pixels)


@pytest.mark.parametrize("transforms,kw", CASES)
def test_many_at_a_time_agrees(transforms, kw):
    """Streams of one kind beside others, some of which only the pixel-by-pixel decoder knows."""
    pixels = [picture(h, w, colours, seed) for seed, (h, w, colours) in enumerate([(13, 21, 9), (1, 64, 2), (32, 64, 300), (7, 5, 40), (2, 3, 3)])]
    streams = [stream(p, transforms if k % 2 else (), **(kw if k % 2 else {"copies": True})) for k, p in enumerate(pixels)]
    for got, want in zip(webp.decode_streams(streams), pixels):
        assert np.array_equal(got, want)


def both_decoders(payload):
    (media,) = webp.encode_payloads([payload])
    assert struct.unpack_from("<4sI", media)[1] + 8 <= len(media)
    streams = webp.streams_of(media)
    many, single = webp_batch.decode_streams(streams), [webp.decode_vp8l(s) for s in streams]
    assert webp.samples_of(many).tobytes() == webp.samples_of(single).tobytes() == payload
    return media


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=2000), st.text(max_size=900).map(str.encode), st.text("ab ", max_size=3000).map(str.encode)))
def test_payload_round_trip(raw):
    payload = webp.payload_of(raw)
    assert len(payload) % 192 == 0 and payload.startswith(raw)
    both_decoders(payload)


def test_long_payload_is_several_files():
    payload = webp.payload_of(bytes(range(97, 122)) * 2000)
    assert len(webp.streams_of(both_decoders(payload))) == -(-len(payload) // (192 * webp.MAX_ROWS)) > 5


def prose(draw, words):
    common = [f"{a}{b}" for a in ("th", "an", "wor", "s", "que") for b in ("e", "d", "ld", "tion", "ing")]
    return " ".join(draw.choice(common) if draw.random() < 0.7 else "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(words))


def test_files_use_every_part_and_are_small(monkeypatch):
    """What the query stores has codes of unlike lengths, back-references, cache symbols and palettes."""
    seen, kinds = Counter(), Counter()
    read = webp.Prefix.read

    def counted(self, bits):
        symbol = read(self, bits)
        if len(self.lengths) >= 280:
            seen["literal" if symbol < 256 else "copy" if symbol < 280 else "cache"] += 1
            kinds[len({n for n in self.lengths if n})] += 1
        return symbol

    monkeypatch.setattr(webp.Prefix, "read", counted)
    palettes = []
    invert = webp.invert_palette
    monkeypatch.setattr(webp, "invert_palette", lambda *a: palettes.append(a[3]) or invert(*a))
    draw = random.Random(1)
    texts = [prose(draw, draw.randrange(1, 900)) for _ in range(30)] + ["", "one line of it again and again\n" * 40, "ab" * 500]
    payloads = [webp.payload_of(t.encode()) for t in texts]
    media = [both_decoders(p) for p in payloads]
    assert min(seen["literal"], seen["copy"], seen["cache"]) > 200
    assert sum(n for k, n in kinds.items() if k > 3) > 1000
    assert {p for p in palettes} >= {0, 3} and len(palettes) >= 3
    # Six bits a byte is what packing the letters would take.
    assert sum(map(len, media)) < 0.6 * sum(map(len, payloads))
    assert webp.encode_payloads(payloads) == [webp.encode_payloads([p])[0] for p in payloads]


def test_code_lengths_are_the_best_within_the_limit():
    draw = np.random.default_rng(3)
    counts = draw.geometric(0.02, (40, 60)) * draw.integers(0, 2, (40, 60))
    counts[0], counts[1] = 0, 0
    counts[0, 7], counts[1, :12] = 5, [2**k for k in range(12)]
    counts[2, :2] = 0
    got = webp_batch.code_lengths(counts, 9)
    for row, own in zip(counts.tolist(), got.tolist()):
        used = {s: n for s, n in enumerate(row) if n}
        assert {s for s, n in enumerate(own) if n} == set(used) and max(own) <= 9
        if len(used) > 1:
            assert sum(2.0**-n for n in own if n) == 1
            best = code_lengths(used, 60)
            if max(best) <= 9:
                assert sum(row[s] * own[s] for s in used) == sum(row[s] * best[s] for s in used)


def test_damaged_streams_are_refused():
    payload = webp.payload_of(prose(random.Random(2), 300).encode())
    (media,) = webp.encode_payloads([payload])
    (data,) = webp.streams_of(media)
    for cut in (3, 30, len(data) // 2, len(data) - 3):
        for decode in (webp.decode_vp8l, lambda d: webp.decode_streams([d])):
            with pytest.raises(ValueError):
                decode(data[:cut])
    for cut in (1, 19, 40):
        with pytest.raises(ValueError):
            webp.streams_of(media[:-cut])
    with pytest.raises(ValueError):
        webp.streams_of(b"JUNK" + media[4:])

    def header(w):
        for value, n in ((0x2F, 8), (3, 14), (0, 14), (1, 4), (0, 1), (0, 1), (0, 1)):
            w.write(value, n)

    before, empty = BitWriter(), BitWriter()
    header(before)  # the only green symbol is a copy of one pixel, which nothing stands before
    put_code(before, [0] * 256 + [1, 1] + [0] * 22)
    for symbol in (0, 0, 255, 0):
        before.write(0b101 | symbol << 3, 11)
    before.write(0, 64)
    header(empty)
    put_code_plain(empty, [0] * 280)
    empty.write(0, 400)
    for w in (before, empty):
        for decode in (webp.decode_vp8l, lambda d: webp.decode_streams([d])):
            with pytest.raises(ValueError):
                decode(w.bytes())


def put_code_plain(w, lengths):
    """Lengths of 4 bits each, whatever they are."""
    w.write(0, 1)
    w.write(15, 4)
    for s in webp.LENGTH_ORDER:
        w.write(4 if s < 16 else 0, 3)
    w.write(0, 1)
    for n in lengths:
        w.write(int(f"{n:04b}"[::-1], 2), 4)


def test_pixels_of_stored_media(docs_of, odd_rows):
    table = webp.stored_media(docs_of(odd_rows))
    got = webp.pixel_table(table).orderBy("doc_id", "image").collect()
    text = "a b c d e f g h i j " * 4000
    own = [r for r in got if r.doc_id == 5]
    assert [r.image for r in own] == list(range(len(own))) and all(r.width == 64 and r.height * 64 == len(r.pixels) for r in own)
    pixels = np.array([p for r in own for p in r.pixels], np.int32).view(np.uint32)
    assert webp.samples_of([pixels.reshape(-1, 64)]).tobytes() == webp.payload_of(text.encode())


def test_query_on_odd_rows(docs_of, odd_rows):
    got = {(r.doc_id, r.payload_sha256): r for r in webp.read_media(webp.media_table(docs_of(odd_rows))).collect()}
    for doc_id, text in odd_rows:
        payload = webp.payload_of((text or "").encode())
        row = got[(doc_id, hashlib.sha256(payload).hexdigest())]
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len((text or "").encode()), len(payload), zlib.crc32(payload[-16:]))
    assert webp.read_media(webp.media_table(docs_of([]))).count() == 0
