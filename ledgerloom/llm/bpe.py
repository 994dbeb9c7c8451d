"""BPE encoding and decoding: merges in rank order through a priority queue over a doubly linked symbol list.

The vocabulary is read from a tokenizer file (``path``, never copied here) whose model is BPE with an
end-of-word suffix over byte letters, with NFC, white-space and lower-case normalisers.  Words repeat, so each
Python worker keeps the ids of words seen lately in a bounded two-generation cache; the rest is merged anew.

Defined results: a null text is encoded as the empty text (no ids, empty decoded text); repeated rows give
repeated results; an empty table gives an empty table; other columns of the input are left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.common import text_of

#: Words kept in each of the two cache generations of a worker.
CACHE_WORDS = 200_000
#: Longer words are encoded without being kept.
CACHE_WORD_CHARS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte value in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 0
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Bpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        # Pair of ids (20 bits each) -> rank (from bit 20) and the id that the pair becomes.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        letters = byte_letters()
        self.inner = {c: vocab.get(c) for c in letters}
        self.last = {c: vocab.get(c + self.suffix) for c in letters}
        self.letters = letters
        words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # The words of a Latin-1 text; other texts are normalised and cut by the library, whose Unicode tables count.
        self.words = re.compile(words.replace(r"\p{L}", "a-zªµºß-öø-ÿ").replace(r"\p{N}", "0-9²³¹¼-¾").replace(r"[^\s", r"[^ \t-\r\x85\xa0"))
        self.beyond = re.compile("[^\x00-\xff]")
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of a word in byte letters: lowest rank first, leftmost of equal rank first, stale entries skipped."""
        inner, find = self.inner, self.merges.get
        ids = [inner[c] for c in word]
        ids[-1] = self.last[word[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is rank, place and new id in one integer, so that the heap compares integers.
        found = [find(a << 20 | b) for a, b in zip(ids, ids[1:])]
        queue = [(m >> 20) << 52 | i << 20 | m & 0xFFFFF for i, m in enumerate(found) if m is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top >> 20 & 0xFFFFFFFF
            j = nxt[i]
            left = ids[i]
            if left < 0 or j >= n:
                continue
            m = find(left << 20 | ids[j])
            if m is None or m >> 20 != top >> 52:
                continue
            new = m & 0xFFFFF
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                m = find(new << 20 | ids[k])
                if m is not None:
                    heappush(queue, (m >> 20) << 52 | i << 20 | m & 0xFFFFF)
            h = prev[i]
            if h >= 0:
                m = find(ids[h] << 20 | new)
                if m is not None:
                    heappush(queue, (m >> 20) << 52 | h << 20 | m & 0xFFFFF)
        return [i for i in ids if i >= 0]

    def word(self, key: str) -> bytes:
        """Packed ids of a word, from the cache where it is known; a key in byte letters starts with a zero."""
        found = self.old.get(key)
        if found is None:
            letters = key[1:] if key[0] == "\0" else "".join([self.letters[b] for b in key.encode("utf-8")])
            found = np.array(self.merge(letters), "<u4").tobytes()
        if len(key) <= CACHE_WORD_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if "\0" in part or self.beyond.search(part):
                words = ["\0" + w for w, _ in self.cut(self.normalize(part))]
            else:
                words = self.words.findall(part.lower())
            get = self.young.get
            found = [get(w) for w in words]
            if None in found:
                word = self.word
                found = [f if f is not None else word(w) for f, w in zip(found, words)]
            out += found
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary strings of ids, joined as the tokenizer file says: by one space, as it names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in ids.tolist()])


@functools.lru_cache(maxsize=4)
def model(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, with ``ids`` and ``decoded`` on request."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches):
        bpe = model(path)
        for batch in batches:
            n, ids_sha, dec_sha, all_ids, all_dec = [], [], [], [], []
            for text in batch.column("text"):
                packed = bpe.encode(text.as_py())
                ids = np.frombuffer(packed, "<u4")
                decoded = bpe.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                dec_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_ids:
                    all_ids.append(ids.astype(np.int32))
                    all_dec.append(decoded)
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(dec_sha, pa.string())}
            if keep_ids:
                cols |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_dec, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
