"""Token ids as Arrow files of fixed-size lists: equal-length sequences and masks with zero-copy random access.

Documents are ranged by ``doc_id`` over partitions.  Each task packs its documents' ids back to back into rows of
``length`` ids and writes one or more shards in Arrow's file format (a stream plus a footer, so that any batch is
found by position and mapped without a copy):

* ``<shard>.arrow``: ``ids`` fixed-size list of unsigned integers, ``mask`` fixed-size list of booleans (false:
  padding, only in a shard's last row);
* ``<shard>.docs.arrow``: ``doc_id``, ``first`` (place of its first id in the shard), ``n_tokens``.

Every attempt of a task names its shards anew, and the stored table of shards lists those of the attempts that counted; a
retried or doubled task leaves files that nothing reads.  A shard holds at most about ``shard_tokens`` ids (one document
more), which bounds a task's memory.  Ranges are of the id and a hash of the text, so that many rows of one id, or without
one, spread over tasks.

Defined results: a null text is the empty text and yields the end id only; rows with a null ``doc_id`` come first;
rows of equal ``doc_id`` are ordered by the hash of their text; an empty table gives no shards; other columns are left out.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.bpe import byte_letters
from ledgerloom.llm.common import shared_dir, stored, text_of, width

#: Words kept in each of the two cache generations of a worker.
CACHE_WORDS = 450_000
CACHE_WORD_CHARS = 64
ROWS_PER_BATCH = 1024

# Latin-1 letters, numbers and white space; texts beyond them go to the library whole.
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", " \t-\r\x85\xa0"


class LibraryEncoder:
    """The tokenizers library, asked once for each word of a worker's cache.

    Byte-level tokenizers cut a text into words by a fixed pattern and encode each word alone, so a word's ids can be
    kept.  Texts with a special token or with letters beyond Latin-1 are encoded whole by the library.
    """

    def __init__(self, path: str, dtype: str):
        self.dtype = dtype
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
        self.letters = dict(enumerate(byte_letters()))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            lettered = word.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.library.model.tokenize(lettered)]
            found = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def by_words(self, text: str) -> bool:
        """Whether the text is Latin-1 without special tokens and without those controls that are no white space here."""
        for s in self.special:
            if s in text:
                return False
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, b"\x00\x1c\x1d\x1e\x1f")) == len(raw)

    def encode(self, text: str) -> bytes:
        if not self.by_words(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        words = self.words.findall(text)
        get = self.young.get
        found = [get(w) for w in words]
        if None in found:
            word = self.word
            found = [f if f is not None else word(w) for f, w in zip(found, words)]
        return b"".join(found)


@functools.lru_cache(maxsize=4)
def encoder(path: str, dtype: str) -> LibraryEncoder:
    return LibraryEncoder(path, dtype)


def write_file(where: str, batches, schema: pa.Schema) -> None:
    """Write an Arrow file; its name must be new."""
    store, path = fs.FileSystem.from_uri(where)
    with store.open_output_stream(path) as out, pa.ipc.new_file(out, schema) as writer:
        for batch in batches:
            writer.write_batch(batch)


def open_file(where: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to an Arrow file; local files are mapped, so that batches are views of them."""
    store, path = fs.FileSystem.from_uri(where)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


def write_shard(where: str, tokens: np.ndarray, length: int, docs: pa.RecordBatch) -> None:
    """One shard: the ids in rows of ``length``, the last one padded and masked, and the list of its documents."""
    rows = -(-len(tokens) // length)
    padded = np.zeros(rows * length, tokens.dtype)
    padded[: len(tokens)] = tokens
    mask = np.arange(rows * length) < len(tokens)
    kinds = pa.from_numpy_dtype(tokens.dtype)
    schema = pa.schema([("ids", pa.list_(kinds, length)), ("mask", pa.list_(pa.bool_(), length))])

    def batches():
        for i in range(0, rows, ROWS_PER_BATCH):
            part = slice(i * length, min(rows, i + ROWS_PER_BATCH) * length)
            ids, seen = pa.array(padded[part]), pa.array(mask[part])
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(ids, length), pa.FixedSizeListArray.from_arrays(seen, length)], schema=schema)

    write_file(f"{where}.arrow", batches(), schema)
    write_file(f"{where}.docs.arrow", [docs], docs.schema)


def read_shard(where: str) -> tuple[np.ndarray, pa.RecordBatch]:
    """The ids of a shard without padding, and its documents."""
    reader = open_file(f"{where}.arrow")
    parts = []
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids, mask = batch.column(0).flatten(), batch.column(1).flatten()
        kept = ids.to_numpy(zero_copy_only=True)
        if i == reader.num_record_batches - 1:
            kept = kept[mask.to_numpy(zero_copy_only=False)]
        parts.append(kept)
    docs = open_file(f"{where}.docs.arrow").get_batch(0)
    return np.concatenate(parts), docs


def write_part(batches, where: str, part: int, path: str, end_id: int, length: int, shard_tokens: int, dtype: str):
    """An attempt at one range of documents: writes its shards and yields a row for each."""
    enc = encoder(path, dtype)
    end, attempt = np.array([end_id], dtype).tobytes(), uuid.uuid4().hex
    seq = total = 0
    ids: list[bytes] = []
    names: list = []
    sizes: list[int] = []

    def flush():
        tokens = np.frombuffer(b"".join(ids), dtype)
        n = np.array(sizes, np.int64)
        table = pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "first": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n)})
        name = f"{where}/part-{part:06d}-{seq:05d}-{attempt}"
        write_shard(name, tokens, length, table)
        return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [name], "n_tokens": [len(tokens)], "n_docs": [len(names)]})

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            packed = enc.encode(text.as_py()) + end
            ids.append(packed)
            names.append(doc_id)
            sizes.append(len(packed) // np.dtype(dtype).itemsize)
            total += sizes[-1]
            if total >= shard_tokens:
                yield flush()
                seq, total, ids, names, sizes = seq + 1, 0, [], [], []
    if names:
        yield flush()


def write_tokens(docs: DataFrame, path: str, end_id: int, length: int = 1024, shard_tokens: int = 1 << 22, dtype: str = "<u2") -> DataFrame:
    """Encode every text, append ``end_id``, write the shards; returns their table (part, seq, path, n_tokens, n_docs).

    ``dtype`` must hold every id of the vocabulary: two bytes for up to 65,536 ids.
    """
    spark = docs.sparkSession
    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store, folder = fs.FileSystem.from_uri(where)
    store.create_dir(folder, recursive=True)

    def run(batches):
        return write_part(batches, where, TaskContext.get().partitionId(), path, end_id, length, shard_tokens, dtype)

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("name", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(width(docs), "doc_id", "name").sortWithinPartitions("doc_id", "name").select("doc_id", "text")
    return stored(ranged.mapInArrow(run, "part long, seq long, path string, n_tokens long, n_docs long"), "shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Read the shards back: each document's place in the whole order, its number of ids and their crc32.

    The running total over shards is one window over the small table of shards, not over documents.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        for batch in batches:
            for where, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist()):
                tokens, docs = read_shard(where)
                first, n = docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                crc = [zlib.crc32(tokens[a : a + k].astype("<u4").tobytes()) for a, k in zip(first.tolist(), n.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": docs.column("doc_id"), "start": pa.array(first + offset), "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.repartition(width(shards), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
