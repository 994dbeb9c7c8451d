import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from tokenizers import Tokenizer

from ledgerloom.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def want(rows):
    out, start = [], 0
    name = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  signed order
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, name(r[1]))):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(docs_of, rows, **kw):
    shards = token_files.write_tokens(docs_of(rows), PATH, 2, **kw)
    got = sorted(map(tuple, token_files.read_tokens(shards).collect()), key=lambda r: r[1])
    assert got == want(rows)
    return shards


def test_round_trip_on_odd_rows(docs_of, odd_rows):
    check(docs_of, [*odd_rows, (None, "no id")])


def test_many_shards_and_short_rows(docs_of, odd_rows):
    shards = check(docs_of, odd_rows, length=16, shard_tokens=20)
    assert shards.count() > 5


def test_random_characters(docs_of):
    draw = random.Random(5)
    rows = [(i, "".join(chr(draw.choice([draw.randrange(256), draw.randrange(256), 32, 39, 115, draw.randrange(0x2FFF)])) for _ in range(80))) for i in range(150)]
    rows += [(1000 + i, "".join(chr(draw.choice([draw.randrange(1, 256), 32, 39, 116])) for _ in range(80))) for i in range(150)]
    check(docs_of, rows)


def test_rows_of_one_id_spread_over_ranges(docs_of):
    for own in (None, 4):
        shards = check(docs_of, [(own, f"text {i}") for i in range(3000)] + [(9, "last")])
        sizes = [r.n_docs for r in shards.collect()]
        assert len(sizes) >= 6 and max(sizes) < 1000


def test_a_failed_attempt_leaves_what_counts_alone(docs_of, spark, tmp_path):
    """The first attempt ends after one shard; the second writes all of the range beside what is left of it."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": ["a b c d", "e f", "g"]})
    attempt = lambda: token_files.write_part([batch], f"file://{tmp_path}", 0, PATH, 2, 8, 3, "<u2")
    failed = next(attempt())
    rows = [r for b in attempt() for r in b.to_pylist()]
    assert len(rows) > 1 and failed.column("path")[0].as_py() not in {r["path"] for r in rows}
    shards = spark.createDataFrame([tuple(r.values()) for r in rows], "part long, seq long, path string, n_tokens long, n_docs long")
    got = sorted(map(tuple, token_files.read_tokens(shards).collect()), key=lambda r: r[1])
    assert got == want([(1, "a b c d"), (2, "e f"), (3, "g")])


def test_clashing_names(docs_of):
    docs = docs_of([(1, "one text"), (2, "two")])
    for c in ("name", "part", "path", "seq"):
        docs = docs.withColumn(c, docs.text)
    assert token_files.read_tokens(token_files.write_tokens(docs, PATH, 2)).count() == 2


def test_empty_table(docs_of):
    check(docs_of, [])


def test_file_layout(docs_of):
    (shard,) = token_files.write_tokens(docs_of([(1, "hello world " * 9)], 1), PATH, 2, length=8).collect()
    reader = token_files.open_file(shard.path + ".arrow")
    batch = reader.get_batch(0)
    assert batch.schema.field("ids").type.list_size == 8 and batch.num_rows == 3
    assert sum(map(sum, batch.column("mask").to_pylist())) == shard.n_tokens
