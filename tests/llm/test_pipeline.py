import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from ledgerloom.llm import bpe, quality
from tests.llm.test_bpe import PATH, want
from tests.llm.test_substring import WINDOW


def corpus():
    """Clean documents, rejected ones, exact and near copies and a shared passage."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8)))
    passage = [word() for _ in range(70)]
    rows, marks = [], []
    for i in range(240):
        words = [word() for _ in range(draw.randrange(60, 160))]
        bad = i % 4 == 3
        if bad:
            words = [w.upper() + "!!" for w in words]
        elif i % 5 == 0:
            words[30:30] = passage
        rows.append((i, " ".join(words), f"s{i % 3}"))
        marks.append((i, 0 if bad else 1, 0))
    for k in range(40):
        i, text, source = rows[4 * k]
        rows.append((1000 + k, text if k % 2 else text + " more", source))
    return rows, marks


@pytest.fixture(scope="module")
def staged(spark, docs_of, tmp_path_factory):
    rows, marks = corpus()
    where = str(tmp_path_factory.mktemp("sf"))
    docs = docs_of([*rows, (None, None, None), (5000, "", "s1")])
    docs.drop("token").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    out = [[tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]]
    frames, docs = [], spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, where)
        docs.write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        frames.append(docs.columns)
        out.append([tuple(r) for r in docs.collect()])
    return where, marks, frames, out


def test_columns(staged):
    assert all(set(c) == set(cp.COLUMNS) for c in staged[2][:-1])


def test_quality_stage(spark, staged):
    where, marks, _, out = staged
    docs = spark.read.parquet(f"{where}/documents.parquet")
    model = quality.fit(docs, quality.not_held_out(spark.read.parquet(f"{where}/labels.parquet")))
    kept = {r.doc_id for r in quality.score(docs, model).collect() if r.quality_score >= cp.KEEP_FROM}
    assert {r[0] for r in out[1]} == kept
    bad = {i for i, q, _ in marks if q == 0}
    assert len(kept & bad) <= 2 and len([i for i, q, _ in marks if q and i not in kept]) <= 2


def test_near_copies_stage(staged):
    before, after = staged[3][1], staged[3][2]
    ids = {r[0] for r in before}
    copies = {1000 + k for k in range(40) if 4 * k in ids}
    if {None, 5000} <= ids:  # both texts are empty; the row without an id comes after all others
        copies.add(None)
    assert {r[0] for r in after} == ids - copies
    assert set(after) <= set(before)


def test_passages_stage(staged):
    before, after = staged[3][2], {r[0]: r for r in staged[3][3]}
    low = lambda i: -(2**63) if i is None else i
    first = {}
    for r in before:
        words = (r[1] or "").split()
        for k in range(len(words) - WINDOW + 1):
            key = tuple(words[k : k + WINDOW])
            first[key] = min(first.get(key, low(r[0])), low(r[0]))
    changed = 0
    for r in before:
        words = (r[1] or "").split()
        gone = {j for k in range(len(words) - WINDOW + 1) if first[tuple(words[k : k + WINDOW])] < low(r[0]) for j in range(k, k + WINDOW)}
        kept = r[1] if not gone else " ".join(w for j, w in enumerate(words) if j not in gone)
        if gone and not kept:
            assert r[0] not in after
        else:
            assert after[r[0]][1] == kept and after[r[0]][4] == (len(kept) if gone else r[4])
        changed += bool(gone)
    assert changed > 10


def test_mix_stage(staged):
    before, after = staged[3][3], staged[3][4]
    taken = Counter(r[0] for r in after)
    assert max(taken.values()) <= 3 and set(after) <= set(before)
    words = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert abs(words(after) / words(before) - 1) < 0.05
    assert len(taken) < len(before) or max(taken.values()) > 1


def test_tokens_stage(staged):
    before, after = staged[3][4], staged[3][5]
    assert sorted(map(str, after)) == sorted(str((r[0], *want(r[1]))) for r in before)
    assert bpe.model(PATH)


def test_rows_of_one_id_through_the_stages(spark, docs_of):
    """Thousands of different documents of one id or none, with columns of clashing names: none is lost or mixed up."""
    draw = random.Random(11)
    for i in (None, 7):
        rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(1, 14))), f"s{k % 3}") for k in range(2000)]
        docs = docs_of(rows)
        for c in ("id", "name", "size", "rest", "class", "copies", "copy", "rate", "x"):
            docs = docs.withColumn(c, docs.text)
        near = cp.drop_near_copies(spark, docs, "")
        assert near.columns == list(cp.COLUMNS) and sorted(r.text for r in near.collect()) == sorted(r[1] for r in rows)
        assert sorted(r.text for r in cp.drop_passages(spark, docs, "").collect()) == sorted(r[1] for r in rows)
        mixed = cp.mix_sources(spark, docs, "").collect()
        words = lambda texts: sum(len(t.split()) for t in texts)
        assert abs(words(r.text for r in mixed) / words(r[1] for r in rows) - 1) < 0.02
        source = {r[1]: r[2] for r in rows}
        assert all(source[r.text] == r.source for r in mixed) and max(Counter(r.text for r in mixed).values()) <= 3
        assert cp.encode(spark, docs, "").count() == len(rows)


def test_run_and_empty_table(spark, docs_of, staged, tmp_path):
    assert sorted(map(str, map(tuple, cp.run(spark, staged[0]).collect()))) == sorted(map(str, staged[3][5]))
    docs_of([]).drop("token").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
