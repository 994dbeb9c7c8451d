import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = words.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius):
    """fps: list of (id, value); returns id -> least id reachable."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in fps:
        for j, y in fps:
            if i < j and (x ^ y).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in fps}


def families(n=60, seed=1):
    draw = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(1, 900))]
        for _ in range(draw.choice([1, 1, 2, 8])):
            rows.append((i, " ".join(words)))
            i += 1
            words = list(words)
            words[draw.randrange(len(words))] = f"v{draw.randrange(9)}"
    draw.shuffle(rows)
    return rows


@pytest.fixture
def given_fingerprints(spark, monkeypatch):
    """near_duplicates over (id, fingerprint) rows."""

    def run(rows):
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        table = spark.createDataFrame([(i, [signed(v)]) for i, v in rows], "doc_id long, fp array<long>").repartition(3)
        monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: table)
        got = [(r.doc_id, r.fp[0] % (1 << 64), r.component_id) for r in simhash.near_duplicates(table).collect()]
        nodes = sorted({v for _, v in rows})
        comp = brute_components(list(enumerate(nodes)), 2)
        least: dict = {}
        for i, v in rows:
            root = comp[nodes.index(v)]
            least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
        key = lambda r: (r[1], r[0] is not None, r[0] or 0)
        assert sorted(got, key=key) == sorted([(i, v, least[comp[nodes.index(v)]]) for i, v in rows], key=key)

    return run


def test_a_row_without_an_id_links_two_others(given_fingerprints):
    f = 0x123456789ABCDEF0
    given_fingerprints([(1, f), (None, f ^ 0b11), (3, f ^ 0b1111)])
    given_fingerprints([(None, f), (None, f ^ 1), (7, ~f % (1 << 64))])


def test_unrelated_fingerprints_of_one_id(given_fingerprints):
    f, g = 0x0F0F0F0F12345678, 0xF0F0F0F087654321
    given_fingerprints([(3, f ^ 1), (5, f), (5, g), (9, g ^ 2)])


def test_thousands_of_rows_of_one_id(given_fingerprints):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(30)]
    given_fingerprints([(4, draw.choice(base) ^ (1 << draw.randrange(64))) for _ in range(3000)])


def test_table_by_brute_force(docs_of, odd_rows):
    rows = families() + [(i + 5000, t) for i, t in odd_rows]
    want = {i: brute_fingerprint(t) for i, t in rows}
    comp = brute_components(sorted(want.items()), 2)
    got = simhash.simhash_table(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{want[r.doc_id]:016x}" and r.component_id == comp[r.doc_id]
    assert len(set(comp.values())) < len(comp) - 20


def test_empty_and_null_ids(docs_of):
    assert simhash.simhash_table(docs_of([])).count() == 0
    got = simhash.simhash_table(docs_of([(None, "a b c"), (3, "a b c"), (None, "q"), (5, None)])).collect()
    assert sorted(map(str, [(r.doc_id, r.component_id) for r in got])) == sorted(map(str, [(None, 3), (3, 3), (None, None), (5, 5)]))


@pytest.mark.parametrize("radius,blocks,together", [(2, 3, 1), (5, 2, 1), (4, 1, 1), (3, 4, 1), (2, 5, 3), (4, 4, 2)])
def test_links_keep_every_component(spark, radius, blocks, together):
    """Also with overlapping boundaries: groups within which a pair may differ."""
    draw = random.Random(radius)
    fps = {}
    for _ in range(25):
        x = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 12])):
            for b in draw.sample(range(64), draw.randrange(radius + 2)):
                x ^= 1 << b
            fps.setdefault(x, len(fps))
    pairs = [(i, [x - (1 << 64) if x >> 63 else x]) for x, i in fps.items()]
    nodes = spark.createDataFrame(pairs, "node long, fp array<long>")
    links = simhash.near_links(nodes, radius, blocks, together, 3, shard_rows=8)
    got = {r.node: r.component for r in simhash.components(links).collect()}
    want = brute_components(sorted((i, x) for x, i in fps.items()), radius)
    assert {i: got.get(i, i) for i in want} == want
    assert all((x ^ y).bit_count() <= radius for x, y in [(dict((i, v) for v, i in fps.items())[r.a], dict((i, v) for v, i in fps.items())[r.b]) for r in links.collect()])


@pytest.mark.parametrize("radius", [0, 2, 9, 20])
def test_tree_by_brute_force(radius):
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 2**64, (40, 2), np.uint64)
    points = base[draw.integers(0, 40, 700)] ^ (np.uint64(1) << draw.integers(0, 64, (700, 2), np.uint64)) ^ (draw.integers(0, 2, (700, 2), np.uint64) << np.uint64(9))
    ids = [(i, int(a) << 64 | int(b)) for i, (a, b) in enumerate(points.tolist())]
    want = brute_components(ids, radius)
    links = simhash.tree_links(points, radius, leaf=8)
    assert len(links) == len(ids) - len(set(want.values()))
    root = {i: i for i, _ in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i, _ in ids} == want


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    assert {r.component for r in simhash.components(links).collect()} == {0}


def test_group_radius_by_brute_force():
    draw = random.Random(3)
    for blocks, together in ((3, 1), (5, 3), (2, 1), (1, 1), (4, 2)):
        masks = [m[0] for m in simhash.group_masks(64, blocks, together)]
        for radius in range(1, 7):
            bound = simhash.group_radius(radius, blocks, together)
            for _ in range(300):
                x = sum(1 << b for b in draw.sample(range(64), radius))
                assert min((x & m).bit_count() for m in masks) <= bound


def test_similar_documents_keep_one(docs_of):
    draw = random.Random(8)
    rows, want = [], set()
    for g in range(30):
        words = [f"w{draw.randrange(9999)}" for _ in range(draw.randrange(150, 400))]
        want.add(len(rows))
        rows.append((len(rows), " ".join(words)))
        for _ in range(g % 4):
            near = list(words)
            near[draw.randrange(len(near))] = "edited"
            rows.append((len(rows), " ".join(near)))
    out = simhash.keep_one(docs_of([*rows, (None, "no id"), (0, rows[0][1])]))
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(want)
    assert out.columns == docs_of([]).columns and out.where("doc_id is null").count() == 1
    assert simhash.keep_one(docs_of([])).count() == 0


def test_rows_of_one_id_are_documents(docs_of):
    draw = random.Random(2)
    for i in (None, 5):
        rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(1, 12)))) for _ in range(3000)]
        got = simhash.keep_one(docs_of([*rows, rows[0], (9, rows[1][1])])).collect()
        assert sorted(r.text for r in got) == sorted(t for _, t in rows)
        assert {r.doc_id for r in got if r.text == rows[1][1]} == {9 if i is None else 5}


def test_clashing_names(docs_of):
    rows = edited_rows(10, 2)
    docs = docs_of(rows)
    for c in ("id", "name", "size", "rest", "class", "node", "own", "late"):
        docs = docs.withColumn(c, docs.doc_id + 1)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and {(r.doc_id, r["class"]) for r in got.collect()} == {(i, i + 1) for i in brute_kept(rows)[0]}
    assert {r.doc_id for r in simhash.simhash_table(docs).collect()} == {r[0] for r in rows}


def brute_kept(rows):
    """Ids left over by linking all pairs of Jaccard similarity 0.8 or more, and the similarities."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := t.split()) or True}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = []
    for i in sets:
        for j in sets:
            if i < j:
                shared = len(sets[i] & sets[j])
                union = len(sets[i]) + len(sets[j]) - shared
                seen.append(shared / union)
                if 5 * shared >= 4 * union:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}, seen


def edited_rows(groups, copies, seed=12):
    """Groups of texts of 4 to 400 words with so many words of the first one replaced that J is about 0.7 to 0.95."""
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{draw.randrange(99999)}" for _ in range(draw.choice([4, 9, 30, 120, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(copies):
            near = list(words)
            if len(near) < 120:
                near += [f"w{draw.randrange(99999)}"] * draw.randrange(1, 1 + len(near) // 4)
            else:
                for k in draw.sample(range(len(near)), max(1, int(len(near) * draw.uniform(0.004, 0.033)))):
                    near[k] = "edited"
            rows.append((len(rows), " ".join(near)))
    return rows


@pytest.mark.parametrize("groups,copies", [(80, 4), (3, 70)])
def test_similar_documents_by_brute_force(docs_of, groups, copies):
    rows = edited_rows(groups, copies)
    want, seen = brute_kept(rows)
    assert sum(0.75 <= j < 0.8 for j in seen) > 20 and sum(0.8 <= j < 0.85 for j in seen) > 20
    assert {r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()} == want


def test_shards_in_parts_lose_no_pair(docs_of):
    rows = edited_rows(2, 60, 3)
    docs = simhash.numbered(docs_of(rows))
    links = simhash.components(simhash.similar_links(docs, simhash.shingle_sets(docs), shard_rows=8))
    want, _ = brute_kept(rows)
    sets = len({simhash.set_name(simhash.shingle_set(t.encode())) for _, t in rows})
    found = links.collect()
    assert sets - sum(r.node != r.component for r in found) == len(want)


def test_similar_sets_share_a_prefix_shingle():
    draw = np.random.default_rng(4)
    for _ in range(3000):
        both = np.unique(draw.integers(0, 2**64, draw.integers(1, 300), np.uint64))
        spare = len(both) // 4  # so many members outside the common ones leave a similarity of 0.8 at least
        cut = draw.integers(0, spare + 1)
        a, b = (np.unique(np.concatenate((both, draw.integers(0, 2**64, n, np.uint64)))) for n in (cut, spare - cut))
        common = np.sort(draw.permutation(both)[: draw.integers(0, len(both) + 1)])
        keys = [simhash.prefix(s, common, np.arange(len(common)) % 9 + 8) for s in (a, b)]
        assert len(np.intersect1d(*keys))
        differ = simhash.map_distance(simhash.full_map(a), simhash.full_map(b))
        assert simhash.may_be_similar(len(a), len(b), differ)


def test_links_do_not_follow_the_number_of_rows(docs_of):
    rows = edited_rows(1, 8, 5)
    more = [(1000 + k, f"other words of row {k} " + " ".join(str(k * j) for j in range(9))) for k in range(3000)]
    alone = {r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()}
    within = {r.doc_id for r in simhash.keep_one(docs_of(rows + more)).collect()}
    assert alone == {i for i in within if i < 1000} == brute_kept(rows)[0]


def test_shared_passages_make_no_pairs(docs_of, monkeypatch):
    """Long texts that share a passage are not similar: hardly any pair of them is compared by sets."""
    draw = random.Random(15)
    rows = []
    for g in range(30):
        passage = [f"p{g}w{k}" for k in range(60)]
        for _ in range(6):
            words = [f"w{draw.randrange(10**9)}" for _ in range(1500)]
            rows.append((len(rows), " ".join(words[:700] + passage + words[700:])))
    seen, inner = [], simhash.confirmed

    def counted(pairs, nodes, rows):
        seen.append(pairs.count())
        return inner(pairs, nodes, rows)

    monkeypatch.setattr(simhash, "confirmed", counted)
    assert simhash.keep_one(docs_of(rows)).count() == len(rows)
    assert sum(seen) < len(rows) // 2


def test_near_copies_come_through_simhash(docs_of):
    words = [f"w{k * 7919 % 10007}" for k in range(3000)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"x{k}" for k in range(500))]
    rows = simhash.numbered(docs_of(list(enumerate(texts))))
    nodes = simhash.stored(simhash.shingle_sets(rows).withColumn("row", simhash.F.struct(*simhash.KEY)), "nodes")
    names = [simhash.set_name(simhash.shingle_set(t.encode())) for t in texts]
    assert {frozenset((r.a, r.b)) for r in simhash.fingerprint_pairs(nodes).collect()} == {frozenset(names[:2])}


def test_rows_grow_with_members_not_pairs(docs_of, monkeypatch):
    """A large group of copies of one text, edited so that many pairs are about as similar as the limit."""
    draw = random.Random(21)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for k in draw.sample(range(len(words)), draw.randrange(1, 5)):
            words[k] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    inner, made = simhash.stored, []

    def counted(df, name):
        out = inner(df, name)
        if len(df.columns) == 2 and name in ("pairs", "links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    want, seen = brute_kept(rows)
    assert sum(0.75 <= j < 0.8 for j in seen) > 500 and len(want) > 1
    assert {r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()} == want
    assert max(made) <= 4 * len(rows)


def test_links_of_a_group_in_parts(spark):
    """Members of one group in many parts: every class that has a similar member elsewhere is linked, no other."""
    draw = random.Random(22)
    sets = []
    for _ in range(12):
        base = [draw.randrange(2**63) for _ in range(100)]
        for _ in range(10):
            sets.append(base[: 100 - draw.randrange(0, 22)] + [draw.randrange(2**63) for _ in range(draw.randrange(0, 4))])
    sets.append([])
    members = [(i % 2, i, i, len(s), sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(members, "key long, node long, class long, n long, members array<long>")
    joined = [set(s) for s in sets]
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 2, len(sets), 2) if 5 * len(joined[i] & joined[j]) >= 4 * len(joined[i] | joined[j]) > 0}
    forest = simhash.Forest()
    want = sum(forest.join(i, j) for i, j in sorted(similar))
    for kind in ({"shard_rows": 7}, {"shard_rows": 1000}, {"shard_rows": 1000, "shard_hashes": 300}):
        found = [(min(r), max(r)) for r in simhash.set_links(df, 4, **kind).collect()]
        assert set(found) <= similar
        forest = simhash.Forest()
        assert sum(forest.join(i, j) for i, j in found) == want


def test_component_rounds_take_few_stages(spark, monkeypatch):
    """Hubs of middling names, chains, rings, repeated and reversed links: right classes, from few stages a round."""
    draw = random.Random(23)
    names = [draw.randrange(-(2**63), 2**63) for _ in range(700)]
    links = [(names[0], n) for n in names[1:300]] + list(zip(names[300:340], names[301:340])) + [(names[400 + k], names[400 + (k + 1) % 50]) for k in range(50)]
    links += [tuple(draw.sample(names[450:], 2)) for _ in range(150)]
    links += [(b, a) for a, b in links[::3]] + [(n, n) for n in names[:5]]
    forest = simhash.Forest()
    for a, b in links:
        forest.join(a, b)
    want = {n: forest.find(n) for n in {x for a, b in links if a != b for x in (a, b)} if forest.find(n) != n}
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    inner, rounds = simhash.stored, []

    def counted(df, name):
        rounds.append(name)
        return inner(df, name)

    monkeypatch.setattr(simhash, "stored", counted)
    spark.sparkContext.setJobGroup("component rounds", "")
    try:
        found = simhash.components(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("component rounds") for s in tracker.getJobInfo(j).stageIds}
    ran = sum(bool((i := tracker.getStageInfo(s)) and i.numCompletedTasks) for s in stages)
    assert [(r.node, r.component) for r in found.sort("node").collect()] == sorted(want.items())
    assert ran <= 6 * len(rounds)
