import hashlib
import random

import duckdb
import pytest

from ledgerloom.llm import middle, queries


def want(doc_id, text):
    """The contract, letter by letter."""
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text))
    return (doc_id, n, "psm", a, b - a, sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r))


def check(docs_of, rows, parts=3):
    got = [tuple(r) for r in middle.middle_table(docs_of(rows, parts)).collect()]
    assert order(got) == order(want(*r[:2]) for r in rows)
    return got


def test_odd_rows(docs_of, odd_rows):
    check(docs_of, [*odd_rows, (None, "no id"), (None, None), (11, "a<P>b"), (12, "<S>"), (13, "<M"), (14, "P>"), (15, "<"), (16, "S>")])


def test_many_ids_give_every_form(docs_of):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice(["a", "é", "漢", "😀", "<", ">", "P", "S", "M", " ", "\n"]) for _ in range(draw.randrange(60)))) for i in range(3000)]
    got = check(docs_of, rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    # texts that lie side by side in a batch form no marker together
    check(docs_of, [(i, ["x<", "P>y", "<S", ">"][i % 4]) for i in range(400)], 1)


def test_texts_longer_than_a_slice(docs_of):
    check(docs_of, [(i, "é漢<>x" * 400_000) for i in range(4)], 2)


def test_empty_table_and_one_id(docs_of):
    check(docs_of, [])
    check(docs_of, [(None, f"text {i}") for i in range(3000)])


def test_rates(docs_of):
    rows = [(i, "some text") for i in range(200)]
    assert {r.form for r in middle.fill_in_middle(docs_of(rows), middle.Rates(rearranged=0)).collect()} == {"plain"}
    assert {r.form for r in middle.fill_in_middle(docs_of(rows), middle.Rates(100, 100)).collect()} == {"spm"}


def test_output_is_the_text(docs_of):
    (r,) = middle.restore(middle.fill_in_middle(docs_of([(4, "abcdefgh")]), middle.Rates(100, 0))).collect()
    a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
    t = "abcdefgh"
    assert r.output == f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" and r.restored == t


def test_restore_refuses_what_was_not_made(spark):
    bad = spark.createDataFrame([(1, 3, "psm", 0, 0, "abc")], middle.FILLED)
    with pytest.raises(Exception, match="one marker of each kind"):
        middle.restore(bad).collect()


def test_twin(docs_of, odd_rows):
    rows = [*odd_rows, *[(100 + i, f"é {i} <b> line\n" * (i % 7)) for i in range(300)]]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    assert order(con.execute(queries.OP11_SQL).fetchall()) == order(want(*r[:2]) for r in rows)
