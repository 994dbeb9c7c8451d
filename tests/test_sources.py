import datetime as dt

import pytest

from ledgerloom.operators.seeds import Rule, active_rules
from ledgerloom.sources import tables


def test_seed_with_commas_quotes_and_patterns(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('rule_id,pattern,notes\nR1,"^[a-z]{2,}$","says ""hi"", twice"\nR2,,\n')
    rows = tables.read_seed(spark, str(tmp_path / "rules.csv"), "rule_id string, pattern string, notes string").collect()
    assert [tuple(r) for r in rows] == [("R1", "^[a-z]{2,}$", 'says "hi", twice'), ("R2", None, None)]


def test_evidence_and_parquet_round_trip(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"m":"x","pct_credit":0.5,"cats":[{"value":null,"count":3}]}\n{"m":"y"}\n')
    df = tables.read_evidence(spark, str(tmp_path / "e.json"))
    tables.save(df, str(tmp_path / "p"))
    rows = {r.m: r for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert rows["x"].cats[0]["count"] == 3 and rows["x"].cats[0]["value"] is None and rows["y"].cats is None


def test_ranked_csv_is_in_order(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 9), ("c", 9)], "merchant string, volume long").repartition(3)
    tables.write_ranked_csv(df, str(tmp_path / "r"), "volume", "merchant")
    assert [r.merchant for r in spark.read.csv(str(tmp_path / "r"), header=True).coalesce(1).collect()] == ["b", "c", "a"]


def test_chat_file(spark, tmp_path):
    df = spark.createDataFrame([("m: x", None, 2.5, "credit", "fuel"), (None, "d", None, "debit", "rent")], "merchant string, description string, amount double, direction string, leaf string")
    tables.write_chat(df, str(tmp_path / "c"), "say")
    rows = sorted(map(tuple, tables.parse_chat(spark.read.text(str(tmp_path / "c"))).collect()))
    assert rows == [("m: x", "n/a", 2.5, 1, "fuel"), ("n/a", "d", 0.0, 0, "rent")]


def test_incremental_overwrite_replaces_recent_days_only(spark, tmp_path):
    path, day = str(tmp_path / "t"), dt.date(2024, 3, 1)
    rows = lambda tag, days: spark.createDataFrame([(tag, day + dt.timedelta(d)) for d in days], "tag string, day date")
    tables.incremental_overwrite(rows("old", range(20)), path, "day")
    tables.incremental_overwrite(rows("new", range(5, 25)), path, "day")
    got = {r.day: r.tag for r in spark.read.parquet(path).collect()}
    assert len(got) == 25
    assert all(got[day + dt.timedelta(d)] == ("old" if d < 12 else "new") for d in range(25))


def test_upsert_keeps_old_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, tables.upsert_predictions(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_active_rules_are_enabled_and_in_order():
    rules = [Rule("R2", 5, "merchant", "regex", "x", "a"), Rule("R1", 5, "merchant", "regex", "x", "a"), Rule("R0", 1, "merchant", "regex", "x", "a", enabled=False)]
    assert [r.rule_id for r in active_rules(rules)] == ["R1", "R2"]


def test_bad_path_is_not_swallowed(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "junk.parquet").write_bytes(b"junk")
    with pytest.raises(Exception, match="(?i)parquet|magic|cannot"):
        tables.incremental_overwrite(spark.createDataFrame([("x", dt.date(2024, 1, 1))], "tag string, day date"), str(tmp_path / "t"), "day")
