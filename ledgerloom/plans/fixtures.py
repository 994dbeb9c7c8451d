"""Adapters that turn the given tables into the feeds and label tables the operators work on.

Each table is one SELECT in the dialect that Spark and DuckDB share, with ``{name}`` for the tables it reads; Spark runs
it by ``spark.sql`` with DataFrames for the names, DuckDB as a common table expression in front of a twin.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.seeds import Rule, parse_sources
from ledgerloom.operators.waterfall import Seeds

_TYPES = {"ECONOMY": "Gambling and Betting - Online", "LARGE": "Identified Salary", "MEDIUM": "Refund", "PROMO": "Shopping", "SMALL": "Bills"}
_PRI = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " ELSE 'Leisure' END"
_SUBS = {1: "Council", 2: "Taxis", 3: "Delivery", 4: "Recruitment Services", 5: "Groceries", 6: "Fuel", 7: "Streaming", 8: "Rent", 13: "Council Tax", 14: "Loans"}
_SUB = "CASE p_brand " + " ".join(f"WHEN 'Brand#{k}' THEN '{v}'" for k, v in _SUBS.items()) + " WHEN 'Brand#9' THEN NULL WHEN 'Brand#10' THEN NULL ELSE p_brand END"
_NAME = "p_name || ' ' || CAST(p_partkey % 10 AS VARCHAR(4))"
_LINES = "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey"

#: leaf, general, necessity, flow, debt, priority, age, risk, recurring, sources of feed A, sources of feed B
TAXONOMY = [
    ("salary", "income", "none", "income", "false", "false", "false", "", "true", "primary:Identified Salary", ""),
    ("salary_gig", "income", "none", "income", "false", "false", "false", "", "true", "primary:Identified Salary + sub:Taxis|Delivery", ""),
    ("income_agency_work", "income", "none", "income", "false", "false", "false", "", "true", "primary:Identified Salary + sub:Recruitment Services", ""),
    ("refund_received", "income", "none", "refund", "false", "false", "false", "", "", "primary:Refund", "STANDARD_5-LOW"),
    ("gambling_unspecified", "gambling", "discretionary", "expense", "false", "false", "true", "high", "", "primary:Gambling and Betting - Online", "ENTERTAINMENT_CASINOS_AND_GAMBLING"),
    ("gambling_betting", "gambling", "discretionary", "expense", "false", "false", "true", "high", "", "", ""),
    ("groceries", "essentials", "essential", "expense", "false", "false", "false", "", "", "Groceries", "LARGE_1-URGENT;LARGE_2-HIGH"),
    ("fuel", "essentials", "essential", "expense", "false", "false", "false", "", "", "Fuel", "SMALL_1-URGENT"),
    ("rent", "housing", "essential", "expense", "false", "true", "false", "", "", "Rent", "SMALL_2-HIGH"),
    ("council_tax", "housing", "essential", "expense", "false", "true", "false", "", "", "Council Tax;primary:(null)", "SMALL_3-MEDIUM"),
    ("loan_repayment", "debt", "essential", "debt", "true", "false", "false", "medium", "", "Loans", "MEDIUM_1-URGENT"),
    ("debt_collection", "debt", "essential", "debt", "true", "true", "false", "high", "", "", "MEDIUM_2-HIGH"),
    ("streaming", "leisure", "discretionary", "expense", "false", "false", "false", "", "", "Streaming", "PROMO_1-URGENT"),
    ("leisure_other", "leisure", "discretionary", "expense", "false", "false", "false", "", "", "primary:Leisure", "PROMO_2-HIGH"),
    ("shopping_other", "shopping", "discretionary", "expense", "false", "false", "false", "", "", "primary:Shopping", "STANDARD_1-URGENT;STANDARD_2-HIGH"),
    ("bills_other", "bills", "essential", "expense", "false", "false", "false", "", "", "primary:Bills;Brand#11", "LARGE_3-MEDIUM"),
    ("transfer_p2p", "transfers", "none", "transfer", "false", "false", "false", "", "", "Brand#12", "LARGE_5-LOW"),
    ("vehicle_purchase", "shopping", "discretionary", "expense", "false", "false", "false", "", "", "", ""),
    ("income_other", "income", "none", "income", "false", "false", "false", "", "", "", ""),
    ("unclassified_other", "unclassified", "none", "none", "false", "false", "false", "", "", "", ""),
]
TAXONOMY_COLUMNS = "leaf, general, necessity, flow, is_debt, is_priority, is_age, risk, recurring, sources, sources_b"
LEAVES = [row[0] for row in TAXONOMY]
#: Rules of the fixture: two of equal priority, one disabled, one with an exclusion, one split by direction.
RULES = [
    Rule("R01", 10, "merchant", "regex", r"^mr (hot|cold)", "transfer_p2p"),
    Rule("R02", 20, "merchant", "exact_set", "anvil|widget 3", "vehicle_purchase", "debit"),
    Rule("R03", 20, "merchant", "exact_set", "anvil", "income_other", "credit"),
    Rule("R04", 5, "merchant", "regex", "ring", "gambling_betting", enabled=False),
    Rule("R05", 30, "description", "regex", r"\bplate\b", "rent", "debit", exclude="plate 4|plate supplier#0000000[0-4]"),
    Rule("R06", 30, "merchant", "regex", r"\bbolt [12]$", "debt_collection"),
]
#: The same rules in SQL, for twins; {m} merchant, {d} description.
RULE_SQL = [
    ("R01", "regexp_matches({m}, '^mr (hot|cold)')", "transfer_p2p"),
    ("R02", "regexp_matches({m}, '\\b(anvil|widget 3)\\b') AND direction = 'debit'", "vehicle_purchase"),
    ("R03", "regexp_matches({m}, '\\b(anvil)\\b') AND direction = 'credit'", "income_other"),
    ("R05", "regexp_matches({d}, '\\bplate\\b') AND NOT regexp_matches({d}, 'plate 4|plate supplier#0000000[0-4]') AND direction = 'debit'", "rent"),
    ("R06", "regexp_matches({m}, '\\bbolt [12]$')", "debt_collection"),
]
MECHANISMS = {"Identified Salary": "salary", "Refund": "refund_received"}
_COLOURS = {"red": "groceries", "blue": "streaming", "old": "fuel"}


def _pick(seed: str, key: str, n: int) -> str:
    """A number below n from md5 digits, the same in both engines."""
    h = f"md5('{seed}' || {key})"
    return f"((ascii(substr({h}, 1, 1)) * 31 + ascii(substr({h}, 2, 1)) * 17 + ascii(substr({h}, 3, 1))) % {n})"


def _values(rows: list[tuple], columns: str) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS v({columns})"


def _labeller(seed: str, blank: int) -> str:
    """Leaf and confidence of one labeller for each merchant of ``strings``: mostly the common draw, sometimes its own.

    The common draw is the truth, but for a sixth of the merchants an error that all labellers share.
    """
    own, truth, error = (_pick(s, "merchant", len(LEAVES)) for s in (seed, "truth", "error"))
    common = f"CASE WHEN {_pick('shared', 'merchant', 6)} = 0 THEN {error} ELSE {truth} END"
    number = f"CASE WHEN {_pick(seed + 'p', 'merchant', 10)} < 7 THEN {common} ELSE {own} END"
    leaf = f"CASE WHEN {_pick(seed + 'b', 'merchant', blank)} = 0 THEN '' ELSE leaf END"
    return f"SELECT merchant, {leaf} AS llm_leaf, CASE WHEN {_pick(seed + 'n', 'merchant', 11)} = 0 THEN NULL ELSE {_pick(seed + 'c', 'merchant', 101)} / 100.0E0 END AS llm_confidence FROM (SELECT merchant, {number} AS no FROM {{strings}}) s JOIN {{leaf_numbers}} n ON s.no = n.leaf_no"


_KEY_A, _KEY_B = "lower(trim(VendorDescription))", "lower(trim(merchant_name))"
TABLES = {
    "raw_a": f"SELECT {_PRI} AS PrimaryCategoryDescription, {_SUB} AS SubCategoryDescription, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '  ' WHEN p_partkey % 23 = 0 THEN 'Mr ' || {_NAME} WHEN p_partkey % 5 = 0 THEN '  ' || upper({_NAME}) || ' ' ELSE {_NAME} END AS VendorDescription, {_NAME} || ' ' || s_name AS Description, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS TransactionTypeId, l_extendedprice AS Amount, l_shipdate AS ts, o_custkey AS applicant {_LINES} WHERE l_linestatus = 'F'",
    "raw_b": f"SELECT CASE WHEN p_type = 'ECONOMY' THEN 'ENTERTAINMENT_CASINOS_AND_GAMBLING' ELSE p_type || '_' || o_orderpriority END AS credit_category_detailed, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN 'Mr ' || {_NAME} ELSE ' ' || upper({_NAME}) || '  ' END AS merchant_name, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE {_NAME} || ' ' || s_name END AS original_description, {_NAME} || ' pos' AS transaction_name, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount, l_shipdate AS ts, o_custkey AS applicant {_LINES} WHERE l_linestatus = 'O'",
    "taxonomy": _values(TAXONOMY, TAXONOMY_COLUMNS),
    "leaf_numbers": _values([(leaf, i) for i, leaf in enumerate(sorted(LEAVES))], "leaf, leaf_no"),
    "dictionary": "SELECT DISTINCT "
    + _NAME
    + " AS merchant, CASE "
    + " ".join(f"WHEN p_name LIKE '{c} %' THEN '{leaf}'" for c, leaf in _COLOURS.items())
    + " END AS leaf, CASE WHEN p_partkey % 2 = 0 THEN 'curated' ELSE 'gating' END AS source FROM {part} WHERE (p_name LIKE 'red %' OR p_name LIKE 'blue %' OR p_name LIKE 'old %') AND p_partkey % 3 = 0 AND p_partkey % 10 < 6",
    "strings": f"SELECT {_KEY_B} AS merchant, count(*) AS volume FROM {{raw_b}} WHERE merchant_name IS NOT NULL AND trim(merchant_name) <> '' GROUP BY 1",
    "labels_a": _labeller("a", 15),
    "labels_b": _labeller("b", 20),
    "labels_c": _labeller("c", 6),
    "verdicts": f"SELECT merchant, CASE {_pick('v', 'merchant', 8)} WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'other' WHEN 3 THEN 'context_dependent' WHEN 4 THEN '' WHEN 5 THEN 'agreed' WHEN 6 THEN 'unclassifiable' ELSE 'unsure' END AS verdict, CASE WHEN {_pick('v', 'merchant', 8)} = 2 THEN (CASE WHEN {_pick('w', 'merchant', 9)} = 0 THEN 'no_such_leaf' ELSE 'shopping_other' END) ELSE '' END AS correct_leaf FROM {{strings}} WHERE {_pick('r', 'merchant', 3)} = 0",
    "gold": f"SELECT merchant, leaf AS gold_leaf, CASE {_pick('gs', 'merchant', 4)} WHEN 0 THEN 'human' WHEN 1 THEN 'dictionary' WHEN 2 THEN 'agreed' ELSE 'first' END AS gold_source, CASE {_pick('st', 'merchant', 3)} WHEN 0 THEN 'head' WHEN 1 THEN 'middle' ELSE 'tail' END AS stratum, volume FROM (SELECT merchant, volume, {_pick('truth', 'merchant', len(LEAVES))} AS no FROM {{strings}} WHERE {_pick('g', 'merchant', 2)} = 0) s JOIN {{leaf_numbers}} n ON s.no = n.leaf_no",
    "gold_rows": f"SELECT merchant, leaf AS gold_leaf, row_no, CASE {_pick('note', 'merchant || CAST(row_no AS VARCHAR(4))', 4)} WHEN 0 THEN 'seen on statement ' || CAST(row_no AS VARCHAR(4)) WHEN 1 THEN '  ' END AS notes FROM (SELECT merchant, row_no, CASE WHEN {_pick('k', 'merchant', 4)} = 0 THEN ({_pick('truth', 'merchant', len(LEAVES))} + row_no) % {len(LEAVES)} ELSE {_pick('truth', 'merchant', len(LEAVES))} END AS no FROM {{strings}} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS r(row_no)) r) s JOIN {{leaf_numbers}} n ON s.no = n.leaf_no",
    "blocks": "SELECT o_orderkey AS id, o_orderdate AS searched, '<report>' || '<transactions><merchant>' || o_orderpriority || '</merchant><amount>' || CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR(20)) END || '</amount><at>2024-01-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(4)) || 'T10:20:30' || CASE WHEN o_orderkey % 5 = 0 THEN 'nonsense' ELSE '.250+00:00' END || '</at></transactions>' || CASE WHEN o_orderkey % 2 = 0 THEN '<transactions><merchant></merchant><amount>1.5</amount></transactions>' ELSE '' END || '</report>' AS response_xml FROM {orders}",
}
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Fixture:
    """Tables of one data folder as DataFrames, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in GIVEN:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in TABLES:
                self.made[name] = self.spark.sql(TABLES[name], **{n: getattr(self, n) for n in needs(TABLES[name])})
            else:
                raise AttributeError(name)
        return self.made[name]

    def seeds(self) -> Seeds:
        b = parse_sources(self.taxonomy, "sources_b").select(F.col("value").alias("cat"), "leaf")
        return Seeds(self.taxonomy, b, self.dictionary.select("merchant", "leaf"), RULES, MECHANISMS)


def _chain(names: list[str], seen: list[str]) -> None:
    for n in names:
        if n in TABLES and n not in seen:
            _chain(needs(TABLES[n]), seen)
            seen.append(n)


def twin(sql: str, extra: dict[str, str] | None = None) -> str:
    """The SQL with its tables written out in front; ``extra`` has tables of the twin's own."""
    extra = extra or {}
    wanted: list[str] = []
    for text in [*extra.values(), sql]:
        _chain([n for n in TABLES if re.search(rf"\b{n}\b", text)], wanted)
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', TABLES[n])})" for n in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql


def rule_case(prefix: str | None, merchant: str, description: str) -> str:
    """WHEN branches of the rules: the leaf, or with a prefix the tier label."""
    return " ".join(f"WHEN coalesce({c.format(m=merchant, d=description)}, false) THEN '{prefix + r if prefix else leaf}'" for r, c, leaf in RULE_SQL)
