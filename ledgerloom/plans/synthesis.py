"""Queries of synthesised features and of point-in-time sums, with twins written from the features' names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import binning as BN
from ledgerloom.operators import risk as R
from ledgerloom.operators import selection as C
from ledgerloom.operators import synthesis as Y
from ledgerloom.plans.features import outcome
from ledgerloom.plans.feeds import a
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import materialised

CUT = "1999-07-01"
#: Money in hundredths: whole numbers, whose sums are the same in any order.
_CENTS = "CAST(round({} * 100) AS BIGINT)"
#: Columns of each table below customers, as both engines make them.
LINES = {"l_orderkey": "l_orderkey", "quantity": "CAST(l_quantity AS BIGINT)", "price": _CENTS.format("l_extendedprice"), "flag": "l_returnflag", "shipped": "l_shipdate"}
ORDERS = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "total": _CENTS.format("o_totalprice"), "status": "o_orderstatus", "ordered": "o_orderdate"}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def entities(fx) -> tuple[list[Y.Entity], list[Y.Relation]]:
    customer = fx.customer.select(F.col("c_custkey").alias("customer"))
    tables = [
        Y.Entity("customer", customer, "customer"),
        Y.Entity("orders", fx.orders.selectExpr(*_select(ORDERS)), "o_orderkey", "ordered", ("total",), {"status": ("F", "O")}),
        Y.Entity("lines", fx.lineitem.selectExpr(*_select(LINES)), "l_orderkey", "shipped", ("quantity", "price"), {"flag": ("A", "R")}),
    ]
    return tables, [Y.Relation("customer", "orders", "o_custkey"), Y.Relation("orders", "lines", "l_orderkey")]


PRIMITIVES = Y.Primitives(numeric=("sum", "mean", "std", "max"))
_NUMBER = {"sum": "sum({})", "mean": "avg({})", "std": "stddev_pop({})", "min": "min({})", "max": "max({})"}


def _digits(f: Y.Feature) -> tuple[int, float]:
    """Digits shown of a number, and what is added first: means of means often end in an exact half of the last digit,
    which the engines' sums miss by their last bits in either direction."""
    digits = 2 if any(c in f.name for c in ("price", "total")) else 4
    return digits, round(0.137 * 10**-digits, 9)


def _sql_of(f: Y.Feature, time: str) -> str:
    """A feature over rows that have its column, or over the months' rows for monthly ones."""
    day = f"CAST(date_diff('day', DATE '1970-01-01', CAST({time} AS DATE)) AS DOUBLE)"
    column = {f"month_{time}": f"month({time})", f"weekday_{time}": f"(isodow({time}) - 1)", f"since_previous_{time}": "gap"}.get(f.of, f.of)
    if f.where:
        column = f"CASE WHEN {f.where[0]} = '{f.where[1]}' THEN {column or 1} END"
    if f.kind == "count":
        return f"count({column or '*'})"
    if f.kind == "category":
        return f"count(DISTINCT {column})"
    if f.kind == "trend":
        return f"nullif(regr_slope({column}, {day}), CAST('NaN' AS DOUBLE))"
    return _NUMBER[f.agg].format(column)


def _grouped(table: str, key: str, time: str, features: list[Y.Feature], cut: str) -> str:
    """All features over a child's rows before the cutoff, by the parent's key."""
    plain = [f for f in features if f.kind != "monthly"]
    monthly = [f for f in features if f.kind == "monthly"]
    rows = f"SELECT *, date_diff('day', lag(CAST({time} AS DATE)) OVER (PARTITION BY {key} ORDER BY {time}), CAST({time} AS DATE)) AS gap FROM {table} WHERE {time} < {cut}"
    sql = f"SELECT {key} AS k, {', '.join(f'{_sql_of(f, time)} AS {f.name}' for f in plain)} FROM ({rows}) r GROUP BY 1"
    if not monthly:
        return sql
    inner = {f"m_{f.inner}_{f.of}": "count(*)" if f.inner == "count" else f"sum({f.of})" for f in monthly}
    months = f"SELECT {key} AS k, date_trunc('month', {time}) AS mth, {', '.join(f'{s} AS {n}' for n, s in inner.items())} FROM {table} WHERE {time} < {cut} GROUP BY 1, 2"
    outer = ", ".join(f"{_NUMBER[f.agg].format(f'm_{f.inner}_{f.of}')} AS {f.name}" for f in monthly)
    return f"SELECT p.*, q.* EXCLUDE (k) FROM ({sql}) p JOIN (SELECT k, {outer} FROM ({months}) m GROUP BY 1) q USING (k)"


def _planned() -> dict[str, list[Y.Feature]]:
    """The plan, which needs names only."""
    tables = [Y.Entity("customer", None, "customer"), Y.Entity("orders", None, "o_orderkey", "ordered", ("total",), {"status": ("F", "O")}), Y.Entity("lines", None, "l_orderkey", "shipped", ("quantity", "price"), {"flag": ("A", "R")})]
    return Y.plan(tables, [Y.Relation("customer", "orders", "o_custkey"), Y.Relation("orders", "lines", "l_orderkey")], "customer", PRIMITIVES)


PLANNED = _planned()


def _shown(f: Y.Feature, column: str) -> str:
    digits, more = _digits(f)
    return f"coalesce({column}, 0) AS {f.name}" if f.kind in ("count", "category") else f"round(CAST({column} AS DOUBLE) + {more:.9f}, {digits}) AS {f.name}"


def _twin(cut: str, customers: str, of_orders: str = "orders_raw", of_lines: str = "lines_raw") -> tuple[str, dict[str, str]]:
    below, top = PLANNED["orders"], PLANNED["customer"]
    zero = [f.name for f in below if f.kind in ("count", "category")]
    parts = {
        "customers_in": customers,
        "orders_raw": f"SELECT {', '.join(_select(ORDERS))} FROM orders",
        "lines_raw": f"SELECT {', '.join(_select(LINES))} FROM lineitem",
        "of_lines": _grouped(of_lines, "l_orderkey", "shipped", below, cut),
        "orders_full": f"SELECT o.*, {', '.join(f'coalesce({n}, 0) AS {n}' for n in zero)}, l.* EXCLUDE (k, {', '.join(zero)}) FROM {of_orders} o LEFT JOIN of_lines l ON o_orderkey = k",
        "of_orders": _grouped("orders_full", "o_custkey", "ordered", top, cut),
    }
    return f"SELECT customer, {', '.join(_shown(f, f.name) for f in top)} FROM customers_in LEFT JOIN of_orders ON customer = k", parts


_SQL, _PARTS = _twin(f"TIMESTAMP '{CUT}'", "SELECT c_custkey AS customer FROM customer")


def _rounded(df, keep: list[str]):
    number = lambda f: F.round(F.col(f.name).cast("double") + _digits(f)[1], _digits(f)[0]).alias(f.name)
    shown = [F.col(f.name) if f.kind in ("count", "category") else number(f) for f in PLANNED["customer"]]
    return df.select(*keep, *shown)


@query("r2_synthesised_features", _SQL, **_PARTS)
def r2s(fx):
    """Features of customers to depth 2 over orders and their lines, as of one day."""
    tables, relations = entities(fx)
    return _rounded(Y.feature_table(tables, relations, "customer", PLANNED, F.lit(CUT).cast("timestamp")), ["customer"])


#: Each customer as of the day of their last order.
_OWN = "SELECT o_custkey AS customer, max(o_orderdate) AS cut FROM orders GROUP BY 1"
_SQL_OWN, _PARTS_OWN = _twin("cut", _OWN, "orders_cut", "lines_cut")
_PARTS_OWN = {
    **{k: _PARTS_OWN[k] for k in ("customers_in", "orders_raw", "lines_raw")},
    "orders_cut": "SELECT o.*, cut FROM orders_raw o JOIN customers_in ON o_custkey = customer",
    "lines_cut": "SELECT l.*, cut FROM lines_raw l JOIN orders_cut ON l_orderkey = o_orderkey",
    **{k: _PARTS_OWN[k] for k in ("of_lines", "orders_full", "of_orders")},
}


@query("r2_features_at_own_times", _SQL_OWN, **_PARTS_OWN)
def r2o(fx):
    """The same features, each customer as of a day of their own."""
    tables, relations = entities(fx)
    cuts = fx.orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.max("o_orderdate").alias("cut"))
    tables[0] = Y.Entity("customer", cuts, "customer")
    return _rounded(Y.feature_table(tables, relations, "customer", PLANNED, "cut"), ["customer"])


_SWEEP = """
SELECT e.applicant, e.eval_ts, count(amount) AS n, CAST(coalesce(sum(CAST(round(amount * 100) AS BIGINT)), 0) AS BIGINT) AS cents,
  count(amount) FILTER (direction = 'credit') AS credits
FROM (SELECT DISTINCT o_custkey AS applicant, o_orderdate AS eval_ts FROM orders) e
LEFT JOIN (SELECT applicant, ts, Amount AS amount, CASE WHEN TransactionTypeId = 1 THEN 'credit' ELSE 'debit' END AS direction FROM raw_a) t
ON t.applicant = e.applicant AND ts < eval_ts {} GROUP BY 1, 2
"""


def _sweep(fx, days):
    asked = fx.orders.select(F.col("o_custkey").alias("applicant"), F.col("o_orderdate").alias("eval_ts"))
    one = F.col("amount").isNotNull()
    measures = {"n": one.cast("long"), "cents": F.round(F.col("amount") * 100).cast("long"), "credits": (one & (F.col("direction") == "credit")).cast("long")}
    return Y.as_of_sums(a(fx), asked, "applicant", "ts", "eval_ts", measures, days)


@query("r3_as_of_sweep", _SWEEP.format("AND ts >= eval_ts - INTERVAL 180 DAY"))
def r3s(fx):
    """Transactions of the half year before each order of an applicant."""
    return _sweep(fx, 180)


@query("r3_as_of_history", _SWEEP.format(""))
def r3h(fx):
    """All transactions before each order of an applicant."""
    return _sweep(fx, None)


def feature_rows(fx):
    """The whole feature table, synthesised and from transactions, with the outcome of each customer, stored once."""
    tables, relations = entities(fx)
    deep = Y.feature_table(tables, relations, "customer", PLANNED, F.lit(CUT).cast("timestamp"))
    own = outcome(fx).select(F.col("applicant").alias("customer"), "bad", *[F.col(c).alias(f"feed_{c}") for c in ("n", "total", "credits")])
    names = [f.name for f in PLANNED["customer"]] + ["feed_n", "feed_total", "feed_credits"]
    return materialised(own.join(deep, "customer", "left"), "features"), names


_LIVE = " UNION ALL ".join(
    f"SELECT '{f.name}' AS feature, round(avg(CASE WHEN coalesce({f.name}, 0) <> 0 THEN 1.0 ELSE 0.0 END), 6) AS live, min({f.name}) IS NOT DISTINCT FROM max({f.name}) AS constant FROM shown"
    for f in PLANNED["customer"]
)


@query("r6_live_features", _LIVE, **_PARTS, shown=_SQL)
def r6s(fx):
    """Live rates of the whole table of synthesised features."""
    return R.live_rate(r2s(fx), [f.name for f in PLANNED["customer"]])


_BOUNDS = {f.name: f"(SELECT quantile_cont(CAST({f.name} AS DOUBLE), [0.25, 0.5, 0.75]) FROM shown)" for f in PLANNED["customer"]}
_BINNED = "SELECT customer, bad, " + ", ".join(f"CASE WHEN {n} IS NULL THEN -1 ELSE len(list_filter({q}, lambda c: c < {n})) END AS {n}" for n, q in _BOUNDS.items()) + " FROM shown JOIN (SELECT c_custkey AS customer, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS bad FROM customer) o USING (customer)"
_IV = """
SELECT feature, round(sum(round((g - b) * ln(g / b), 6)), 6) AS iv FROM (
  SELECT feature, (bad + 0.5) / sum(bad + 0.5) OVER (PARTITION BY feature) AS b, (n - bad + 0.5) / sum(n - bad + 0.5) OVER (PARTITION BY feature) AS g
  FROM (SELECT feature, bin, count(*) AS n, sum(bad) AS bad FROM (UNPIVOT binned ON COLUMNS(* EXCLUDE (customer, bad)) INTO NAME feature VALUE bin) u GROUP BY 1, 2) x
) y GROUP BY 1
"""


@query("r4_iv_of_all_features", _IV, **_PARTS, shown=_SQL, binned=_BINNED)
def r4s(fx):
    """Information values of the whole table of synthesised features, in one order and one count."""
    rows = r2s(fx).join(fx.customer.select(F.col("c_custkey").alias("customer"), (F.col("c_acctbal") < 0).cast("int").alias("bad")), "customer")
    return C.information_values(materialised(rows, "features"), [f.name for f in PLANNED["customer"]], "bad")


@query("r5_forward_select")
def r5(fx):
    """The whole feature table competes: live features that are not close to one of more information value, then the
    choice by the Gini of the third of the customers that no model has seen."""
    rows, names = feature_rows(fx)
    live = [r.feature for r in R.live_rate(rows, names).where("live >= 0.05 and not constant").collect()]
    kept = [r.feature for r in BN.choose_features(rows, live, "bad", 0.9).where("kept").collect()]
    held = F.pmod(F.xxhash64("customer"), F.lit(3)) == 0
    found = C.forward_select(rows.where(~held), rows.where(held), sorted(kept), "bad", 5)
    return fx.spark.createDataFrame([(i + 1, f, round(g, 6)) for i, (f, g) in enumerate(found)] or [(0, "none", 0.0)], "step int, feature string, gini double")
