"""Deep feature synthesis over related tables, and point-in-time sums at many evaluation times.

``plan`` walks the relations from a target table down to its children and enumerates features by stacking primitives:
aggregates of a child's columns, of transforms of its columns, of its rows with a given category, of its monthly sums, and
of features that the child has from its own children, up to a depth.  ``feature_table`` computes all features of a plan
with one exchange for each relation: parent rows and child rows are brought together by the relation's key in a union, and
every aggregate, window and monthly sum of that relation follows from that partitioning in one pass.

With a cutoff only child rows before it count, at every level.  A cutoff is one time for all, or a column of the target;
a column is handed down by joins on the relations' keys.

Rows of one key are together in one task, where windows sort them (which spills) and sums hold one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entity:
    """A table: key, time of its rows, columns to aggregate, and the categories that conditions ask for."""

    name: str
    df: DataFrame
    key: str
    time: str | None = None
    numeric: tuple[str, ...] = ()
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Relation:
    """A child's column that names a parent's key."""

    parent: str
    child: str
    column: str


#: Aggregates of numbers by name, over a column that is null where a row does not count.
NUMERIC = {
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "skew": F.skewness,
}
#: Aggregates of categories.
CATEGORICAL = {"mode": lambda c: F.mode(c, True)}
#: Numbers from a time.
TRANSFORMS = {"month": F.month, "weekday": F.weekday}


@dataclass(frozen=True)
class Primitives:
    """What to stack: aggregates, transforms of times (``since_previous``: days since the row before), sums and counts by
    category, and aggregates of monthly sums and counts."""

    numeric: tuple[str, ...] = ("sum", "mean", "std", "min", "max")
    trend: bool = True
    categorical: tuple[str, ...] = ("nunique",)
    transforms: tuple[str, ...] = ("month", "weekday", "since_previous")
    where: tuple[str, ...] = ("count", "sum")
    monthly: tuple[str, ...] = ("mean", "std", "max")


@dataclass(frozen=True)
class Feature:
    """An aggregate over the rows of a relation's child.

    ``kind``: number, trend, category, count, or monthly; ``of`` is a column of the child, a transform or a feature of
    its own; ``where`` a category column and its value; ``inner`` the sum within a month.
    """

    name: str
    child: str
    kind: str
    agg: str
    of: str | None = None
    where: tuple[str, str] | None = None
    inner: str | None = None
    depth: int = 1


def _made(relation_child: Entity, agg: str, of: str | None, kind: str, depth: int, where=None, inner=None) -> Feature:
    words = [agg, relation_child.name, *([f"monthly_{inner}"] if inner else []), *([of] if of else []), *(map(str, where) if where else ())]
    return Feature("__".join(words), relation_child.name, kind, agg, of, where, inner, depth)


def plan(entities: list[Entity], relations: list[Relation], target: str, primitives: Primitives = Primitives(), depth: int = 2) -> dict[str, list[Feature]]:
    """Features of the target and of every table below it that they stack on, by table.

    A table without children in reach of the depth has none.
    """
    by_name = {e.name: e for e in entities}
    out: dict[str, list[Feature]] = {}

    def walk(name: str, left: int) -> list[Feature]:
        found: list[Feature] = []
        for r in relations:
            if r.parent != name or left < 1:
                continue
            child = by_name[r.child]
            below = walk(r.child, left - 1)
            columns = [(c, 0) for c in child.numeric]
            if child.time is not None and left > 1:
                columns += [(f"{t}_{child.time}", 1) for t in primitives.transforms]
            columns += [(f.name, f.depth) for f in below if f.kind != "category" or f.agg == "nunique"]
            found.append(_made(child, "count", None, "count", 1))
            for c, d in columns:
                if d + 1 > left:
                    continue
                found += [_made(child, a, c, "number", d + 1) for a in primitives.numeric]
                if primitives.trend and child.time is not None and d == 0:
                    found.append(_made(child, "trend", c, "trend", 1))
            for c, values in child.categories.items():
                found += [_made(child, a, c, "category", 1) for a in primitives.categorical]
                for v in values:
                    if "count" in primitives.where:
                        found.append(_made(child, "count", None, "count", 1, where=(c, v)))
                    if "sum" in primitives.where:
                        found += [_made(child, "sum", n, "number", 1, where=(c, v)) for n in child.numeric]
            if child.time is not None and left > 1:
                for a in primitives.monthly:
                    found += [_made(child, a, n, "monthly", 2, inner="sum") for n in child.numeric]
                    found.append(_made(child, a, None, "monthly", 2, inner="count"))
        if found:
            out[name] = found
        return found

    walk(target, depth)
    return out


def stamped(entities: list[Entity], relations: list[Relation], target: str, cutoff: str) -> dict[str, DataFrame]:
    """Every table below the target with the cutoff of the target row that its rows belong to, as ``_cut``."""
    by_name = {e.name: e for e in entities}
    out = {target: by_name[target].df.withColumn("_cut", F.col(cutoff))}

    def down(name: str) -> None:
        for r in relations:
            if r.parent == name:
                upper = out[name].select(F.col(by_name[name].key).alias("_key"), "_cut")
                out[r.child] = by_name[r.child].df.join(upper, F.col(r.column) == F.col("_key")).drop("_key")
                down(r.child)

    down(target)
    return out


def feature_table(entities: list[Entity], relations: list[Relation], target: str, features: dict[str, list[Feature]], cutoff: Column | str | None = None) -> DataFrame:
    """The target's rows with its features, as columns of their names.

    ``cutoff``: a time for all, or the name of a column of the target; without it all rows count.  A child row without a
    time does not count where there is a cutoff.  A target row without children has nulls, and zero for counts.
    """
    by_name = {e.name: e for e in entities}
    frames = stamped(entities, relations, target, cutoff) if isinstance(cutoff, str) else {e.name: e.df for e in entities}
    cut = F.col("_cut") if isinstance(cutoff, str) else cutoff

    def rows(name: str) -> DataFrame:
        own = by_name[name]
        df = frames[name]
        if cut is not None and name != target and own.time is not None:
            df = df.where(F.col(own.time) < cut)
        wanted = features.get(name, [])
        return _with_features(df, own, [r for r in relations if r.parent == name and any(f.child == r.child for f in wanted)], wanted)

    def _with_features(df: DataFrame, own: Entity, below: list[Relation], wanted: list[Feature]) -> DataFrame:
        if not below:
            return df
        names = df.columns
        together = df.select(F.col(own.key).alias("_key"), F.lit(0).alias("_of"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
        for i, r in enumerate(below, 1):
            child = by_name[r.child]
            mine = [f for f in wanted if f.child == r.child]
            plain = {f.of for f in mine if f.of and f.of not in _transforms(child)} | {f.where[0] for f in mine if f.where}
            time = [F.col(child.time).cast("timestamp").alias(f"_time_{i}")] if child.time else []
            part = rows(r.child).select(F.col(r.column).alias("_key"), F.lit(i).alias("_of"), *time, *[F.col(f"`{c}`").alias(f"_{i}_{c}") for c in sorted(plain)])
            together = together.unionByName(part, allowMissingColumns=True)
        # The one exchange of these relations; all that follows is by its key.
        together = together.repartition("_key")
        aggs: list[Column] = [F.first("_row", ignorenulls=True).alias("_row")]
        for i, r in enumerate(below, 1):
            child = by_name[r.child]
            mine = [f for f in wanted if f.child == r.child]
            together, more = _aggregates(together, i, child, mine)
            aggs += more
        # Children without a parent row have no place in the result.
        grouped = together.groupBy("_key").agg(*aggs).where(F.col("_row").isNotNull())
        return grouped.select("_row.*", *[f"`{f.name}`" for f in wanted if any(f.child == r.child for r in below)])

    return rows(target).drop("_cut")


def _transforms(child: Entity) -> set[str]:
    return {f"{t}_{child.time}" for t in (*TRANSFORMS, "since_previous")} if child.time else set()


def _aggregates(df: DataFrame, i: int, child: Entity, wanted: list[Feature]) -> tuple[DataFrame, list[Column]]:
    """Windows beside the rows where features ask for them, and the aggregates over the rows of child ``i``."""
    mine = F.col("_of") == i
    time = F.col(f"_time_{i}") if child.time else None
    column = {f"{t}_{child.time}": fn(time) for t, fn in TRANSFORMS.items()} if child.time else {}
    month = F.trunc(time, "month") if child.time else None
    if any(f.of == f"since_previous_{child.time}" for f in wanted):
        before = F.lag(time).over(Window.partitionBy("_key", "_of").orderBy(month, time))
        df = df.withColumn(f"_gap_{i}", F.date_diff(F.to_date(time), F.to_date(before)))
        column[f"since_previous_{child.time}"] = F.col(f"_gap_{i}")
    monthly = [f for f in wanted if f.kind == "monthly"]
    if monthly:
        own = Window.partitionBy("_key", "_of", month)
        sums = {f"_sum_{i}_{c}": F.sum(f"_{i}_{c}").over(own) for c in dict.fromkeys(f.of for f in monthly if f.of)}
        df = df.withColumns({f"_nth_{i}": F.row_number().over(own.orderBy(time)), f"_count_{i}": F.count("*").over(own), **sums})

    # The first row of each value of a category, so that distinct values are counted without grouping by them.
    named = dict.fromkeys(f.of for f in wanted if f.kind == "category" and f.agg == "nunique")
    if named:
        df = df.withColumns({f"_new_{i}_{c}": F.row_number().over(Window.partitionBy("_key", "_of", f"_{i}_{c}").orderBy(f"_{i}_{c}")) == 1 for c in named})

    def value(f: Feature) -> Column:
        if f.kind == "monthly":
            inner = F.col(f"_count_{i}") if f.inner == "count" else F.col(f"_sum_{i}_{f.of}")
            return F.when(mine & (F.col(f"_nth_{i}") == 1) & time.isNotNull(), inner)
        c = column.get(f.of, F.col(f"_{i}_{f.of}")) if f.of else F.lit(1)
        met = mine & (F.col(f"_{i}_{f.where[0]}") == f.where[1]) if f.where else mine
        return F.when(met, c)

    def agg(f: Feature) -> Column:
        v = value(f)
        if f.kind == "count":
            return F.count(v)
        if f.kind == "category" and f.agg == "nunique":
            return F.count(F.when(F.col(f"_new_{i}_{f.of}"), v))
        if f.kind == "category":
            return CATEGORICAL[f.agg](v)
        if f.kind == "trend":
            return F.regr_slope(v, F.when(mine, F.unix_date(F.to_date(time)).cast("double")))
        return NUMERIC[f.agg](v)

    return df, [agg(f).alias(f.name) for f in wanted]


def as_of_sums(df: DataFrame, evals: DataFrame, key: str, ts: str, eval_ts: str, measures: dict[str, Column], lookback_days: int | None = None) -> DataFrame:
    """``key, eval_ts`` of every distinct evaluation with the sums of the measures over the key's rows before that time.

    At most ``lookback_days`` before it.  Rows and evaluations are swept together in order of time: running sums stand at
    the place of each evaluation and, with a lookback, at its start, and their difference is the sum, so no row is joined
    with the evaluations that it counts for and the work is that of one sort.  A measure that is null does not count; an
    evaluation without rows has zeros.  Sums of decimals or whole numbers are exact.
    """
    at = F.col(eval_ts).cast("timestamp")
    names = list(measures)
    rows = df.select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_at"), F.lit(1).alias("_late"), *[F.coalesce(m, F.lit(0)).alias(n) for n, m in measures.items()]).where(F.col("_at").isNotNull())
    asked = evals.select(F.col(key).alias("_key"), at.alias("_eval")).distinct()
    marks = [F.struct(F.col("_eval").alias("at"), F.lit(1).alias("sign"))]
    if lookback_days is not None:
        marks.append(F.struct((F.col("_eval") - F.make_dt_interval(days=F.lit(lookback_days))).alias("at"), F.lit(-1).alias("sign")))
    # A mark stands before the rows of its own time: those at an evaluation do not count, those at a start do.
    marked = asked.select("_key", "_eval", F.explode(F.array(*marks)).alias("m")).select("_key", F.col("m.at").alias("_at"), F.lit(0).alias("_late"), "_eval", F.col("m.sign").alias("_sign"))
    swept = rows.unionByName(marked, allowMissingColumns=True).repartition("_key")
    upto = Window.partitionBy("_key").orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, 0)
    run = swept.withColumns({f"_run_{n}": F.sum(F.coalesce(n, F.lit(0))).over(upto) for n in names}).where("_late = 0")
    out = run.groupBy("_key", "_eval").agg(*[F.sum(F.col("_sign") * F.col(f"_run_{n}")).alias(n) for n in names])
    return out.withColumnsRenamed({"_key": key, "_eval": eval_ts})
