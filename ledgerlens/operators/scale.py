"""Exact order statistics that stay distributed, by one path for all sizes.

``percentile`` keeps every distinct value of a group in one buffer and a window without PARTITION BY sorts everything
in one task. Here sketches say where a quantile lies and only the values around it are kept; global ranks range-sort the rows, each
range numbers its own, and only one row per range meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize, write_once

#: Size of the sketches, the number of ranks they are asked for, the share of ranks by which a bracket is wider on either side
#: (three times the sketch's error at 99 %), and how many values of a bracket one task may hold.
SKETCH_SIZE, GRID, SLACK, KEPT_VALUES = 1024, 128, 0.014, 1 << 20


def running_totals(df: DataFrame, order: Sequence[Column | str], totals: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``new: column`` of ``totals``, the sum of the column over all rows up to this one.

    Rows are range-sorted on ``order`` into as many ranges as there are shuffle partitions. The sorted table is written once,
    because the sums of the ranges and the rows must see the same ranges. ``order`` should end in a column that tells
    rows apart, so that no value of the leading columns has to fit into one range.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = write_once(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    within = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("__range").agg(*[F.sum(c).alias(new) for new, c in totals.items()])
    starts = sums.select("__range", *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"__at_{new}") for new in totals])
    out = ranged.withColumns({new: F.sum(c).over(within) for new, c in totals.items()})
    out = out.join(F.broadcast(starts), "__range")  # one row per range
    return out.select(*df.columns, *[(F.col(new) + F.col(f"__at_{new}")).alias(new) for new in totals])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles of one column, one column per entry of ``probs``, one row per group."""
    return column_quantiles(df, {value: probs}, by)


def column_quantiles(df: DataFrame, wanted: dict[str, dict[str, float]], by: Sequence[str] = (), keep: int = KEPT_VALUES) -> DataFrame:
    """Linear-interpolation quantiles of several columns, one column per name in ``wanted`` (column: name: probability), one row per group.

    Null and NaN values and null groups are left out; infinite values rank like any other. Without groups there is always one
    row, of nulls if no value is left.

    A first pass makes one mergeable sketch per group and column. From it follows a bracket for each quantile, wider than the
    sketch's rank error. Where a bracket may hold more than ``keep`` values, a pass sketches the values inside it and
    narrows it. The last pass counts the values below each bracket and keeps the different ones inside it, from which the
    quantile is read off. Ranks are checked against exact counts; a bracket that misses its rank starts again from minimum
    to maximum. No values are written, and a task holds at most a sketch or about ``keep`` values of a group.
    """
    targets = [(name, column, float(p)) for column, probs in wanted.items() for name, p in probs.items()]
    x = {c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in wanted}
    rows = df.where(every([F.col(k).isNotNull() for k in by])).select(*by, *[x[c].alias(f"__x{i}") for i, c in enumerate(wanted)])
    index = {c: f"__x{i}" for i, c in enumerate(wanted)}
    first = {"n": F.count, "least": F.min, "most": F.max, "sketch": lambda v: F.kll_sketch_agg_double(v, SKETCH_SIZE)}
    brackets = _settled(rows.groupBy(*by).agg(*[f(v).alias(f"__{name}{v}") for v in index.values() for name, f in first.items()]))
    start = []
    for t, (_, column, p) in enumerate(targets):
        v, place = index[column], F.lit(p) * (F.col(f"__n{index[column]}") - 1)
        ends = (F.col(f"__least{v}"), F.col(f"__most{v}"))
        start += [F.col(f"__n{v}").alias(f"__n{t}"), *[c.alias(f"__{n}{t}") for n, c in zip(("least", "most"), ends)]]
        start += _bracket(t, F.col(f"__sketch{v}"), F.col(f"__n{v}"), place, *ends)
    brackets = _settled(brackets.select(*by, *start))
    columns = [index[column] for _, column, _ in targets]
    places = [F.lit(p) * (F.col(f"__n{t}") - 1) for t, (_, _, p) in enumerate(targets)]
    while True:
        spread = [F.when(F.col(f"__low{t}") < F.col(f"__high{t}"), F.col(f"__expected{t}")).otherwise(0.0) for t in range(len(targets))]
        if _largest(brackets, F.greatest(*spread, F.lit(0.0)), by) > keep:
            brackets = _narrowed(rows, brackets, by, columns, places)
            continue
        found = _settled(_read_off(rows, brackets, by, columns, places))
        missed = F.when(every([F.col(f"__hit{t}") for t in range(len(targets))]), 0).otherwise(1)
        if not _largest(found, missed, by):
            break
        again = [F.col(f"__{end}{t}").alias(f"__{to}{t}") for t in range(len(targets)) for end, to in (("least", "low"), ("most", "high"))]
        full = [F.col(f"__n{t}").cast("double").alias(f"__expected{t}") for t in range(len(targets))]
        kept = [c for c in brackets.columns if not c.startswith(("__low", "__high", "__expected"))]
        brackets = _settled(brackets.select(*kept, *again, *full))
    values = []
    for t, (name, _, _) in enumerate(targets):
        low, high = F.col(f"__a{t}"), F.col(f"__b{t}")
        values.append(F.when(low == high, low).otherwise(low + (high - low) * F.col(f"__part{t}")).alias(name))
    return found.select(*by, *values)


def _settled(df: DataFrame) -> DataFrame:
    """A small frame of one row per group, computed once; without groups its row becomes literals."""
    if any(not c.startswith("__") for c in df.columns):
        return materialize(df)
    return df.sparkSession.createDataFrame([df.first()], df.schema)


def _largest(df: DataFrame, value: Column, by: Sequence[str]) -> float:
    """The largest ``value`` of a settled frame; its one row needs no job."""
    return ((df.agg(F.max(value)) if by else df.select(value)).first() or [0])[0] or 0


def _bracket(t: int, sketch: Column, n: Column, place: Column, least: Column, most: Column) -> list[Column]:
    """Ends of the bracket around the two ranks next to ``place`` among ``n`` sketched values, and about how many values it holds."""
    n = F.nullif(n, F.lit(0))
    known = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))
    low = F.floor((F.floor(place) / n - SLACK) * GRID).cast("int")
    high = F.ceil(((F.ceil(place) + 1) / n + SLACK) * GRID).cast("int")
    ends = (
        F.when(n.isNull(), None).when(low <= 0, least).otherwise(F.get(known, low)),
        F.when(n.isNull(), None).when(high >= GRID, most).otherwise(F.get(known, high)),
    )
    expected = n * (F.least(high, F.lit(GRID)) - F.greatest(low, F.lit(0)) + 2 * GRID * SLACK) / GRID
    return [ends[0].alias(f"__low{t}"), ends[1].alias(f"__high{t}"), F.coalesce(expected, F.lit(0.0)).alias(f"__expected{t}")]


def _beside(rows: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return rows.join(brackets, list(by))
    row = brackets.first()
    return rows.withColumns({c: F.lit(row[c]).cast(brackets.schema[c].dataType) for c in brackets.columns})


def _narrowed(rows: DataFrame, brackets: DataFrame, by: Sequence[str], columns: list[str], places: list[Column]) -> DataFrame:
    """Brackets made narrower by a sketch of the values inside them."""
    sums = []
    for t, v in enumerate(columns):
        inside = F.col(v).between(F.col(f"__low{t}"), F.col(f"__high{t}"))
        sums += [F.count_if(F.col(v) < F.col(f"__low{t}")).alias(f"__below{t}"), F.count_if(inside).alias(f"__held{t}")]
        sums.append(F.kll_sketch_agg_double(F.when(inside, F.col(v)), SKETCH_SIZE).alias(f"__sketch{t}"))
    carried = [c for c in brackets.columns if c not in by]
    found = _beside(rows, brackets, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in carried], *sums)
    out = [*by, *[F.col(f"__{n}{t}") for t in range(len(columns)) for n in ("n", "least", "most")]]
    for t in range(len(columns)):
        low, high, held = F.col(f"__low{t}"), F.col(f"__high{t}"), F.col(f"__held{t}")
        place = places[t] - F.col(f"__below{t}")
        hit = (F.floor(place) >= 0) & (F.ceil(place) < held)
        narrow = _bracket(t, F.col(f"__sketch{t}"), held, place, low, high)
        wide = (F.col(f"__least{t}"), F.col(f"__most{t}"), F.col(f"__n{t}").cast("double"))
        out += [F.when(hit, a).otherwise(b).alias(n) for a, b, n in zip(narrow, wide, (f"__low{t}", f"__high{t}", f"__expected{t}"))]
    return _settled(found.select(*out))


def _read_off(rows: DataFrame, brackets: DataFrame, by: Sequence[str], columns: list[str], places: list[Column]) -> DataFrame:
    """Per group and target the two values around the quantile, the part between them, and whether the bracket held both."""
    beside = _beside(rows, brackets, by)
    cells = []
    for t, v in enumerate(columns):
        x, low, high = F.col(v), F.col(f"__low{t}"), F.col(f"__high{t}")
        cells.append(F.when(x <= high, F.struct(F.lit(t).alias("t"), F.when(x >= low, x).alias("v"))))  # v is null below the bracket
    counted = beside.select(*by, F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy(*by, "c.t", "c.v").agg(F.count("*").alias("__m"))
    upto = W.partitionBy(*by, "t").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0)
    ranked = _beside(counted.withColumn("__upto", F.sum("__m").over(upto)), brackets, by)
    out = []
    for t, place in enumerate(places):
        before = F.col("__upto") - F.col("__m")
        for name, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            held = (F.col("t") == t) & (before <= rank) & (rank < F.col("__upto"))
            out += [F.max(F.when(held, F.col("v"))).alias(f"__{name}{t}"), F.max(F.when(held & F.col("v").isNotNull(), 1)).alias(f"__{name}_hit{t}")]
        out += [F.first(place - F.floor(place)).alias(f"__part{t}"), F.first(f"__n{t}").alias(f"__n{t}")]
    found = ranked.groupBy(*by).agg(*out)
    if by:  # a group without values has no row there
        found = brackets.select(*by).join(found, list(by), "left")
    hits = [
        ((F.coalesce(F.col(f"__n{t}"), F.lit(0)) == 0) | (F.col(f"__a_hit{t}").isNotNull() & F.col(f"__b_hit{t}").isNotNull())).alias(f"__hit{t}")
        for t in range(len(columns))
    ]
    return found.select(*by, *[c for c in found.columns if c not in by and "_hit" not in c], *hits)


def every(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of every row under a total order (ties are spread by its tie-break column)."""
    return running_totals(df.withColumn("__one", F.lit(1)), order, {name: "__one"}).drop("__one")


def top_n(df: DataFrame, order: Sequence[Column], n: int, name: str | None = "rank") -> DataFrame:
    """The first ``n`` rows under ``order`` (a per-task top-n, then one merge), optionally numbered."""
    head = df.orderBy(*order).limit(n)
    if name is None:
        return head
    return head.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """Top-n per group. The rank filter lets Spark cut every group to n rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def one_row(df: DataFrame) -> dict:
    """Collect a global aggregate (exactly one row) for use as literals."""
    return df.first().asDict()
