"""Exact quantiles without a task that holds all values: ranges of values are counted, and only those that a rank falls into are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import shared_folder

#: Ranges that one is split into, and values up to which a range or a whole group is sorted by itself.
CELLS, FEW = 1024, 50_000


def _written(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def values_at(rows: DataFrame, keys: list[str], wanted: DataFrame, cells: int = CELLS, few: int = FEW) -> DataFrame:
    """keys, _r and _x: the value of each wanted rank (from 0, of the values in order) among the rows (keys, _v) of its keys.

    rows are read once for each round. A round counts the ranges' cells, of equal width between the least and the largest value of a
    range, before anything is shuffled; what goes on is each cell with a rank in it, until it has one value only or ``few`` rows.
    Ranks that no row has give no rows. Nulls in keys are keys; values are finite.
    """
    match = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    renamed = lambda df: df.select(*(F.col(k).alias(f"_b_{k}") for k in keys), *(c for c in df.columns if c not in keys))
    inside = lambda ranges: rows.join(renamed(ranges), [*match, F.col("_v").between(F.col("_low"), F.col("_high"))])
    at = lambda n: F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / F.when(F.col("_high") > F.col("_low"), F.col("_high") / 2 - F.col("_low") / 2).otherwise(F.lit(1.0)) * n), F.lit(n - 1))
    whole = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n")).withColumn("_before", F.lit(0).cast("long"))
    start = renamed(whole)
    found = wanted.join(start, match).where("_r >= 0 AND _r < _n").select(*keys, "_r", "_low", "_high", "_before", "_n")
    done: list[DataFrame] = []
    while True:
        found = _written(found)
        done.append(found.where("_low = _high").select(*keys, "_r", F.col("_low").alias("_x")))
        left = found.where(f"_low < _high AND _n > {few}")
        done.append(_sorted(inside(found.where(f"_low < _high AND _n <= {few}").select(*keys, "_low", "_high", "_before").distinct()), keys, found))
        if left.isEmpty():
            break
        own = left.select(*keys, "_low", "_high", "_before").distinct()
        counts = inside(own).groupBy(*keys, F.col("_low").alias("_of"), F.col("_before").alias("_past"), at(cells).alias("_part")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        ahead = Window.partitionBy(*keys, "_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # cells of one range
        counts = renamed(counts.withColumn("_before", F.col("_past") + F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_past", "_part"))
        asked = left.select(*keys, "_r", F.col("_low").alias("_asked"))
        found = asked.join(counts, [*match, F.col("_asked") == F.col("_of"), F.col("_r") >= F.col("_before"), F.col("_r") < F.col("_before") + F.col("_n")]).select(*keys, "_r", "_low", "_high", "_before", "_n")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _sorted(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """Values by rank in ranges of few rows, each sorted by itself."""
    per = rows.groupBy(*(F.col(f"_b_{k}").alias(k) for k in keys), "_low", "_before", "_v").agg(F.count("*").alias("_m"))
    so_far = Window.partitionBy(*keys, "_low").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_upto", F.col("_before") + F.sum("_m").over(so_far)).select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col("_low").alias("_of"), "_v", "_upto", "_m")
    return found.join(per, [*(F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys), F.col("_low") == F.col("_of"), F.col("_r") < F.col("_upto"), F.col("_r") >= F.col("_upto") - F.col("_m")]).select(*keys, "_r", F.col("_v").alias("_x"))


def percentiles(df: DataFrame, by: list[str], columns: list[str], points: list[float], cells: int = CELLS, few: int = FEW) -> DataFrame:
    """by, and for each column an array of its percentiles at the points (0 to 1), by linear interpolation; null without a value.

    Exact, as the percentile of SQL is, but no task holds the values of a large group (values_at()). Null values, NaN and infinities don't
    count. Without ``by`` there is one row; an empty table then has nulls.
    """
    if not columns:
        return df.groupBy(*by).agg(F.lit(None).alias("_")).drop("_")
    plain = df.select(*by, *(_finite(F.col(c)).alias(f"_c{i}") for i, c in enumerate(columns)))
    counts = _written(plain.groupBy(*by).agg(*(F.count(f"_c{i}").alias(f"_n{i}") for i in range(len(columns)))))
    large = counts.where(F.greatest(*(F.col(f"_n{i}") for i in range(len(columns))), F.lit(0)) > few)
    named = [F.percentile(f"_c{i}", points).alias(c) for i, c in enumerate(columns)]
    if large.isEmpty():
        return plain.groupBy(*by).agg(*named)
    own = large.select(*(F.col(k).alias(f"_b_{k}") for k in by), F.lit(True).alias("_large"))
    marked = plain.join(own, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by], "left") if by else plain.withColumn("_large", F.lit(True))
    small = marked.where("_large IS NULL").groupBy(*by).agg(*named) if by else None
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("_c"), F.col(f"_c{i}").alias("_v")) for i in range(len(columns)))))
    rows = marked.where("_large").select(*by, each).where("_v IS NOT NULL")
    place = F.inline(F.array(*(F.struct(F.lit(i).alias("_c"), F.lit(j).alias("_p"), (F.lit(float(p)) * (F.col(f"_n{i}") - 1)).alias("_place")) for i in range(len(columns)) for j, p in enumerate(points))))
    places = _written(large.select(*by, place).where("_place >= 0"))
    lower, upper = F.floor("_place"), F.ceil("_place")
    wanted = places.select(*by, "_c", lower.alias("_r")).union(places.select(*by, "_c", upper.alias("_r"))).distinct()
    keys = [*by, "_c"]
    found = _written(values_at(rows, keys, wanted, cells, few))
    side = lambda name: found.select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), F.col("_r").alias(f"_{name}_r"), F.col("_x").alias(f"_{name}"))
    on = lambda name, r: [*(F.col(k).eqNullSafe(F.col(f"_{name}_{k}")) for k in keys), r == F.col(f"_{name}_r")]
    both = places.join(side("below"), on("below", lower)).join(side("above"), on("above", upper))
    x = F.when(lower == upper, F.col("_below")).otherwise((upper - F.col("_place")) * F.col("_below") + (F.col("_place") - lower) * F.col("_above"))
    # the columns of a group's points, which are a row each
    cell = lambda i, j: F.max(F.when((F.col("_c") == i) & (F.col("_p") == j), x))
    arrays = [F.when(F.count(F.when(F.col("_c") == i, 1)) > 0, F.array(*(cell(i, j) for j in range(len(points))))).alias(c) for i, c in enumerate(columns)]
    out = both.groupBy(*by).agg(*arrays)
    return out if small is None else out.unionByName(small)


def aggregated(df: DataFrame, by: list[str], plain: list[Column], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """df by group with the plain aggregates and the named quantiles, each of a column at a point (percentiles())."""
    columns, points = sorted({c for c, _ in quantiles.values()}), sorted({p for _, p in quantiles.values()})
    found = percentiles(df, by, columns, points).select(*(F.col(k).alias(f"_b_{k}") for k in by), *(F.col(c).alias(f"_q_{c}") for c in columns))
    out = df.groupBy(*by).agg(*plain)
    both = out.join(found, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by], "left")
    return both.select(*out.columns, *(F.get(f"_q_{c}", F.lit(points.index(p))).alias(name) for name, (c, p) in quantiles.items()))


def percentiles_of_earlier(df: DataFrame, order: str, value: str, point: float, cells: int = CELLS, few: int = FEW) -> DataFrame:
    """order, n and x: for each value of ``order``, how many finite values the smaller ones have, and their percentile at the point.

    Cells of equal width are counted by order, and summed along it; then, for each, only rows of the cell that its rank falls into
    are looked at. order takes few values (folds, months): a row for each and cell is made, never one for each row and later fold.
    """
    rows = df.select(F.col(order).alias("_f"), _finite(F.col(value)).alias("_v"))
    known = rows.where("_v IS NOT NULL AND _f IS NOT NULL")
    ends = known.agg(F.min("_v"), F.max("_v")).first()
    orders = rows.where("_f IS NOT NULL").select("_f").distinct()
    empty = orders.select(F.col("_f").alias(order), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("x"))
    if ends[0] is None:
        return empty
    low, high = ends
    cell = F.least(F.floor((F.col("_v") / 2 - low / 2) / ((high / 2 - low / 2) or 1.0) * cells), F.lit(cells - 1)).alias("_cell")
    counts = _written(known.select("_f", cell).groupBy("_f", "_cell").agg(F.count("*").alias("_n")))
    grid = orders.crossJoin(F.broadcast(counts.select("_cell").distinct())).join(counts, ["_f", "_cell"], "left")  # orders are few, and cells at most so many
    past = Window.partitionBy("_cell").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("_f", "_cell", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_m"))
    upto = Window.partitionBy("_f").orderBy("_cell")  # cells of one order
    grid = _written(grid.withColumns({"_before": F.coalesce(F.sum("_m").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_m").over(Window.partitionBy("_f"))}))
    places = _written(grid.groupBy("_f").agg(F.max("_all").alias("_n")).withColumn("_place", F.lit(float(point)) * (F.col("_n") - 1)))
    asked = places.where("_n > 0").select("_f", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_r"))
    asked = _written(asked.join(grid, "_f").where("_r >= _before AND _r < _before + _m").select("_f", "_cell", (F.col("_r") - F.col("_before")).alias("_r"), F.col("_r").alias("_rank")))
    held = known.select(F.col("_f").alias("_g"), "_v", cell).join(F.broadcast(asked.select("_f", "_cell").distinct()), "_cell").where("_g < _f").select("_f", "_cell", "_v")
    found = values_at(held, ["_f", "_cell"], asked.select("_f", "_cell", "_r"), cells, few).join(asked, ["_f", "_cell", "_r"]).select("_f", F.col("_rank").alias("_r"), "_x")
    found = places.join(found, "_f", "left").groupBy("_f", "_n", "_place").agg(F.min_by("_x", "_r").alias("_a"), F.max_by("_x", "_r").alias("_b"))
    lower, upper = F.floor("_place"), F.ceil("_place")
    x = F.when(lower == upper, F.col("_a")).otherwise((upper - F.col("_place")) * F.col("_a") + (F.col("_place") - lower) * F.col("_b"))
    return found.select(F.col("_f").alias(order), F.col("_n").alias("n"), x.alias("x"))
