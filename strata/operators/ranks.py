"""Row numbers and exact percentiles of tables of any size: brackets from sketches, range-sorted partitions, put together by counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.storage import stored

BEFORE = Window.unboundedPreceding
#: Size of the quantile sketch (rank error about 0.25 %), and how far a bracket reaches to either side of its rank.
SKETCH, REACH = 2000, 0.01
#: Groups of at most FEW values are wholly inside their brackets; groups of more than MOST different values inside brackets are sorted by ranges.
FEW, MOST = 10_000, 1 << 22


def numbered(rows: DataFrame, name: str, *order: Column | str, within: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """rows with their place (from 0, a long) in this order as column `name`: over all rows, or within each key of `within`.

    Partitions are sorted ranges, so a key with most of the rows is spread over many; what is summed up by key is a row for
    each range that holds it. `total` names a column for the count of the key's rows. A null key is a key.
    """
    at, part, before, first = (f"{name}_{x}" for x in ("at", "part", "before", "first"))
    laid = stored(rows.orderBy(*within, *order).withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "numbered")
    keys = [f"{name}_key{i}" for i in range(len(within))]
    counts = laid.groupBy(F.col(part).alias(f"{name}_range"), *[F.col(k).alias(a) for k, a in zip(within, keys)]).agg(F.count("*").alias(before), F.min(at).alias(first))
    every = Window.partitionBy(*keys)
    sums = [F.col(f"{name}_range"), *keys, F.col(first), F.coalesce(F.sum(before).over(every.orderBy(f"{name}_range").rowsBetween(BEFORE, -1)), F.lit(0)).alias(before)]
    counts = counts.select(*sums, *([F.sum(before).over(every).alias(total)] if total else []))
    same = F.col(part) == F.col(f"{name}_range")
    for k, a in zip(within, keys):
        same &= F.col(k).eqNullSafe(F.col(a))
    placed = laid.join(counts, same).withColumn(name, F.col(before) + F.col(at) - F.col(first))
    return placed.drop(at, part, before, first, f"{name}_range", *keys)


def running(rows: DataFrame, sums: tuple[str, ...], *order: Column | str, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with, for each column c of `sums`, c_upto (its sum up to the row in this order, the row included) and c_all (its
    whole sum), over all rows or within each key of `within`. Order and keys must tell rows apart.

    Partitions are sorted ranges; what one task holds is a range, and what is summed up by key a row for each range that
    holds it.
    """
    laid = stored(rows.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "running")
    keys = [f"_key{i}" for i in range(len(within))]
    ranges = laid.groupBy(F.col("_part").alias("_range"), *[F.col(k).alias(a) for k, a in zip(within, keys)]).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    every = Window.partitionBy(*keys)
    below = [F.coalesce(F.sum(f"_{c}").over(every.orderBy("_range").rowsBetween(BEFORE, -1)), F.lit(0)).alias(f"_{c}_below") for c in sums]
    ranges = ranges.select("_range", *keys, *below, *[F.sum(f"_{c}").over(every).alias(f"{c}_all") for c in sums])
    same = F.col("_part") == F.col("_range")
    for k, a in zip(within, keys):
        same &= F.col(k).eqNullSafe(F.col(a))
    here = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(BEFORE, 0)
    placed = laid.withColumns({f"{c}_upto": F.sum(c).over(here) for c in sums}).join(ranges, same)
    return placed.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}_below") for c in sums}).select(*rows.columns, *[f"{c}_{x}" for c in sums for x in ("upto", "all")])


def percentiles(rows: DataFrame, column: str, at: list[float], *keys: str, few: bool = False) -> DataFrame:
    """keys, n, p: the count of present values, and their exact percentiles, interpolated between neighbours (null without a value).

    One scan sketches each group's quantiles, which bracket every rank asked for; a second keeps the values inside, a few
    hundredths of the rows a rank, and counts what lies between brackets, all added up by value on the way to the shuffle.
    Only those are sorted. The counts tell whether a rank fell into its bracket: if one did not, or a group's brackets hold
    too many different values for a task, all values are sorted by ranges instead, so results never rest on the sketch. A
    group of nulls alone has n = 0. Null keys are keys. Runs its jobs when it is called. few: however many rows there are,
    there are few groups, whose brackets go to every task, so that rows needn't meet by key.
    """
    value = F.col(column).cast("double")
    ends = rows.groupBy(*[F.col(k).alias(f"_end_{k}") for k in keys]).agg(F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("_sketch"))
    told = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(min(max(q + d, 0.0), 1.0)) for q in at for d in (-REACH, REACH)]))
    told = F.when(F.col("_n") > FEW, told)
    within = [(F.when((F.col("_n") <= FEW) | F.lit(q - REACH <= 0), F.col("_min")).otherwise(told[2 * i]), F.when((F.col("_n") <= FEW) | F.lit(q + REACH >= 1), F.col("_max")).otherwise(told[2 * i + 1])) for i, q in enumerate(at)]
    ends = ends.select(*[f"_end_{k}" for k in keys], "_n", F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in within]).alias("_brackets"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_end_{k}"))
    plain = rows.select(*keys, value.alias("_v"))
    # Without keys, one row of brackets.
    both = plain.join(F.broadcast(ends) if few else ends, same) if keys else plain.crossJoin(F.broadcast(ends))
    # A value outside of all brackets counts right after the end of the last bracket below it (before all if there is none).
    inside = F.exists("_brackets", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    before = F.array_max(F.transform(F.filter("_brackets", lambda b: b["hi"] < F.col("_v")), lambda b: b["hi"]))
    each = both.select(*keys, "_n", F.when(inside, F.col("_v")).when(F.col("_v").isNotNull(), before).alias("v"), (~F.coalesce(inside, F.lit(False))).alias("out"), F.col("_v").isNotNull().cast("long").alias("c"))
    parts = stored(each.groupBy(*keys, "_n", "v", "out").agg(F.sum("c").alias("c")), "brackets")
    if keys and (parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > MOST or not keys and parts.count() > MOST:
        return _by_ranges(rows.withColumn(column, value), column, at, *keys)
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first(), "out").rowsBetween(BEFORE, 0))
    placed = parts.withColumn("upto", upto)
    rank = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    holds = lambda r: ~F.col("out") & (F.col("upto") - F.col("c") <= r) & (r < F.col("upto"))
    found = [x for i, q in enumerate(at) for x in (F.max(F.when(holds(F.floor(rank(q))), F.col("v"))).alias(f"lo{i}"), F.max(F.when(holds(F.ceil(rank(q))), F.col("v"))).alias(f"hi{i}"))]
    best = stored(placed.groupBy(*keys).agg(F.max("_n").alias("n"), *found), "percentiles")
    missed = reduce(lambda a, b: a | b, [F.col(f"{x}{i}").isNull() for i in range(len(at)) for x in ("lo", "hi")], F.lit(False))
    if best.where((F.col("n") > 0) & missed).limit(1).count():
        return _by_ranges(rows.withColumn(column, value), column, at, *keys)
    return _between(best, at, *keys)


def _between(best: DataFrame, at: list[float], *keys: str) -> DataFrame:
    """keys, n, p from the values at the ranks next to each percentile."""
    rank = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    between = lambda i, q: F.col(f"lo{i}") + (rank(q) - F.floor(rank(q))) * (F.col(f"hi{i}") - F.col(f"lo{i}"))
    return best.select(*keys, "n", F.array(*[between(i, q) for i, q in enumerate(at)]).alias("p"))


def _by_ranges(rows: DataFrame, column: str, at: list[float], *keys: str) -> DataFrame:
    """percentiles() by a sort of all distinct values by ranges: each range looks only for the ranks that fall into it."""
    counts = rows.groupBy(*[F.col(k).alias(k) for k in keys], F.col(column).alias("v")).agg(F.count(column).alias("c"))
    laid = stored(counts.orderBy(*keys, "v").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "ranges")
    ranges = laid.groupBy("part", *keys).agg(F.sum("c").alias("sum"))
    # A row for each range and group.
    below = Window.partitionBy(*keys).orderBy("part").rowsBetween(BEFORE, -1)
    ranges = ranges.select(F.col("part").alias("_part"), *[F.col(k).alias(f"_key_{k}") for k in keys], F.coalesce(F.sum("sum").over(below), F.lit(0)).alias("below"), F.sum("sum").over(Window.partitionBy(*keys)).alias("n"))
    same = F.col("part") == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    upto = F.sum("c").over(Window.partitionBy("part", *keys).orderBy("v").rowsBetween(BEFORE, 0))
    placed = laid.withColumn("upto", upto).join(ranges, same).withColumn("upto", F.col("below") + F.col("upto"))
    rank = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    holds = lambda r: (F.col("upto") - F.col("c") <= r) & (r < F.col("upto"))
    found = [x for i, q in enumerate(at) for x in (F.max(F.when(holds(F.floor(rank(q))), F.col("v"))).alias(f"lo{i}"), F.max(F.when(holds(F.ceil(rank(q))), F.col("v"))).alias(f"hi{i}"))]
    return _between(placed.groupBy(*keys).agg(F.max("n").alias("n"), *found), at, *keys)
