"""Summaries of effects and of neutral sets: filters, attached columns, grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_names, null_safe_join
from .components import _drop, _kept
from .sampling import running_sum

INF = float("inf")
BOX = (0.05, 0.25, 0.5, 0.75, 0.95)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def finite_effects(effects: DataFrame, col: str = "ddg") -> DataFrame:
    """Rows of finite effect, the effect made absolute."""
    return effects.where(finite(F.col(col))).withColumn(col, F.abs(col))


def counted(rows: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """keys, x and n, how often each value comes: counts combine before the shuffle, and quantiles of few groups need no more."""
    return rows.groupBy(*keys, x.alias("x")).agg(F.count("*").alias("n"))


#: Rows of counted values up to which one aggregate takes them; it holds a group's values in one task.
AT_ONCE = 1_000_000


def quantiles(counts: DataFrame, keys: list[str], fractions, at_once: int = AT_ONCE) -> DataFrame:
    """keys and q, an array of quantiles at `fractions` of counted values (keys, x, n), interpolated between values.

    A quantile lies between two places among a group's sorted values. Running counts over ranges of
    (keys, x) say which values stand there, so a group's values are spread over many tasks, however
    many they are. Few counted values in all go through one aggregate, with the same result. Null
    values don't count; a group without others has nulls. Infinity sorts last, and between a
    finite value and infinity lies infinity.
    """
    held = _kept(counts.select(*keys, "x", "n"))
    if held.count() <= at_once:
        return held.groupBy(*keys).agg(F.percentile("x", F.array(*map(F.lit, fractions)), F.col("n")).alias("q"))
    present = held.where("x is not null")
    totals = present.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = running_sum(present, keys, ["x"], F.col("n"), "before")
    wanted = null_safe_join(placed, totals, keys)
    cells = []
    for k, f in enumerate(fractions):
        at = F.lit(f) * (F.col("total") - 1)
        for name, place in ((f"lo{k}", F.floor(at)), (f"hi{k}", F.ceil(at))):
            cells.append(F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("x"))).alias(name))
    found = wanted.groupBy(*keys).agg(*cells, F.first("total").alias("total"))
    q = []
    for k, f in enumerate(fractions):
        at, lo, hi = F.lit(f) * (F.col("total") - 1), F.col(f"lo{k}"), F.col(f"hi{k}")
        q.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    groups = held.select(*keys).distinct()
    named = found.select(*keys, F.array(*q).alias("q"))
    return null_safe_join(groups, named, keys, "left") if keys else named


def box_stats(rows: DataFrame, keys: list[str], col: str, digits: int | None = None) -> DataFrame:
    """p5, p25, p50, p75, p95 of a column by group, interpolated between values."""
    x = F.col(col) if digits is None else F.round(col, digits)
    cut = quantiles(counted(rows, keys, x), keys, BOX)
    return cut.select(*keys, *[F.col("q")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(BOX)])


def box_stats_at_two_levels(rows: DataFrame, key: str, finer: str, col: str) -> DataFrame:
    """box_stats by key and by (key, finer) in one pass; `finer` is null in the former."""
    both = rows.select(key, finer, col, F.explode(F.array(F.lit(0), F.lit(1))).alias("level"))
    return box_stats(both.withColumn(finer, F.when(F.col("level") == 1, F.col(finer))), [key, finer, "level"], col).drop("level")


def neutral_set_sizes(gpmap: DataFrame, valid: Column | None = None) -> DataFrame:
    rows = gpmap if valid is None else gpmap.where(valid)
    return rows.groupBy("structure").agg(F.count("*").alias("size"))


def effect_sizes(effects: DataFrame, key: str, col: str = "ddg") -> DataFrame:
    """key, x, n: absolute effects, counted; infinite ones are among them, null and NaN are not."""
    return counted(effects.where(F.col(col).isNotNull() & ~F.isnan(col)), [key], F.abs(col))


def stability_table(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """By key: size, maximum and mean stability, and the lower quartile of absolute effects, infinite ones included.

    sizes: key, x, n of effects, as `effect_sizes` or `mutate.site_differences` count them.
    """
    sets = rows.groupBy(key).agg(F.count("*").alias("size"), F.max("stability").alias("max_dg"), F.avg("stability").alias("mean_dg"))
    low = quantiles(sizes, [key], [0.25]).select(key, F.col("q")[0].alias("lower_quartile_abs_ddg"))
    return sets.join(low, key, "left")


def attach(gpmap: DataFrame, components: DataFrame) -> DataFrame:
    """gpmap (code, structure, ...) with nc_id and the size of its neutral set. Two tables in buckets by code are joined without a shuffle; sizes are a row for each structure."""
    sizes = neutral_set_sizes(gpmap).withColumnRenamed("size", "neutral_set_size")
    return gpmap.join(components.select("code", "nc_id"), "code").join(sizes, "structure")


def sequence_summary(gpmap: DataFrame, components: DataFrame) -> DataFrame:
    """code, structure, nc_id, nc_size, stability, neutral_set_size, mfe of folded sequences."""
    sized = components.join(components.groupBy("nc_id").agg(F.count("*").alias("nc_size")), "nc_id").select("code", "nc_id", "nc_size")
    return gpmap.join(neutral_set_sizes(gpmap).withColumnRenamed("size", "neutral_set_size"), "structure").join(sized, "code").select("code", "structure", "nc_id", "nc_size", "stability", "neutral_set_size", "mfe")


def element_length_quartiles(effects: DataFrame, least: int = 20) -> DataFrame:
    """Median and quartiles by role, place and element length; null below `least` rows."""
    keys = ["role", "place", "element_length"]
    counts = _kept(counted(effects, keys, F.col("ddg")))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    joined = null_safe_join(sizes, quantiles(counts, keys, (0.25, 0.5, 0.75)), keys)
    return joined.select(*keys, "n", *[F.when(F.col("n") >= least, F.col("q")[k]).alias(c) for k, c in enumerate(("lower", "median", "upper"))])


def stack_size_class(role: Column, length: Column) -> Column:
    return F.when(role != "stack", role).when(length <= 2, "stack 1-2").when(length <= 4, "stack 3-4").otherwise("stack 5+")


def model_category(role: Column, stack_length: Column) -> Column:
    """L for loops, B for bulges and internal loops, S and its length for stacks."""
    return F.when(role == "stack", F.concat(F.lit("S"), stack_length.cast("string"))).when(role.isin("bulge", "internal loop"), "B").otherwise("L")


def model_parameters(effects: DataFrame) -> DataFrame:
    """Quartiles of absolute effects by category, of point mutations alone and with pair swaps.

    effects: category, kind ('point' or 'bp'), ddg. Infinite effects of point mutations are left
    out; those of pair swaps stay.
    """
    rows = effects.where((F.col("kind") == "bp") | finite(F.col("ddg"))).select("category", F.abs("ddg").alias("x"), (F.col("kind") == "point").alias("point"))
    # A point mutation counts on its own and together with swaps.
    both = rows.select("category", "x", F.explode(F.when(F.col("point"), F.array(F.lit("point"), F.lit("swaps"))).otherwise(F.array(F.lit("swaps")))).alias("set"))
    cut = quantiles(counted(both, ["category", "set"], F.col("x")), ["category", "set"], (0.25, 0.5, 0.75))
    names = ("lower", "median", "upper")
    cells = [F.max(F.when(F.col("set") == kind, F.col("q")[k])).alias(f"{kind}_{n}") for kind in ("point", "swaps") for k, n in enumerate(names)]
    return cut.groupBy("category").agg(*cells)


def threshold_fractions(effects: DataFrame, key: str, below: list[float], above: list[float]) -> DataFrame:
    """Shares of effects that are small, and that don't lower stability much; infinite ones count below the line."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    name = lambda kind, x: f"{kind}_{str(abs(x)).replace('.', '_')}"
    return effects.groupBy(key).agg(*[share(F.abs("ddg") <= x + 0.001).alias(name("abs", x)) for x in below], *[share(F.col("ddg") >= x - 0.001).alias(name("minus", x)) for x in above])


def walk_summary(samples: DataFrame, effects: DataFrame, key: str, stable_only: bool = True) -> DataFrame:
    """By key: mean stability, share of stability near zero, lower quartile with and median without infinite effects."""
    near = F.abs("stability") <= 1e-5
    mean = F.avg(F.when(~near, F.col("stability"))) if stable_only else F.avg("stability")
    head = samples.groupBy(key).agg(mean.alias("dg"), F.avg(F.when(near, 1.0).otherwise(0.0)).alias("fraction_dg_zero"))
    sizes = _kept(counted(effects.where("ddg is not null"), [key], F.abs("ddg")))
    low = quantiles(sizes, [key], [0.25]).select(key, F.col("q")[0].alias("lower_quartile_ddg"))
    middle = quantiles(sizes.where(finite(F.col("x"))), [key], [0.5]).select(key, F.col("q")[0].alias("median_ddg"))
    return head.join(low, key, "left").join(middle, key, "left")


def average_rank(rows: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks with ties averaged; a null value has no rank. Ranks are running counts over distinct values, which ranges of them sum."""
    size, before = free_names(rows, "_n", "_before")
    counts = rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias(size))
    running = running_sum(counts, [], [col], F.col(size), before)
    return rows.join(running, col, "left").withColumn(out, F.col(before) + (F.col(size) + 1) / 2).drop(size, before)


def histogram_2d(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Counts of non-empty cells and their centres; the last bin is closed."""
    ends = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.col(lo)) * bins / (F.col(hi) - F.col(lo))), F.lit(bins - 1))
    centre = lambda b, lo, hi: F.col(lo) + (F.col(b) + 0.5) * (F.col(hi) - F.col(lo)) / bins
    both = rows.crossJoin(F.broadcast(ends))  # one row
    grouped = both.groupBy(cell(x, "x0", "x1").alias("bx"), cell(y, "y0", "y1").alias("by"), "x0", "x1", "y0", "y1").agg(F.count("*").alias("n"))
    return grouped.select(centre("bx", "x0", "x1").alias("x"), centre("by", "y0", "y1").alias("y"), "n")


def drop_rare_category(rows: DataFrame, family: str, least: int = 10) -> DataFrame:
    """rows without the roles of a family if its end or its middle class has fewer than `least` rows."""
    counts = rows.where(F.col("role") == family).groupBy("place").agg(F.count("*").alias("n"))
    enough = counts.agg(((F.count("*") == 2) & F.coalesce(F.min("n") >= least, F.lit(False))).alias("keep"))
    return rows.crossJoin(F.broadcast(enough)).where((F.col("role") != family) | F.col("keep")).drop("keep")


def _digests(rows: DataFrame, part: Column, key: str, values: list[str]) -> DataFrame:
    """part, n, x, s: how many rows a part of the keys has, and two digests that any order of them gives."""
    h = F.xxhash64(key, *values)
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s"))


def differing_rows(stored: DataFrame, computed: DataFrame, key: str, values: list[str], parts: int = 1024) -> tuple[DataFrame, int]:
    """Rows of either side in parts of the keys whose digests differ, and how many rows the equal parts have.

    key is an integer. Keys are dealt to `parts` parts by a hash, those of parts that differ to `parts` finer
    ones, so of equal tables only digests travel. Rows: key, in_a, in_b and a_*, b_* of the values.
    """
    sides = [df.select(key, *values) for df in (stored, computed)]
    hashed, equal, at = F.xxhash64(F.lit(7), key), 0, None
    for level in range(2):
        part = F.pmod(F.shiftright(hashed, 24 * level), F.lit(parts)).cast("int")
        a, b = (_digests(df, part, key, values) for df in sides)
        names = ("n", "x", "s")
        joined = _kept(a.join(b.select("part", *[F.col(c).alias(f"b_{c}") for c in names]), "part", "full"))
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
        equal += joined.where(same).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        at = joined.where(~same).select(F.col("part").alias("_part"))  # at most `parts` rows
        sides = [df.join(F.broadcast(at), part == F.col("_part"), "left_semi") for df in sides]
    a, b = (df.select(F.col(key).alias(f"{c}_key"), *[F.col(v).alias(f"{c}_{v}") for v in values], F.lit(True).alias(f"in_{c}")) for df, c in zip(sides, "ab", strict=True))
    both = a.join(b, F.col("a_key").eqNullSafe(F.col("b_key")), "full")
    rows = both.select(F.coalesce("a_key", "b_key").alias(key), F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"), *[f"{c}_{v}" for v in values for c in "ab"])
    return rows, equal


def agrees(rows: DataFrame, values: list[str], within: float = 1e-3) -> Column:
    """Whether all values of both sides of `differing_rows` agree: numbers within `within` or equal infinities, others if they are equal; null agrees with null alone."""
    ok = F.col("in_a") & F.col("in_b")
    for v in values:
        a, b = F.col(f"a_{v}"), F.col(f"b_{v}")
        near = a.eqNullSafe(b)
        if rows.schema[f"a_{v}"].dataType.typeName() in ("double", "float"):
            near = near | F.coalesce(F.abs(a - b) < within, F.lit(False))
        ok = ok & near
    return ok


def reconcile(stored: DataFrame, computed: DataFrame, key: str, values: list[str], parts: int = 1024) -> DataFrame:
    """rows on either side, rows that agree (see `agrees`), one_sided: rows whose key the other side lacks. A null value is a value."""
    found, equal = differing_rows(stored, computed, key, values, parts)
    one = F.count_if(~(F.col("in_a") & F.col("in_b")))
    return found.agg((F.count("*") + equal).alias("rows"), (F.count_if(agrees(found, values)) + equal).alias("agree"), one.alias("one_sided"))
