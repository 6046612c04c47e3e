"""Repeatable samples: every draw is a function of keys and a seed, never of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_names, null_safe_join
from .components import _drop, _kept

PRIME = 2147483647


def mix(key: Column, seed: int) -> Column:
    """A pseudo-random integer below PRIME from an integer key, the same in any engine that has xor and shifts.

    Congruential steps alone are one affine map of the key, whose values lie on a lattice; the
    shifts between them break that.
    """
    step = lambda k, s: F.pmod(F.pmod(k, F.lit(PRIME)) * 1103515245 + s, F.lit(PRIME))
    fold = lambda k, n: k.bitwiseXOR(F.shiftright(k, n))
    first = fold(step(key.cast("long"), 12345 + seed), 15)
    return step(fold(step(first, 67891), 13), seed)


def random_sequences(ids: DataFrame, length: int, seed: int) -> DataFrame:
    """id and the code of an independent uniform sequence for each id."""
    sites = F.sequence(F.lit(0), F.lit(length - 1))
    digit = lambda k: F.pmod(F.floor(mix(F.col("id") * length + k, seed) / 64), F.lit(4)).cast("long")
    return ids.select("id", F.aggregate(F.transform(sites, digit), F.lit(0).cast("long"), lambda a, d: a * 4 + d).alias("code"))


def running_sum(rows: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """rows with the sum of value over those of equal keys that come before in `order`, which must be unique within them.

    Rows are dealt by ranges of (keys, order), so a key of any share of the rows spans many
    tasks: each range sums its own rows, and what comes before it is a sum of the ranges' totals.
    """
    part, size, local, base = free_names(rows, "_part", "_size", "_local", "_base")
    by = [*keys, *order] if keys else order
    dealt = rows.withColumn(size, value).repartitionByRange(*by).withColumn(part, F.spark_partition_id())
    held = _kept(dealt)
    before = lambda w: F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = held.groupBy(*keys, part).agg(F.sum(size).alias(size))
    # A row for each key and range that has it.
    bases = totals.select(*keys, part, before(Window.partitionBy(*keys).orderBy(part)).alias(base)) if keys else totals.select(part, before(Window.partitionBy(F.lit(0)).orderBy(part)).alias(base))
    placed = held.withColumn(local, before(Window.partitionBy(*keys, part).orderBy(*order)))
    return null_safe_join(placed, bases, [*keys, part]).withColumn(out, F.col(local) + F.col(base)).drop(part, size, local, base)


def draw_of(key: Column, draw: Column, seed: int) -> Column:
    """A pseudo-random integer of 62 bits of a key and a draw, which are mixed apart."""
    own = mix(key, seed) * 65536 + draw
    return mix(own, seed + 1) * PRIME + mix(own, seed + 2)


def sample_per_group(rows: DataFrame, group: str, order: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement from each group: group, draw, and the row drawn.

    A draw is a rank in its group, so groups are ranked once and draws joined by (group, rank).
    Rows of a group need different values in `order`, the least of which seeds its draws. Columns
    of rows named `draw` are replaced.
    """
    rows = rows.drop("draw")
    rank, size, key = free_names(rows, "_rank", "_n", "_key")
    ranked = running_sum(rows, [group], [order], F.lit(1), rank)
    sizes = rows.groupBy(group).agg(F.count("*").alias(size), F.min(order).alias(key))
    draws = sizes.select(group, size, key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    picked = draws.select(group, "draw", F.pmod(draw_of(F.col(key), F.col("draw"), seed), F.col(size)).alias(rank))
    return picked.join(ranked, [group, rank]).drop(rank)


def sample_n(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that only their keys decide."""
    (o,) = free_names(rows, "_o")
    return rows.withColumn(o, mix(F.col(key), seed)).orderBy(o, key).limit(n).drop(o)


def weighted_sample(rows: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, each stratum as likely as any other: weight 1 over its size.

    The n smallest of -ln(u)/weight are a sample of successive weighted draws.
    """
    size, o = free_names(rows, "_n", "_o")
    weighted = rows.join(rows.groupBy(stratum).agg(F.count("*").alias(size)), stratum)
    u = (mix(F.col(key), seed) + 0.5) / PRIME
    return weighted.withColumn(o, F.round(-F.log(u) * F.col(size), 6)).orderBy(o, key).limit(n).drop(o, size)


def fill_to_target(rows: DataFrame, key: str, size: str, target: int, seed: int) -> DataFrame:
    """Whole rows, in hashed order, until their sizes add up to at least `target`. Sums run by ranges of that order."""
    o, before = free_names(rows, "_o", "_before")
    summed = running_sum(rows.withColumn(o, mix(F.col(key), seed)), [], [o, key], F.col(size), before)
    return summed.where(F.col(before) < target).drop(o, before)


def sample_until_distinct(draw, per_structure: int, wanted: int, batch: int, rounds: int = 64) -> DataFrame:
    """structure: at least per_structure * wanted distinct ones, by rounds of draws.

    draw(first, n) gives the structures of draws number `first` to first + n - 1, each of which is decided
    by its number, so that results don't depend on rounds or partitions but for how far they go. A
    round is sized by the share of new structures in the one before, and is at least `batch`; if `rounds`
    of them don't suffice, what was found is an error.
    """
    target, found, drawn, size, known = per_structure * wanted, None, 0, batch, 0
    for _ in range(rounds):
        new = draw(drawn, size).select("structure").where("structure is not null").distinct()
        found_now = _kept(new if found is None else found.union(new).distinct())
        if found is not None:
            _drop(found)
        count = found_now.count()
        found, drawn = found_now, drawn + size
        if count >= target:
            return found
        # New ones become rarer, so what the last share says is doubled; a round without any doubles as well.
        share = (count - known) / size
        size, known = int(min(max(batch, 2 * (target - count) / share if share else 2 * size), 64 * size)), count
    raise ValueError(f"{known} structures of {target} after {drawn} draws")
