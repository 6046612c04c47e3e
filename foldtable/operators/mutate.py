"""Mutational neighbourhoods: projections and explodes of coded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.codec import PAIRS, base_at, with_base


def point_neighbours(seqs: DataFrame, length: int, pos: Column | None = None, codes=codec) -> DataFrame:
    """seqs (code, ...) with pos, new_base and mutant for each of the three other bases at every site, or at one. codes: `codec`, or `wide_codec` for long sequences."""
    sites = F.array(pos.cast("int")) if pos is not None else F.sequence(F.lit(0), F.lit(length - 1))
    rows = seqs.withColumn("pos", F.explode(sites)).withColumn("new_base", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.where(F.col("new_base") != codes.base_at(F.col("code"), F.col("pos"), length)).withColumn("mutant", codes.with_base(F.col("code"), F.col("pos"), F.col("new_base"), length))


def _pair_numbers() -> Column:
    numbers = [("ACUG".index(a), "ACUG".index(b)) for a, b in PAIRS]
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in numbers])


def _pair_rows(seqs: DataFrame, pairs: DataFrame, length: int) -> DataFrame:
    """seqs (code, structure, ...) with i, j and a, b for each pair of sites and each allowed pair of bases."""
    one = pairs.where("pos < partner").select("structure", F.col("pos").alias("i"), F.col("partner").alias("j"))
    rows = seqs.join(one, "structure").withColumn("p", F.explode(_pair_numbers())).withColumns({"a": F.col("p.a"), "b": F.col("p.b")}).drop("p")
    first = with_base(F.col("code"), F.col("i"), F.col("a"), length)
    rows = rows.withColumn("half", first).withColumn("mutant", with_base(F.col("half"), F.col("j"), F.col("b"), length)).drop("half")
    return rows.withColumn("same_a", base_at(F.col("code"), F.col("i"), length) == F.col("a")).withColumn("same_b", base_at(F.col("code"), F.col("j"), length) == F.col("b"))


def bp_double_mutants(seqs: DataFrame, pairs: DataFrame, length: int) -> DataFrame:
    """For every pair of sites, the allowed pairs of bases that differ at both ends."""
    return _pair_rows(seqs, pairs, length).where(~F.col("same_a") & ~F.col("same_b")).drop("same_a", "same_b")


def bp_swaps_at_site(seqs: DataFrame, pairs: DataFrame, length: int, pos: Column) -> DataFrame:
    """At a paired site, all allowed pairs of bases but the current one."""
    rows = _pair_rows(seqs, pairs, length).where((F.col("i") == pos) | (F.col("j") == pos))
    return rows.where(~(F.col("same_a") & F.col("same_b"))).drop("same_a", "same_b")


def double_mutant(g1: Column, g2: Column, g3: Column) -> Column:
    """The sequence with g2's and g3's change of g1."""
    return g2.bitwiseXOR(g3).bitwiseXOR(g1)


def site_mutants(seqs: DataFrame, length: int, more: list[str]) -> DataFrame:
    """seqs (code and the columns `more`) with pos, new_base, mutant and the mutant's m_* columns, for each mutant that seqs has too.

    The mutants of a sequence at a site are the other members of its site group, four at most,
    so a sequence travels once for each site and nothing is joined. A code that is repeated is one sequence.
    """
    held = ["code", *more]
    rows = site_groups(seqs.select(*held), length).withColumn("it", F.struct(*held))
    groups = rows.groupBy("pos", "masked").agg(F.collect_list("it").alias("m")).where(F.size("m") > 1)
    pairs = groups.select("pos", F.explode("m").alias("a"), "m").select("pos", "a", F.explode("m").alias("b")).where("a.code <> b.code")
    new = base_at(F.col("b.code"), F.col("pos"), length).alias("new_base")
    return pairs.select(*[F.col(f"a.{c}").alias(c) for c in held], "pos", new, F.col("b.code").alias("mutant"), *[F.col(f"b.{c}").alias(f"m_{c}") for c in more])


def site_differences(seqs: DataFrame, length: int, key: str, value: str) -> DataFrame:
    """key, x, n: how often the absolute difference x of a value lies between a sequence of a key and a mutant that seqs has too.

    key is a long, value a double; seqs also has code. A site group is four values and four keys of fixed
    width, so it needs no sort and no list, and only counts leave it. Differences that are null or not
    a number don't count. A code that is repeated is one sequence, with its largest value and key.
    """
    base = base_at(F.col("code"), F.col("pos"), length)
    rows = site_groups(seqs.select("code", key, value), length).select("pos", "masked", base.alias("base"), key, value)
    cell = lambda c, b: F.max(F.when(F.col("base") == b, F.col(c)))
    groups = rows.repartition("pos", "masked").groupBy("pos", "masked").agg(*[cell(c, b).alias(f"{c}_{b}") for c in (key, value) for b in range(4)])
    both = [(a, b) for a in range(4) for b in range(4) if a != b]
    found = groups.select(F.inline(F.array(*[F.struct(F.col(f"{key}_{a}").alias(key), F.abs(F.col(f"{value}_{b}") - F.col(f"{value}_{a}")).alias("x")) for a, b in both])))
    return found.where("x is not null and not isnan(x)").groupBy(key, "x").agg(F.count("*").alias("n"))


def site_groups(seqs: DataFrame, length: int, codes=codec) -> DataFrame:
    """seqs with pos and masked: rows equal in both differ at that site alone."""
    rows = seqs.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return rows.withColumn("masked", codes.masked(F.col("code"), F.col("pos"), length))
