"""Epistasis within neutral components: squares of two mutations and their stabilities."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import base_at, masked, with_base
from .mutate import site_groups
from .sampling import running_sum

RESOLUTION = 0.1


def epistasis_present(both: Column, neither: Column, one: Column, other: Column, resolution: float = RESOLUTION) -> Column:
    return F.abs(both + neither - one - other) > 0.99 * resolution


#: Four cells of a square: corner, changed at pos1, at pos2, at both; a cell is 4 times the base at pos1 plus that at pos2.
CELLS = [(4 * a + c, 4 * b + c, 4 * a + d, 4 * b + d) for a, b in combinations(range(4), 2) for c, d in combinations(range(4), 2)]
#: Every square seen from each of its corners.
CORNERS = [x for p, q, r, s in CELLS for x in ((p, q, r, s), (q, p, s, r), (r, s, p, q), (s, r, q, p))]


def _largest(cell: Column, n: int, value: str) -> list[Column]:
    return [F.max(F.when(cell == k, F.col(value))).alias(f"e{k}") for k in range(n)]


def _groups(members: DataFrame, length: int) -> DataFrame:
    """nc_id, pos1, pos2, rest, e: sequences of a component that agree outside two sites, where they can hold a square.

    e has the energies of the sixteen cells, null where there is no member; rest is the code with
    both sites at base 0. A corner of a square has a neighbour in its component at both sites, so
    only pairs of such sites of a sequence are dealt out. Groups are values of fixed width, without
    lists or sorts. A member that is repeated is one, with the largest of its energies; a member without energy takes no part.
    """
    base = base_at(F.col("code"), F.col("pos"), length)
    sites = site_groups(members.select("nc_id", "code", "energy"), length).select("nc_id", "pos", "masked", base.alias("base"), "energy")
    cells = sites.repartition("nc_id", "pos", "masked").groupBy("nc_id", "pos", "masked").agg(*_largest(F.col("base"), 4, "energy"))
    there = sum(F.col(f"e{k}").isNotNull().cast("int") for k in range(4))
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("base"), F.col(f"e{k}").alias("energy")) for k in range(4)]))
    near = cells.where(there > 1).select("nc_id", "pos", "masked", each).where("energy is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos"))
    code = with_base(F.col("masked"), F.col("pos"), F.col("base"), length)
    bits = near.select("nc_id", code.alias("code"), "energy", bit.alias("bit")).groupBy("nc_id", "code").agg(F.bit_or("bit").alias("bits"), F.max("energy").alias("energy"))
    at = F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1)) == 1)
    open_sites = bits.select("nc_id", "code", "energy", at.alias("at")).where(F.size("at") > 1)
    pair = F.flatten(F.transform("at", lambda i: F.transform(F.filter("at", lambda j: j > i), lambda j: F.struct(i.alias("pos1"), j.alias("pos2")))))
    rows = open_sites.select("nc_id", "code", "energy", F.explode(pair).alias("p")).select("nc_id", "code", "energy", "p.*")
    both = masked(masked(F.col("code"), F.col("pos1"), length), F.col("pos2"), length)
    cell = base_at(F.col("code"), F.col("pos1"), length) * 4 + base_at(F.col("code"), F.col("pos2"), length)
    dealt = rows.select("nc_id", "pos1", "pos2", both.alias("rest"), cell.alias("cell"), "energy").repartition("nc_id", "pos1", "pos2", "rest")
    groups = dealt.groupBy("nc_id", "pos1", "pos2", "rest").agg(*_largest(F.col("cell"), 16, "energy"))
    full = sum(F.col(f"e{k}").isNotNull().cast("int") for k in range(16))
    return groups.where(full >= 4).select("nc_id", "pos1", "pos2", "rest", F.array(*[f"e{k}" for k in range(16)]).alias("e"))


def _found(cells: list[tuple[int, ...]]) -> Column:
    """(cells, energies) of those squares whose four cells are all there."""
    four = F.array(*[F.array(*map(F.lit, c)) for c in cells])
    known = F.transform(four, lambda c: F.struct(c.alias("c"), F.transform(c, lambda k: F.col("e")[k]).alias("s")))
    return F.filter(known, lambda q: F.forall(q["s"], lambda v: v.isNotNull()))


def squares(members: DataFrame, length: int) -> DataFrame:
    """nc_id, pos1, pos2, g1, g2, g3, g4 and their energies s1..s4, each square from all corners.

    members: nc_id, code, energy. g2 and g3 are g1 changed at pos1 and at pos2, g4 at both.
    """
    rows = _groups(members, length).select("nc_id", "pos1", "pos2", "rest", F.explode(_found(CORNERS)).alias("q"))
    put = lambda k: with_base(with_base(F.col("rest"), F.col("pos1"), F.floor(F.col("q.c")[k] / 4), length), F.col("pos2"), F.col("q.c")[k] % 4, length)
    return rows.select("nc_id", "pos1", "pos2", *[put(k).alias(f"g{k + 1}") for k in range(4)], *[F.col("q.s")[k].alias(f"s{k + 1}") for k in range(4)])


def epistasis_fraction(found: DataFrame, ignore_zero: bool, resolution: float = RESOLUTION) -> DataFrame:
    """nc_id, fraction of `squares` with epistasis; null where none counts.

    With ignore_zero only corners count at which both single mutations have an effect.
    """
    s = [F.col(f"s{k}") for k in range(1, 5)]
    counts = (F.abs(s[1] - s[0]) > 0.99 * resolution) & (F.abs(s[2] - s[0]) > 0.99 * resolution) if ignore_zero else F.lit(True)
    present = epistasis_present(s[0], s[3], s[1], s[2], resolution)
    return found.groupBy("nc_id").agg(F.try_divide(F.count_if(counts & present), F.count_if(counts)).alias("fraction"))


def epistasis_fractions(members: DataFrame, length: int, resolution: float = RESOLUTION) -> DataFrame:
    """nc_id, fraction of squares with epistasis, and fraction_nonzero, of the corners at which both single mutations have an effect.

    A fraction is null where nothing counts; components without squares have no row. Each group
    counts its own squares, so a row a group is what is added up by component.
    """
    found = F.transform(_found(CELLS), lambda q: q["s"])
    whole = _groups(members, length).select("nc_id", found.alias("squares")).where(F.size("squares") > 0)
    least = 0.99 * resolution
    apart = lambda s, i, j: F.abs(s[i] - s[j]) > least
    # The neighbours of each corner are the two it differs from at one site.
    corners = lambda s: sum((apart(s, k, i) & apart(s, k, j)).cast("int") for k, i, j in ((0, 1, 2), (1, 0, 3), (2, 3, 0), (3, 2, 1)))
    present = lambda s: epistasis_present(s[0], s[3], s[1], s[2], resolution)
    total = lambda f: F.aggregate("squares", F.lit(0), lambda n, s: n + f(s))
    sums = whole.groupBy("nc_id").agg(
        F.sum(F.size("squares")).alias("n"), F.sum(total(lambda s: present(s).cast("int"))).alias("k"),
        F.sum(total(corners)).alias("c"), F.sum(total(lambda s: F.when(present(s), corners(s)).otherwise(0))).alias("ck"),
    )
    return sums.select("nc_id", F.try_divide("k", "n").alias("fraction"), F.try_divide("ck", "c").alias("fraction_nonzero"))


def shuffle_within_group(members: DataFrame, order: Column) -> DataFrame:
    """members (nc_id, code, energy) with the energies of each component permuted by `order`, of code."""
    placed = running_sum(members.select("nc_id", "code"), ["nc_id"], ["code"], F.lit(1), "n")
    dealt = running_sum(members.select("nc_id", "code", "energy", order.alias("o")), ["nc_id"], ["o", "code"], F.lit(1), "n").select("nc_id", "n", "energy")
    return placed.join(dealt, ["nc_id", "n"]).select("nc_id", "code", "energy")


def epistasis_table(landscapes: dict[str, DataFrame], length: int) -> DataFrame:
    """nc_id, landscape, ignore_zero, fraction over several landscapes (nc_id, code, energy)."""
    out = None
    for name, members in landscapes.items():
        both = F.array(F.struct(F.lit(False).alias("ignore_zero"), F.col("fraction")), F.struct(F.lit(True).alias("ignore_zero"), F.col("fraction_nonzero").alias("fraction")))
        part = epistasis_fractions(members, length).select("nc_id", F.lit(name).alias("landscape"), F.inline(both))
        out = part if out is None else out.unionByName(part)
    return out
