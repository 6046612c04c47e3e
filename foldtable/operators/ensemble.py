"""Stability as aggregates over an ensemble table (code, structure, energy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mutate import point_neighbours

# kT in kcal/mol at 37 degrees Celsius, and the limit beyond which a weight is one.
KT = 0.0019872 * 310.15
ONE = 1e-8
INF = float("inf")
#: Which stability, which effect and which map a quantity stands for.
QUANTITIES = {
    "energygap": ("energy_gap", "ddg_gap", "mfe_unique"),
    "Boltzmann_based": ("dg_boltz", "ddg_boltz", "mfe_unique_fifty"),
    "free_energy": ("energy_gap", "d_mfe", "mfe_unique"),
}


def _dg(p: Column) -> Column:
    return F.when(F.abs(1 - p) < ONE, F.lit(INF)).otherwise(KT * F.log(p / (1 - p)))


def stability(ensemble: DataFrame) -> DataFrame:
    """code, structure (of lowest energy; ties by text), mfe, energy_gap (null without a second), dg_boltz.

    A structure counts once for each sequence, with its lowest energy; rows without a structure or an energy don't
    count. Rows are dealt by code once, or not at all where the table is stored so. The lowest is found
    first, and the least of the others and the sum of weights relative to it are aggregates of fixed
    width, so no list of a sequence's structures is held.
    """
    low = F.min(F.struct("energy", "structure")).over(Window.partitionBy("code"))
    rows = ensemble.where("structure is not null and energy is not null").select("code", "structure", "energy").withColumn("low", low)
    rows = rows.select("code", "structure", "energy", F.col("low.energy").alias("mfe"), F.col("low.structure").alias("best"))
    once = rows.groupBy("code", "best", "mfe", "structure").agg(F.min("energy").alias("energy"))
    found = once.groupBy("code", "best", "mfe").agg(
        F.min(F.when(F.col("structure") != F.col("best"), F.col("energy"))).alias("next"), F.sum(F.exp((F.col("mfe") - F.col("energy")) / KT)).alias("weights")
    )
    return found.select("code", F.col("best").alias("structure"), "mfe", (F.col("next") - F.col("mfe")).alias("energy_gap"), _dg(1 / F.col("weights")).alias("dg_boltz"))


def forms(ensemble: DataFrame) -> DataFrame:
    """code, m_forms: the energy and Boltzmann weight p of every structure of a sequence, as a map; repeated rows count once."""
    rows = ensemble.where("structure is not null").groupBy("code").agg(F.collect_set(F.struct("structure", "energy")).alias("all"))
    rows = rows.withColumn("low", F.array_min(F.transform("all", lambda x: x["energy"])))
    weight = lambda x: F.exp((F.col("low") - x["energy"]) / KT)
    rows = rows.withColumn("total", F.aggregate("all", F.lit(0.0), lambda s, x: s + weight(x)))
    entry = lambda x: F.struct(x["structure"], F.struct(x["energy"].alias("energy"), (weight(x) / F.col("total")).alias("p")))
    return rows.select("code", F.map_from_entries(F.transform("all", entry)).alias("m_forms"))


def probabilities(ensemble: DataFrame) -> DataFrame:
    """ensemble with p, the Boltzmann weight of each structure of a sequence."""
    own = Window.partitionBy("code")
    rows = ensemble.withColumn("low", F.min("energy").over(own)).withColumn("w", F.exp((F.col("low") - F.col("energy")) / KT))
    return rows.withColumn("p", F.col("w") / F.sum("w").over(own)).drop("low", "w")


def structures_in_range(ensemble: DataFrame, width: float) -> DataFrame:
    """Structures at most `width` above the lowest, which is always among them."""
    low = F.min("energy").over(Window.partitionBy("code"))
    return ensemble.withColumn("low", low).where(F.col("energy") - F.col("low") <= width + 1e-9).drop("low")


def energy_of_pair(pairs: DataFrame, ensemble: DataFrame) -> DataFrame:
    """pairs (code, structure) with their energy, infinite where the sequence can't form the structure."""
    return pairs.join(ensemble, ["code", "structure"], "left").withColumn("energy", F.coalesce("energy", F.lit(INF)))


def maps(stable: DataFrame, unfolded: str) -> DataFrame:
    """stable with is_folded, is_unique and is_fifty: the three definitions of the map."""
    folded = F.col("structure") != unfolded
    unique = folded & F.coalesce(F.abs("energy_gap") > 1e-6, F.lit(False))
    return stable.withColumns({"is_folded": folded, "is_unique": unique, "is_fifty": folded & (F.col("dg_boltz") > 0)})


def select_quantity(table: DataFrame, quantity: str) -> DataFrame:
    """table with `stability` and `ddg` taken from the columns that the quantity stands for."""
    dg, ddg, _ = QUANTITIES[quantity]
    return table.withColumns({c: F.col(x) for c, x in (("stability", dg), ("ddg", ddg)) if x in table.columns})


def ddg_table(stable: DataFrame, ensemble: DataFrame, length: int, unfolded: str) -> DataFrame:
    """code, pos, new_base, mutant and the three effects of every point mutation of folded sequences.

    The wild type's structure is held fixed. Mutants that aren't in `stable` are left out. One
    join brings the mutant's stored values and all its structures, among which the old one is looked up.
    """
    wild = stable.where(F.col("structure") != unfolded)
    rows = with_effects(point_neighbours(wild, length), stable, ensemble)
    return rows.select("code", "structure", "pos", "new_base", "mutant", "ddg_gap", "ddg_boltz", "d_mfe")


def with_effects(rows: DataFrame, stable: DataFrame, ensemble: DataFrame) -> DataFrame:
    """rows (columns of stable, mutant, ...) with the three effects of the change from code to mutant, the structure held fixed."""
    kept = ("structure", "mfe", "energy_gap", "dg_boltz")
    # Spark knows neither how many mutants a row becomes nor how large a map is: by the stored files' size it would send either to all tasks by way of the driver.
    side = stable.select("code", *[F.col(c).alias(f"m_{c}") for c in kept]).join(forms(ensemble).hint("merge"), "code").withColumnRenamed("code", "mutant")
    held = F.try_element_at("m_forms", F.col("structure"))
    rows = rows.join(side.hint("merge"), "mutant").withColumn("held", held["energy"]).withColumn("held_p", held["p"])
    same, fits = F.col("m_structure") == F.col("structure"), F.col("held").isNotNull()
    gap = F.when(same, F.col("m_energy_gap") - F.col("energy_gap")).when(fits, F.col("m_mfe") - F.col("held") - F.col("energy_gap")).otherwise(F.lit(-INF))
    boltz = F.when(same, F.col("m_dg_boltz") - F.col("dg_boltz")).when(fits, _dg(F.col("held_p")) - F.col("dg_boltz")).otherwise(F.lit(-INF))
    mfe = F.when(same, F.col("m_mfe") - F.col("mfe")).when(fits, F.col("held") - F.col("mfe")).otherwise(F.lit(INF))
    found = rows.withColumns({"ddg_gap": gap, "ddg_boltz": boltz, "d_mfe": mfe})
    return found.drop("held", "held_p", "m_forms", *[f"m_{c}" for c in kept])
