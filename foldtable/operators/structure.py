"""Features of dot-bracket structures, one row for each site.

Structures are a dimension: features depend on nothing else, so they are computed on distinct
structures and joined back on (structure, pos). All windows are within one structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT, DOT = "(", ")", "."


def symbols(structures: DataFrame) -> DataFrame:
    """structure, pos, sym, run (open brackets so far) of distinct, non-null, non-empty structures."""
    distinct = structures.select("structure").where(F.length("structure") > 0).distinct()
    sites = distinct.select("structure", F.posexplode(F.split("structure", "")).alias("pos", "sym"))
    step = F.when(F.col("sym") == OPEN, 1).when(F.col("sym") == SHUT, -1).otherwise(0)
    return sites.withColumn("run", F.sum(step).over(_along()).cast("int"))


def _along(*keys: str):
    return Window.partitionBy("structure", *keys).orderBy("pos")


def balance(structures: DataFrame) -> DataFrame:
    """structure, balanced: whether brackets match and no other character occurs."""
    ends = symbols(structures).groupBy("structure").agg(F.min("run").alias("low"), F.max_by("run", "pos").alias("last"))
    return ends.select("structure", ((F.col("low") >= 0) & (F.col("last") == 0) & F.col("structure").rlike(r"^[.()]*$")).alias("balanced"))


def with_partner(sites: DataFrame) -> DataFrame:
    """Adds level (depth of the pair a bracket belongs to) and partner, null for unpaired sites.

    On one level, brackets open and shut in turn, so a bracket's partner is its neighbour there.
    """
    level = F.when(F.col("sym") == SHUT, F.col("run") + 1).otherwise(F.col("run"))
    there = _along("level", "paired")
    partner = F.when(F.col("sym") == OPEN, F.lead("pos").over(there)).when(F.col("sym") == SHUT, F.lag("pos").over(there))
    return sites.withColumn("level", level).withColumn("paired", F.col("sym") != DOT).withColumn("partner", partner)


def base_pairs(structures: DataFrame) -> DataFrame:
    """structure, pos, partner of every paired site; an unbalanced structure is an error."""
    ok = balance(structures)
    checked = ok.select(F.when(F.col("balanced"), F.col("structure")).otherwise(F.raise_error(F.concat(F.lit("not balanced: "), "structure"))).alias("structure"))
    return with_partner(symbols(checked)).where("paired").select("structure", "pos", "partner")


def pair_arrays(structures: DataFrame) -> DataFrame:
    """structure, pairs: its pairs as one array of structs (i, j), empty where it has none."""
    rows = with_partner(symbols(structures)).groupBy("structure")
    pairs = F.array_sort(F.collect_list(F.when(F.col("sym") == OPEN, F.struct(F.col("pos").alias("i"), F.col("partner").alias("j")))))
    return rows.agg(pairs.alias("pairs"))


def site_features(structures: DataFrame) -> DataFrame:
    """All features of each site of balanced structures.

    structure, pos, sym, partner, prev_sym, next_sym, prev_bracket, next_bracket and their
    positions, stack_length, loop_length, element_length, exterior, multiloop, role, place.
    """
    s = with_partner(symbols(structures))
    w = _along()
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    bracket = F.when(F.col("paired"), F.struct("pos", "sym", "partner"))
    s = s.select(
        "*", F.lag("sym", 1, " ").over(w).alias("prev_sym"), F.lead("sym", 1, " ").over(w).alias("next_sym"),
        F.lag("partner").over(w).alias("partner_before"), F.lead("partner").over(w).alias("partner_after"),
        F.last(bracket, True).over(before).alias("pb"), F.first(bracket, True).over(after).alias("nb"),
        F.least("pos", "partner").alias("i"), (F.col("pos") + F.col("partner")).alias("ij"),
    )
    # Runs: pairs (i, j), (i+1, j-1) keep i+j, and rows keep their distance to their rank.
    s = s.withColumn("stack_run", F.when(F.col("paired"), F.col("i") - F.row_number().over(Window.partitionBy("structure", "sym", "ij").orderBy("i"))))
    s = s.withColumn("loop_run", F.when(~F.col("paired"), F.col("pos") - F.row_number().over(_along("sym"))))
    size = lambda *k: F.count("*").over(Window.partitionBy("structure", "sym", *k)).cast("int")
    s = s.withColumn("stack_length", F.when(F.col("paired"), size("ij", "stack_run"))).withColumn("loop_length", F.when(~F.col("paired"), size("loop_run")))
    s = s.withColumn("exterior", ~F.col("paired") & (F.col("run") == 0))
    # The pair around a site is the last to open one level up; it closes a multiloop if it holds two pairs.
    up = F.when(F.col("paired"), F.col("level") - 1).otherwise(F.col("run"))
    s = s.withColumn("depth", up)
    opened = F.when((F.col("sym") == OPEN), F.struct("level", "pos"))
    s = s.withColumn("opened", F.filter(F.collect_list(opened).over(before), lambda o: o["level"] == F.col("depth")))
    s = s.withColumn("parent", F.when(F.col("depth") > 0, F.element_at("opened", -1)["pos"])).drop("opened")
    children = F.sum(F.when(F.col("sym") == OPEN, 1).otherwise(0)).over(Window.partitionBy("structure", "parent"))
    s = s.withColumn("multiloop", F.col("parent").isNotNull() & (children > 1))
    return _with_role(s).select(
        "structure", "pos", "sym", "partner", "prev_sym", "next_sym", F.coalesce("pb.sym", F.lit(" ")).alias("prev_bracket"), F.coalesce("nb.sym", F.lit(" ")).alias("next_bracket"),
        F.col("pb.pos").alias("prev_bracket_pos"), F.col("nb.pos").alias("next_bracket_pos"), "stack_length", "loop_length",
        F.coalesce("stack_length", "loop_length").alias("element_length"), "exterior", "multiloop", "role", "place",
    )


def _with_role(s: DataFrame) -> DataFrame:
    symbol = lambda at: F.when((at < 0) | (at >= F.length("structure")), " ").otherwise(F.substring("structure", at + 1, F.lit(1)))
    around = [F.col("prev_sym"), F.col("next_sym"), symbol(F.col("partner") - 1), symbol(F.col("partner") + 1)]
    open_end = around[0].isin(DOT, " ")
    for x in around[1:]:
        open_end = open_end | x.isin(DOT, " ")
    nested = (F.abs(F.col("partner_before") - F.col("partner")) == 1) & (F.abs(F.col("partner_after") - F.col("partner")) == 1)
    touches = F.col("prev_sym").isin(OPEN, SHUT) | F.col("next_sym").isin(OPEN, SHUT)
    edge = (F.col("prev_sym") == " ") | (F.col("next_sym") == " ")
    hairpin = (F.col("pb.sym") == OPEN) & (F.col("nb.sym") == SHUT)
    opposite = F.abs(F.col("nb.partner") - F.col("pb.partner")) - 1
    role = (
        F.when(F.col("paired"), "stack").when(F.col("exterior"), "exterior loop").when(hairpin, "hairpin loop")
        .when(F.col("multiloop"), "multiloop").when(opposite != 0, "internal loop").otherwise("bulge")
    )
    end = F.when(F.col("paired"), open_end | ~F.coalesce(nested, F.lit(False))).when(F.col("exterior"), touches | edge).otherwise(touches)
    return s.withColumn("role", role).withColumn("place", F.when(end, "end").otherwise("middle"))


def validity(structures: DataFrame) -> DataFrame:
    """structure, balanced, hairpins_ok, has_pair, isolated, valid, valid_with_isolated.

    A pair encloses three sites at least; `isolated` says that some stack has one pair only.
    """
    balanced = balance(structures)
    good = site_stacks(balanced.where("balanced"))
    flags = good.groupBy("structure").agg(F.bool_and(F.abs(F.col("partner") - F.col("pos")) >= 4).alias("hairpins_ok"), (F.min("stack_length") == 1).alias("isolated"))
    joined = balanced.join(flags, "structure", "left")
    pair = F.col("hairpins_ok").isNotNull()
    fine = F.col("balanced") & F.coalesce("hairpins_ok", F.lit(False))
    return joined.select(
        "structure", "balanced", F.coalesce("hairpins_ok", F.col("balanced")).alias("hairpins_ok"), pair.alias("has_pair"),
        F.coalesce("isolated", F.lit(False)).alias("isolated"), (fine & ~F.coalesce("isolated", F.lit(False))).alias("valid"), fine.alias("valid_with_isolated"),
    )


def keep_valid(rows: DataFrame, structures: DataFrame) -> DataFrame:
    """Rows whose structure is valid: neither unfolded nor with a pair that stands alone. `structures` holds all of theirs."""
    valid = validity(structures).where("valid").select("structure")
    return rows.join(valid, "structure", "left_semi")


def site_stacks(structures: DataFrame) -> DataFrame:
    """structure, pos, partner, stack_length of paired sites of balanced structures."""
    s = with_partner(symbols(structures)).where("paired").withColumn("i", F.least("pos", "partner")).withColumn("ij", F.col("pos") + F.col("partner"))
    s = s.withColumn("stack_run", F.col("i") - F.row_number().over(Window.partitionBy("structure", "sym", "ij").orderBy("i")))
    return s.select("structure", "pos", "partner", F.count("*").over(Window.partitionBy("structure", "sym", "ij", "stack_run")).cast("int").alias("stack_length"))


def coarse_grain(structures: DataFrame) -> DataFrame:
    """structure, coarse: runs of dots as `_`, stacks as `[ ]`, of balanced structures.

    A bracket that repeats the symbol before it counts anew where their partners aren't adjacent.
    """
    s, w = with_partner(symbols(structures)), _along()
    jump = F.col("paired") & (F.abs(F.col("partner") - F.lag("partner").over(w)) > 1)
    keep = (F.lag("sym").over(w) != F.col("sym")) | jump | (F.col("pos") == 0)
    kept = s.withColumn("keep", keep).where("keep").groupBy("structure").agg(F.array_sort(F.collect_list(F.struct("pos", "sym"))).alias("a"))
    return kept.select("structure", F.translate(F.array_join(F.transform("a", lambda x: x["sym"]), ""), ".()", "_[]").alias("coarse"))


def coarse_grain_high(structures: DataFrame) -> DataFrame:
    """structure, coarse_high: stacks alone, those that only loops part being one."""
    first = coarse_grain(structures).withColumn("inner", F.translate(F.replace("coarse", F.lit("_"), F.lit("")), "[]", "()"))
    second = coarse_grain(first.select(F.col("inner").alias("structure"))).select(F.col("structure").alias("inner"), "coarse")
    return first.drop("coarse").join(second, "inner", "left").select("structure", F.coalesce("coarse", F.lit("")).alias("coarse_high"))


def count_pairs(structure: Column) -> Column:
    return F.length(structure) - F.length(F.replace(structure, F.lit(OPEN), F.lit("")))


def count_stacks(coarse: Column) -> Column:
    return F.length(coarse) - F.length(F.replace(coarse, F.lit("["), F.lit("")))


def shape_class(features: DataFrame) -> DataFrame:
    """structure, shape: bulge before internal before stack, with the number of pairs."""
    has = lambda role: F.bool_or(F.col("role") == role)
    kinds = features.groupBy("structure").agg(F.when(has("bulge"), "bulge").when(has("internal loop"), "internal").otherwise("stack").alias("kind"))
    return kinds.select("structure", F.concat_ws(" ", "kind", count_pairs(F.col("structure"))).alias("shape"))
