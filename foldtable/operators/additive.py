"""The additive model of set sizes: counts of mutations that a stability allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def additive_set_size(models: DataFrame) -> DataFrame:
    """models (model, dg, classes) with size, the number of sequences that the model allows.

    classes: array of structs (impact, sites, k) in order. For each class n mutations are taken,
    up to what stability is left for (all sites where the impact isn't positive), in
    C(sites, n) (k-1)^n ways, and cost n impacts. States that leave equal stability are merged,
    so a class multiplies states by its sites at most. A model that is repeated has one row; models of one
    name and stability with other classes have rows of their own.
    """
    depth = models.agg(F.max(F.size("classes"))).first()[0] or 0
    now = models.select("model", "dg", "classes").distinct().select("model", "dg", "classes", F.col("dg").alias("rest"), F.lit(1.0).alias("ways"))
    for k in range(depth):
        c = F.try_element_at("classes", F.lit(k + 1))
        allowed = F.when(c["impact"] > 0, F.least(F.floor(F.abs("rest") / c["impact"]), c["sites"])).otherwise(c["sites"])
        rows = now.withColumn("c", c).withColumn("n", F.explode(F.sequence(F.lit(0), F.coalesce(allowed, F.lit(0)).cast("int"))))
        # C(sites, n) as a running product, which is exact while it is below 2^53.
        steps = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
        chosen = F.aggregate(steps, F.lit(1.0), lambda x, i: x * (F.col("c.sites") - F.col("n") + i) / i)
        ways = F.when(F.col("c").isNull(), 1.0).otherwise(chosen * F.pow(F.col("c.k") - 1, F.col("n")))
        # Not rounded: how often an impact fits into what is left is decided by the very doubles.
        # No mutation costs nothing, even of a class whose impact is infinite.
        rest = F.when(F.col("c").isNull() | (F.col("n") == 0), F.col("rest")).otherwise(F.col("rest") - F.col("n") * F.col("c.impact"))
        rows = rows.select("model", "dg", "classes", rest.alias("rest"), (F.col("ways") * ways).alias("ways"))
        now = rows.groupBy("model", "dg", "classes", "rest").agg(F.sum("ways").alias("ways"))
    return now.groupBy("model", "dg", "classes").agg(F.sum("ways").alias("size")).drop("classes")


def lookup_params(parameters: DataFrame) -> DataFrame:
    """category, swaps, quantity, impact: the wide table of model_parameters as rows."""
    kinds = [(kind, q) for kind in ("point", "swaps") for q in ("lower", "median", "upper")]
    cells = F.array(*[F.struct(F.lit(kind == "swaps").alias("swaps"), F.lit(q).alias("quantity"), F.col(f"{kind}_{q}").alias("impact")) for kind, q in kinds])
    return parameters.select("category", F.explode(cells).alias("c")).select("category", "c.*")


#: The largest stability of a curve, and its number of points, without and with bulges.
GRIDS = {False: (4.2, 1000), True: (2.5, 500)}


def curve_models(parameters: DataFrame, length: int, k_pair_component: int = 2) -> DataFrame:
    """The models of all curves: set type x pairs 2..5 x bulges 0..2 x an even grid of stabilities from 0 (GRIDS).

    Quartiles stand for half of a class' sites each, the median for the odd one. Combinations
    without room, or whose stack length has no parameters, are left out.
    """
    spark = parameters.sparkSession
    sets = spark.range(2).select((F.col("id") == 1).alias("swaps"))
    shapes = spark.range(2, 6).select(F.col("id").cast("int").alias("pairs")).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("bulges")))
    shapes = shapes.withColumn("loops", length - 2 * F.col("pairs") - F.col("bulges")).where("bulges = 0 or (pairs >= 4 and loops >= 3)")
    stack = F.concat(F.lit("S"), F.when(F.col("bulges") > 0, F.floor(F.col("pairs") / 2)).otherwise(F.col("pairs")).cast("string"))
    parts = F.array(
        F.struct(F.lit(0).alias("o"), stack.alias("category"), F.col("pairs").alias("sites"), F.when(F.col("swaps"), 6).otherwise(k_pair_component).alias("k")),
        F.struct(F.lit(1).alias("o"), F.lit("L").alias("category"), F.col("loops").alias("sites"), F.lit(4).alias("k")),
        F.struct(F.lit(2).alias("o"), F.lit("B").alias("category"), F.col("bulges").alias("sites"), F.lit(4).alias("k")),
    )
    rows = shapes.crossJoin(F.broadcast(sets)).withColumn("p", F.explode(parts)).select("pairs", "bulges", "swaps", "p.*").where("sites > 0")
    named = rows.join(lookup_params(parameters), ["category", "swaps"], "left")
    sites = F.when(F.col("quantity") == "median", F.col("sites") % 2).otherwise(F.floor(F.col("sites") / 2)).cast("int")
    q = F.when(F.col("quantity") == "lower", 0).when(F.col("quantity") == "median", 1).otherwise(2)
    cells = named.withColumn("n", sites).groupBy("pairs", "bulges", "swaps").agg(
        F.count_if(F.col("impact").isNull()).alias("unknown"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("o", q.alias("q"), "impact", F.col("n").alias("sites"), "k")))).alias("cells"))
    model = F.concat_ws("/", F.when(F.col("swaps"), "neutral set").otherwise("neutral component"), "pairs", "bulges")
    classes = F.transform("cells", lambda c: F.struct(c["impact"].alias("impact"), c["sites"].alias("sites"), c["k"].alias("k")))
    top, points = (F.when(F.col("bulges") > 0, GRIDS[True][k]).otherwise(GRIDS[False][k]) for k in range(2))
    known = cells.where("unknown = 0").select(model.alias("model"), classes.alias("classes"), top.alias("top"), points.alias("points"))
    dealt = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    return dealt.select("model", "classes", (F.col("k") * (F.col("top") / (F.col("points") - 1))).alias("dg"))
