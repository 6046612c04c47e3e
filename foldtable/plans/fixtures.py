"""Maps, ensembles and structures that Spark derives from the driver's tables.

Plain integer arithmetic, so that any SQL engine derives the same rows. Sequences have 13 sites
of which the last eight vary.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import _kept

L = 13
#: The structures that phenotypes 0 to 5 stand for, and the unfolded one.
STRUCTURES = ["(((....)))...", ".(.((....)).)", ".(((...)))...", "((.((...)))).", "((......))...", "..((((...))))", "............."]
UNFOLDED = STRUCTURES[6]

CODES = """lc as (select *, (l_orderkey*2654435761 + l_partkey*40503 + l_linenumber*97) % 65536 as code from lineitem),
g as (select code, cast(sum(l_suppkey) % 6 as bigint) as phen, cast(sum(l_partkey) % 45 as double)/10 as dg,
  -cast(sum(l_partkey*7 + l_linenumber) % 80 as double)/10 as mfe from lc group by code),
st as (select * from (values {}) as t(sid, structure))""".format(", ".join(f"({k}, '{s}')" for k, s in enumerate(STRUCTURES)))  # fmt: skip
MAP = CODES + ", m as materialized (select g.code, st.structure, g.dg as stability, g.mfe from g join st on g.phen = st.sid), mu as materialized (select m.*, cast(p as int) as p, xor(code, cast(x as bigint) << cast(2*(12-p) as int)) as mutant from m, range(5, 13) r(p), range(1, 4) q(x))"
ENSEMBLE = MAP + """, e as (select g.code, st.structure, case when st.sid = 6 then 0.0 else -cast((g.code*13 + st.sid*29) % 60 as double)/10 end as energy
  from g join st on st.sid = 6 or (g.code*31 + st.sid*17) % 7 < 3)"""
_SHAPE = """select structure, count(*) as parts from (select
  repeat('.', a) || case when k % 4 = 0
    then repeat('(', s1) || repeat('.', b1) || repeat('(', s2) || repeat('.', h) || repeat(')', s2) || repeat('.', b2) || repeat('(', s1) || '...' || repeat(')', s1) || repeat(')', s1)
    else repeat('(', s1) || repeat('.', b1) || repeat('(', s2) || repeat('.', h) || repeat(')', s2) || repeat('.', b2) || repeat(')', s1) end
    || repeat('.', c) {bad} as structure
  from (select p_partkey as k, p_partkey % 3 as a, 1 + p_partkey % 4 as s1, p_partkey // 3 % 3 as b1, 1 + p_partkey // 9 % 4 as s2,
    {h} + p_partkey // 36 % 4 as h, p_partkey // 5 % 3 as b2, p_partkey // 7 % 4 as c from part) t) u group by structure"""
#: Balanced structures of many shapes, and the same with hairpins that are too short and brackets too many.
SHAPES = "shapes as (" + _SHAPE.format(bad="", h=3) + ")"
ROUGH = "rough as (" + _SHAPE.format(bad="|| case when k % 13 = 0 then ')' when k % 17 = 0 then '(.' else '' end", h=1) + ")"


def mix_sql(key: str, seed: int) -> str:
    """sampling.mix in SQL."""
    step = lambda k, s: f"((({k}) % 2147483647) * 1103515245 + {s}) % 2147483647"
    fold = lambda k, n: f"xor({k}, ({k}) >> {n})"
    first = fold(step(f"cast({key} as bigint)", 12345 + seed), 15)
    return step(fold(step(first, 67891), 13), seed)


def draw_sql(key: str, draw: str, seed: int) -> str:
    """sampling.draw_of in SQL."""
    own = f"({mix_sql(key, seed)}) * 65536 + {draw}"
    return f"(({mix_sql(own, seed + 1)}) * 2147483647 + {mix_sql(own, seed + 2)})"


def for_spark(sql: str) -> str:
    """The fixtures' SQL in Spark's dialect."""
    import re

    return re.sub(r"p_partkey // (\d+)", r"(p_partkey div \1)", sql)


class Tables:
    """The fixture frames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def structures(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(STRUCTURES)), "sid long, structure string")

    @cached_property
    def g(self) -> DataFrame:
        rows = self.raw("lineitem").selectExpr("(l_orderkey*2654435761 + l_partkey*40503 + l_linenumber*97) % 65536 as code", "l_suppkey", "l_partkey", "l_linenumber")
        return rows.groupBy("code").agg(
            F.expr("sum(l_suppkey) % 6").alias("phen"), F.expr("cast(sum(l_partkey) % 45 as double)/10").alias("dg"),
            F.expr("-cast(sum(l_partkey*7 + l_linenumber) % 80 as double)/10").alias("mfe"),
        )

    @cached_property
    def gpmap(self) -> DataFrame:
        joined = self.g.join(F.broadcast(self.structures), self.g.phen == self.structures.sid)  # seven rows
        return joined.select("code", "structure", F.col("dg").alias("stability"), "mfe")

    @cached_property
    def kept_map(self) -> DataFrame:
        """The map, written once for queries that read it several times."""
        return _kept(self.gpmap)

    @cached_property
    def ensemble(self) -> DataFrame:
        joined = self.g.join(F.broadcast(self.structures), F.expr("sid = 6 or (code*31 + sid*17) % 7 < 3"))  # seven rows
        return joined.selectExpr("code", "structure", "case when sid = 6 then 0D else -cast((code*13 + sid*29) % 60 as double)/10 end as energy")

    def _shapes(self, sql: str) -> DataFrame:
        self.raw("part").createOrReplaceTempView("part")
        name = sql.split()[0]
        return self.spark.sql(for_spark(f"with {sql} select * from {name}"))

    @cached_property
    def shapes(self) -> DataFrame:
        return self._shapes(SHAPES)

    @cached_property
    def rough(self) -> DataFrame:
        return self._shapes(ROUGH)
