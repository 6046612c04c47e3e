"""Sequences beyond 31 bases against string operations."""

import random

import pytest
from pyspark.sql import functions as F

from foldtable.functions import codec
from foldtable.functions import wide_codec as wide
from foldtable.operators import components, mutate

BASES = "ACUG"


def random_seq(rng, n):
    return "".join(rng.choice(BASES) for _ in range(n))


@pytest.mark.parametrize("length", [1, 31, 32, 40, 62])
def test_round_trip_bases_and_masks(spark, length):
    rng = random.Random(length)
    seqs = ["A" * length, "G" * length, *(random_seq(rng, length) for _ in range(40))]
    rows = spark.createDataFrame([(s, rng.randrange(length), rng.randrange(4), rng.choice(seqs)) for s in seqs], "s string, pos int, b int, o string")
    code, pos = wide.seq_to_code(F.col("s")), F.col("pos")
    found = rows.select(
        "*", wide.code_to_seq(code, length).alias("back"), wide.base_at(code, pos, length).alias("base"),
        wide.code_to_seq(wide.with_base(code, pos, F.col("b"), length), length).alias("put"), wide.code_to_seq(wide.masked(code, pos, length), length).alias("masked"),
        wide.hamming(code, wide.seq_to_code(F.col("o"))).alias("d"), code.alias("c"),
    ).collect()
    for r in found:
        put = lambda x: r.s[: r.pos] + x + r.s[r.pos + 1 :]
        assert (r.back, BASES[r.base], r.put, r.masked, r.d) == (r.s, r.s[r.pos], put(BASES[r.b]), put("A"), sum(a != b for a, b in zip(r.s, r.o, strict=True)))
    number = lambda s: [BASES.index(x) for x in s]
    assert [r.s for r in sorted(found, key=lambda r: tuple(r.c))] == sorted(seqs, key=number)
    if length <= 31:
        assert rows.where(codec.seq_to_code(F.col("s")) != wide.seq_to_code(F.col("s"))["lo"]).count() == 0


def test_what_is_no_sequence(spark):
    rows = spark.createDataFrame([(None,), ("",), ("AXC",), ("A" * 63,), ("acgt" * 10,)], "s string")
    assert [r[0] for r in rows.select(wide.code_to_seq(wide.seq_to_code(F.col("s")), 40)).collect()] == [None, None, None, None, "ACGU" * 10]


def test_neighbours_and_components_of_40_sites(spark):
    rng = random.Random(9)
    nodes = set()
    for s in ("x", "y"):
        for _ in range(6):
            at = random_seq(rng, 40)
            for _ in range(40):
                nodes.add((s, at))
                k = rng.choice([0, 5, 8, 9, 20, 39])
                at = at[:k] + rng.choice(BASES) + at[k + 1 :]
    seqs = spark.createDataFrame(sorted(nodes), "structure string, s string").select("structure", wide.seq_to_code(F.col("s")).alias("code"))
    mutants = mutate.point_neighbours(seqs.limit(5), 40, codes=wide).select(wide.code_to_seq(F.col("code"), 40).alias("a"), wide.code_to_seq(F.col("mutant"), 40).alias("b"), "pos").collect()
    assert len({(r.a, r.b) for r in mutants}) == 5 * 120 and all([k for k in range(40) if r.a[k] != r.b[k]] == [r.pos] for r in mutants)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    number = lambda n: [BASES.index(x) for x in n[1]]
    for s, c in nodes:
        for k in range(40):
            for b in BASES:
                other = (s, c[:k] + b + c[k + 1 :])
                if other in nodes:
                    a, d = sorted((find((s, c)), find(other)), key=number)
                    root[d] = a
    got = components.neutral_components(seqs.unionByName(seqs.limit(50)), 40, wide)
    text = got.select("structure", wide.code_to_seq(F.col("code"), 40).alias("s"), wide.code_to_seq(F.col("nc_id"), 40).alias("n")).collect()
    assert {(r.structure, r.s): r.n for r in text} == {n: find(n)[1] for n in nodes} and len(text) == len(nodes)
