"""Effects of all mutants from one pass over a sequence, against folding each mutant."""

import time

import numpy as np
import pytest

from foldtable.functions.codec import seq_to_code
from foldtable.operators import folding, mutant_folding, trie_folding
from foldtable.operators import structure_space as space
from foldtable.plans import registry
from foldtable.sources import tables


def rows_of(effects, length):
    """mutant_effects as rows of folding.EFFECTS."""
    for r in effects.collect():
        assert len(r.ddg_gap) == len(r.d_mfe) == 3 * length
        for k, (ddg, d_mfe) in enumerate(zip(r.ddg_gap, r.d_mfe, strict=True)):
            pos, turn = k // 3, k % 3 + 1
            yield r.code, r.structure, r.mfe, r.energy_gap, pos, r.code >> 2 * (length - 1 - pos) & 3 ^ turn, ddg + 0.0, d_mfe + 0.0


def sequences(spark, length, n):
    """Random codes, half of them of C, U and G mostly, which fold more and tie more."""
    rng = np.random.default_rng(length)
    codes = [int("".join(map(str, rng.choice(bases, length))), 4) for bases in ([0, 1, 2, 3], [1, 3, 1, 3, 2, 0]) for _ in range(n)]
    return spark.createDataFrame([(c,) for c in sorted(set(codes))], "code long")


@pytest.mark.parametrize("length", [5, 9, 13, 20])
def test_equals_plain_enumeration(spark, length):
    seqs = sequences(spark, length, 150)
    structures = folding.structure_list(space.enumerate_structures(spark, length), length)
    for least in (-1.0, 0.001):
        want = [(*r[:6], r.ddg_gap + 0.0, r.d_mfe + 0.0) for r in folding.sequence_effects(seqs, structures, least).collect()]
        got = list(rows_of(mutant_folding.mutant_effects(seqs, length, least, together=64), length))
        assert (len(want) > 1000) == (length > 9) and sorted(got) == sorted(want)


def test_equals_descent_at_thirty_sites(spark):
    # Two that fold into a multiloop.
    texts = ["GCGGGGGGGAAACCCACCAAAGGUCCCCGC", "UAGUUCGCCAAAGGCGGUAAAACCGAACUA"]
    more = spark.createDataFrame([(s,) for s in texts], "seq string").select(seq_to_code("seq").alias("code"))
    seqs = sequences(spark, 30, 20).unionByName(more)
    want = [(*r[:6], r.ddg_gap + 0.0, r.d_mfe + 0.0) for r in trie_folding.trie_effects(seqs, 30).collect()]
    got = list(rows_of(mutant_folding.mutant_effects(seqs, 30), 30))
    assert len(want) > 2500 and sorted(got) == sorted(want)
    assert sum(r[1] == "((((((" + "(((...)))" * 2 + "))))))" for r in got) == 2 * 90
    with pytest.raises(ValueError):
        mutant_folding.Fold(np.zeros(1, "int64"), 31)


def test_a_sequence_takes_little_time(spark, tmp_path):
    tables.map_store(spark.range(40_000).withColumnRenamed("id", "o_orderkey"), f"{tmp_path}/orders.parquet")
    began = time.time()
    rows = registry.QUERIES["long_sequence_effects"](spark, str(tmp_path))
    assert rows.count() > 1_800_000
    assert time.time() - began < 45
