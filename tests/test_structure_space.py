"""Structures by number and the trie of all structures, against plain growth and plain scoring."""

import numpy as np
import pytest

from foldtable.operators import folding, trie_folding
from foldtable.operators import structure_space as space


def grown(length, isolated):
    """Balanced texts by growing prefixes, then judged pair by pair."""
    found, now = [], [""]
    for k in range(length):
        now = [s + c for s in now for c in ".()" if (c != ")" or s.count("(") > s.count(")")) and (s + c).count("(") - (s + c).count(")") <= length - k - 1]
    for s in now:
        pairs = set(folding.pairs_of(s))
        lonely = any((i - 1, j + 1) not in pairs and (i + 1, j - 1) not in pairs for i, j in pairs)
        if pairs and all(j - i > 3 for i, j in pairs) and (isolated or not lonely):
            found.append(s)
    return sorted(found)


@pytest.mark.parametrize("isolated", [False, True])
def test_structures_by_number(spark, isolated):
    for length in (0, 4, 5, 6, 7, 9, 12):
        want = grown(length, isolated)
        assert space.how_many(length, isolated) == len(want)
        assert sorted(r.structure for r in space.enumerate_structures(spark, length, isolated).collect()) == want
    assert [space.how_many(n) for n in (13, 16, 20, 30)] == [59, 303, 2740, 760982]


def test_samples_are_distinct_and_valid(spark):
    from foldtable.operators.structure import validity

    for seed in (1, 2):
        found = space.enumerate_structures(spark, 30, num_samples=3000, seed=seed)
        assert found.distinct().count() == 3000 == validity(found).where("valid and length(structure) = 30").count()
        again = space.enumerate_structures(spark, 30, num_samples=3000, seed=seed).repartition(3)
        assert sorted(again.collect()) == sorted(found.collect())
    assert space.enumerate_structures(spark, 13, num_samples=1000).distinct().count() == 59
    one, other = (set(space.enumerate_structures(spark, 30, num_samples=3000, seed=s).collect()) for s in (1, 2))
    assert len(one & other) < 100


def test_shuffled_ranks_are_a_permutation():
    for size in (1, 2, 3, 59, 64, 65, 1000):
        assert sorted(space.shuffled_rank(np.arange(size), size, 3).tolist()) == list(range(size))


def test_trie_has_every_structure_once(spark):
    for length, isolated in ((13, False), (11, True), (18, False)):
        trie = space.build_trie(spark, length, trie_folding.LOOPS, -342, isolated)
        names = space.structures_of_keys(trie.key, length).tolist()
        assert sorted(names[1:]) == sorted(r.structure for r in space.enumerate_structures(spark, length, isolated).collect()) and names[0] == "." * length
        assert (space.structure_keys(names) == trie.key).all() and sorted(names) == [names[k] for k in np.argsort(trie.key)]
        loops = [round(100 * x) for x in folding.Energies(names).loops]
        assert trie.loops.tolist() == loops
        # A bound holds for everything below, whatever its stacks are.
        stacks = [len(x) for x in folding.Energies(names).stacks]
        for k in range(len(names) - 1, 0, -1):
            up = int(trie.parent[k])
            while True:
                assert trie.below[up] <= loops[k] - 342 * (stacks[k] - stacks[up])
                if up == 0:
                    break
                up = int(trie.parent[up])
    assert len(space.build_trie(spark, 5, trie_folding.LOOPS, -342).key) == 1
    with pytest.raises(ValueError):
        space.build_trie(spark, 40, trie_folding.LOOPS, -342)


@pytest.mark.parametrize("length", [13, 20])
def test_descent_equals_plain_enumeration(spark, length):
    from foldtable.operators.sampling import random_sequences

    seqs = random_sequences(spark.range(400), length, 11).select("code").distinct()
    structures = folding.structure_list(space.enumerate_structures(spark, length), length)
    for least in (-1.0, 0.001):
        want = folding.sequence_effects(seqs, structures, least).collect()
        got = trie_folding.trie_effects(seqs, length, least).collect()
        assert len(want) > 1000 and sorted(map(str, got)) == sorted(map(str, want))


def test_few_of_the_long_structures_are_visited(spark):
    from foldtable.operators.sampling import random_sequences

    seqs = random_sequences(spark.range(200), 30, 11).select("code").repartition(2)
    folds = trie_folding.trie_folds(seqs, 30).collect()
    assert len(folds) == 200 and max(r.visited for r in folds) < 0.02
    # A sequence's energy in the structure found is that of scoring it alone.
    for r in folds[:50]:
        if "(" in r.structure:
            assert folding.Energies([r.structure]).table(np.array([r.code]))[0, 0] == r.mfe < 0
        else:
            assert r.mfe == 0
