"""Components, SimHash and embedding groups against brute force."""

import random
import re

import numpy as np
import xxhash

from foldtable.llm import common, embedding_dedup, simhash
from foldtable.llm.components import connected_components
from foldtable.llm.queries import QUERIES

from .data import SF, components, documents, empty_documents


def frame_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    rows = connected_components(df).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


def test_components_of_paths_hubs_and_random_graphs(spark):
    rng = random.Random(4)
    path = [(k, k + 1) for k in range(0, 60)]
    hub = [(5000, k) for k in range(4000, 4200)]
    mixed = [(rng.randrange(10_000, 10_100), rng.randrange(10_000, 10_100)) for _ in range(80)]
    links = [*path, *hub, *mixed, (7, 7), (1, 0), (20_000, 20_000)]
    want = components({x for e in links for x in e}, links)
    assert frame_components(spark, [*links, (None, 3)]) == {k: v for k, v in want.items() if k != 20_000 and any(k in e and e[0] != e[1] for e in links)}
    assert frame_components(spark, []) == {}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(rows, docs):
    fps = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i][1] ^ fps[j][1]).bit_count() <= 4]
    comp = components(range(len(fps)), links)
    least = {}
    for k, c in comp.items():
        least[c] = min((x for x in (least.get(c), fps[k][0]) if x is not None), default=None)
    want = sorted((str(i), f"{f:016x}", str(least[comp[k]])) for k, (i, f) in enumerate(fps))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_simhash(spark):
    check_simhash(QUERIES["op5_simhash_near_dedup"](spark, SF).collect(), common.table(spark, SF, "documents").collect())


def test_simhash_of_awkward_rows(spark):
    docs = documents(spark)
    check_simhash(simhash.group_documents(spark, docs).collect(), docs.collect())
    assert simhash.group_documents(spark, empty_documents(spark)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14]
    assert kept.where("doc_id is null").count() == 1


def test_rows_of_one_id_and_different_texts(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c.upper()), (4, c), (5, c)]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept[:2] == sorted([(1, a), (1, b)])
    assert len(kept) == 3 and kept[2] in [(4, c), (4, c.upper())]


def test_ball_links_are_complete_and_sound(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps):
        for _ in range(3):
            fps.add(f ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 7))))
    fps = sorted(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = components(range(len(fps)), links)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    place = {signed(f): k for k, f in enumerate(fps)}
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for size in (1 << 21, 3000):
        got = components(range(len(fps)), [(place[r.a], place[r.b]) for r in simhash.link_fingerprints(frame, bucket_variants=size).collect()])
        assert got == want


def test_every_radius_links_all(spark):
    """Pairs that differ by just 1 to 6 bits link at every radius that covers them, odd ones too."""
    rng = random.Random(6)
    pairs = [(f := rng.getrandbits(63), f ^ sum(1 << k for k in rng.sample(range(63), d)), d) for d in range(1, 7) for _ in range(12)]
    frame = spark.createDataFrame([(x,) for p in pairs for x in p[:2]], "fp long").distinct()
    for radius in range(1, 6):
        for rows in (1 << 20, 50):
            got = {frozenset((r.a, r.b)) for r in simhash.link_fingerprints(frame, radius, bucket_variants=4000, partition_rows=rows).collect()}
            assert got == {frozenset((a, b)) for a, b, d in pairs if d <= radius}


def test_rows_that_differ_in_other_columns_alone(spark):
    """Of rows of one id and text the same one stays, however they are dealt."""
    rows = [(1, "a b c", f"s{k}", k) for k in range(6)] + [(2, "a b c", "t", 0)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, rid int")
    kept = [simhash.keep_one(docs.repartition(n, *by)).collect() for n, by in ((1, ()), (7, ("source",)), (3, ("rid",)))]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def test_full_buckets_split():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3, dtype="uint64")
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 60, 40, dtype="uint64")) for b in base]))
    spent = rng.integers(0, 3, len(fps))
    pairs = [set(map(frozenset, np.concatenate([np.stack(p, 1) for p in simhash._meet(fps, spent, 62, 2, most)]).tolist())) for most in (1 << 22, 500)]
    roots = [components(range(len(fps)), [tuple(p) for p in found if len(p) == 2]) for found in pairs]
    assert roots[0] == roots[1]


def check_vectors(rows, vectors):
    n = len(vectors)
    ok = lambda v: v.label is not None and v.embedding and all(x is not None and np.isfinite(x) for x in v.embedding) and any(v.embedding)
    good = [k for k in range(n) if ok(vectors[k])]
    x = {k: np.array(vectors[k].embedding, "float64") for k in good}
    links = []
    for a in good:
        for b in good:
            if a < b and vectors[a].label == vectors[b].label and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98:
                links.append((a, b))
    comp, count = components(range(n), links), [sum(k in e for e in links) for k in range(n)]
    least = {}
    for k, c in comp.items():
        least[c] = min((i for i in (least.get(c), vectors[k].vec_id) if i is not None), default=None)
    want = [(vectors[k].vec_id, count[k], least[comp[k]], vectors[k].vec_id == least[comp[k]]) for k in range(n)]
    assert sorted(map(str, want)) == sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in rows)
    return len(links)


def test_embeddings(spark):
    assert check_vectors(QUERIES["op10_embedding_near_dedup"](spark, SF).collect(), common.table(spark, SF, "embeddings").collect()) >= 0


def test_embeddings_of_awkward_rows(spark):
    rng = random.Random(9)
    near = lambda v, e: [x + e * rng.gauss(0, 1) for x in v]
    bases = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    rows = [(k, near(bases[k % 4], 0.03 + 0.03 * (k % 5)), k % 3 % 2) for k in range(60)]
    rows += [(100 + k, bases[0], 1) for k in range(30)]
    inf = float("inf")
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [None] * 16, 1), (203, [inf] + [0.0] * 15, 1), (204, [float("nan")] * 16, 1), (205, [], 1), (206, bases[0], None)]
    rows += [(207, bases[0][:5], 1), (207, bases[0][:5], 1), (None, bases[0], 1), (208, [1e-20 * x for x in bases[0]], 1), (209, [1e18 * x for x in bases[0]], 1)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    check_vectors(embedding_dedup.group_vectors(spark, frame).collect(), frame.collect())
    assert embedding_dedup.group_vectors(spark, frame.limit(0)).count() == 0
    # Many small blocks give the same.
    whole = sorted(map(str, embedding_dedup.near_duplicates(frame).collect()))
    assert sorted(map(str, embedding_dedup.near_duplicates(frame, block_bytes=7 * 16 * 8).collect())) == whole


def test_very_large_and_small_components_link(spark):
    v = [3.0, -1.0, 2.0, 0.5]
    rows = [(k, [x * s for x in v], 1) for k, s in enumerate((1.0, 1e200, 1e-200, 1e300, 5e-310))] + [(9, [1e200, 1e200, -1e200, 0.0], 1), (10, [1e-200, 1e200, 0.0, 0.0], 1), (11, [0.0, 7.0, 0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.group_vectors(spark, frame).collect()}
    assert got == {**{k: (4, 0) for k in range(5)}, 9: (0, 9), 10: (1, 10), 11: (1, 10)}


def test_tiles_of_any_side_find_the_same():
    x = np.random.default_rng(2).normal(size=(40, 3))
    whole = {tuple(sorted(p)) for p in np.stack(embedding_dedup._all_links(x, x, 0.98, True), 1).tolist()}
    assert whole and all({tuple(sorted(p)) for p in np.stack(embedding_dedup._all_links(x, x, 0.98, True, side), 1).tolist()} == whole for side in (1, 7, 40))
    both = set(map(tuple, np.stack(embedding_dedup._all_links(x[:25], x[15:], 0.98, False, 6), 1).tolist()))
    assert both == set(map(tuple, np.stack(embedding_dedup._all_links(x[:25], x[15:], 0.98, False), 1).tolist()))


def test_bounds_never_hide_a_link():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24))
    y = x[rng.integers(0, 300, 300)] + rng.normal(size=(300, 24)) * 0.2
    cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
    i, j = embedding_dedup._links(x, y, 0.98, False)
    assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(cos >= 0.98), strict=True))
