"""Filter audit against filters applied one after another."""

import random
from itertools import permutations

from foldtable.llm import filter_audit

from .data import documents, empty_documents


def plain_steps(masks, n):
    """(order, step) -> kept, removed, redundant, unique, good, toxic, by going through the masks in each order."""
    found = {}
    for order in permutations(range(n)):
        left = dict(masks)
        for step, f in enumerate(order, 1):
            out = {m: c for m, c in left.items() if m >> f & 1}
            left = {m: c for m, c in left.items() if not m >> f & 1}
            gone = sum(c[0] for c in out.values())
            failing = sum(c[0] for m, c in masks.items() if m >> f & 1)
            found[order, step] = [sum(c[0] for c in left.values()), gone, failing - gone, masks.get(1 << f, (0,))[0], sum(c[1] for c in out.values()), sum(c[2] for c in out.values())]
    return found


def test_diagrams_of_random_masks():
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(4):
            masks = {rng.randrange(1 << n): (rng.randrange(1, 99), rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(1, 2 << n))}
            letters, want = filter_audit.LETTERS[:n] if n < 6 else "UVWXYZ", plain_steps(masks, n)
            got = {(tuple(map(letters.index, o)), s): rest for o, s, *rest in filter_audit.diagram_steps(masks, letters)}
            assert {k: v[:6] for k, v in got.items()} == want
            sums = {f: sum(v[1] for (o, s), v in want.items() if o[s - 1] == f) for f in range(n)}
            assert all(v[6] == sums[o[s - 1]] for (o, s), v in got.items())


def test_orders_differ_by_neighbours():
    for n in (1, 2, 3, 5):
        orders = list(filter_audit.adjacent_orders(n))
        assert len({o for o, _ in orders}) == len(orders) == len(list(permutations(range(n))))
        for (a, _), (b, k) in zip(orders[:-1], orders[1:], strict=True):
            assert b == (*a[:k], a[k + 1], a[k], *a[k + 2 :])


def test_diagram_shares_equal_nodes():
    # Of independent filters with equal counts, each level has one node.
    diagram = filter_audit.Diagram({m: (1, 0, 0) for m in range(16)}, 4)
    assert [len(x) for x in diagram.levels] == [1, 1, 1, 1]
    diagram.swap(1)
    assert [len(x) for x in diagram.levels] == [1, 1, 1, 1] and diagram.root[0] == (16, 0, 0)


def plain_masks(docs, labels):
    import re

    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    parts = {}
    for d in docs:
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = d.doc_id is not None and any(e.doc_id is not None and e.doc_id < d.doc_id and (e.text or "") == t for e in docs)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        of = parts.setdefault(d.source or "", {})
        m = sum(1 << k for k, f in enumerate(fails) if f)
        old = of.get(m, (0, 0, 0))
        of[m] = (old[0] + 1, old[1] + (d.doc_id in good), old[2] + (d.doc_id in toxic))
    return parts


def test_audit_of_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    docs = documents(spark, [long, long, long + " #", "A" * 50, None, "", long.upper(), "same " * 400, long, None, "a\x0bb\x1cc d " * 100])
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.where("doc_id = 8").selectExpr("doc_id", "text", "lang", "'other' as source", "n_chars", "shard", "part", "tokens"))
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, None, 1), (8, 1, 1), (8, 1, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit.failure_masks(docs, labels).collect()
    want = plain_masks(docs.collect(), labels.collect())
    got = {}
    for r in found:
        assert got.setdefault(r.part, {}).setdefault(r["mask"], (r.docs, r.good, r.toxic)) == (r.docs, r.good, r.toxic)
    assert got == want and len(want) == 3
    rows = filter_audit.audit_documents(spark, docs, labels).collect()
    assert len(rows) == 600 * 3
    for part, masks in want.items():
        steps = plain_steps(masks, 5)
        mine = {(tuple(map("ABCDE".index, r.filter_order)), r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in rows if r.part == part}
        assert mine == steps
    assert filter_audit.audit_documents(spark, empty_documents(spark), labels).count() == 0
    assert filter_audit.audit_documents(spark, docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
