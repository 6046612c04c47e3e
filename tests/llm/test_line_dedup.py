"""Line deduplication against comparing all lines with all."""

import hashlib
import random

from foldtable.llm import common, line_dedup
from foldtable.llm.queries import QUERIES

from .data import SF, components, documents, empty_documents


def plain(docs):
    """Kept text and counts of each (doc_id, text), in order of the documents."""
    where = {}
    for i, text in docs:
        for p, x in enumerate((text or "").split("\n")):
            if n := line_dedup.normal(x):
                where.setdefault(n, []).append((i is not None, i, p))
    lines = sorted(where)
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in lines]
    posting = {}
    for k, s in enumerate(sets):
        for g in s:
            posting.setdefault(g, []).append(k)
    links = []
    for k, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in posting[g]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        links += [(j, k) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= 0.8]
    comp, first = components(range(len(lines)), links), {}
    for k, x in enumerate(lines):
        first[comp[k]] = min(first.get(comp[k], min(where[x])), min(where[x]))
    at = {x: first[comp[k]] for k, x in enumerate(lines)}
    out = []
    for i, text in docs:
        keep, full, left = [], 0, 0
        for p, x in enumerate((text or "").split("\n")):
            n = line_dedup.normal(x)
            stays = not n or at[n] == (i is not None, i, p)
            full, left = full + bool(n), left + bool(n and stays)
            keep += [x] if stays else []
        out.append((i, None if text is None else "\n".join(keep), full, left))
    return out, len(links)


def test_lines_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    want, links = plain(docs)
    rows = QUERIES["op7_line_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_kept, r.kept_sha256) for r in rows) == sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in want)
    assert links > 5


def noisy(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    for x in list(lines):
        for _ in range(rng.randrange(0, 6)):
            y = x.split()
            for _ in range(rng.randrange(1, 4)):
                y[rng.randrange(len(y))] = rng.choice(words)
            lines.append(" ".join(y).upper() if rng.random() < 0.3 else " ".join(y))
    rng.shuffle(lines)
    return lines


def test_near_lines_and_awkward_rows(spark):
    rng = random.Random(6)
    lines = noisy(rng, 150)
    texts = ["\n".join(lines[k : k + 5]) for k in range(0, len(lines), 5)] + ["a\n\n  \nA\n b\nB ", None, "", "\n", "é" * 30, "É" * 30 + "\nx", "z" * 20000]
    docs = documents(spark, texts)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    want, links = plain(given)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_kept"] and links > 50
    rows = [(r.doc_id, r.text, r.n_lines, r.n_kept) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def near_components(spark, lines, **sizes):
    """Components of one group of lines by near_lines, and those of all pairs."""
    half = lambda x: int.from_bytes(line_dedup.line_key(x)[:8], "little", signed=True)
    keys = {line_dedup.line_key(x): x for x in lines}
    texts = spark.createDataFrame([(half(x), k, x) for k, x in keys.items()], "h long, line binary, words string")
    groups = spark.createDataFrame([(7, half(x)) for x in lines], "hub long, h long")
    edges = [(bytes(r.a), bytes(r.b)) for r in line_dedup.near_lines(groups, texts, 0.8, **sizes).collect()]
    near = [(a, b) for a, x in keys.items() for b, y in keys.items() if a < b and line_dedup.jaccard(x, y) >= 0.8]
    assert len(edges) < len(keys)
    return components(keys, edges), components(keys, near)


def test_groups_without_a_good_hub_lose_no_link(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the others again "
    lines = [base + f"number {k} of them" for k in range(6)] + ["entirely different words stand in this line, one after the other " + c for c in "xy"] + ["zzz"]
    got, want = near_components(spark, lines)
    assert got == want and len(set(got.values())) == 3


def test_groups_cut_into_blocks_lose_no_link(spark):
    rng = random.Random(9)
    alphabet = "abcdefgh \u00e9\u0416\u4e2d"
    lines = ["", "short", "shorte"]
    for _ in range(5):
        base = [rng.choice(alphabet) for _ in range(150)]
        for _ in range(30):
            x = list(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(150)] = rng.choice(alphabet)
            lines.append("".join(x))
    lines = list(dict.fromkeys(x for x in lines if x))
    got, want = near_components(spark, lines, least=400, most=3000)
    assert got == want and 5 < len(set(got.values())) < len(lines) - 50


def test_shingles_as_numbers():
    rng = random.Random(10)
    many = "".join(chr(0x4E00 + k) for k in range(400))
    for alphabet in ("ab", "ab\u00ff", "ab\u0416\U0001f600", many):
        lines = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (3, 8, 9, 40, 300, 300)]
        codes, held = line_dedup._codes(lines)
        for i, x in enumerate(lines):
            own = line_dedup.shingles(x) if len(x) >= 8 else set()
            assert len(codes[i]) == len(own) and held[i].sum() == max(0, len(x) - 7)
            for j, y in enumerate(lines):
                assert len(set(codes[i].tolist()) & set(codes[j].tolist())) == len(own & (line_dedup.shingles(y) if len(y) >= 8 else set()))


def test_bands_find_pairs_at_the_threshold():
    rng = random.Random(8)
    found = total = 0
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 400)))
        k = rng.randrange(len(a) - 12)
        b = a[:k] + "".join(rng.choice("abcdefgh") for _ in range(max(1, len(a) // 12))) + a[k + max(1, len(a) // 12) :]
        if 0.8 <= line_dedup.jaccard(a, b) < 0.9:
            x, y = line_dedup.band_keys([a, b])
            total, found = total + 1, found + bool((x == y).any())
    assert total > 100 and found / total > 0.98
