"""Spelling variants, collision counting and the Merkle manifest against
plain versions, and on the defined cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from custodia.llm import collision_search, kd_tree, merkle, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}


# -- spelling variants -----------------------------------------------------

def plain_words(rows):
    n = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    out, form = {}, {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in words if one_edit(w, x))
        if near and -near[0][0] >= 2 * n:
            form[w] = near[0][1]
        out[w] = (form.get(w), n, len(near), words[form[w]] if w in form else None)
    for w in words:
        root = w
        while root in form:
            root = form[root]
        f, *rest = out[w]
        out[w] = (f, root, *rest)
    return out


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(80):
            w = rng.choice(base[: 1 + int(60 * rng.random() ** 2)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", w[k] + "e"]) + w[k + 1:]
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        rows.append((i if i % 40 else None, " ".join(words), "en", "s", 1))
    rows += [rows[3], rows[3], (900, None, None, None, None), (901, "", "en", "s", 0), (902, "12 ... ?", "en", "s", 1),
             (903, " ".join(["a" * 3000] * 3 + ["a" * 3001] * 7 + ["ab" * 1500] * 3), "en", "s", 1)]
    return rows


@pytest.mark.parametrize("cell, sample", [(8192, 65536), (20, 40), (1, 3)])
def test_spelling_variants_equal_brute_force(spark, letters, cell, sample):
    docs = spark.createDataFrame(letters, DOCS).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = spelling.spelling_variants(docs, cell=cell, sample=sample).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(letters)
    assert len(got) == len({r.word for r in got}) > 100
    assert any(r.form for r in got) and any(r.form and r.root != r.form for r in got)


def test_cells_of_equal_vectors_are_split(spark):
    # anagrams share their counts, no split separates them
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(300)}
    words |= {w[:3] + "b" + w[4:] for w in list(words)[:50]}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = collections.Counter((r.word, r.other) for r in spelling.near_words(df, cell=16, sample=64).collect())
    assert got == collections.Counter((a, b) for a in words for b in words if one_edit(a, b))


def test_spelling_of_nothing(spark, letters):
    assert spelling.spelling_variants(spark.createDataFrame(letters, DOCS).limit(0)).count() == 0


def test_boxes_within_reach_hold_all_near_points():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (500, 6)).astype(np.int32)
    tree, leaves = kd_tree.build(points, 8)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(500))
    asked = rng.integers(0, 5, (60, 6)).astype(np.int32)
    for within in (0, 1, 2):
        seen = collections.defaultdict(set)
        for leaf, rows in kd_tree.reached(tree, asked, within):
            for r in rows:
                seen[int(r)] |= set(leaves[leaf].tolist())
        for r in range(60):
            near = np.flatnonzero(np.abs(points - asked[r]).sum(axis=1) <= within)
            assert set(near.tolist()) <= seen[r]
    same = np.ones((50, 6), np.int32)
    assert kd_tree.build(same, 8)[0].n_leaves == 1


# -- collision counting ----------------------------------------------------

def exact(rows, k, every=100):
    use = [(i, np.array(v, float)) for i, v in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in use:
        if i % every == 0:
            found = sorted((float(np.sqrt(((c - q) ** 2).sum())), j) for j, c in use if j != i and len(c) == len(q))
            out[i] = [(j, d) for d, j in found[:k]]
    return out


def test_neighbours_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = exact(rows, 10)
    got = collections.defaultdict(list)
    for r in collision_search.nearest(table, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    found = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert found >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert [d for _, d in got[q]] == pytest.approx([dict(rows_).get(j, d) for (j, d), rows_ in
                                                        zip(got[q], [dict(want[q])] * len(got[q]))])


@pytest.mark.parametrize("block_rows", [16384, 30])
def test_neighbours_of_rough_vectors(spark, block_rows):
    rng = np.random.default_rng(6)
    same = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, same) for i in range(250)]                   # a very common vector
    rows += [(500, same), (600, None), (700, [0.0] * 8), (800, [1.0, None] + [0.0] * 6),
             (900, [float("nan")] * 8), (900, [float("inf")] * 8), (None, same), (100, same),
             (2000, [1.0, 2.0]), (2001, [1.0, 2.5]), (2100, [3.0]), (2200, []),
             (3000, [1e300] + [0.0] * 7), (3001, [1e300] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>") \
        .withColumn("rank", F.lit("clash")).withColumn("id", F.lit(100))
    with np.errstate(over="ignore"):
        want = exact([r for r in rows if r != (100, same)], 10)
    got = collections.defaultdict(list)
    for r in collision_search.nearest(df, F.col("id") % 100 == 0, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert 2100 not in got and got[2000] == [(2001, 0.5)]
    assert got[500] == [(100, 0.0)] + [(1000 + i, 0.0) for i in range(9)]
    assert got[3000][0][0] == 3001
    for q in set(want) - {100, 500, 2000, 2100}:
        mine = {j for j, _ in want[q]} - {100}
        assert len(mine & {j for j, _ in got[q]}) >= len(mine) - 1 and len(got[q]) == 10
    assert collision_search.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_every_neighbour_if_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<double>")
    got = collision_search.nearest(df, F.col("id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 3.0)]


# -- manifest --------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """(root, per leaf a list of (before, after))."""
    paths, groups = [[] for _ in leaves], [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        up, merged = [], []
        for at in range(0, len(leaves), 16):
            run = leaves[at:at + 16]
            for s in range(len(run)):
                for k in groups[at + s]:
                    paths[k].append(("".join(run[:s]), "".join(run[s + 1:])))
            up.append(H(*run))
            merged.append([k for g in groups[at:at + 16] for k in g])
        leaves, groups = up, merged
    return leaves[0], paths


def plain_manifest(rows):
    by_source = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = H(*map(framed, (i, source, lang, n, text)))
        late = H(*map(framed, (i, source, lang, n, text and text.translate(LOWER))))
        spoilt = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by_source[source].append((i is not None, i or 0, leaf, late if spoilt else leaf, i))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in order:
        by_source[s].sort(key=lambda r: r[:3])
        tops[s] = plain_tree([r[2] for r in by_source[s]])
    root, above = plain_tree([tops[s][0] for s in order])
    out = collections.Counter()
    for s, over in zip(order, above):
        for r, path in zip(by_source[s], tops[s][1]):
            h = r[3]
            for before, after in path + over:
                h = H(before, h, after)
            proof = H(*(a + b for a, b in path + over))
            out[r[4], r[2], tops[s][0], root, proof, h, h == root] += 1
    return out


def manifest_rows(n):
    rng = random.Random(n)
    sources = [f"s{k}" for k in range(20)] + [None, "é", "Z", "a", "=", "-", ""]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(sources)
        text = rng.choice([None, "", "Some TEXT é\n", "lower only", "X" * 30000])
        rows.append((rng.choice([i, i * 1000, -i]), text, rng.choice(["en", None]), source, rng.choice([None, 7])))
    return rows


@pytest.mark.parametrize("n", [1, 2, 16, 17, 900])
def test_manifest_equals_plain_trees(spark, n):
    rows = manifest_rows(n)
    rows += rows[:n // 3] + [(None, "NULL id", "en", "hot", 1)] * (n > 2)    # repeated rows and a row without id
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("h", F.lit("clash"))
    got = collections.Counter(tuple(r) for r in merkle.verify(df).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == plain_manifest(rows)


def test_manifest_does_not_depend_on_the_partitions(spark):
    rows = manifest_rows(300)
    df = spark.createDataFrame(rows, DOCS)
    first = sorted(map(tuple, merkle.verify(df.repartition(7)).collect()), key=str)
    assert first == sorted(map(tuple, merkle.verify(df.coalesce(1)).collect()), key=str)
    assert merkle.verify(df.limit(0)).count() == 0
