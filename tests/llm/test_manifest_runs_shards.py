"""Manifest, periodic runs and shards against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seqdrift.llm import manifest, periodic, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(11)
    words = [f"W{i}é" for i in range(40)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    langs = ["en", "de", None, "", "é"]
    rows = [(i, prose(rng.randint(0, 130)), rng.choice(langs), rng.choice(["s", None]), rng.choice([None, i])) for i in range(180)]
    rows += [(200, None, "lone", "s", 0), (201, "", "en", "s", 0), (None, None, None, None, None), (None, prose(5), "en", "s", 3),
             (202, prose(9000), "en", "s", 1), (203, "tick tock " * 900, "en", "s", 1), (204, " \t\n", "de", "s", 3),
             (205, f"{prose(30)} " + "a b c d e f g h i " * 5 + "a b c z", "en", "s", 9)]
    rows += [rows[3], rows[3], (3, "another", "en", "s", 1)] + [(300 + i, "copied text", "en", "s", 11) for i in range(150)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    clash = ["g", "i", "n", "h", "grp", "c0", "path", "digest", "size", "shard", "slot", "runs", "__block", "__place"]
    docs = spark.createDataFrame(odd_rows, DOCS).select("*", *[F.lit(1).alias(c) for c in clash], F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    return docs.repartition(7)


# -- manifest ----------------------------------------------------------------------------------------

def brute_manifest(rows, fanout=8):
    def leaf(r, text):
        doc_id, _, lang, source, n_chars = r
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def tree(hashes):
        """(root, for each leaf its [(left, right)] up to the root)."""
        paths, members, level = [[] for _ in hashes], [[j] for j in range(len(hashes))], list(hashes)
        while len(level) > 1:
            up, own = [], []
            for a in range(0, len(level), fanout):
                run = level[a:a + fanout]
                for j in range(len(run)):
                    for m in members[a + j]:
                        paths[m].append(("".join(run[:j]), "".join(run[j + 1:])))
                up.append(sha("".join(run)))
                own.append(sum(members[a:a + fanout], []))
            level, members = up, own
        return level[0], paths

    out, groups = [], {}
    for r in rows:
        low = r[1] if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        turn = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low if turn else r[1]), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = tree([subs[g][0] for g in order])
    for g, above in zip(order, tops):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), subs[g][1]):
            path, h = path + above, x[3]
            for left, right in path:
                h = sha(left + h + right)
            out.append((x[4], x[2], subs[g][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def manifest_rows(docs, fanout=8):
    found = manifest.document_manifest(docs, fanout)
    folded = found.withColumn("folded", manifest.fold(F.col("path"), F.col("presented")))
    return [tuple(r) for r in folded.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")), "folded",
                                            F.expr("folded = root")).collect()]


@pytest.mark.parametrize("fanout", [8, 3])
def test_manifest(odd, odd_rows, fanout):
    got = manifest_rows(odd, fanout)
    assert sorted(got, key=key) == sorted(brute_manifest(odd_rows, fanout), key=key)
    assert {r[6] for r in got} == {True, False}


def test_manifest_small(spark, odd_rows):
    assert manifest_rows(spark.createDataFrame([], DOCS)) == []
    for rows in ([odd_rows[0]], odd_rows[:2], [r for r in odd_rows if r[2] == "en"][:9]):
        docs = spark.createDataFrame(rows, DOCS)
        assert sorted(manifest_rows(docs), key=key) == sorted(brute_manifest(rows), key=key)


# -- periodic runs -----------------------------------------------------------------------------------

def brute_runs(w, least=24, periods=3):
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    best = (None,) * 4
    for s, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark, odd, odd_rows, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
    rows = [r for r in odd_rows if r[0] != 202]
    want = [brute_row(r[0], r[1]) for r in rows]
    assert sorted((r for r in got if r[0] != 202), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) >= 8 and len(got) == len(odd_rows)
    assert periodic.find_periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_periodic_runs_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"].split()) < 1500}
    got = {r["doc_id"]: tuple(r) for r in periodic.op12_periodic_runs(spark, SF).collect()}
    assert all(got[i] == brute_row(i, t) for i, t in texts.items()) and len(texts) > 100


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)), max_size=8), max_size=5),
       st.sampled_from([4, 8, 32]), st.sampled_from([(24, 3), (6, 2), (9, 4)]))
def test_runs_of_random_repeats(texts, v, limits):
    words = [[x for block, times in t for x in block * times] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    units = np.array([x for w in words for x in w], np.int64)
    want = sorted((t, *r) for t, w in enumerate(words) for r in brute_runs(w, *limits))
    assert sorted(periodic.find_runs(units, sizes, *limits, v=v)) == want


def test_extensions_and_cover():
    for v in (4, 8, 32, 64):
        cover = periodic.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    rng = np.random.default_rng(3)
    units = np.concatenate([np.tile(rng.integers(1, 4, 37), 9), rng.integers(1, 3, 300)]).astype(np.uint32)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(units)), np.arange(len(units))))
    a, b = a[a != b], b[a != b]
    ext = periodic.Extensions(units, 8)(a, b)
    for x, y, n in list(zip(a.tolist(), b.tolist(), ext.tolist()))[::37]:
        u = units.tolist()
        m = 0
        while max(x, y) + m < len(u) and u[x + m] == u[y + m]:
            m += 1
        assert m == n
    # a long text in many parts gives the same
    one = np.zeros(3000, np.int64)
    whole, periodic.PAIRS = periodic.PAIRS, 64
    try:
        assert periodic.find_runs(one, np.array([3000])) == [(0, 0, 3000, 1)]
    finally:
        periodic.PAIRS = whole


# -- shards --------------------------------------------------------------------------------------------

def least_capacity(sizes, shards):
    """Smallest largest part of a contiguous partition, by dynamic programming."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    best = total[1:].astype(float)
    for _ in range(shards - 1):
        best = np.array([min(best[i], min((max(best[j - 1], total[i + 1] - total[j]) for j in range(1, i + 1)), default=best[i]))
                         for i in range(len(sizes))])
    return int(best[-1])


@pytest.mark.parametrize("shards", [16, 3, 1])
def test_shards(odd, odd_rows, shards):
    got = [tuple(r) for r in sharding.shard_documents(odd, shards).collect()]
    assert sorted(got and [r[:3] for r in got], key=key) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows), key=key)
    groups, of = {}, {}
    for i, t, *_ in odd_rows:
        groups[sha(t or "")] = groups.get(sha(t or ""), 0) + len((t or "").encode()) + 1
        of.setdefault((i, zlib.crc32((t or "").encode())), set()).add(sha(t or ""))
    where = {}
    for i, _, crc, shard, _ in got:
        for d in of[i, crc]:
            where.setdefault(d, set()).add(shard)
    assert all(len(s) == 1 for s in where.values())
    order = sorted(groups)
    held = [min(where[d]) for d in order]
    assert held == sorted(held) and set(held) <= set(range(shards))
    sums = [sum(groups[d] for d in order if d in where and min(where[d]) == s) for s in range(shards)]
    assert max(sums) == least_capacity([groups[d] for d in order], shards)
    for s in range(shards):
        assert sorted(r[4] for r in got if r[3] == s) == list(range(sum(r[3] == s for r in got)))
    assert sum(s > 0 for s in sums) == min(shards, len(order))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60) | st.integers(1, 4000), min_size=1, max_size=40), st.integers(1, 9), st.integers(1, 3))
def test_capacity_from_summaries(sizes, shards, width):
    """Cells refined as in plan_shards give the optimum that dynamic programming finds, and keep to it."""
    digest = sorted(sha(f"{j}/{n}") for j, n in enumerate(sizes))
    table = dict(zip(digest, sizes))

    def summary(prefixes, w):
        out = {}
        for d, n in table.items():
            if any(d.startswith(p) for p in prefixes):
                s, c = out.get(d[:w], (0, 0))
                out[d[:w]] = (s + n, c + 1)
        return sorted((p, s, c) for p, (s, c) in out.items())

    first = summary([""], width)
    cells = sharding.Cells([p for p, _, _ in first], [s for _, s, _ in first], [c == 1 for _, _, c in first])
    low = max(-(-cells.total // shards), max(sizes))
    while True:
        low, high = cells.least(shards, low, True), cells.least(shards, low, False)
        if low == high:
            break
        parents = cells.undecided(low, high, shards)
        assert parents
        cells = cells.finer(parents, [r for p in parents for r in summary([p], len(p) + 1)])
    assert high == least_capacity(sizes, shards)
    cuts = cells.cuts(high, shards)
    sums = [0] * shards
    for d in digest:
        sums[sum(d >= c for c in cuts)] += table[d]
    assert max(sums) == high and cuts == sorted(cuts)


def test_shards_small_and_written(spark, odd, odd_rows, tmp_path):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame(odd_rows, DOCS)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows)
    want = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_documents(docs, 4).collect()}
    assert all(want[r["doc_id"], zlib.crc32((r["text"] or "").encode())] == r["shard"] for r in back.collect())
