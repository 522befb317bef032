"""Text operators against brute force on small tables, with nulls, ties, repeats and empty input."""

import collections
import hashlib
import html
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from seqdrift.llm import chat, decontaminate, html_extract, pii, quality_classifier, quality_rules, sentencepieces, \
    simhash, substring, suffixes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    """Copies, near copies, shared passages, nulls, repeated rows and one long text."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(rng.randint(1, 160))) for i in range(30)]
    rows += [(30 + i, f"{prose(20)} {passage} {prose(20)}") for i in range(8)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, rows[35][1] + " tail"), (43, passage + "\n" + passage)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (None, prose(60)), (None, None), (5, rows[5][1]), (60, "é ñ \x0b ß " * 30),
             (61, prose(12000) + " " + passage), (62, "ab " * 200)]
    line = prose(12)
    rows += [(70 + i, f"{prose(9)}\n" + f"{line}\n" * (3 + 4 * i) + f"{prose(30)}\n" + f"{line}\n" * 9) for i in range(4)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return docs_of(spark, odd_rows).withColumn("id", F.lit(1)).withColumn("s", F.lit("x")).withColumn("w", F.lit(2))


def units(text, kind):
    data = (text or "").encode()
    return data.split() if kind == "words" else [data[i:i + 1] for i in range(len(data))]


def brute_repeats(rows, k, kind):
    """Per (id, text): (n, removed, spans, sha) by the contracts' definitions."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    glue = b" " if kind == "words" else b""
    first = {}
    for i, t in order:
        u = units(t, kind)
        for p in range(len(u) - k + 1):
            first.setdefault(glue.join(u[p:p + k]), ((i is None, i or 0), p))
    out = {}
    for i, t in order:
        u, gone = units(t, kind), set()
        for p in range(len(u) - k + 1):
            who, at = first[glue.join(u[p:p + k])]
            me = (i is None, i or 0)
            if who < me or kind == "bytes" and who == me and at < p:
                gone.update(range(p, p + k))
        kept = glue.join(x for j, x in enumerate(u) if j not in gone)
        spans = sum(j - 1 not in gone for j in gone)
        out[i, t] = (len(u), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_word_windows(odd, odd_rows, hot):
    rows = substring.remove_repeats(odd, hot=hot).collect()
    want = brute_repeats(odd_rows, 50, "words")
    key = lambda x: (x[0] is None, x)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in rows), key=key) == sorted(
        ((i, n, g, sha) for (i, t), (n, g, _, sha) in ((r, want[r]) for r in odd_rows)), key=key)


@pytest.mark.parametrize("hot", [4096, 2])
def test_byte_windows(odd, odd_rows, hot):
    rows = suffixes.remove_repeats(odd, hot=hot).collect()
    want = brute_repeats(odd_rows, 100, "bytes")
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, rows), key=key) == sorted(((i, *want[i, t]) for i, t in odd_rows), key=key)


@pytest.mark.parametrize("hot", [4096, 2])
def test_windows_of_repeated_rows_and_ids(spark, hot):
    """Repeated rows, ids with several texts and several null ids around one passage, against brute force."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"v{rng.randrange(300)}" for _ in range(n))
    passage = prose(70)
    rows = [(1, f"{prose(9)} {passage} {prose(9)}")] * 2 + [(2, f"{prose(5)} {passage}"), (3, f"{prose(6)} {passage} a"),
            (3, f"{prose(7)} {passage} b"), (4, prose(60))] + [(None, f"{prose(8 + i)} {passage} {prose(5)}") for i in range(4)]
    rows += [rows[-1], rows[-2], rows[3], (2, rows[0][1])]
    docs = docs_of(spark, rows)

    def want(k, kind):
        def place(i, t):
            h = xxhash.xxh128_intdigest(t.encode()) >> 64
            return (i is None, i or 0, (h ^ 1 << 63) if kind == "bytes" else 0)
        glue, first, out = b" " if kind == "words" else b"", {}, []
        starts = lambda u: range(len(u) - k + 1)
        for i, t in rows:
            u = units(t, kind)
            for p in starts(u):
                w = glue.join(u[p:p + k])
                first[w] = min(first.get(w, ((True, 1 << 64, 0), 0)), (place(i, t), p if kind == "bytes" else 0))
        for i, t in rows:
            u = units(t, kind)
            gone = {q for p in starts(u) if (place(i, t), p if kind == "bytes" else 0) > first[glue.join(u[p:p + k])]
                    for q in range(p, p + k)}
            kept = glue.join(x for j, x in enumerate(u) if j not in gone)
            out.append((i, len(u), len(gone), hashlib.sha256(kept).hexdigest()))
        return sorted(out, key=str)

    got = [tuple(r) for r in substring.remove_repeats(docs, hot=hot).collect()]
    assert sorted(got, key=str) == want(50, "words")
    got = [(r[0], r[1], r[2], r[4]) for r in suffixes.remove_repeats(docs, hot=hot).collect()]
    assert sorted(got, key=str) == want(100, "bytes")


def test_maximal_repeats(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (110, 130))
    rows = [(1, "x" + a + "y"), (2, "z" + a + "q"), (3, a[5:] + b), (4, "k" + b)]
    found = collections.defaultdict(set)
    text = dict(rows)
    for r in suffixes.maximal_repeats(docs_of(spark, rows)).collect():
        found[text[r.doc_id][r.start:r.start + r.length]].add((r.doc_id, r.start))
    assert all(len(x) > 1 and len(t) >= 100 for t, x in found.items())
    assert found[a] == {(1, 1), (2, 1)}
    assert found[a[5:]] == {(1, 6), (2, 6), (3, 0)}
    assert any((3, 105) in x or (4, 1) in x for x in found.values())


def test_repeat_intervals():
    text = "banana$"
    order = sorted(range(7), key=lambda i: text[i:])
    prefix = [0] + [next(j for j in itertools.count() if text[a + j:a + j + 1] != text[b + j:b + j + 1])
                    for a, b in zip(order, order[1:])]
    left = [ord(text[i - 1]) if i else -1 for i in order]
    got = {(text[order[lo]:order[lo] + n], tuple(sorted(order[lo:hi + 1]))) for n, lo, hi in
           suffixes.repeat_intervals(prefix, left, 1)}
    assert got == {("a", (1, 3, 5)), ("ana", (1, 3))}


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(odd, odd_rows):
    near = {}
    for i, t in odd_rows:
        near.setdefault(fingerprint(t), set()).add(i)
    root = {f: f for f in near}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(near, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for f, ids in near.items():
        for i in ids - {None}:
            least[find(f)] = min(i, least.get(find(f), i))
    rows = simhash.near_duplicates(odd).collect()
    key = lambda x: (x[0] is None, str(x))
    assert sorted(((r.id, r.fp % 2 ** 64, r.component_id) for r in rows), key=key) == sorted(
        ((i, fingerprint(t), least.get(find(fingerprint(t)))) for i, t in odd_rows), key=key)


def test_anchors_cover_all_pairs_within_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2 ** 64 - 1]
    values = {b ^ e for b in base for e in [0, *(1 << rng.randrange(64) | 1 << rng.randrange(64) for _ in range(12))]}
    signed = [v - 2 ** 64 if v >> 63 else v for v in values]
    got = {(r.a % 2 ** 64, r.b % 2 ** 64) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()}
    want = {tuple(p) for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want}


def test_keep_one(odd, odd_rows):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    named = {i for i in ids if i is not None}
    assert len([i for i in ids if i is not None]) == len(named) and ids.count(None) == 2
    assert 3 in named and not {40, 41} & named and 5 in named and 50 in named and 51 not in named


def brute_leaks(rows, items, width=5, similarity=0.8):
    word = lambda t: re.findall(decontaminate.read.__globals__["WORD"], (t or "").lower())
    out = {}
    for item, text in items:
        w = word(text)
        k = min(width, len(w))
        if not k:
            continue
        n = len(w) - k + 1
        own = collections.Counter(tuple(w[i:i + k]) for i in range(n))
        for i, t in rows:
            d = word(t)
            sh = [tuple(d[j:j + k]) for j in range(len(d) - k + 1)]
            if not own.keys() & set(sh):
                continue
            for p in range(max(1, len(sh) - n + 1)):
                win = collections.Counter(sh[p:p + n])
                if (s := sum((own & win).values()) / max(1, sum((own | win).values()))) >= similarity:
                    out[i, item] = max(s, out.get((i, item), 0))
    return out


def test_decontamination(spark, odd, odd_rows):
    whole = odd_rows[2][1].split()
    items = [(1, " ".join(whole[:40])), (2, " ".join(whole[:40])), (3, odd_rows[33][1]), (4, "w1 w2"), (5, None), (6, ""),
             (7, " ".join(whole[:25] + ["new"])), (8, odd_rows[3][1].upper()), (None, "w3 w4 w5")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(odd, bench).collect()}
    named = [x for x in items if x[0] not in (2,)]
    assert got == brute_leaks(odd_rows, named)
    left = {r.doc_id for r in decontaminate.drop_contaminated(odd, bench).collect()}
    assert left == {i for i, _ in odd_rows} - {i for i, _ in got}


def test_decontamination_of_null_ids(spark):
    """Rows without an id, and rows that share one, are matched each by itself and reported under their id."""
    rng = random.Random(9)
    prose = lambda n: " ".join(f"z{rng.randrange(500)}" for _ in range(n))
    items = [(1, prose(30)), (2, prose(25))]
    rows = [(None, f"{prose(9)} {items[0][1]} {prose(4)}"), (None, prose(40)), (None, items[1][1]), (None, None), (7, prose(30)),
            (7, f"{prose(3)} {items[1][1]}"), (7, f"{prose(3)} {items[1][1]}")] + [(None, prose(20)) for _ in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id is None, r.item_id, round(r.similarity, 6)) for r in decontaminate.matches(docs_of(spark, rows), bench).collect())
    assert got == [(False, 2, 1.0), (True, 1, 1.0), (True, 2, 1.0)]


def test_filters_judge_rows_by_their_own_text(spark):
    """Null and repeated ids: a contaminated row takes no other with it; near copies go, other texts stay."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"u{rng.randrange(500)}" for _ in range(60)) for _ in range(4))
    bench = spark.createDataFrame([(1, a)], "item_id bigint, text string")
    rows = [(None, a), (None, b), (7, a), (7, c), (8, d)]
    left = decontaminate.drop_contaminated(docs_of(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(None, b), (7, c), (8, d)], key=str)
    rows = [(None, a), (None, a.upper()), (7, b), (7, c), (None, c), (8, d), (8, d)]
    kept = [(r.doc_id, r.text.lower()) for r in simhash.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (7, b), (7, c), (8, d)], key=str)


def test_quality_rules_base(odd, odd_rows):
    trusted = odd.where("doc_id < 20").select("doc_id")
    got = {(r.doc_id, r.n_words, r.n_repeat_words): r for r in quality_rules.judge(odd, trusted).collect()}
    for i, t in odd_rows:
        w = units(t, "words")
        grams = collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        again = {q for j in range(len(w) - 4) if grams[tuple(w[j:j + 5])] > 1 for q in range(j, j + 5)}
        r = got[i, len(w), len(again)]
        lines = [x for x in (t or "").split("\n") if units(x, "words")]
        assert r.word_chars == len("".join(x.decode() for x in w)) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rules_ratio(spark):
    """Scores equal a direct evaluation of the two multinomials."""
    import numpy as np
    rows = [(1, "aa bb cc aa"), (2, "xx yy"), (3, None), (4, "aa bb zz")]
    d = docs_of(spark, rows)
    counts = quality_rules.count_ngrams(d, d.where("doc_id in (1, 4)").select("doc_id"))
    assert counts[1, 0].sum() == sum(max(0, len(t or "") - 2) for _, t in rows)
    assert counts[0, 1].sum() == 4 + 3 + 3 + 2 and counts[1, 1].sum() == 4 + 3 + 3 + 2 + 2 + 1
    ratio = quality_rules.log_ratio(counts)
    for r in quality_rules.judge(d, d.where("doc_id in (1, 4)").select("doc_id")).collect():
        want = 0.0
        for table, (bucket, _) in enumerate(quality_rules.Slice([(dict(rows)[r.doc_id] or "").encode()]).buckets()):
            want += float(np.mean(ratio[table][bucket])) if len(bucket) else 0.0
        assert r.score == pytest.approx(want)


def test_quality_rules_scores_by_plain_counts(spark):
    """Scores against n-grams counted as such: no hashing, no code of the operator."""
    import math
    rows = [(1, "the river path is open today"), (2, "the river is high"), (3, "win $$ win $$ now"), (4, "the path is open"),
            (5, "the river is high"), (6, "zz"), (7, "")]
    trusted = {1, 5}
    d = docs_of(spark, rows)
    grams = {t: (w + [f"{a} {b}" for a, b in zip(w, w[1:])], [t[i:i + 3] for i in range(len(t) - 2)]) for t in {t for _, t in rows} for w in [t.split()]}
    good = {t for i, t in rows if i in trusted}
    want = {}
    for i, t in rows:
        score = 0.0
        for table in (0, 1):
            raw = collections.Counter(g for x in grams for g in grams[x][table])
            target = collections.Counter(g for x in good for g in grams[x][table])
            n, prior = sum(target.values()), 1e-4 * sum(target.values())
            own = [math.log((target[g] + prior) / (raw[g] * n / sum(raw.values()) + prior)) for g in grams[t][table]]
            score += sum(own) / max(1, len(own))
        want[i] = score
    got = {r.doc_id: r for r in quality_rules.judge(d, d.where("doc_id in (1, 5)").select("doc_id")).collect()}
    for i, _ in rows:
        assert got[i].score == pytest.approx(want[i]) and got[i].kept == (want[i] >= -0.25 and not got[i].base_failed)


def test_quality_rules_verdict(spark):
    """Clean documents stay, junk goes, with and without labels of their own."""
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge(docs, quality_rules.trusted_ids(labels)).where("not base_failed").join(labels, "doc_id")
    kept = {(r.quality, r.kept): r.n for r in got.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert kept.get((1, False), 0) == 0 and kept.get((0, True), 0) == 0


def test_quality_rules_copies_and_size(spark):
    """Verdicts don't change with copies of a clean unlabelled text, a repeated table or larger counts."""
    import numpy as np
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs, trusted = docs.select("doc_id", "text"), quality_rules.trusted_ids(labels)
    once = {r.doc_id: r for r in quality_rules.judge(docs, trusted).collect()}
    named = {r.doc_id for r in labels.collect()}
    clean = max((r for r in once.values() if r.kept and r.doc_id not in named), key=lambda r: r.score)
    more = docs.where(F.col("doc_id") == clean.doc_id).crossJoin(spark.range(999).select((F.col("id") + 10 ** 6).alias("new")))
    many = quality_rules.judge(docs.unionByName(more.select(F.col("new").alias("doc_id"), "text")), trusted).collect()
    assert len(many) == len(once) + 999
    assert all(r.kept and r.score == clean.score for r in many if r.doc_id >= 10 ** 6)
    tenfold = quality_rules.judge(docs.crossJoin(spark.range(10)).select("doc_id", "text"), trusted).collect()
    assert len(tenfold) == 10 * len(once)
    for r in [r for r in many if r.doc_id < 10 ** 6] + tenfold:
        assert (r.kept, r.score) == (once[r.doc_id].kept, once[r.doc_id].score)
    counts = np.random.default_rng(5).integers(0, 20, (2, 2, quality_rules.BUCKETS))
    assert np.allclose(quality_rules.log_ratio(10 * counts), quality_rules.log_ratio(counts))


def naive_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out)


def test_pii_base_spans():
    rng = random.Random(2)
    parts = list("ab1.@-+ ()%2590") + ["12", "255.", "+1 ", "@a.b", "4111111111111111", "10.0.0.1"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        assert pii.base_spans(t) == naive_spans(t)
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_pii_field(spark):
    texts = [f"mail joe.{i}@mail.example.com or 4111111111111111 or +1 (377) 555-0{i:03} at 10.0.{i}.1, {i} more "
             f"and again +1 (377) 555-0{i:03} or joe.{i}@mail.example.com" for i in range(200)]
    weights = pii.train(texts)
    t = "é call +1 (377) 555-0271 now. again 555-0271, and 4111111111111111 twice 4111111111111111; item 3"
    base, every = pii.find([t], weights)[0]
    assert base == naive_spans(t) and set(base) < set(every)
    assert (t.index("555-0271,"), 3, t.index("555-0271,") + 8) in every
    assert pii.find(["a clean text with 3 numbers, 1999 and 2.0"], weights)[0] == ([], [])
    rows = [(1, t), (2, None), (3, ""), (None, t)]
    got = pii.find_personal_data(docs_of(spark, rows), weights).collect()
    assert [r.n_phone for r in got] == [1, 0, 0, 1] and [r.n_card for r in got] == [2, 0, 0, 2]
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert got[0].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
    clean = pii.redact(docs_of(spark, rows), weights).collect()
    assert clean[0].text.count("[PHONE]") >= 2 and "4111" not in clean[0].text and clean[1].text is None
    assert clean[0].n_chars == len(clean[0].text)


def test_pii_repeats():
    """Every repeat of a covered token is found, however many there are and however it is spelled."""
    texts = [f"mail joe.{i}@mail.example.com or 4111111111111111 or +1 (377) 555-0{i:03} at 10.0.{i}.1, {i} more "
             f"and again +1 (377) 555-0{i:03} or joe.{i}@mail.example.com" for i in range(200)]
    weights = pii.train(texts)
    t = "call +1 (377) 555-0271 now. " + " ".join(["or as said before ring 555-0271 then"] * 49)
    base, every = pii.find([t], weights)[0]
    assert len(base) == 1 and len(every) == 50
    assert {t[s:e] for s, k, e in every[1:] if k == 3} == {"555-0271"}
    pairs = lambda t: pii.Nodes([t], [pii.base_spans(t)])
    n = pairs("555-0271 and 5550271 with 555.0271's and 377-555-0271 but 12 and 12")
    assert n.hubs == 2 and sorted(n.hub[:, 1].tolist()) == [0] * 3 + [1] * 4
    t = "call +1 (377) 555-0271 now. ring 555.0271 or 555-0271's line"
    assert {t[s:e] for s, k, e in pii.find([t], weights)[0][1][1:]} == {"555.0271", "555-0271"}


def test_belief_propagation_is_exact_on_trees():
    import numpy as np
    nodes = pii.Nodes(["a1 b2 c3 zz d4"], [[]])
    rng = np.random.default_rng(0)
    w = {"own": rng.normal(size=(pii.FEATURES, pii.LABELS)), "chain": rng.normal(size=(5, 5)), "skip": np.zeros((5, 5))}
    got = pii.marginals(nodes, w, np.zeros(4, bool), rounds=6)
    own = w["own"][nodes.features].sum(axis=1)
    total = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        p = np.exp(sum(own[i, y[i]] for i in range(4)) + w["chain"][y[0], y[1]] + w["chain"][y[1], y[2]])
        for i in range(4):
            total[i, y[i]] += p
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True))


def test_sentencepiece(spark, odd, odd_rows):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    machine = sentencepieces.PieceTransducer(sentencepieces.load_model())
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "漢", "😀", "1", "00", "--", "==", "(", ")", "ing", "tion", "▁", "<s>", "<0x0A>", "ß",
             ".", ",", "!!", "'s", "_", "%"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = machine.encode(t).tolist()
        assert ids == sp.encode(t) and machine.decode(ids) == t.replace("▁", " ")
    tokens = sentencepieces.encode(odd)
    got = [(r.doc_id, r.ids, r.round_trip) for r in tokens.collect()]
    assert got == [(i, sp.encode(t or ""), True) for i, t in odd_rows]
    assert [r.text for r in sentencepieces.decode(tokens).collect()] == [t or "" for _, t in odd_rows]


def test_quality_classifier(spark):
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality_classifier.op2_quality_classifier(spark, f"{SF}/../sf0.01")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == 1000 and len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    # only the text and the training labels matter
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    other = quality_classifier.fit(docs.withColumn("lang", F.lit("x")), flipped)
    assert other[0] == pytest.approx(model[0]) and [r for r, _ in other[1]] == [r for r, _ in model[1]]
    odd = docs_of(spark, [(1, None), (2, ""), (None, "a b")]).withColumn("score", F.lit("x")).withColumn("label", F.lit(3))
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(odd, model).collect())
    assert quality_classifier.classify(odd.limit(0), model).count() == 0
    # the compiled rules against a plain evaluation of paths and weights
    import math
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_classifier.classify(docs, model).collect():
        values = quality_classifier.statistics(texts[r.doc_id].encode())
        z = model[0] + sum(w for rule, w in model[1] if all((values[at] <= v) == below for at, below, v in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == (r.score >= 0.5)
    assert quality_classifier.fit(docs, labels.limit(0)) == (0.0, [])


def test_html_blocks_and_extraction(spark):
    page = ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>menu</a>"
            "</ul></nav><!-- <p>no</p> --><div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p>One <b>two</b>"
            "three&nbsp;&#233; <p>Next\n part<br>here</article><footer>&copy; me</footer>")
    cut = html_extract.blocks(page)
    assert [b.text for b in cut] == ["t", "menu", "Buy now", "Head & line", "One twothree é", "Next part here", "© me"]
    assert html_extract.teach(cut) == [0, 0, 0, 1, 1, 1, 0]
    assert html_extract.blocks("") == [] and html_extract.blocks("<p") [0].text == "<p"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_extract.fit(pages)
    got = {r.page_id: r for r in html_extract.extract(pages, weights).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", body))]
        assert got[r.page_id].text == "\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    rows = spark.createDataFrame([(1, "u", None), (None, None, ""), (1, "u", page)], "page_id bigint, url string, html string")
    assert [r.text for r in html_extract.extract(rows, weights).collect()][:2] == ["", ""]
    assert html_extract.extract(rows.limit(0), weights).count() == 0


def test_html_deep_paths(spark):
    """Containers far up the path and words in the middle of a long block are read."""
    import numpy as np
    deep = "".join(f'<div class="wrap-{i} row-{i}">' for i in range(10))
    page = (f"<body><article>{deep}<p>The council met on Monday and agreed on the new plan for the river path, it said.</p></article>"
            f"<section class=comments>{deep}<p>I think that this was a fine piece and I would like to read more of it.</p></section></body>")
    cut = html_extract.blocks(page)
    assert len(cut) == 2 and all(len(b.path) > 40 for b in cut) and html_extract.teach(cut) == [1, 0]
    x = html_extract.features(cut)
    plain = html_extract.features([html_extract.Block([n for n in b.path if n not in ("article", "comments")], b.text) for b in cut])
    for i, name in enumerate(("article", "comments")):
        at = [html_extract._bucket(p + name, html_extract.PATH_SIZE) for p in ("", "2")]
        assert x[i, at].all() and not plain[i, at].all()
    pages = [html_extract.Block(["p"], " ".join(["a"] * 40 + [w] * 40 + ["a"] * 40)) for w in ("river", "council")]
    words = html_extract.features(pages)[:, html_extract.PATH_SIZE:html_extract.PATH_SIZE + html_extract.WORD_SIZE]
    assert np.allclose(words.sum(axis=1), 1) and not np.allclose(words[0], words[1])
    weights = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    chance = html_extract.predict(weights, [x])[0]
    assert chance[0] >= 0.5 > chance[1]


def test_lstm_gradients():
    import numpy as np
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in html_extract.new_weights(rng).items()}
    x, mask = html_extract._pad([rng.normal(size=(4, w["xf"].shape[0])), rng.normal(size=(2, w["xf"].shape[0]))])
    x = x.astype(np.float64)
    d_out = rng.normal(size=(4, 2, html_extract.HIDDEN)).astype(np.float32) * mask[:, :, None]
    for side in "fb":
        loss = lambda: float((html_extract._read(w, side, x, mask)[0] * d_out).sum())
        grad = {k: np.zeros(v.shape) for k, v in w.items()}
        html_extract._learn(w, side, x, html_extract._read(w, side, x, mask)[1], d_out, grad)
        for name in ("x" + side, "h" + side, "c" + side):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            keep = w[name][at]
            w[name][at] = keep + 1e-2
            up = loss()
            w[name][at] = keep - 1e-2
            down = loss()
            w[name][at] = keep
            assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3)


def test_chats(spark):
    tools = '{"tools":[{"name":"add","parameters":{"properties":{"a":{"type":"number"},"b":{"type":"integer"}},"required":["a"]}}]}'
    rows = [(1, 0, "system", tools),
            (1, 2, "assistant", '{"content":"x","tool_calls":[{"id":"c1","name":"add","arguments":{"b":2,"a":1.5}},'
                                '{"id":"c2","name":"add","arguments":{"b":"q","a":1}}]}'),
            (1, 1, "tool", '{"tool_call_id":"c1","content":"3.5"}'), (1, 9, "tool", '{"tool_call_id":"zz","content":"?"}'),
            (1, 1, "assistant", '{"tool_calls":[{"id":"c3","name":"sub","arguments":{"z":{"y":1,"b":[2]}},"after":["c1"]}]}'),
            (1, 1, "user", "hi"), (1, 1, "user", "hi"), (None, None, None, None),
            (2, 0, "assistant", '{"tool_calls":[{"id":"a","name":"t","arguments":"[1"}]}'), (2, 1, "assistant", '{"tool_calls": nope'),
            (3, 0, "assistant", '{"tool_calls":[{"id":"p","name":"t","arguments":{},"after":["q"]}]}'),
            (3, 1, "tool", '{"tool_call_id":"p"}'), (3, 2, "assistant", '{"tool_calls":[{"id":"q","name":"t","after":["p"]}]}'),
            (3, 3, "tool", '{"tool_call_id":"q"}')]
    d = spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string").withColumn("key", F.lit(1))
    got = {(r.conv_id, r.position): r for r in chat.format_chats(d).collect()}
    assert len(got) == len(set(rows))
    one = [got[1, p] for p in range(6)]
    assert [(r.turn, r.role) for r in one] == [(0, "system"), (1, "user"), (2, "assistant"), (1, "tool"), (1, "assistant"), (9, "tool")]
    assert [r.status for r in one] == ["ok", "ok", "mistyped_argument", "ok", "unknown_tool", "orphan"]
    assert one[1].copies == 2 and (one[2].n_calls, one[2].n_valid, one[2].n_linked) == (2, 1, 1) and one[3].result_of == "c1"
    assert one[2].message == ('{"content":"x","role":"assistant","tool_calls":[{"arguments":{"a":1.5,"b":2},"id":"c1","name":"add"},'
                              '{"arguments":{"a":1,"b":"q"},"id":"c2","name":"add"}]}')
    assert '"arguments":{"z":{"b":[2],"y":1}}' in one[4].message
    assert got[2, 0].message.count('"[1"') == 1 and got[2, 1].message == '{"content":"{\\"tool_calls\\": nope","role":"assistant"}'
    assert [got[3, p].status for p in range(4)] == ["cycle"] * 4 and got[None, 0].message == "{}"
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chats_with_leading_white_space(spark):
    rows = [(1, 0, "system", ' \n{"tools":[{"name":"add","parameters":{"properties":{"a":{"type":"number"}}}}]}'),
            (1, 1, "assistant", '\r\n {"tool_calls":[{"id":"c","name":"add","arguments":{"a":1}}]}'),
            (1, 2, "tool", '\t{"tool_call_id":"c","content":"1"}')]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string"))
    got = {r.position: r for r in got.collect()}
    assert (got[1].n_calls, got[1].n_valid, got[1].n_linked) == (1, 1, 1) and got[2].result_of == "c"


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert substring.remove_repeats(none).count() == 0 and suffixes.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(odd, bench).count() == 0
    assert quality_rules.judge(none, none.select("doc_id")).count() == 0
    assert pii.find_personal_data(none, pii.fit(none)).count() == 0 and sentencepieces.encode(none).count() == 0
    page = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract(page, html_extract.fit(page)).count() == 0


def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = cp.quality_rules_stage(spark, docs, SF)
    want = {r.doc_id for r in quality_rules.judge(docs, quality_rules.trusted_ids(labels)).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    fps = {i: fingerprint(t) for i, t in rows}
    group = {i: i for i in fps}
    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    one = cp.near_duplicates_stage(spark, kept, SF)
    assert {r.doc_id for r in one.collect()} == set(group.values())

    rows = [(r.doc_id, r.text) for r in one.collect()]
    leaks = brute_leaks(rows, [tuple(r) for r in bench.collect()])
    clean = cp.decontamination_stage(spark, one, SF)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in leaks}

    masked = {r.doc_id: r for r in cp.personal_data_stage(spark, clean, SF).collect()}
    for r in clean.collect():
        got = masked[r.doc_id]
        assert not naive_spans(got.text) and (naive_spans(r.text) or got.text == r.text)
    final = cp.run(spark, SF)
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    assert {r.doc_id: r.ids for r in final.collect()} == {i: sp.encode(r.text) for i, r in masked.items()}


def test_chats_nested_calls_and_schemas(spark):
    """Function form, unknown keys, type lists, enums, nested objects and arrays; nothing vanishes."""
    import json
    schema = {"type": "object", "required": ["a"], "properties": {
        "a": {"type": ["string", "null"]}, "b": {"enum": [1, "1", None, {"y": 1, "x": 2}]},
        "c": {"type": "object", "required": ["d"], "properties": {"d": {"type": "array", "items": {
            "type": "object", "properties": {"e": {"type": "integer"}}, "additionalProperties": False}}}}}}
    tools = {"tools": [{"type": "function", "function": {"name": "f", "parameters": schema}},
                       {"name": "g", "parameters": {"additionalProperties": True, "properties": {}}}]}
    cases = [({"a": "x"}, "ok"), ({"a": None}, "ok"), ({"a": 1}, "mistyped_argument"), ({"b": 1}, "missing_argument"),
             ({"a": "x", "b": 1}, "ok"), ({"a": "x", "b": "1"}, "ok"), ({"a": "x", "b": None}, "ok"), ({"a": "x", "b": "2"}, "not_in_enum"),
             ({"a": "x", "b": {"x": 2, "y": 1}}, "ok"), ({"a": "x", "z": 1}, "unexpected_argument"),
             ({"a": "x", "c": {}}, "missing_argument"), ({"a": "x", "c": {"d": [], "more": 1}}, "ok"),
             ({"a": "x", "c": {"d": [{"e": 1}, {"e": 2}]}}, "ok"), ({"a": "x", "c": {"d": [{"e": 1}, {"e": "2"}]}}, "mistyped_argument"),
             ({"a": "x", "c": {"d": [{"q": 1}]}}, "unexpected_argument"), ({"a": "x", "c": {"d": 3}}, "mistyped_argument"),
             ([1], "bad_json")]
    rows = [(i, 0, "system", json.dumps(tools)) for i in range(len(cases))]
    for i, (given, _) in enumerate(cases):
        text = json.dumps(given) if i % 2 else given
        rows.append((i, 1, "assistant", json.dumps({"tool_calls": [
            {"id": "9", "type": "function", "index": 0, "function": {"name": "f", "arguments": text, "strict": True}}], "refusal": "no", "usage": {"b": 1, "a": [2]}})))
        rows.append((i, 2, "tool", json.dumps({"tool_call_id": "9", "content": "r", "elapsed": 1.5})))
    rows.append((99, 0, "system", json.dumps(tools)))
    rows.append((99, 1, "assistant", json.dumps({"content": "c", "tool_calls": [{"id": "1", "name": "g", "arguments": {"free": 1}, "after": ["0"]}]})))
    got = {(r.conv_id, r.position): r for r in chat.format_chats(
        spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string")).collect()}
    for i, (given, status) in enumerate(cases):
        call, result = got[i, 1], got[i, 2]
        assert (call.status, call.n_valid, call.n_linked) == (status, int(status == "ok"), 1), given
        want = {"refusal": "no", "role": "assistant", "tool_calls": [{"arguments": given, "function": {"strict": True}, "id": "9",
                "index": 0, "name": "f", "type": "function"}], "usage": {"a": [2], "b": 1}}
        assert call.message == json.dumps(want, sort_keys=True, separators=(",", ":"))
        assert result.message == '{"content":"r","elapsed":1.5,"role":"tool","tool_call_id":"9"}' and result.result_of == "9"
    assert got[99, 1].status == "ok"
    assert got[99, 1].message == '{"content":"c","role":"assistant","tool_calls":[{"after":["0"],"arguments":{"free":1},"id":"1","name":"g"}]}'


def test_html_loses_no_text():
    text = lambda page: [b.text for b in html_extract.blocks(page)]
    assert text('<article><p>One <svg class="i"/> two</p><p>three <svg-icon></svg-icon> four</p><select-box>five</select-box></article>') == [
        "One two", "three four", "five"]
    assert text("<p data-x=don't>Hello it's</p><p>more</p>") == ["Hello it's", "more"]
    assert text('<p>a<svg><path d="M 1>2"/></svg>b</p><button>no</button>c<object>kept') == ["ab", "ckept"]
    assert text('<p>x<script>if (a<b) "</p>"</script>y<!-- z <p>q</p> --> w<!-- open') == ["xy w"]
    assert text("<p title=\"a > b\">t</p><p title='it\"s'>u</p>k<STYLE >zz") == ["t", "u", "k"]
    # many unclosed tags are read in one pass
    assert len(html_extract.blocks("<a " * 50_000)) == 1 and len(html_extract.blocks("<button>x" * 20_000)) == 1


def test_samples_of_long_texts_only(spark):
    """Pages and texts longer than what training reads of each still train, and are worked on whole."""
    page = ("<html><body><nav><a>Home</a> <a>About</a></nav><article>" + "<p>The council met on Monday and agreed on the plan for the path.</p>" * 1200
            + "</article><footer>All rights reserved</footer></body></html>")
    pages = spark.createDataFrame([(i, "u", page.replace("Monday", f"day {i}")) for i in range(12)], "page_id bigint, url string, html string")
    assert len(page) > html_extract.MAX_SAMPLE_CHARS
    for r in html_extract.extract(pages, html_extract.fit(pages)).collect():
        assert r.text.count("The council met on day") == 1200
    docs = spark.createDataFrame([(i, "mail a.b%d@example.org or call +44 20 7946 0%03d now " % (i, i) * 800) for i in range(8)], "doc_id bigint, text string")
    assert docs.selectExpr("min(length(text))").first()[0] > pii.MAX_SAMPLE_CHARS
    weights = pii.fit(docs)
    assert all(abs(w).sum() > 0 for w in weights.values())


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_with_any_columns(spark, odd_rows, tmp_path, empty):
    """Stages over odd and empty tables with clashing and map columns: same rows as without them."""
    import corpus_pipeline as cp
    plain = docs_of(spark, odd_rows + [(900, "a.b@example.org " + "word other " * 20), (901, None), (901, None)])
    plain = plain.limit(0) if empty else plain
    names = ["_bad", "_keep", "id", "row", "row_id", "found", "staying", "times", "fp", "component_id", "words", "p", "key", "n"]
    wide = plain.select("*", *[F.lit(7).alias(c) for c in names], F.create_map(F.lit("k"), F.lit(1)).alias("m"),
                        F.array(F.lit("x")).alias("hashes"))
    got = []
    for kind, docs in (("plain", plain), ("wide", wide)):
        where = tmp_path / kind
        docs.write.parquet(str(where / "documents.parquet"))
        labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id bigint, quality int, toxic int")
        bench = spark.createDataFrame([(1, odd_rows[4][1]), (2, None)], "item_id bigint, text string")
        for name, t in (("labels", labels), ("benchmark", bench)):
            (t.limit(0) if empty else t).write.parquet(str(where / f"{name}.parquet"))
        step = docs
        for _, stage in cp.STAGES[:-1]:
            step = stage(spark, step, str(where))
            assert step.columns == docs.columns and dict(step.dtypes) == dict(docs.dtypes)
        if kind == "wide":
            assert all(r["m"] == {"k": 1} and r["_bad"] == 7 for r in step.collect())
        got.append(sorted((repr(tuple(r)) for r in cp.run(spark, str(where)).collect())))
    assert got[0] == got[1] and bool(got[0]) != empty


def test_replicated_fingerprints_are_not_broadcast(spark):
    """The replicas of a small file are many times its rows; no side of that join may be sent to the driver."""
    fps = spark.range(500).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tables_of_a_row_per_fingerprint_are_not_broadcast(spark, odd):
    for result in (simhash.near_duplicates(odd), simhash.keep_one(odd)):
        plan = result._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
