"""Benchmark decontamination with DataFrame functions only.

A document is contaminated by a benchmark item if one of its item-sized windows (as many words as
the item) has a weighted shingle similarity of 0.8 or more with it: over the multisets of 5-word
shingles, the sum of the smaller counts over the sum of the larger ones.

1. Items: identical items are one class, named by the smallest item_id.
2. Places: a window that reaches the similarity shares so many shingles with the item that it has at
   least one of the item's rarest few (prefix filter). Shingles of the corpus are joined to those,
   which leaves few places; no window without such a shingle can be verified, so none is lost.
3. Fingerprints: every item-sized window over such a place gets a 64-bit SimHash.
4. Multi-index search: fingerprints are cut into 8 blocks of 8 bits. Two fingerprints at most 23 bits
   apart differ by at most 2 bits in some block, so each item is entered under every block value
   within 2 bits of its own (37 a block) and windows are looked up by (window length, block, value).
   Windows at similarity 0.8 are about 10 bits away on average, so few lie beyond 23 (see README).
5. Verification: the exact weighted shingle similarity of every pair found.

Words are lower-cased runs without ASCII white space. Items of fewer than five words are one shingle
of all their words (windows have that length too); items without words match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqdrift.config import materialize

from .common import let, read, row_key, sized, words_of

SHINGLE = 5
SIMILARITY = 0.8
MAX_BITS = 23
BLOCKS = 8
LANE = 0x0000000100000001


def shingle_array(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order (fewer words: none)."""
    return let(words, lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))).otherwise(F.array().cast("array<bigint>")))


def simhash(hashes: Column) -> Column:
    """Fingerprint of an array of hashes: bit set in over half of them.

    One sum holds the counts of bits b and b + 32 in its two halves.
    """
    def count(h: Column, b: int) -> Column:
        return F.aggregate(h, F.lit(0).cast("bigint"),
                           lambda a, x: a + F.shiftrightunsigned(x, b).bitwiseAND(F.lit(LANE)))

    def bits(total: Column, n: Column, b: Column) -> Column:
        low = (total.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) * 2 > n).cast("bigint")
        high = (F.shiftrightunsigned(total, 32) * 2 > n).cast("bigint")
        return F.call_function("shiftleft", low.bitwiseOR(F.shiftleft(high, 32)), b)

    return let(hashes, lambda h: let(F.size(h), lambda n: F.aggregate(
        F.transform(F.array(*[count(h, b) for b in range(32)]), lambda total, b: bits(total, n, b)),
        F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of two arrays' values."""
    def times(xs: Column, v: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == v))

    return let(a, lambda x: let(b, lambda y: F.aggregate(
        F.array_distinct(x), F.lit(0), lambda n, v: n + F.least(times(x, v), times(y, v)))))


def blocks(fp: Column) -> Column:
    """The fingerprint's blocks, lowest bits first."""
    width = 64 // BLOCKS
    mask = F.lit((1 << width) - 1).cast("bigint")
    return let(fp, lambda x: F.array(*[F.shiftrightunsigned(x, i * width).bitwiseAND(mask) for i in range(BLOCKS)]))


def item_classes(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, width, n, hashes): items with words, identical ones as the smallest item_id."""
    words = benchmark.select("item_id", words_of(F.lower(F.col("text"))).alias("words"))
    first = words.where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id"))
    n = F.size("words")
    hashes = reduce(lambda rest, w: F.when(n == w, shingle_array(F.col("words"), w)).otherwise(rest),
                    range(1, width), shingle_array(F.col("words"), width))
    return first.select("item_id", F.least(n, F.lit(width)).alias("width"), hashes.alias("hashes")) \
        .withColumn("n", F.size("hashes"))


def rare_shingles(items: DataFrame, similarity: float) -> DataFrame:
    """(width, n, shingle): of every item the fewest shingles (rarest among items first) such that a
    window of its size without any of them cannot reach the similarity.

    Against n shingles of an item the similarity s needs an overlap of s n or more, so
    n - overlap + 1 of them suffice; copies of one shingle count as many.
    """
    each = items.select("item_id", "width", "n", F.posexplode("hashes").alias("place", "shingle"))
    share = each.groupBy("width", "shingle").agg(F.countDistinct("item_id").alias("items"))
    ranked = each.join(share, ["width", "shingle"]).groupBy("item_id", "width", "n").agg(
        F.array_sort(F.collect_list(F.struct("items", "shingle"))).alias("by_rarity"))
    need = F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9))
    taken = F.slice(F.col("by_rarity"), F.lit(1), (F.col("n") - need + 1).cast("int"))
    return ranked.select("width", "n", F.explode(taken).alias("s")).select(
        "width", "n", F.col("s.shingle").alias("shingle")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity): contaminated documents and the items found in them.

    One row per document and item class (the smallest item_id of identical items) with the largest
    similarity of a window. Null and empty texts and items match nothing; rows with a null doc_id are
    compared like others and reported under null; rows that repeat an id are reported once, with the
    best of them. Empty tables give an empty result. Extra columns are ignored.
    """
    items = materialize(item_classes(benchmark.select("item_id", "text"), width), "decon-items")
    rare = materialize(rare_shingles(items, similarity), "decon-rare")
    n_rare = rare.count()
    sizes = [r[0] for r in rare.select("width").distinct().collect()]  # at most ``width`` numbers
    if not sizes:
        sizes = [width]

    # rows are told apart by id and text, so that null and repeated ids are no group of rows
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")

    def words(table: DataFrame) -> Column:
        return words_of(F.lower(table["text"])).alias("words")

    def places(w: int) -> DataFrame:
        """(row, starts by n): where a window may lie, per document with a rare shingle."""
        hashes = rows.select("row", words(rows)).select("row", shingle_array(F.col("words"), w).alias("hashes"))
        each = hashes.select("row", F.posexplode("hashes").alias("at", "shingle"))
        hit = each.join(sized(rare.where(F.col("width") == w).drop("width"), n_rare), "shingle")
        return hit.groupBy("row").agg(F.collect_set(F.struct("n", "at")).alias("seeds")).withColumn("width", F.lit(w))

    seeds = materialize(reduce(DataFrame.unionAll, [places(w) for w in sizes]), "decon-places")
    # only the words of documents with a place are split again
    todo = rows.join(sized(seeds, seeds.count()), "row")
    todo = todo.select(F.col("row.id").alias("doc_id"), words(todo), "width", "seeds")
    hashes = reduce(lambda rest, w: F.when(F.col("width") == w, shingle_array(F.col("words"), w)).otherwise(rest),
                    sizes[1:], shingle_array(F.col("words"), sizes[0]))
    todo = todo.select("doc_id", "width", "seeds", hashes.alias("hashes"))
    def windows_over(s: Column, size: Column) -> Column:
        """(n, start) of the item-sized windows over a place; a shorter text is one window."""
        last = F.greatest(F.lit(0), F.least(s["at"], size - s["n"]))
        return F.transform(F.sequence(F.least(last, F.greatest(F.lit(0), s["at"] - s["n"] + 1)), last),
                           lambda i: F.struct(s["n"].alias("n"), i.alias("start")))

    spots = let(F.size("hashes"), lambda size: F.array_distinct(F.flatten(
        F.transform("seeds", lambda s: windows_over(s, size)))))
    windows = todo.select("doc_id", "width", "hashes", F.explode(spots).alias("w"))
    windows = windows.select("doc_id", "width", F.col("w.n").alias("n"),
                             F.slice(F.col("hashes"), F.col("w.start") + 1, F.col("w.n")).alias("window"))
    windows = windows.withColumn("fp", simhash(F.col("window")))

    near = [v for v in range(1 << 64 // BLOCKS) if v.bit_count() <= MAX_BITS // BLOCKS]
    index = (items.withColumn("item_fp", simhash(F.col("hashes")))
             .select("item_id", "width", "n", "item_fp", F.posexplode(blocks(F.col("item_fp"))).alias("block", "own"))
             .select("*", F.explode(F.array(*[F.lit(v).cast("bigint") for v in near])).alias("off"))
             .withColumn("value", F.col("own").bitwiseXOR(F.col("off"))).drop("own", "off"))
    index = materialize(index, "decon-index")
    asked = windows.select("*", F.posexplode(blocks(F.col("fp"))).alias("block", "value"))
    found = asked.join(sized(index, index.count()), ["width", "n", "block", "value"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair found under several blocks is verified under the first of them
    first_block = F.array_position(F.transform(blocks(apart), lambda x: F.bit_count(x) <= MAX_BITS // BLOCKS), True) - 1
    found = found.where((F.bit_count(apart) <= MAX_BITS) & (first_block == F.col("block")))
    found = found.join(sized(items.select("item_id", F.col("hashes").alias("item")), n_rare), "item_id")
    shared = multiset_overlap(F.col("window"), F.col("item"))
    union = F.size("window") + F.size("item") - shared
    verified = found.select("doc_id", "item_id", (shared / union).alias("similarity"))
    return (verified.where(F.col("similarity") >= similarity)
            .groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item.

    Rows are judged by (doc_id, digest of the text), so null and repeated ids share no verdict; rows
    without a text stay. All columns stay as they are, whatever their names; empty input or an empty
    benchmark drops nothing.
    """
    row = row_key(F.col("doc_id"), F.col("text"))
    bad = matches(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("found")).distinct()
    bad = materialize(bad, "decon-bad")
    # the columns of docs travel as one value, so that no name of theirs meets one of these
    whole = docs.select(row.alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(sized(bad, bad.count()), F.col("row_id") == F.col("found"), "left_anti").select("row.*")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Brute force: all windows of all documents that share a shingle with an item of their size.
OP1_SQL = r"""
WITH iw AS (SELECT min(item_id) AS item_id, w FROM (
         SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
       WHERE len(w) > 0 GROUP BY w),
it AS (SELECT item_id, least(len(w), 5) AS k, w FROM iw),
ish AS (SELECT item_id, k, len(w) - k + 1 AS n, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM it),
isc AS (SELECT item_id, k, n, s, count(*) AS c FROM ish GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM it),
dsh AS (SELECT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s,
               unnest(range(1, len(w) - k + 2)) AS p, len(w) - k + 1 AS size FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT d.doc_id, d.size, i.item_id, i.k, i.n, d.p FROM dsh d JOIN isc i ON d.s = i.s AND d.k = i.k),
enough AS (SELECT doc_id, item_id, k, n, any_value(size) AS size FROM hit GROUP BY doc_id, item_id, k, n HAVING count(*) >= 0.8 * n),
st AS (SELECT doc_id, item_id, k, n, unnest(range(1, greatest(size - n, 0) + 2)) AS p0 FROM enough),
win AS (SELECT st.doc_id, st.item_id, st.n, st.p0, d.s, count(*) AS c FROM st JOIN dsh d
        ON d.doc_id = st.doc_id AND d.k = st.k AND d.p BETWEEN st.p0 AND st.p0 + st.n - 1 GROUP BY ALL),
sz AS (SELECT doc_id, item_id, n, p0, sum(c) AS m FROM win GROUP BY ALL),
ov AS (SELECT w.doc_id, w.item_id, w.n, w.p0, sum(least(w.c, i.c)) AS o FROM win w JOIN isc i ON i.item_id = w.item_id AND i.s = w.s GROUP BY ALL)
SELECT doc_id, item_id, max(o::DOUBLE / (n + m - o)) AS similarity FROM ov JOIN sz USING (doc_id, item_id, n, p0)
GROUP BY doc_id, item_id HAVING max(o::DOUBLE / (n + m - o)) >= 0.8
"""
