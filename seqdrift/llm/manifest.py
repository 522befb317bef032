"""Merkle manifest of a dataset: one hash tree per group, one tree over the groups, a proof per row.

Children are pivoted into slots: conditional aggregates spread the up to ``fanout`` children of a parent
into columns, the concatenated columns hash to the parent, and the concatenation without the own slot
column is what a child needs as siblings. Levels are written tables of a fanout-th of the rows below;
paths then run top-down, each level joined once, and the leaves take their path from their own parent's
row. Positions come from range blocks, so a group with most of the rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqdrift.config import materialize
from seqdrift.operators.ranges import range_index

from .common import let, read

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the contract tampers with a row; rows without an id are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """Hash of all siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def slots(nodes: DataFrame, fanout: int, carry: list[str]) -> DataFrame:
    """(g, n, i, s0 … s<fanout-1>, h): children (g, n, i, h, carry) spread over the slots of their parent.

    n and i are the parent's: nodes of its level in the group, and place among them. A slot is a
    struct of the child's hash and the carried columns, null where there is no child.
    """
    child = F.struct("h", *carry)
    slot = [F.max(F.when(F.col("i") % fanout == j, child)).alias(f"s{j}") for j in range(fanout)]
    rows = nodes.where("n > 1").groupBy("g", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
                                        F.expr(f"i div {fanout}").alias("i")).agg(*slot)
    return rows.withColumn("h", F.sha2(together(range(fanout)), 256))


def together(columns) -> Column:
    """The hashes of slot columns as one string; empty slots add nothing."""
    return F.concat(F.lit(""), *[F.coalesce(F.col(f"s{j}.h"), F.lit("")) for j in columns])


def grow(nodes: DataFrame, fanout: int, carry: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """(written slot tables from the leaves up, (g, h, depth): what remains of every group).

    nodes: (g, n, i, h, carry), i counting 0 … n - 1 in group g. One number comes to the driver, the
    size of the largest group; it gives the number of levels.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], nodes.where("n = 1").select("g", "h", F.lit(0).alias("depth"))
    while largest > 1:
        levels.append(materialize(slots(nodes, fanout, carry if not levels else []), f"{name}-{len(levels) + 1}"))
        nodes = levels[-1].select("g", "n", "i", "h")
        tops = tops.unionAll(nodes.where("n = 1").select("g", "h", F.lit(len(levels)).alias("depth")))
        largest = -(-largest // fanout)
    return levels, materialize(tops, f"{name}-tops")


def children(level: DataFrame, above: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """(g, i, child, path, keep): the children of a slot table, each with its siblings put before its parent's path."""
    child = F.explode(F.array(*[
        F.struct(F.col(f"s{j}").alias("child"), (F.col("i") * fanout + j).alias("i"),
                 F.struct(together(range(j)).alias("left"), together(range(j + 1, fanout)).alias("right")).alias("own"))
        for j in range(fanout)])).alias("c")
    rows = level.drop("h", "n").join(above, ["g", "i"]).select("g", "path", *keep, child).where("c.child is not null")
    return rows.select("g", "c.i", "c.child", F.concat(F.array("c.own"), "path").alias("path"), *keep)


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """(g, child, path, keep) of every leaf; tops: (g, h, depth, path, keep), what a group's root has above it."""
    above = None
    for depth in range(len(levels), 0, -1):
        here = tops.where(F.col("depth") == depth).select("g", F.lit(0).cast("bigint").alias("i"), "path", *keep)
        above = here if above is None else here.unionByName(above)
        above = children(levels[depth - 1], above, fanout, keep)
        if depth > 1:
            above = materialize(above.drop("child"), f"manifest-paths-{depth}")
    return above


def manifest(rows: DataFrame, group: str, order: list[str], carry: list[str], fanout: int = FANOUT) -> DataFrame:
    """(carry, leaf, subroot, root, path): the tree over ``rows`` (group, order columns, carry, leaf).

    Per ``group`` leaves ascend by ``order`` and then by their hash (nulls first, rows equal in both are
    the same leaf twice); while several nodes remain, every ``fanout`` consecutive ones become the
    hash of their hex digests. The subroots, in the order of the groups, give the root alike. ``path``
    lists the siblings of every level, split into those left and right of the own node. Empty input
    gives an empty result; a table of one row has its leaf as subroot and root and an empty path.
    """
    kept = rows.select(F.col(group).alias("grp"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                       F.col("leaf").alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    held = [f"c{i}" for i in range(len(carry))]
    nodes = range_index(kept, ["grp", *[f"o{i}" for i in range(len(order))], "h", *held], ["grp"], "i", "g", "n", "manifest-order")
    nodes = materialize(nodes.select("g", "n", "i", "h", *held), "manifest-leaves")
    levels, tops = grow(nodes, fanout, held, "manifest")
    # the tree over the groups, which their first positions order
    upper = range_index(tops.select("g", "h"), ["g"], (), "i", None, "n", "manifest-groups")
    upper = materialize(upper.select(F.lit(0).cast("bigint").alias("g"), "n", "i", "h", F.col("g").alias("c0")), "manifest-upper")
    floors, peak = grow(upper, fanout, ["c0"], "manifest-root")
    peak = peak.select("g", "h", "depth", F.lit(None).cast(PATH).alias("path"), F.col("h").alias("root"))
    peak = peak.withColumn("path", F.array().cast(PATH))
    if floors:
        roots = descend(floors, peak, fanout, ["root"]).select(F.col("child.c0").alias("g"), "path", "root")
    else:
        roots = upper.select(F.col("c0").alias("g")).crossJoin(F.broadcast(peak.select("path", "root")))  # one row
    tops = materialize(tops.join(roots, "g").withColumn("subroot", F.col("h")), "manifest-subroots")
    keep = ["subroot", "root"]
    lone = nodes.where("n = 1").select("g", F.struct("h", *held).alias("child")).join(
        tops.select("g", "path", *keep), "g").select("child", "path", *keep)
    found = lone
    if levels:
        found = lone.unionByName(descend(levels, tops, fanout, keep).select("child", "path", *keep))
    return found.select(*[F.col(f"child.{h}").alias(c) for h, c in zip(held, carry)],
                        F.col("child.h").alias("leaf"), "subroot", "root", "path")


def document_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, presented, subroot, root, path): the manifest of ``documents`` rows.

    ``presented`` is the leaf of the row as the contract tampers with it (text in lower case where 3
    divides the checksum of the id), else the leaf itself. Nulls hash as ``-``; empty texts as ``0:``;
    null languages are one group, the first. Rows without an id come first and are not tampered with;
    repeated rows are leaves of their own. Other columns are not read. Empty input: empty result.
    """
    d = docs.select(*FIELDS)
    values = [F.col(c) for c in FIELDS[:-1]]
    changed = F.when(tampered(F.col("doc_id")), leaf_hash(*values, F.translate("text", UPPER, LOWER)))
    leaves = d.select("doc_id", "lang", leaf_hash(*values, F.col("text")).alias("leaf"), changed.alias("changed"))
    # written, so that choosing the range bounds does not read and hash the texts again
    found = manifest(materialize(leaves, "manifest-hashes"), "lang", ["doc_id"], ["doc_id", "changed"], fanout)
    return found.select("doc_id", "leaf", F.coalesce("changed", "leaf").alias("presented"), "subroot", "root", "path")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found = document_manifest(read(spark, sf_dir, "documents"))
    folded = found.withColumn("folded_root", let(F.struct("path", "presented"), lambda x: fold(x["path"], x["presented"])))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


#: The contract over recursive levels: crc32 by nibbles, nodes up, siblings per node, leaves folded up.
OP11_SQL = r"""
WITH RECURSIVE
nib AS (SELECT list_transform(range(16), lambda x: list_reduce([x, 0, 0, 0, 0], lambda c, s: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
enc AS (SELECT doc_id, lang, text, concat(
          coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
          coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS pre,
          coalesce(strlen(text) || ':' || text, '-') AS own,
          coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
          xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4,
                   t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1])), 4294967295) AS crc
        FROM documents, nib),
leaf AS (SELECT doc_id, lang, sha256(pre || own) AS h, sha256(pre || CASE WHEN crc % 3 = 0 THEN low ELSE own END) AS shown FROM enc),
pos AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf),
up AS (SELECT g, 0 AS lvl, n, i, h FROM pos
       UNION ALL
       SELECT g, lvl + 1, (n + 7) // 8, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, lvl, n, i // 8),
sub AS (SELECT g, h, lvl, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, n, i, h FROM sub
        UNION ALL
        SELECT lvl + 1, (n + 7) // 8, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, n, i // 8),
sib AS (SELECT g, lvl, i, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM up WHERE n > 1),
rsib AS (SELECT lvl, i, coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
         FROM top WHERE n > 1),
chain AS (SELECT g, lvl, i, l, r FROM sib
          UNION ALL SELECT sub.g, sub.lvl + t.lvl, 0, t.l, t.r FROM sub JOIN rsib t ON t.i = sub.i // (8 ** t.lvl)::BIGINT),
walk AS (SELECT g, 0 AS lvl, i, i AS leaf_i, shown AS h, '' AS p FROM pos
         UNION ALL
         SELECT w.g, w.lvl + 1, CASE WHEN w.lvl + 1 >= s.lvl THEN 0 ELSE w.i // 8 END, w.leaf_i, sha256(c.l || w.h || c.r), w.p || c.l || c.r
         FROM walk w JOIN chain c ON c.g = w.g AND c.lvl = w.lvl AND c.i = w.i JOIN sub s ON s.g = w.g),
done AS (SELECT g, leaf_i, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM walk GROUP BY g, leaf_i)
SELECT pos.doc_id, pos.h AS leaf, sub.h AS subroot, r.h AS root, sha256(done.p) AS proof_sha256, done.h AS folded_root,
       done.h = r.h AS verified
FROM pos JOIN sub USING (g) JOIN done ON done.g = pos.g AND done.leaf_i = pos.i CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""
