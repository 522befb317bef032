"""Shards of nearly equal bytes: a minimax contiguous partition of ordered, atomic groups.

Rows with equal texts are one group, which is never torn apart; groups stand in the order of their
digests. The smallest capacity for which greedy filling needs no more than the wanted shards is found
by binary search. The driver sees no groups for it, only a bounded summary, bytes by digest prefix:
a check on the summary has a careful and a hopeful answer (a cut inside a prefix lies at its start, or
anywhere), and prefixes over which the answers differ are summed again by longer prefixes until they agree.
The cuts are prefixes, so a row's shard is a comparison with its own digest: no join, however large a group is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from seqdrift.config import materialize
from seqdrift.operators.ranges import range_index

from .common import read

SHARDS = 16
#: Hex digits of the first summary (at most 16 ** FIRST rows on the driver) and of each refinement.
FIRST, FINER = 4, 2

#: Sorts behind every digest.
END = "~"


@dataclass
class Cells:
    """Bytes of the groups by digest prefix, in digest order; single: the cell is one group."""

    prefix: list[str]
    size: list[int]
    single: list[bool]

    def __post_init__(self):
        self.edge = [0, *accumulate(self.size)]

    @property
    def total(self) -> int:
        return self.edge[-1]

    def fill(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, list[int]]:
        """Whether greedy filling reaches the end, and the cells of several groups that it had to cut."""
        at, open_cells = 0, []
        for _ in range(shards):
            if at + capacity >= self.total:
                return True, open_cells
            cell = bisect_right(self.edge, at + capacity) - 1
            inside = self.edge[cell] < at + capacity and not self.single[cell]
            if inside:
                open_cells.append(cell)
            at = at + capacity if inside and hopeful else self.edge[cell]
        return at >= self.total, open_cells

    def least(self, shards: int, low: int, hopeful: bool) -> int:
        """The smallest capacity of at least ``low`` that is enough."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, hopeful)[0]:
                high = mid
            else:
                low = mid + 1
        return low

    def undecided(self, low: int, high: int, shards: int) -> list[str]:
        """Prefixes to sum more finely while the capacity is only known to be in [low, high]."""
        found = set()
        for part in range(5):
            for hopeful in (False, True):
                found.update(self.fill(low + (high - low) * part // 4, shards, hopeful)[1])
        return [self.prefix[c] for c in sorted(found)]

    def finer(self, parents: list[str], rows: list[tuple[str, int, int]]) -> Cells:
        gone = set(parents)
        cells = [c for c in zip(self.prefix, self.size, self.single) if c[0] not in gone]
        return Cells(*map(list, zip(*sorted(cells + [(p, s, n == 1) for p, s, n in rows]))))

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """First prefixes of shards 1, 2, …, no shard beyond the capacity and all as equal as may be.

        Cells that are larger than an equal share count as shards of their own; the others share the
        remaining shards equally. While there are cells enough, no shard is empty.
        """
        need = [self.total]
        for _ in range(shards - 1):
            need.append(self.edge[bisect_left(self.edge, need[-1] - capacity)] if need[-1] > capacity else 0)
        large, share = [], self.total / shards
        while len(now := [s for s in self.size if s > share]) > len(large) and len(now) < shards:
            large, share = now, (self.total - sum(now)) / (shards - len(now))
        # bytes and number of the large cells from each cell on
        least = min(large, default=self.total + 1)
        ahead = list(accumulate([s if s >= least else 0 for s in reversed(self.size)], initial=0))[::-1]
        count = list(accumulate([int(s >= least) for s in reversed(self.size)], initial=0))[::-1]
        at, out, n = 0, [], len(self.size)
        for left in range(shards, 1, -1):
            here = bisect_left(self.edge, at)
            goal = at + (self.total - at - ahead[here]) / max(1, left - count[here])
            after = bisect_right(self.edge, goal)
            best = min(range(max(0, after - 1), min(n, after) + 1), key=lambda j: abs(self.edge[j] - goal))
            best = max(min(max(best, here + 1), n - left + 1), bisect_left(self.edge, need[left - 1]), here)
            best = min(best, bisect_right(self.edge, at + capacity) - 1)
            at = self.edge[best]
            out.append(self.prefix[best] if best < n else END)
        return out


@dataclass
class ShardPlan:
    """The smallest possible largest shard in bytes and the digests at which shards begin."""

    capacity: int
    cuts: list[str]

    def shard(self, digest: Column) -> Column:
        out = F.lit(0)
        for cut in self.cuts:
            out = out + (digest >= cut).cast("int")
        return out


def digest_of(text: Column) -> Column:
    """Equal texts have equal digests; a null text counts as the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def size_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint") + 1


def plan_shards(rows: DataFrame, shards: int = SHARDS) -> ShardPlan:
    """The plan for ``rows`` (digest, size); rows of one digest stay together.

    The capacity is the exact optimum for groups in digest order: no contiguous partition has a smaller
    largest shard. An empty table gives a plan of capacity 0; with fewer groups than shards the last
    shards stay empty.
    """
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")

    def summary(table: DataFrame, width: int) -> list[tuple[str, int, int]]:
        per = table.groupBy(F.substring("digest", 1, width).alias("p")).agg(F.sum("size"), F.count(F.lit(1)))
        return sorted(tuple(r) for r in per.collect())

    first = summary(groups, FIRST)
    if not first:
        return ShardPlan(0, [END] * (shards - 1))
    cells = Cells([p for p, _, _ in first], [s for _, s, _ in first], [n == 1 for _, _, n in first])
    low = max(-(-cells.total // shards), groups.agg(F.max("size")).first()[0])
    while True:
        low, high = cells.least(shards, low, True), cells.least(shards, low, False)
        if low == high:
            return ShardPlan(high, cells.cuts(high, shards))
        parents = cells.undecided(low, high, shards)
        more = []
        for width in sorted({len(p) for p in parents}):
            part = F.substring("digest", 1, width).isin([p for p in parents if len(p) == width])
            more += summary(groups.where(part), width + FINER)
        cells = cells.finer(parents, more)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text).

    size: bytes of the text plus 1; rows of equal texts share a shard (null and empty texts are equal);
    slot: place in the shard by digest, then doc_id (nulls first), 0, 1, … without gaps. Repeated rows
    have neighbouring slots. Other columns are not read. Empty input gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                                   digest_of(F.col("text")).alias("digest")), "shard-rows")
    dealt = rows.withColumn("shard", plan_shards(rows, shards).shard(F.col("digest")))
    placed = range_index(dealt, ["shard", "digest", "doc_id"], ["shard"], "slot", name="shard-order")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> ShardPlan:
    """Write all columns of ``docs`` under ``path``, one folder ``shard=<n>`` a shard, in slot order.

    A column of ``docs`` called ``shard`` is replaced.
    """
    text = F.col("text")
    plan = plan_shards(docs.select(digest_of(text).alias("digest"), size_of(text).alias("size")), shards)
    order = [F.col("shard"), digest_of(text), F.col("doc_id")]
    docs.withColumn("shard", plan.shard(digest_of(text))).repartitionByRange(*order).sortWithinPartitions(*order) \
        .write.partitionBy("shard").parquet(path)
    return plan


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    rows = shard_documents(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
