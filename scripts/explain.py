"""Print the physical plan of registered queries and a one-line summary.

Usage: python scripts/explain.py [sf_dir] name [name ...] [--formatted]
Summary: exchanges, join strategies, windows, scans, and whether filters/columns
reach the parquet scans.
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(plan: str) -> str:
    def n(pat):
        return len(re.findall(pat, plan))
    return (f"exchanges={n(r'Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning')} "
            f"broadcasts={n(r'BroadcastExchange')} BHJ={n(r'BroadcastHashJoin')} SMJ={n(r'SortMergeJoin')} "
            f"SHJ={n(r'ShuffledHashJoin')} BNLJ={n(r'BroadcastNestedLoopJoin')} cartesian={n(r'CartesianProduct')} "
            f"windows={n(r'Window ')} groupLimit={n(r'WindowGroupLimit')} scans={n(r'Scan parquet')} "
            f"pushed={n(r'PushedFilters: \[[^\]]')}")


def main():
    args = [a for a in sys.argv[1:] if a != "--formatted"]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    from seqdrift.catalog import QUERIES
    from seqdrift.config import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    for name in names:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {name}: {summary(plan)}")
        if "--formatted" in sys.argv:
            df.explain("formatted")


if __name__ == "__main__":
    main()
