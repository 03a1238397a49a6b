"""Shape of the executed plan of registered queries: scans, exchanges, reuse, joins.

    python tools/plan_shape.py /root/testdata/sf0.01 name ...
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

PATTERNS = {
    "scans": r"(?<!\w)FileScan|Scan parquet", "exchanges": r"[\- ]Exchange (hash|range|round|Single|REPARTITION)", "reused": r"ReusedExchange", "single": r"Exchange SinglePartition",
    "broadcast_joins": r"BroadcastHashJoin", "sort_merge": r"SortMergeJoin", "shuffled_hash": r"ShuffledHashJoin", "nested_loop": r"BroadcastNestedLoopJoin", "cartesian": r"CartesianProduct",
    "windows": r"[\- ]Window ", "group_limit": r"WindowGroupLimit", "python": r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas",
}


def main() -> None:
    from windrow import catalog
    from windrow.session import local_session

    catalog.load()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    for name in sys.argv[2:] or sorted(catalog.QUERIES):
        df = catalog.QUERIES[name](spark, sys.argv[1])
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        final = text.split("+- == Initial Plan ==")[0]
        print(name, {k: len(re.findall(p, final)) for k, p in PATTERNS.items()})


if __name__ == "__main__":
    main()
