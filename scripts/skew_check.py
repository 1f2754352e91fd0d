"""Show that rank_within spreads a hot group over many tasks.

Ranks lineitem rows inside l_returnflag (three values, each holding about
a third of the rows: every group is a hot group) with a plain window and
with rank_within, and reports the shuffle records read per task of each
job from Spark's event log.

usage: python scripts/skew_check.py [sf_dir] [slice_rows]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _lines(path: str):
    """Lines of a (rolling, possibly zstd-compressed) event log file."""
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as f:
            data = zstandard.ZstdDecompressor().stream_reader(f).read()
        yield from data.decode().splitlines()
    else:
        with open(path) as f:
            yield from f


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    slice_rows = int(sys.argv[2]) if len(sys.argv) > 2 else 20000
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from residua.operators.ranking import rank_within
    from residua.session import get_session
    logdir = tempfile.mkdtemp(prefix="residua-eventlog-")
    spark = get_session("local[8]", shuffle_partitions=16,
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir})
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    jobs = {
        "plain window": li.withColumn("pos", F.row_number().over(
            Window.partitionBy("l_returnflag").orderBy(*order))),
        "rank_within": rank_within(li, ["l_returnflag"], order, slice_rows=slice_rows),
    }
    for name, df in jobs.items():
        spark.sparkContext.setJobGroup(name, name)
        df.write.format("noop").mode("overwrite").save()
    spark.stop()
    per_job: dict[str, list[int]] = {}
    stage_job: dict[int, str] = {}
    for path in sorted(glob.glob(os.path.join(logdir, "**", "*"), recursive=True)):
        if os.path.isdir(path) or "appstatus" in os.path.basename(path):
            continue
        for line in _lines(path):
            if not line.strip():
                continue
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = group
            elif kind == "SparkListenerTaskEnd":
                m = ev.get("Task Metrics") or {}
                n = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                group = stage_job.get(ev.get("Stage ID"))
                if group and n:
                    per_job.setdefault(f"{group} / stage {ev['Stage ID']}", []).append(n)
    for key, counts in sorted(per_job.items()):
        counts.sort()
        total = sum(counts)
        print(f"{key:34s} tasks={len(counts):3d} rows={total:8d} max task={counts[-1]:7d} "
              f"({counts[-1] / total:5.1%})")


if __name__ == "__main__":
    main()
