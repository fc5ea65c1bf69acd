"""Banded Hamming joins against nested loops on the same signatures: prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from auditloom.operators import similarity
from auditloom.plans.fixtures import signatures

LIMITS = (8, 14)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
    spark = builder.config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = signatures(spark, sf_dir).select("vec_id", "sig").repartition(int(cpus)).cache()
    line = {"signatures": rows.count(), "runs": []}
    for limit in LIMITS:
        for warm in (True, False):
            began = time.time()
            near = similarity.near_pairs(rows, rows, "vec_id", "sig", limit, self_join=True).count()
            banded = time.time() - began
            a, b = (rows.select(F.col("vec_id").alias(f"id_{s}"), F.col("sig").alias(f"s_{s}")) for s in "ab")
            began = time.time()
            plain = a.join(F.broadcast(b), (F.col("id_a") < F.col("id_b")) & (similarity.hamming(F.col("s_a"), F.col("s_b")) <= limit)).count()
            nested = time.time() - began
        assert near == plain
        candidates = similarity.near_candidates(rows, rows, "sig", limit).count()
        line["runs"].append({"limit": limit, "pairs": near, "banded_sec": round(banded, 2), "nested_sec": round(nested, 2), "candidates": candidates})
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
