"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from vicinal.operators import AnnIndex
from vicinal.queries import base, first_vector, queries
from vicinal.sources import clear_scratch, scratch_path

NAMES = ("knn_l2", "knn_cosine", "knn_manhattan", "knn_full_order", "knn_join", "range_search", "knn_per_label", "distance_stats")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        run = queries()[name]
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    # the index: building it, one search, and a hundred searches at once, at default options
    df, q = base(spark, folder), first_vector(spark, folder)
    asked = df.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    index = None

    def build():
        nonlocal index
        index = AnnIndex.build(df, scratch_path(spark, "bench"), id_column="vec_id", column="embedding", dims=64)

    steps = {
        "ann_build": build,
        "ann_search": lambda: index.search(q, 10).write.format("noop").mode("overwrite").save(),
        "ann_search_batch": lambda: index.search(asked, 10).write.format("noop").mode("overwrite").save(),
    }
    for name, step in steps.items():
        times = []
        for _ in range(3):
            began = time.perf_counter()
            step()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total of the best of 3 runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
