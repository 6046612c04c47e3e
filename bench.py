"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from foldtable.plans import registry

NAMES = [
    "set_stability_table", "nc_stability_table", "neutral_components", "site_versatility", "epistasis_fraction", "ddg_table",
    "percentile_by_role", "percentile_by_role_length", "structural_role", "model_parameters", "sample_per_group", "correlations",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
