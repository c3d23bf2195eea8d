"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]: one JSON line; seconds are the best of three after a warm-up."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quern.operators.queries import QUERIES  # noqa: E402
from quern.operators.validate import compile_schema  # noqa: E402

SCHEMA = '{"type":"object","required":["q","d"],"properties":{"q":{"type":"number","minimum":1,"maximum":50},"d":{"maximum":0.1},"f":{"enum":["A","N","R"]}}}'
ONE_OF = '{"oneOf":[{"properties":{"q":{"minimum":25}}},{"properties":{"d":{"minimum":0.05}}}]}'


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_json(F.struct(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("f"))).alias("doc")).repartition(int(cpus)).cache()
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_json(F.struct(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))).alias("doc")).repartition(int(cpus)).cache()
    rows = docs.count() + 0 * pairs.count()
    runs = {n: (lambda n=n: QUERIES[n](spark, sf_dir)) for n in ("conversation_valid", "properties", "one_of", "items_single", "unique_items", "const_object", "ref_recursive", "error_report", "schema_join")}
    runs["tier_native"] = lambda: compile_schema(SCHEMA, tier="native").over(docs, "doc", valid="valid").select("valid")
    runs["tier_arrow"] = lambda: docs.select(compile_schema(SCHEMA, tier="arrow").valid("doc"))
    runs["tier_native_one_of"] = lambda: compile_schema(ONE_OF, tier="native").over(pairs, "doc", valid="valid").select("valid")
    runs["column_native"] = lambda: docs.select(compile_schema(SCHEMA, tier="native").valid("doc"))
    runs["parse_only"] = lambda: docs.select(F.expr("try_parse_json(doc) IS NULL"))
    seconds = {}
    for name, run in runs.items():
        times = []
        for _ in range(4):
            t = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        seconds[name] = round(min(times[1:]), 4)
    rates = {f"{k}_rows_per_s": round(rows / seconds[k]) for k in ("tier_native", "tier_native_one_of", "column_native", "tier_arrow", "parse_only")}
    rates |= {f"{k}_per_core": round(v / int(cpus)) for k, v in rates.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rates": rates, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
