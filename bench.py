"""Runs the headline queries once warm and prints one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from meterlake.plans import coach_queries, more_queries, queries

QUERIES = queries.QUERIES | coach_queries.QUERIES | more_queries.QUERIES
HEADLINE = ["spend_hourly_by_model", "spend_summary", "workflow_summary", "workflow_steps", "agent_longest_run", "anomaly_rolling", "forecast_holt", "prompt_compress", "redact_text", "rule_duplicates", "reply_stats", "context_trim",
            "read_report", "weekly_timeline", "command_roi", "request_rewrite", "latency_percentiles"]


ORACLE_SQL = queries.ORACLE_SQL | coach_queries.ORACLE_SQL | more_queries.ORACLE_SQL


def by_duckdb(sf_dir: str, cpus: str) -> dict[str, float]:
    """Seconds that the same queries take in DuckDB on the same files, the second of two runs; those with SQL only."""
    import duckdb

    con = duckdb.connect(config={"threads": int(cpus)})
    for table in ("events", "documents", "conversations", "lineitem", "part", "supplier", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    took = {}
    for name in HEADLINE:
        if name in ORACLE_SQL:
            for _ in range(2):
                began = time.time()
                con.execute(ORACLE_SQL[name]).fetchall()
                took[name] = round(time.time() - began, 3)
    return took


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "duckdb": by_duckdb(sf_dir, cpus), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
