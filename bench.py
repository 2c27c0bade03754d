"""Time the headline queries: best of three warm runs each into a no-op sink. Prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import time

from tidegate.plans import load_all
from tidegate.registry import QUERIES
from tidegate.session import local_session

HEADLINE = (
    "nexmark_q1 nexmark_q2 nexmark_q3 nexmark_q5 nexmark_q8 nexmark_q11 ad_click_join order_shipment pageview_counter "
    "join_ttl_latest join_interval join_stream_table join_nway_inner join_override win_tumbling_keyed win_session "
    "win_collect trig_any sql_group_count sql_join_left agg_descriptor agg_uniq agg_value_hist agg_matrix_margins "
    "sort_total sort_secondary sort_kth stat_conf_bounds stat_ewma stat_running_median stock_running_sum "
    "stock_window_count stock_pool stock_match spike_detect stop_detect markov_train fraud_score sentiment word_count "
    "word_hist grep db_pageview latency_fill map_field_select"
).split()


def timed(query, spark, sf_dir: str, runs: int = 3) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return min(times[1:])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    load_all()
    queries = {name: round(timed(QUERIES[name], spark, sf_dir), 4) for name in HEADLINE}
    total = round(sum(queries.values()), 4)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    lineitems = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": queries, "sf": sf,
             "lineitem_rows": lineitems, "cpus": cpus}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
