"""Headline queries, timed one after another in one warm session; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans.catalog import QUERIES  # noqa: E402
from ledgerlens.session import get_session  # noqa: E402

HEADLINE = (
    "spec_top_countries kpi_snapshot kpi_last_90_days kpi_dashboard mom_growth revenue_by_day revenue_by_country "
    "region_month_matrix contribution_shares arg_max_dims box_stats histogram_20 drilldown_txn left_join_merge "
    "spend_tiers rfm clv clv_summary repeat_purchase_summary churn_scores health_scores segment_loyal cohort_table "
    "cohort_insights geography product_performance promo_impact promo_impact_derived affinity_rules affinity_summary "
    "daily_spine moving_avg decomposition_stats trend_runs zscore_anomalies ses_forecast linear_trend_forecast "
    "clean_amounts clean_dates deal_size profile_columns quality_score exploratory_top_values ingest_months "
    "question_entities question_routing jaccard_match qa_pairs run_history_last5 live_kpis kmeans_segments"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("ledgerlens-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["kpi_snapshot"](spark, folder).collect()  # start the JVM's warm-up outside the clock
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
