"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of input tables, BENCH_CPUS the local cores. Every query runs to the end
into a sink that discards rows; one small run of each Python and ML path warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from windowlark import catalog  # noqa: E402
from windowlark.learn import models  # noqa: E402
from windowlark.plans import views  # noqa: E402
from windowlark.session import get_spark  # noqa: E402

HEADLINE = [
    "scan_parquet", "count_by_key", "join_multikey", "rejoin_agg", "outer_annotate", "cross_noise", "partner_pairs",
    "knn_exact", "knn_labels", "label_agreement", "knn_classify", "mean_vector", "frequent_top_classes", "rank_predictions",
    "frame_vectors", "context_vectors", "noise_negatives", "adaptive_threshold", "representative_source", "training_v2",
    "restrict_labels", "training_v6", "training_v7", "relabel_v6", "row_id", "moving_avg3", "split_stratified",
    "average_precision", "macro_metrics", "freq_pairs", "standard_scale", "anova_f", "class_series", "neighbor_table",
    "dedupe_keys", "knn_probe", "slice_windows", "training_v1",
    "slice_windows_long", "pca_project", "freq_sets", "closeness_graph", "fit_labels", "boosted_splits", "knn_descent",
]


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def fits(spark, folder: str) -> dict[str, Callable[[], object]]:
    """The learners whose fit times the reference publishes, with a prediction pass each."""
    rows = views.table(spark, folder, "embeddings").withColumn("label", F.col("label").cast("string")).cache()
    rows.count()

    def run(train):
        return lambda: discard(models.predict(train(), rows, "embedding", "label"))

    return {
        "fit_logistic": run(lambda: models.train_logistic(rows, "embedding", "label", max_iter=100)),
        "fit_pca_logistic": run(lambda: models.train_logistic(rows, "embedding", "label", max_iter=100, components=32)),
        "fit_linear_svc": run(lambda: models.train_linear_svc(rows, "embedding", "label", max_iter=20, parallelism=8)),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    warm = str(Path(folder).parent / "sf0.001")
    warm = warm if os.path.isdir(warm) else folder
    for name in ("scan_parquet", "label_agreement", "training_v7"):
        discard(catalog.PLANS[name](spark, warm))
    jobs = {n: (lambda n=n: discard(catalog.PLANS[n](spark, folder))) for n in HEADLINE} | fits(spark, folder)
    times = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
