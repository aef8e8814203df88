"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from shardfit.catalog import fixtures  # noqa: E402
from shardfit.operators import layout as L  # noqa: E402
from shardfit.operators.design import block_design  # noqa: E402
from shardfit.operators.metrics import predict  # noqa: E402
from shardfit.operators.scaling import center_scale  # noqa: E402
from shardfit.plans.crossval import cv_summary, global_cv, lambda_grid, local_cv  # noqa: E402
from shardfit.plans.model import fit_model, model_layout  # noqa: E402


CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def scale_lineitem(spark, d):
    drain(center_scale(fixtures.lineitem_rows(spark, d, CPUS)))


def project_leave_one_out(spark, d):
    rows = fixtures.embedding_rows(spark, d)
    layout, _ = model_layout(rows, 4, 8, "sparse", "add", "range")
    drain(block_design(rows, layout))


def ridge_blocks(spark, d):
    drain(fit_model(fixtures.embedding_rows(spark, d), 4, 8, lam=0.1))


def ridge_cv(spark, d):
    drain(cv_summary(global_cv(fixtures.embedding_rows(spark, d), lambda_grid(spark), 5,
                               n_blocks=4, q=8)))


def ridge_local_cv(spark, d):
    rows = fixtures.embedding_rows(spark, d)
    layout, _ = model_layout(rows, 4, 8)
    drain(local_cv(rows, layout, lambda_grid(spark), 5))


def ridge_tall(spark, d):
    rows = center_scale(fixtures.lineitem_rows(spark, d, CPUS), response=(True, True))
    drain(fit_model(rows, 4, 1, lam=0.1, n_features=8))


def transpose_lineitem(spark, d):
    drain(L.transpose(fixtures.lineitem_rows(spark, d, CPUS), 8))


def ranked_folds_lineitem(spark, d):
    drain(L.assign_folds(fixtures.lineitem_rows(spark, d, CPUS).select("row_id"), 5, mode="rank"))


def ridge_documents(spark, d):
    drain(fit_model(fixtures.document_rows(spark, d, CPUS), 8, 16, lam=0.5, n_features=1024))


def svm_blocks(spark, d):
    drain(fit_model(fixtures.embedding_classes(spark, d), 4, 8, "hinge", 0.1))


def logistic_blocks(spark, d):
    drain(fit_model(fixtures.embedding_classes(spark, d), 4, 8, "logistic", 0.1))


def logistic_tall(spark, d):
    rows = center_scale(fixtures.lineitem_rows(spark, d, CPUS))
    label = F.when(F.col("y") > 50000, 1.0).otherwise(-1.0)
    drain(fit_model(rows.withColumn("y", label), 4, 1, "logistic", 0.1,
                    n_features=8))


def scale_wide(spark, d):
    """20 480 dense features."""
    rows = fixtures.embedding_rows(spark, d).repartition(CPUS)
    wide = F.flatten(F.array_repeat("features", 320))
    drain(center_scale(rows.withColumn("features", wide)))


def predict_wide_sparse(spark, d):
    """65 536 hashed words of all documents."""
    p = 1 << 16
    rows = fixtures.document_rows(spark, d, CPUS, labelled=False, n_columns=p)
    drain(predict(rows, fixtures.fixed_beta(spark, p), p))


QUERIES = [scale_lineitem, project_leave_one_out, ridge_blocks, ridge_cv, ridge_local_cv,
           ridge_tall, transpose_lineitem, ranked_folds_lineitem, ridge_documents, svm_blocks,
           logistic_blocks, logistic_tall, scale_wide, predict_wide_sparse]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    spark.range(1000).repartition(CPUS).mapInArrow(lambda b: b, "id bigint").count()
    times = {}
    for query in QUERIES:
        start = time.perf_counter()
        query(spark, sf_dir)
        times[query.__name__] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
