"""From raw data to the stored forms that the fits read."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from shardfit.operators.layout import transpose
from shardfit.operators.rows import feature_count, is_sparse
from shardfit.operators.scaling import center_scale
from shardfit.sinks.tables import cast_and_save, save_cols, save_n_feats, save_response
from shardfit.sources.stored import read_and_cast, read_dataset


def preprocess(spark: SparkSession, out_train: str, out_test: str, data_format: str = "text",
               text_format: str = "spaces", path=None, train=None, test=None,
               test_fraction: float = 0.2, seed: int = 3, sparse: bool = False,
               features: tuple[bool, bool] = (True, True),
               response: tuple[bool, bool] = (False, False), fit_on: str = "train",
               row_class: str | None = None, third_class: str | None = None,
               mode: str = "errorifexists") -> tuple[DataFrame, DataFrame, int]:
    """Read, split, centre and scale; save column-wise data, responses and the width.

    ``row_class`` also saves the rows with the suffix ``-rowwise``, and
    ``third_class`` once more without it. Returns the train rows, the test rows
    and the number of features.
    """
    if sparse and any(features):
        raise ValueError("sparse rows cannot be centred or scaled by feature")
    where = dict(path=path, train=train, test=test, test_fraction=test_fraction, seed=seed,
                 sparse=sparse)
    if data_format == "text":
        sets = read_dataset(spark, text_format, **where)
    elif data_format == "object":
        sets = read_and_cast(spark, **where)
    else:
        raise ValueError(f"data format must be 'object' or 'text', got {data_format!r}")
    sets = center_scale(*sets, features=features, response=response, fit_on=fit_on)
    sets = [s.persist(StorageLevel.MEMORY_AND_DISK) for s in sets]
    try:
        n_features = max(feature_count(s) for s in sets)
        if row_class and row_class != "text":
            cast_and_save(*sets, row_class, f"{out_train}-rowwise", f"{out_test}-rowwise", mode)
        if third_class and third_class != "text":
            cast_and_save(*sets, third_class, out_train, out_test, mode)
        for rows, out in zip(sets, (out_train, out_test)):
            width = None if is_sparse(rows) else n_features
            save_cols(transpose(rows, width), f"{out}-colwise", mode)
            save_response(rows, f"{out}-response", mode)
        save_n_feats(spark, n_features, f"{out_train}-nFeats", mode)
    finally:
        for s in sets:
            s.unpersist()
    return sets[0], sets[1], n_features
