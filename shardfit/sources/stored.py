"""Readers of rows saved by this library, and the one-file / two-file choice."""

from pyspark.sql import DataFrame, SparkSession

from shardfit.operators.layout import split_train_test
from shardfit.operators.rows import as_rows, feature_count, is_sparse, sparse_rows, to_sparse
from shardfit.sources import text

TEXT_READERS = {
    "libsvm": text.read_libsvm,
    "spaces": text.read_spaces,
    "comma": text.read_comma,
}


def _train_and_test(read, path, train, test, test_fraction, seed):
    if train is not None and test is not None:
        return read(train), read(test)
    if path is None:
        raise ValueError("give either path, or both train and test")
    return split_train_test(read(path), test_fraction, seed)


def read_dataset(spark: SparkSession, fmt: str, path=None, train=None, test=None,
                 test_fraction: float = 0.2, seed: int = 3,
                 sparse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows from labelled text: one split file, or two files."""
    if fmt not in TEXT_READERS:
        raise ValueError(f"text format must be one of {sorted(TEXT_READERS)}, got {fmt!r}")
    if fmt == "libsvm":
        width = None
        if not sparse:
            # one width for both files, so that train and test have the same columns
            files = [train, test] if train is not None and test is not None else [path]
            width = text.libsvm_width(spark, *files)

        def read(p):
            return text.read_libsvm(spark, p, sparse=sparse, n_features=width)
    else:
        def read(p):
            rows = TEXT_READERS[fmt](spark, p)
            return to_sparse(rows) if sparse else rows
    return _train_and_test(read, path, train, test, test_fraction, seed)


def read_stored_rows(spark: SparkSession, path=None, train=None, test=None,
                     test_fraction: float = 0.2, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Train and test from saved parquet, in the form in which it was saved."""
    return _train_and_test(
        spark.read.parquet, path, train, test, test_fraction, seed
    )


def read_and_cast(spark: SparkSession, path=None, train=None, test=None,
                  test_fraction: float = 0.2, seed: int = 3,
                  sparse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test as labelled rows from any stored row form."""
    width = None
    paths = [train, test] if train is not None and test is not None else [path]
    if not sparse and paths != [None]:
        stored = [df for p in paths if is_sparse(df := spark.read.parquet(p))]
        # one width for both sets, so that train and test have the same columns
        width = max((feature_count(df) for df in stored), default=None)

    def read(p):
        df = spark.read.parquet(p)
        return sparse_rows(df) if sparse else as_rows(df, n_features=width)
    return _train_and_test(read, path, train, test, test_fraction, seed)
