"""Values sent once to every executor, and small tables brought to the driver and back."""

import ctypes
import gc
import pickle
import sys
import uuid

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def to_driver(df: DataFrame) -> pd.DataFrame:
    """Collect a table whose size depends on the model and not on the rows."""
    return df.toArrow().to_pandas()


def from_driver(spark: SparkSession, frame: pd.DataFrame, schema: str) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pandas(frame, preserve_index=False), schema)


def per_process(key, make):
    """What `make` returns, made once by a worker process; the latest value alone is kept.

    Code of this package travels by value, so its own globals last for one task; a worker's
    interpreter lasts longer.
    """
    held = vars(sys).setdefault("_shardfit_held", {})
    if key not in held:
        held.clear()
        give_back()
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Return freed memory of this process to the system, since workers outlive their stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim:
        trim(0)


class Shared:
    """A broadcast value whose classes travel with it, so that tasks need no installed copy."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._key = uuid.uuid4().hex
        self._value = None

    def __getstate__(self):
        return {"_sent": self._sent, "_key": self._key, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = per_process(self._key, lambda: pickle.loads(self._sent.value))
        return self._value

    def release(self) -> None:
        self._sent.unpersist()
