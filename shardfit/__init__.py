"""shardfit: L2-penalised linear models on Spark tables, fitted block by block.

Kernels that run inside tasks are pickled by value, so executors need numpy and
pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
