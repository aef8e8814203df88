"""Size limits that decide between a broadcast and a shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000     # rows of a small numeric table, about 64 MB
MATRIX_VALUES = 32_000_000     # doubles of a matrix sent to every executor, 256 MB
DENSE_WIDTH = 4_096            # widest design matrix solved by m x m systems


def broadcast_if_small(df: DataFrame, n_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast when a known row count allows it, else join by sorting both sides.

    Without the hint Spark could still broadcast the large table, as it
    underestimates tables that grow by an explode.
    """
    return F.broadcast(df) if n_rows <= limit else df.hint("merge")
