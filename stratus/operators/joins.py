"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound for an explicit broadcast. Anything larger falls back to the
# shuffle (sort-merge) join that Catalyst/AQE pick on their own.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of ``df`` (after pruning and filters)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        # py4j hands a Scala BigInt over as a Python int, or as an object.
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - e.g. Spark Connect sessions
        return None


def decoded_row_bytes(df: DataFrame) -> int:
    """A generous width of one decoded row: fixed types by size, text as 64
    characters, nested values as 256 bytes."""
    fixed = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "float": 4, "double": 8,
             "long": 8, "timestamp": 8, "decimal": 16, "string": 64}
    return 16 + sum(fixed.get(f.dataType.typeName(), 256) for f in df.schema.fields)


def sized_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES,
                    rows_of: DataFrame | None = None) -> DataFrame:
    """Mark ``df`` for broadcast when it is known to be small.

    ``rows_of`` names the input that bounds the number of ``df``'s rows (a
    many-to-one join onto small dimensions keeps the row count of its fact
    side); its rows are counted, for a table of files from the footers, and
    multiplied by the width of a decoded row of ``df``. Without it the
    optimizer's estimate of ``df`` is used. When the size is unknown or too
    big the frame is returned unchanged, leaving the join to a shuffle join
    (with AQE able to switch at runtime).
    """
    size = rows_of.count() * decoded_row_bytes(df) if rows_of is not None else estimated_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df
