"""Connected components of an edge table of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` with another neighbour; component is the smallest node reachable."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
