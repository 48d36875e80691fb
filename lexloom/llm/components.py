"""Connected components by least labels and pointer jumping, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import write_and_read


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``label``: the least node of each component, for every node of an edge.

    A node takes the least label among its own and its neighbours', then the label of
    that label; labels halve their distance to the least node at least, so the rounds
    grow with the logarithm of a component's breadth.  Only one number a round, the
    count of changed labels, comes to the driver.
    """
    both = edges.select(F.col(left).alias("__from"), F.col(right).alias("__to"))
    both = both.union(both.select("__to", "__from")).filter("__from <> __to").distinct()
    both = write_and_read(both, "links")
    labels = both.groupBy("__from").agg(F.least(F.min("__to"), F.col("__from")).alias("label"))
    labels = write_and_read(labels.withColumnRenamed("__from", "node"), "labels")
    while True:
        near = both.join(labels, F.col("__to") == F.col("node")).groupBy("__from").agg(F.min("label").alias("__near"))
        step = labels.join(near, F.col("node") == F.col("__from")).select(
            "node", F.col("label").alias("__old"), F.least("label", "__near").alias("label")
        )
        up = labels.select(F.col("node").alias("__up"), F.col("label").alias("__up_label"))
        jumped = step.join(up, F.col("label") == F.col("__up")).select(
            "node", "__old", F.least("label", "__up_label").alias("label")
        )
        stored = write_and_read(jumped, "labels")
        labels = stored.select("node", "label")
        if stored.filter("label <> __old").isEmpty():
            return labels
