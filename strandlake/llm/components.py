"""Connected components of a link table, by least labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each end of links (a, b): label is the least node of its component.

    A round gives each node the least label among its neighbours', then the label of that label. Labels only fall, and the
    rounds end when none does. A hub's many links are combined before the shuffle.
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    before = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("fresh"))
        jump = labels.select(F.col("node").alias("fresh"), F.col("label").alias("further"))
        following = written(met.join(jump, "fresh").select("node", F.least("fresh", "further").alias("label"), (F.least("fresh", "further") < F.col("label")).alias("fell")), "labels")
        forget(before)
        labels, before = following.select("node", "label"), following
        if not following.agg(F.max("fell")).first()[0]:
            forget(both)
            return labels
