"""Connected components of a large graph by least labels and pointer jumping, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for every node of the links (a, b). Nulls are left out.

    Every round takes the least label among the neighbours, then the label of the label; rounds grow with the logarithm of
    a component's diameter in practice. Each round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = saved(both, "components-links")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "components-0")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        nearer = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "m").alias("new"))
        of = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        jumped = nearer.join(of, nearer["new"] == of["_n"], "left").select("node", "comp", F.least("new", "_c").alias("new"))
        jumped = saved(jumped, "components")
        labels = jumped.select("node", F.col("new").alias("comp"))
        if jumped.filter("new < comp").isEmpty():
            return labels
