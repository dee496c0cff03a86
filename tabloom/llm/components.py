"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import packed, saved


def components(links: DataFrame) -> DataFrame:
    """(id, label): for every id in ``links`` (a, b; any types that compare) the least id it is joined to.

    Labels are written to the shared folder each round, so a round depends on files only; a round takes the least
    label of all neighbours and then the label's own label, so the rounds grow with the logarithm of a chain.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "cc-edges")
    n = both.count()
    first = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = saved(packed(first, n), "cc-labels")
    while True:
        near = packed(both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("_near")), n)
        stepped = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", F.least("label", F.coalesce("_near", "label")).alias("label"), F.col("label").alias("was")
        )
        stepped = saved(packed(stepped, n), "cc-step")
        root = stepped.select(F.col("id").alias("_id"), F.col("label").alias("_root"))
        new = stepped.join(root, stepped["label"] == root["_id"], "left").select(
            "id", F.least("label", F.coalesce("_root", "label")).alias("label"), "was"
        )
        new = saved(packed(new, n), "cc-labels")
        labels = new.select("id", "label")
        if new.where("label < was").isEmpty():
            return labels
