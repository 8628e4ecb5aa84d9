"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the smallest id reachable.

    Each round takes the least label of the neighbours and then the label's own label, so long
    chains shrink by powers; rounds are staged in the folder. Repeated and reversed links count once, an id linked with itself alone
    has no row, a link with a null is none, and an empty table gives no rows.
    """
    # hints keep growing tables off the driver: below the limit in bytes a table of links would be broadcast
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(links.where("a <> b").select(F.explode(ways).alias("x")).select("x.*").distinct(), folder, "links")
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), folder, "labels0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("id").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.hint("merge"), labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("further"))
        new = staged(lower.join(jump.hint("merge"), "to").select("id", "old", F.least("to", "further").alias("label")), folder, f"labels{k}")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
