"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import released, small, stored


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root) for every id in links (x, y): root is the smallest id that can be reached. Loops and repeated links do no harm.

    Each round gives every id the least label among its neighbours and itself and then the label of that label, so long chains
    shrink by halves. Labels stay distributed; what a round learns is written to the shared folder. It ends when the two labels of
    every link are equal: a smallest id keeps itself as its label, so all others of its component have it too.
    """
    both = links.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("l")).select("l.*").where("x <> y")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("near")).select(F.col("x").alias("id"), F.least("x", "near").alias("root")))
    near_to = small(labels.count())

    def further(table: DataFrame) -> DataFrame:
        """(id, root) after the label of each label."""
        jump = near_to(labels.select(F.col("id").alias("at"), F.col("root").alias("further")))
        return table.join(jump, table["root"] == jump["at"]).select("id", F.least("root", "further").alias("root"))

    for k in range(max_rounds):
        if k:
            near = both.join(near_to(labels), both["y"] == labels["id"]).groupBy("x").agg(F.min("root").alias("near"))
            pulled = near.join(near_to(labels), labels["id"] == near["x"])
            after = stored(further(pulled.select("id", F.least("root", "near").alias("root"))))
        else:
            after = stored(further(labels))
        released(labels)
        labels = after
        x, y = (near_to(labels.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))) for c in "xy")
        if links.where("x <> y").join(x, "x").join(y, "y").where("x_root <> y_root").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
