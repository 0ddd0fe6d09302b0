"""Connected components over a table of edges.

Each round takes the smallest label among the neighbours and then follows the
label's own label (pointer jumping), so long chains shrink by halves. Rounds
are written to the shared folder; only the number of changed rows comes to the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stash, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that can be reached. edges: u, v."""
    both = stash(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    now = stash(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        low = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = now.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        new = stash(low.join(up, "mid").select("node", F.least("mid", "top").alias("label"), (F.least("mid", "top") != F.col("old")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop_stash(now)
        now = new
        if not moved:
            return now.select("node", "label")
