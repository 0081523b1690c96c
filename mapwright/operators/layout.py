"""Page layout: columns, running heads and feet, reading order.

Roles and reading order are windows over blocks dealt by document once; what groups
by page or signature within the document moves nothing more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.functions import text as T

GAP = 100.0


def _starts(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Distinct rounded left edges of each page with the gap to the edge before."""
    edges = blocks.select(*page, F.bround("x0").alias("x")).distinct()
    return edges.withColumn("before", F.lag("x").over(W.partitionBy(*page).orderBy("x")))


def detect_layout(blocks: DataFrame, page: list[str], gap: float = GAP, least_width: float = 150.0) -> DataFrame:
    """(page, layout): single_column, dual_column or table."""
    clusters = _starts(blocks, page).groupBy(*page).agg((1 + F.count_if(F.col("x") - F.col("before") >= gap)).alias("clusters"))
    width = blocks.groupBy(*page).agg(F.avg(F.col("x1") - F.col("x0")).alias("width"))
    layout = F.when(F.col("clusters") == 1, "single_column").when(F.col("clusters") > 2, "table").when(F.col("width") < least_width, "table").otherwise("dual_column")
    return clusters.join(width, page).select(*page, layout.alias("layout"))


def order_by_columns(blocks: DataFrame, doc: str, page: str, pos: str = "pos", gap: float = GAP) -> DataFrame:
    """Adds ``place``: reading order in the document; left column first where a page has a gap."""
    of_page = W.partitionBy(doc, page)
    every = of_page.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    frame = blocks.repartition(doc).withColumn("_x", F.bround("x0"))
    # Edges repeat here: a repeat lies 0 from the one before, only the first of its kind has a gap.
    frame = frame.withColumn("_before", F.lag("_x").over(of_page.orderBy("_x")))
    apart = (F.col("_x") > F.col("_before")) & (F.col("_x") - F.col("_before") >= gap) & F.col(doc).isNotNull() & F.col(page).isNotNull()
    frame = frame.withColumn("_split", F.min_by((F.col("_before") + F.col("_x")) / 2, F.when(apart, F.col("_x"))).over(every))
    sided = frame.withColumn("_side", F.coalesce((F.col("x0") >= F.col("_split")).cast("int"), F.lit(0)))
    return sided.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy(page, "_side", "y0", pos))).drop("_x", "_before", "_split", "_side")


def classify_by_margin(y0, page_height, margin: float = 70.0):
    """header, footer or body by distance from the page's edges."""
    return F.when(y0 < margin, "header").when(y0 > page_height - margin, "footer").otherwise("body")


def classify_blocks(blocks: DataFrame, doc: str, page: str, pos: str = "pos", text: str = "text") -> DataFrame:
    """Adds ``role``: text that recurs on pages at one height, then blocks set apart by a gap."""
    of_page = W.partitionBy(doc, page)
    frame = blocks.where(F.col(doc).isNotNull()).repartition(doc)
    frame = frame.withColumn("_sig", F.struct(T.comparable(F.col(text)).alias("t"), F.bround(F.col("y0") / 20.0).alias("y")))
    frame = frame.withColumn("_mid", (F.min("y0").over(of_page) + F.max("y0").over(of_page)) / 2)
    alike = W.partitionBy(doc, "_sig")
    recurs = F.min(page).over(alike) < F.max(page).over(alike)
    edge = F.min_by(F.when(F.col("y0") < F.col("_mid"), "header").otherwise("footer"), pos).over(alike)
    frame = frame.withColumn("role", F.when(recurs, edge).otherwise("body")).drop("_sig", "_mid")
    order = of_page.orderBy("y0", pos)
    every = of_page.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    body = F.col("role") == "body"
    frame = frame.withColumn("_n", F.count("*").over(every)).withColumn("_i", F.row_number().over(order) - 1).withColumn("_n_body", F.count_if(body).over(every))
    # Spacing between successive body blocks; the upper median of a page's spacings sets its gap.
    last_body = F.last(F.when(body, F.col("y0")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    frame = frame.withColumn("_space", F.when(body, F.col("y0") - last_body))
    spaces = F.array_sort(F.collect_list("_space").over(every))
    frame = frame.withColumn("_median", F.get(spaces, F.floor(F.size(spaces) / 2).cast("int")))
    frame = frame.withColumn("_gap", F.greatest(4 * F.col("_median"), F.lit(50.0))).withColumn("_able", F.col("_n_body") >= 2)
    frame = frame.withColumn("_up", F.col("y0") - F.lag("y0").over(order)).withColumn("_down", F.lead("y0").over(order) - F.col("y0"))
    # From below: the last body block with a gap above it.
    foot = F.max(F.when(F.col("_able") & body & (F.col("_i") > 0) & (F.col("_up") >= F.col("_gap")), F.col("_i"))).over(every)
    frame = frame.withColumn("_foot", foot)
    frame = frame.withColumn("role", F.when(body & (F.col("_n") - F.col("_foot") < F.col("_foot")) & (F.col("_i") >= F.col("_foot")), "footer").otherwise(F.col("role")))
    # From above, with the roles as they are now.
    head = F.min(F.when(F.col("_able") & (F.col("role") == "body") & (F.col("_i") < F.col("_n") - 1) & (F.col("_down") >= F.col("_gap")), F.col("_i"))).over(every)
    frame = frame.withColumn("_head", head)
    above = F.col("_head") + 1
    frame = frame.withColumn("role", F.when((F.col("role") == "body") & (above < F.col("_n") - above) & (F.col("_i") <= F.col("_head")), "header").otherwise(F.col("role")))
    return frame.select(*blocks.columns, "role")
