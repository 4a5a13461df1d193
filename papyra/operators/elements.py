"""Elements of stored pages as intervals (E1): every element of a name with its start, end and nesting level.

The tags of a name are numbered along the page in one pass. A running sum gives each tag's depth, and an element's end is
the next tag of its own level, found by one ordered look ahead: the work is linear in the tags, whatever their nesting.
Two elements are nested exactly if their intervals are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def element_intervals(pages: DataFrame, tag: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pre, level, open_tag, start, inner, inner_end): one row per ``<tag>`` element.

    ``pre`` numbers the elements of a page in document order, ``level`` is 1 for those within no other of their name;
    ``start``, ``inner`` and ``inner_end`` are character positions from 0 of the opening tag, of the content and of the
    closing tag (the end of the page if there is none). A closing tag without an element is left out. Only the tags are
    shuffled, by page; ``key`` must be unique.
    """
    pieces = pages.select(key, F.posexplode(F.split(html, f"(?i)(?=<{tag}\\b|</{tag}\\b)")).alias("at", "piece"))
    head = F.regexp_extract("piece", f"(?is)^</?{tag}\\b[^>]*>?", 0)
    tags = pieces.select(key, "at", F.length("piece").alias("size"), head.alias("tag"))
    in_order = Window.partitionBy(key).orderBy("at")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("tag").rlike("^<[^/]")
    step = F.when(opens, 1).when(F.startswith("tag", F.lit("</")), -1).otherwise(0)
    tags = tags.select(key, "at", "tag", opens.alias("opens"), step.alias("step"),
                       F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("start"),
                       F.sum("size").over(Window.partitionBy(key)).cast("int").alias("total"))
    tags = tags.withColumn("sum", F.sum("step").over(in_order))
    # the depth never falls below 0: a closing tag that would take it there closes nothing
    least = F.least(F.lit(0), F.coalesce(F.min("sum").over(before), F.lit(0)))
    tags = tags.withColumn("least", least).where((F.col("step") != 0) & ~((F.col("step") == -1) & (F.col("sum") < F.col("least"))))
    level = F.col("sum") - F.col("least") + F.when(F.col("opens"), 0).otherwise(1)
    tags = tags.withColumn("level", level.cast("int"))
    same = Window.partitionBy(key, "level").orderBy("at")
    found = tags.withColumn("inner_end", F.coalesce(F.lead("start").over(same), F.col("total"))).where("opens")
    return found.select(key, (F.row_number().over(in_order) - 1).cast("bigint").alias("pre"), "level",
                        F.col("tag").alias("open_tag"), "start", (F.col("start") + F.length("tag")).alias("inner"), "inner_end")
