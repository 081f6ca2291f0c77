"""Anchors of a page as a table function, to be joined laterally to the pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .html import read_links
from .urls import LEAST_PATH, likely_article


class PageLinks:
    """position, link (absolute) and title of every anchor of a page."""

    def eval(self, html: str, base: str) -> Iterator[tuple[int, str, str]]:
        for position, (link, title) in enumerate(read_links(html, base)):
            yield position, link, title


#: The table function: links_of(page, address).
links_of = F.udtf(PageLinks, returnType="position int, link string, title string")


def candidates(pages: DataFrame, *, most: int, least_path: int = LEAST_PATH) -> DataFrame:
    """The first ``most`` links of every page (page_id, html, url) that look like articles of its site, each address
    once, by position: page_id, position, link, title, error. A page without any has one row that says so."""
    table = pages.lateralJoin(links_of(F.col("html").outer(), F.col("url").outer()), how="left")
    likely = table.filter(likely_article(F.col("link"), F.col("url"), least_path))
    once = likely.groupBy("page_id", "link").agg(F.min("position").alias("position"), F.min_by("title", "position").alias("title"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
    first = once.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
    found = pages.select("page_id").join(first, "page_id", "left")
    return found.withColumn("error", F.when(F.col("link").isNull(), "no candidate links")).select("page_id", "position", "link", "title", "error")
