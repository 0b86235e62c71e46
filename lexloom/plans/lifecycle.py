"""The whole way of a document: pages and templates in, cleaned node tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, templates, wikitext


def node_table(pages: DataFrame, template_table: DataFrame, site: templates.Site | None = None, cleaned: bool = True) -> DataFrame:
    """Nodes of (page_id, title, rawtext): expansion (unless ``expanded``), parsing and, if wanted, cleaning; one Python stage for each document."""
    site = site or templates.Site()
    if "expanded" in pages.columns:
        raw, done = pages.where(~F.coalesce("expanded", F.lit(False))), pages.where(F.coalesce("expanded", F.lit(False))).select(F.col("page_id").cast("string").alias("page_id"), "title", F.col("rawtext").alias("text"))
        texts = templates.expand_pages(raw, template_table, site).select("page_id", "title", "text").unionByName(done)
    else:
        texts = templates.expand_pages(pages, template_table, site).select("page_id", "title", "text")
    return wikitext.parse_pages(texts, "text", "page_id", site.lang, clean.clean if cleaned else None)
