"""Pages to readable content. All map-side: one pass over the HTML, no shuffle but for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions import html_blocks, pages, text


def with_root(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``root``: the content root of the page without noise elements."""
    cleaned = df.withColumn("__clean", pages.strip_noise(html))
    staged = cleaned.withColumn("__simple", pages.simple_content_root("__clean")).withColumn(
        "__nested",
        html_blocks.nested_root(F.when(pages.needs_nested_root("__clean"), F.col("__clean"))),
    )
    root = F.coalesce(F.col("__simple"), F.col("__nested"), pages.body_root("__clean"))
    return staged.withColumn("root", root).drop("__clean", "__simple", "__nested")


def read_pages(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """url, title, author, description, content, links, images, metadata and token cost of pages
    whose status is 200 (or unknown). Links and images are those that stand in the content: a link inside a heading
    or a table is text there and is not listed."""
    if "status" in df.columns:
        df = df.filter(F.col("status") == 200)
    staged = (
        with_root(df)
        .withColumn("head", pages.page_head("html"))
        .withColumn("blocks", html_blocks.markdown_blocks("root"))
        .withColumn("pictured", html_blocks.markdown_images("blocks"))
        .withColumn("full", html_blocks.markdown_text("pictured"))
        .withColumn("shell", pages.is_spa_shell("html", "root"))
    )
    content = F.substring("full", 1, max_chars) if max_chars else F.col("full")
    return staged.withColumn("content", content).select(
        *[c for c in ("page_id",) if c in df.columns],
        "url",
        F.coalesce(F.nullif("head.og_title", F.lit("")), F.nullif("head.title", F.lit(""))).alias("title"),
        F.nullif("head.author", F.lit("")).alias("author"),
        F.nullif("head.og_description", F.lit("")).alias("description"),
        "content",
        pages.page_links("pictured").alias("links"),
        pages.page_images("blocks").alias("images"),
        F.coalesce(F.nullif("head.og_type", F.lit("")), F.lit("unknown")).alias("type"),
        F.nullif("head.published_time", F.lit("")).alias("published_at"),
        F.when(F.col("shell"), "spa-shell")
        .when(F.col("full") == "", "og-tags-only")
        .otherwise("readability").alias("source"),
        F.nullif("head.canonical", F.lit("")).alias("canonical"),
        F.nullif("head.og_site_name", F.lit("")).alias("site_name"),
        text.token_cost("content").alias("tokens"),
        text.token_cost("html").alias("html_tokens"),
    )


def savings_by_source(reads: DataFrame) -> DataFrame:
    """Tokens of the content against tokens of the raw HTML, per source."""
    sums = reads.groupBy("source").agg(
        F.count("*").alias("pages"),
        F.sum("tokens").alias("read_tokens"),
        F.sum("html_tokens").alias("html_tokens"),
    )
    saved = F.lit(1.0) - F.col("read_tokens") / F.col("html_tokens")
    return sums.withColumn(
        "savings_pct",
        F.when(F.col("html_tokens") > 0, F.floor(saved * 1000 + 0.5) / F.lit(10.0)).otherwise(0.0),
    )
