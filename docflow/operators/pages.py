"""Pages of documents: listing, checks, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow import constants as C
from docflow.functions import geometry, markup
from docflow.functions.text import occurrences, or_default
from docflow.operators.ordering import PAGE_BLOCK, running_offset


def explode_pages(docs: DataFrame, page_count: str = "page_count") -> DataFrame:
    """One row per page, ``page_index`` from 0. Needs no shuffle."""
    last = F.col(page_count).cast("bigint") - 1
    # A document without pages is dropped first: the sequence 0 … -1 counts down.
    return docs.filter(F.col(page_count) > 0).withColumn(
        "page_index", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )


def count_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with the number of their rows in ``pages`` as ``page_count``."""
    counts = pages.groupBy("document_index").agg(F.count(F.lit(1)).alias("page_count"))
    return docs.drop("page_count").join(counts, "document_index", "left").withColumn(
        "page_count", F.coalesce("page_count", F.lit(0))
    )


def zero_page_docs(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents without any page, as failures."""
    return (
        count_pages(docs, pages)
        .filter(F.col("page_count") == 0)
        .withColumn("status", F.lit("failed"))
        .withColumn("error", F.lit(C.ZERO_PAGES_ERROR))
    )


def check_prompts(df: DataFrame, prompt: str = "prompt", default: str = C.DEFAULT_PROMPT) -> DataFrame:
    """Fill in the default prompt and check for exactly one image placeholder."""
    filled = or_default(F.col(prompt), default)
    return df.withColumn(prompt, filled).withColumn(
        "prompt_ok", occurrences(F.col(prompt), C.IMAGE_PLACEHOLDER) == 1
    )


def page_pixels(df: DataFrame, dpi: int = C.DEFAULT_DPI) -> DataFrame:
    """Pixel size of pages given in points (``width_pt``, ``height_pt``)."""
    return df.withColumn("width", geometry.page_pixels(F.col("width_pt"), dpi)).withColumn(
        "height", geometry.page_pixels(F.col("height_pt"), dpi)
    )


def plan_tiles(df: DataFrame, min_tiles: int = C.MIN_TILES, max_tiles: int = C.MAX_TILES) -> DataFrame:
    """Add ``tiles_w`` and ``tiles_h``."""
    plan = geometry.tile_plan(F.col("width"), F.col("height"), min_tiles, max_tiles)
    return df.withColumn("_plan", plan).select("*", "_plan.tiles_w", "_plan.tiles_h").drop("_plan")


def tiling_usage(planned: DataFrame) -> DataFrame:
    """Every candidate tiling with the number of pages that use it."""
    used = planned.groupBy("tiles_w", "tiles_h").agg(F.count(F.lit(1)).alias("pages"))
    tilings = [
        F.struct(F.lit(columns).alias("tiles_w"), F.lit(rows).alias("tiles_h"))
        for columns, rows in geometry.candidate_tilings()
    ]
    candidates = (
        planned.sparkSession.range(1).select(F.explode(F.array(*tilings)).alias("_t")).select("_t.*")
    )
    return candidates.join(used, ["tiles_w", "tiles_h"], "left").withColumn(
        "pages", F.coalesce("pages", F.lit(0))
    )


def plan_tokens(df: DataFrame, crop_mode: bool = True) -> DataFrame:
    """Add ``tiles_w``, ``tiles_h`` and ``image_tokens``."""
    return plan_tiles(df).withColumn(
        "image_tokens", geometry.image_tokens(F.col("tiles_w"), F.col("tiles_h"), crop_mode)
    )


def tile_boxes(df: DataFrame) -> DataFrame:
    """One row per tile of a page with its crop box; needs the tile plan."""
    boxes = geometry.tile_boxes(F.col("tiles_w"), F.col("tiles_h"))
    return df.withColumn("_box", F.explode(boxes)).select("*", "_box.*").drop("_box")


def over_budget(df: DataFrame, max_model_len: int = C.MAX_MODEL_LEN) -> DataFrame:
    """Pages whose prompt and output do not fit the model's context."""
    if max_model_len < 1:
        raise ValueError("max_model_len must be at least 1")
    return df.filter(F.col("input_tokens") + F.col("output_tokens") > max_model_len)


def flag_eos(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.withColumn("has_eos", markup.has_eos(F.col(text)))


def drop_unfinished(df: DataFrame) -> DataFrame:
    """Keep pages whose output ended by itself; the rest ran away repeating."""
    return df.filter("has_eos")


def number_kept_pages(df: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """Dense ``kept_index`` over the remaining pages of each document.

    Also adds ``part_index``, the page block; the result is partitioned by
    document and part, so one large document is spread over many tasks.
    """
    return running_offset(
        df.withColumn("_one", F.lit(1).cast("bigint")),
        order="page_index",
        value="_one",
        keys=["document_index"],
        bucket_rows=block,
        out="kept_index",
        keep_bucket="part_index",
    ).drop("_one")
