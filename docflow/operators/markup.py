"""Operators over model output: tags, boxes, text, markdown, repetition."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow import constants as C
from docflow.functions import markup
from docflow.operators.ordering import PAGE_BLOCK
from docflow.operators.pages import drop_unfinished, flag_eos, number_kept_pages

PAGE_KEYS = ("document_index", "page_index")
# Token arrays compared at once; bounds the memory of the repetition check.
ROWS_AT_ONCE = 256


def ref_tags(df: DataFrame, text: str = "raw_text", keys: Collection[str] = PAGE_KEYS) -> DataFrame:
    """One row per tag: number, label, coordinates, whether it marks an image."""
    return df.select(*keys, F.explode(markup.ref_tags(F.col(text))).alias("_tag")).select(
        *keys, "_tag.*"
    )


def detections(df: DataFrame, text: str = "raw_text", keys: Collection[str] = PAGE_KEYS) -> DataFrame:
    """One row per box, normalised and in pixels of ``width`` by ``height``."""
    boxes = markup.detections(F.col(text), F.col("width"), F.col("height"))
    return df.select(*keys, F.explode(boxes).alias("_box")).select(*keys, "_box.*")


def wrong_detections(df: DataFrame, text: str = "raw_text", keys: Collection[str] = PAGE_KEYS) -> DataFrame:
    """Tags whose coordinates are readable but not a list of 4-number boxes."""
    return ref_tags(df, text, keys).filter(markup.wrong_boxes(F.col("coords")))


def clean_text(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.withColumn("clean_text", markup.clean_text(F.col(text)))


def tidy_formulas(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.withColumn(text, markup.tidy_formulas(F.col(text)))


def eval_markdown(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Markdown of separate images, as written for an evaluation run."""
    return df.withColumn("markdown", markup.eval_markdown(F.col(text)))


def image_markdown(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Markdown of single images."""
    return df.withColumn("markdown", markup.plain_image_links(F.col(text)))


def _join_pages(numbered: DataFrame, page_text: str) -> DataFrame:
    """Page texts in order, one row per document and part."""
    page = F.struct("page_index", F.col(page_text).alias("text"))
    return numbered.groupBy("document_index", "part_index").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(page)),
                lambda p: F.concat(p["text"], F.lit("\n" + C.PAGE_SPLIT + "\n")),
            ),
            "",
        ).alias("markdown")
    )


def markdown_with_tags(df: DataFrame, text: str = "raw_text", block: int = PAGE_BLOCK) -> DataFrame:
    """Document text with its tags, from pages that ended by themselves.

    A document of more than ``block`` pages comes in several consecutive
    parts; their concatenation is the whole text.
    """
    kept = drop_unfinished(flag_eos(df, text))
    pages = kept.select(
        "document_index",
        "page_index",
        F.expr(f"page_index div {block}").alias("part_index"),
        markup.drop_eos(F.col(text)).alias("_text"),
    )
    return _join_pages(pages, "_text")


def markdown_pages(df: DataFrame, text: str = "raw_text", block: int = PAGE_BLOCK) -> DataFrame:
    """Document markdown with image links, in parts like the tagged text."""
    kept = drop_unfinished(flag_eos(df.select(*PAGE_KEYS, text), text))
    numbered = number_kept_pages(kept, block)
    linked = numbered.withColumn(
        "_text", markup.link_images(markup.drop_eos(F.col(text)), F.col("kept_index"))
    )
    return _join_pages(linked, "_text")


def _kept_boxes(df: DataFrame, text: str) -> DataFrame:
    kept = drop_unfinished(flag_eos(df.select(*PAGE_KEYS, "width", "height", text), text))
    numbered = number_kept_pages(kept)
    boxes = markup.detections(F.col(text), F.col("width"), F.col("height"))
    return numbered.withColumn("_boxes", boxes)


def crop_manifest(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Pictures to cut out: one row per box of an image tag, with its file name.

    Boxes are counted over the whole page, while links count tags, so names
    differ where one tag has several boxes.
    """
    pictures = F.filter("_boxes", lambda box: box["label"] == C.IMAGE_LABEL)
    return (
        _kept_boxes(df, text)
        .select(*PAGE_KEYS, "kept_index", F.posexplode(pictures).alias("crop_index", "_box"))
        .select(
            *PAGE_KEYS,
            F.concat_ws("_", "kept_index", F.concat("crop_index", F.lit(".jpg"))).alias("crop_name"),
            *[F.col("_box.bbox")[i].alias(name) for i, name in enumerate(("x1", "y1", "x2", "y2"))],
        )
    )


def layout_manifest(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Frames to draw: pixel box, line width and label position."""
    return (
        _kept_boxes(df, text)
        .select(*PAGE_KEYS, "kept_index", F.explode("_boxes").alias("_box"))
        .select(
            *PAGE_KEYS,
            "kept_index",
            "_box.ref_index",
            "_box.box_index",
            "_box.label",
            *[F.col("_box.bbox")[i].alias(name) for i, name in enumerate(("x1", "y1", "x2", "y2"))],
        )
        .withColumn("line_width", F.when(F.col("label") == C.TITLE_LABEL, 4).otherwise(2))
        .withColumn("label_x", F.col("x1"))
        .withColumn("label_y", F.greatest(F.lit(0), F.col("y1") - 15))
    )


FIGURE_SCHEMA = (
    "struct<Line: struct<line: array<string>, line_type: array<string>,"
    " line_endpoint: array<string>>,"
    " Circle: struct<circle_center: array<string>, radius: array<double>>>"
)
_NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
_POINT = rf"\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)"


def _figures(df: DataFrame, text: str) -> DataFrame:
    """Rows that hold a geometry figure, parsed. Single quotes are accepted."""
    return df.filter(F.contains(F.col(text), F.lit("line_type"))).withColumn(
        "_figure", F.from_json(F.col(text), FIGURE_SCHEMA)
    )


def _coordinate(text: str, pattern: str, group: int):
    return F.regexp_extract(F.col(text), pattern, group).try_cast("double")


def geometry_lines(df: DataFrame, text: str, keys: Collection[str] = PAGE_KEYS) -> DataFrame:
    """Line segments of figures; a line that does not parse is skipped."""
    first = rf"\A\s*{_POINT}\s*(?: -- |\z)"
    last = rf"(?:\A| -- )\s*{_POINT}\s*\z"
    return (
        _figures(df, text)
        .select(
            *keys,
            F.col("_figure.Line.line_type").alias("_types"),
            F.posexplode("_figure.Line.line").alias("line_index", "_line"),
        )
        .select(
            *keys,
            F.col("line_index").cast("bigint").alias("line_index"),
            F.get("_types", "line_index").alias("line_type"),
            _coordinate("_line", first, 1).alias("x1"),
            _coordinate("_line", first, 2).alias("y1"),
            _coordinate("_line", last, 1).alias("x2"),
            _coordinate("_line", last, 2).alias("y2"),
        )
        .dropna(subset=["line_type", "x1", "y1", "x2", "y2"])
    )


def geometry_endpoints(df: DataFrame, text: str, keys: Collection[str] = PAGE_KEYS) -> DataFrame:
    """Labelled points of figures."""
    point = rf": {_POINT}"
    return (
        _figures(df, text)
        .select(*keys, F.posexplode("_figure.Line.line_endpoint").alias("point_index", "_point"))
        .select(
            *keys,
            F.col("point_index").cast("bigint").alias("point_index"),
            F.substring_index("_point", ": ", 1).alias("label"),
            _coordinate("_point", point, 1).alias("x"),
            _coordinate("_point", point, 2).alias("y"),
        )
    )


def geometry_circles(df: DataFrame, text: str, keys: Collection[str] = PAGE_KEYS) -> DataFrame:
    """Circles of figures; a centre without a radius, or the reverse, is left out."""
    centre = rf": {_POINT}"
    circles = F.arrays_zip(
        F.col("_figure.Circle.circle_center").alias("centre"),
        F.col("_figure.Circle.radius").alias("radius"),
    )
    return (
        _figures(df, text)
        .select(*keys, F.posexplode(circles).alias("circle_index", "_circle"))
        .filter("_circle.centre is not null and _circle.radius is not null")
        .select(
            *keys,
            F.col("circle_index").cast("bigint").alias("circle_index"),
            F.substring_index("_circle.centre", ": ", 1).alias("label"),
            _coordinate("_circle.centre", centre, 1).alias("x"),
            _coordinate("_circle.centre", centre, 2).alias("y"),
            F.col("_circle.radius").alias("radius"),
        )
    )


def repeats_of(
    arrays: Sequence[np.ndarray], n: int, window: int, whitelist: Collection[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that end an n-gram seen before in the window.

    Gives (array number, position, start of the nearest earlier n-gram). The
    arrays are laid end to end. For every distance they are compared with
    themselves shifted; ``n`` equal tokens in a row are a repeat.
    """
    ids = np.concatenate(arrays)
    lengths = np.array([len(a) for a in arrays])
    owner = np.repeat(np.arange(len(arrays)), lengths)
    begins = np.cumsum(lengths) - lengths
    earlier = np.full(len(ids), -1, dtype=np.int64)
    for distance in range(1, min(window - n + 1, len(ids) - n) + 1):
        same = (ids[distance:] == ids[:-distance]) & (owner[distance:] == owner[:-distance])
        total = np.concatenate(([0], np.cumsum(same)))
        starts = np.flatnonzero(total[n:] - total[:-n] == n)
        ends = starts + distance + n - 1
        fresh = earlier[ends] < 0
        earlier[ends[fresh]] = starts[fresh]
    hits = np.flatnonzero((earlier >= 0) & ~np.isin(ids, list(whitelist)))
    of = owner[hits]
    return of, hits - begins[of], earlier[hits] - begins[of]


def repeated_ngrams(
    df: DataFrame,
    n: int = C.REPETITION_SETTINGS["service"][0],
    window: int = C.REPETITION_SETTINGS["service"][1],
    whitelist: Collection[int] = C.REPETITION_WHITELIST,
    tokens: str = "token_ids",
    keys: Collection[str] = PAGE_KEYS,
) -> DataFrame:
    """Tokens that complete an n-gram already seen in the last ``window`` tokens.

    One row per such token with the position of the nearest earlier n-gram.
    Works on each token array alone: exploding n-grams would shuffle n times
    the data. A single-token n-gram never counts as a repeat.
    """
    if n < 1 or window < 1:
        raise ValueError("n and window must be at least 1")
    allowed = frozenset(whitelist)
    keys = list(keys)
    columns = [*keys, "position", "earlier_start"]

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), ROWS_AT_ONCE):
                rows = part.iloc[at : at + ROWS_AT_ONCE]
                of, position, earlier = repeats_of(list(rows[tokens]), n, window, allowed)
                yield rows.iloc[of][keys].assign(position=position, earlier_start=earlier)[columns]

    long_enough = df.filter((F.size(tokens) > n) & F.lit(n > 1)).select(*keys, tokens)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    return long_enough.mapInPandas(find, ", ".join([*fields, "position bigint", "earlier_start bigint"]))


def snapshot_deltas(
    df: DataFrame,
    keys: Collection[str],
    order: str,
    text: str,
    block: int = PAGE_BLOCK,
) -> DataFrame:
    """New text of each growing snapshot: what lies beyond the previous length.

    ``order`` is a non-negative integer, unique per key. Snapshots are cut into
    blocks, and each block gets the last length of the one before it, so a key
    with very many snapshots is spread over many tasks.
    """
    keys = list(keys)
    blocks = df.withColumn("_block", F.expr(f"`{order}` div {block}"))
    last = blocks.groupBy(*keys, "_block").agg(
        F.max_by(F.length(text), order).alias("_last")
    )
    earlier = last.select(
        *keys,
        "_block",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_before"),
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocks.repartition(*keys, "_block")
        .withColumn("_previous", F.lag(F.length(text)).over(in_block))
        .join(earlier, [*keys, "_block"])
        .withColumn(
            "delta",
            F.substring(
                F.col(text), F.coalesce("_previous", "_before", F.lit(0)) + 1, F.length(text)
            ),
        )
        .drop("_block", "_previous", "_before")
    )
