"""Expressions over grounded model output.

A tag is ``<|ref|>label<|/ref|><|det|>coordinates<|/det|>``. All expressions
are native and work on one row, so they need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow import constants as C
from docflow.functions.text import strip


def has_eos(raw: Column) -> Column:
    """Whether the model ended its output by itself."""
    return F.contains(raw, F.lit(C.EOS_TOKEN))


def drop_eos(raw: Column) -> Column:
    return F.replace(raw, F.lit(C.EOS_TOKEN), F.lit(""))


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, C.REF_PATTERN, "")


def plain_symbols(text: Column) -> Column:
    """Spell two LaTeX definition signs in plain characters."""
    text = F.replace(text, F.lit("\\coloneqq"), F.lit(":="))
    return F.replace(text, F.lit("\\eqqcolon"), F.lit("=:"))


def clean_text(raw: Column) -> Column:
    """Output without end token and tags, symbols and blank lines tidied."""
    text = plain_symbols(drop_tags(drop_eos(raw)))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _all_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.REF_PATTERN), F.lit(0))


def ref_tags(text: Column) -> Column:
    """All tags: ``array<struct<ref_index, full, label, coords, is_image>>``.

    The text is searched once; label and coordinates are cut from each tag.
    """
    opening, middle, closing = "<|ref|>", "<|/ref|><|det|>", "<|/det|>"
    image_tag = f"<|ref|>{C.IMAGE_LABEL}<|/ref|>"

    def parts(full: Column, i: Column) -> Column:
        inner = F.substring(full, len(opening) + 1, F.length(full) - len(opening) - len(closing))
        label = F.substring_index(inner, middle, 1)
        return F.struct(
            i.cast("bigint").alias("ref_index"),
            full.alias("full"),
            label.alias("label"),
            F.substring(inner, F.length(label) + len(middle) + 1, F.length(inner)).alias("coords"),
            F.contains(full, F.lit(image_tag)).alias("is_image"),
        )

    return F.transform(_all_tags(text), parts)


def _as_json(coords: Column) -> Column:
    """Coordinate list as JSON: round brackets and trailing commas replaced."""
    return F.regexp_replace(F.translate(coords, "()", "[]"), r",\s*\]", "]")


def parse_boxes(coords: Column) -> Column:
    """Boxes of a coordinate text, null when it is not a list of number lists."""
    named = coords.rlike(r"\b(null|true|false)\b")
    return F.when(~named, F.from_json(_as_json(coords), "array<array<double>>"))


def wrong_boxes(coords: Column) -> Column:
    """Whether the text is a well-formed value, but not a list of 4-number boxes.

    Text that does not parse at all is not wrong: its tag has no boxes.
    """
    boxes = parse_boxes(coords)
    named = coords.rlike(r"\b(null|true|false)\b")
    readable = ~named & F.try_parse_json(_as_json(coords)).isNotNull()
    bad_size = F.exists(boxes, lambda box: F.coalesce(F.size(box), F.lit(0)) != 4)
    return F.when(boxes.isNull(), readable).otherwise(bad_size)


def _pixel(value: Column, side: Column) -> Column:
    return (value / F.lit(C.COORDINATE_RANGE) * side).try_cast("bigint")


def detections(text: Column, width: Column, height: Column) -> Column:
    """Boxes of all tags, in order, each as it was given and in pixels.

    ``array<struct<ref_index, box_index, label, bbox_norm, bbox>>``. Pixel
    values are truncated toward zero.
    """
    return detections_of(ref_tags(text), width, height)


def detections_of(tags: Column, width: Column, height: Column) -> Column:
    """As :func:`detections`, of tags that :func:`ref_tags` has found."""

    def of_tag(tag: Column) -> Column:
        return F.transform(
            F.filter(
                F.coalesce(parse_boxes(tag["coords"]), F.array().cast("array<array<double>>")),
                lambda box: F.size(box) == 4,
            ),
            lambda box, n: F.struct(
                tag["ref_index"].alias("ref_index"),
                n.cast("bigint").alias("box_index"),
                tag["label"].alias("label"),
                box.alias("bbox_norm"),
                F.array(
                    _pixel(F.get(box, F.lit(0)), width),
                    _pixel(F.get(box, F.lit(1)), height),
                    _pixel(F.get(box, F.lit(2)), width),
                    _pixel(F.get(box, F.lit(3)), height),
                ).alias("bbox"),
            ),
        )

    return F.flatten(F.transform(tags, of_tag))


def _linked(text: Column, tags: Column, page: Column | None) -> Column:
    """Image tags replaced by links to numbered pictures, of a page if given."""
    prefix = F.lit("![](images/") if page is None else F.concat(F.lit("![](images/"), page, F.lit("_"))
    images = F.transform(
        F.filter(tags, lambda tag: tag["is_image"]),
        lambda tag, k: F.struct(
            tag["full"].alias("full"), F.concat(prefix, k, F.lit(".jpg)\n")).alias("link")
        ),
    )
    return F.aggregate(images, text, lambda acc, image: F.replace(acc, image["full"], image["link"]))


def link_images(text: Column, page: Column) -> Column:
    """Markdown of one page: image tags become links, other tags go.

    Equal image tags all take the first link. Symbols and blank lines are
    tidied once per removed tag, so not at all on a page without one.
    """

    def rendered(tags: Column) -> Column:
        return F.aggregate(
            F.filter(tags, lambda tag: ~tag["is_image"]),
            _linked(text, tags, page),
            lambda acc, tag: fewer_newlines(plain_symbols(F.replace(acc, tag["full"], F.lit("")))),
        )

    return let(ref_tags(text), rendered)


def fewer_newlines(text: Column) -> Column:
    """One pass over runs of four, then of three newlines."""
    text = F.replace(text, F.lit("\n\n\n\n"), F.lit("\n\n"))
    return F.replace(text, F.lit("\n\n\n"), F.lit("\n\n"))


def tidy_formulas(text: Column) -> Column:
    r"""Inside one-line ``\[…\]``: drop ``\quad (…)`` and outer white space."""
    formula = r"\\\[([^\n]*?)\\\]"
    gaps = F.split(text, formula, -1)
    inner = F.regexp_extract_all(text, F.lit(formula), F.lit(1))
    tidied = F.transform(
        inner,
        lambda body: F.concat(
            F.lit("\\["),
            strip(F.regexp_replace(body, r"(?U)\\quad[\s\x1c-\x1f]*\([^)]*\)", "")),
            F.lit("\\]"),
        ),
    )
    return F.array_join(
        F.zip_with(gaps, tidied, lambda gap, body: F.concat(gap, F.coalesce(body, F.lit("")))),
        "",
    )


def eval_markdown(raw: Column) -> Column:
    """Formulas tidied, then every tag removed. The end token stays."""
    return let(
        tidy_formulas(raw),
        lambda text: F.aggregate(
            _all_tags(text),
            text,
            lambda acc, tag: fewer_newlines(F.replace(acc, tag, F.lit(""))),
        ),
    )


def plain_image_links(raw: Column) -> Column:
    """Markdown of a single image: links without a page number, newlines kept."""

    def rendered(tags: Column) -> Column:
        return F.aggregate(
            F.filter(tags, lambda tag: ~tag["is_image"]),
            _linked(raw, tags, None),
            lambda acc, tag: plain_symbols(F.replace(acc, tag["full"], F.lit(""))),
        )

    return let(ref_tags(raw), rendered)
