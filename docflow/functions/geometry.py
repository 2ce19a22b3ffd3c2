"""Expressions for page size, tiles and image token counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow import constants as C


def page_pixels(points: Column, dpi: int = C.DEFAULT_DPI) -> Column:
    """Pixels of a page side given in points; a started pixel counts."""
    if dpi < 1:
        raise ValueError("dpi must be at least 1")
    return F.ceil(points * F.lit(dpi) / F.lit(C.POINTS_PER_INCH) - F.lit(0.001)).cast("bigint")


def candidate_tilings(min_tiles: int = C.MIN_TILES, max_tiles: int = C.MAX_TILES) -> list[tuple[int, int]]:
    """Pairs (columns, rows) with a tile count in range, by tile count."""
    if not 1 <= min_tiles <= max_tiles:
        raise ValueError("need 1 <= min_tiles <= max_tiles")
    return [
        (columns, count // columns)
        for count in range(min_tiles, max_tiles + 1)
        for columns in range(1, count + 1)
        if count % columns == 0
    ]


def tile_plan(
    width: Column,
    height: Column,
    min_tiles: int = C.MIN_TILES,
    max_tiles: int = C.MAX_TILES,
    size: int = C.TILE_SIZE,
) -> Column:
    """Tiles for a page: ``struct<tiles_w, tiles_h>``.

    A page that fits one tile is not cut. Else the tiling nearest in aspect
    ratio is taken; of equally near ones the largest whose area the page fills
    by more than half, or the smallest if it fills none. The candidates are a
    constant array, so the generated code stays small however often the plan is
    used in a query.
    """
    area = width.cast("bigint") * height.cast("bigint")
    aspect = width / height
    candidates = F.array(*[
        F.struct(
            F.lit(columns / rows).alias("ratio"),
            F.lit(0.5 * size * size * columns * rows).alias("half"),
            F.lit(rank).alias("rank"),
            F.lit(columns).alias("tiles_w"),
            F.lit(rows).alias("tiles_h"),
        )
        for rank, (columns, rows) in enumerate(candidate_tilings(min_tiles, max_tiles), 1)
    ])
    # Least distance first; then the last one the page fills, else the first.
    best = F.array_min(
        F.transform(
            candidates,
            lambda tiling: F.struct(
                F.abs(aspect - tiling["ratio"]).alias("distance"),
                F.when(area > tiling["half"], -tiling["rank"]).otherwise(tiling["rank"]).alias("preference"),
                tiling["tiles_w"].alias("tiles_w"),
                tiling["tiles_h"].alias("tiles_h"),
            ),
        )
    )
    uncut = (width <= C.TILE_SIZE) & (height <= C.TILE_SIZE)
    one = F.struct(F.lit(1).alias("tiles_w"), F.lit(1).alias("tiles_h"))
    return F.when(uncut, one).otherwise(
        F.struct(best["tiles_w"].alias("tiles_w"), best["tiles_h"].alias("tiles_h"))
    )


def _tokens_per_side(size: int) -> int:
    return math.ceil((size // C.PATCH_SIZE) / C.DOWNSAMPLE_RATIO)


def image_tokens(tiles_w: Column, tiles_h: Column, crop_mode: bool = True) -> Column:
    """Tokens of a page image: overview, separator, and one grid per tile if cut."""
    overview = _tokens_per_side(C.BASE_SIZE) ** 2 + 1
    per_tile = _tokens_per_side(C.TILE_SIZE) ** 2
    if not crop_mode:
        return F.lit(overview).cast("bigint")
    tiles = tiles_w.cast("bigint") * tiles_h.cast("bigint")
    return F.when(tiles > 1, F.lit(overview) + F.lit(per_tile) * tiles).otherwise(
        F.lit(overview)
    ).cast("bigint")


def tile_boxes(tiles_w: Column, tiles_h: Column, size: int = C.TILE_SIZE) -> Column:
    """Row-major crop boxes on the page resized to ``tiles * size``."""
    numbers = F.sequence(F.lit(0), (tiles_w * tiles_h - 1).cast("int"))

    def box(k: Column) -> Column:
        column = (k % tiles_w).cast("bigint")
        row = F.floor(k / tiles_w).cast("bigint")
        return F.struct(
            k.cast("bigint").alias("tile_index"),
            (column * size).alias("left"),
            (row * size).alias("top"),
            ((column + 1) * size).alias("right"),
            ((row + 1) * size).alias("bottom"),
        )

    return F.transform(numbers, box)
