import random

import pytest
from pyspark.sql import functions as F

from docflow.functions import geometry
from docflow.operators import pages

CANDIDATES = [(w, h) for count in range(2, 7) for w in range(1, 7) for h in range(1, 7) if w * h == count]


def expected_tiles(width, height):
    if max(width, height) <= 768:
        return 1, 1
    distance = {pair: abs(width / height - pair[0] / pair[1]) for pair in CANDIDATES}
    tied = [pair for pair in CANDIDATES if distance[pair] == min(distance.values())]
    filled = [pair for pair in tied if width * height > 0.5 * 768**2 * pair[0] * pair[1]]
    return filled[-1] if filled else tied[0]


def test_candidates():
    assert sorted(geometry.candidate_tilings()) == sorted(CANDIDATES)
    assert len(CANDIDATES) == 13
    with pytest.raises(ValueError):
        geometry.candidate_tilings(3, 2)


def test_tile_plan_matches_brute_force(spark):
    rng = random.Random(7)
    sizes = {(rng.randint(1, 4000), rng.randint(1, 4000)) for _ in range(4000)}
    # Exact ties: ratios half way between candidates, small and large.
    sizes |= {(a * k, b * k) for a, b in ((1, 1), (2, 2), (5, 2), (3, 4), (7, 2), (1, 6)) for k in range(100, 2000, 37)}
    sizes |= {(768, 768), (769, 768), (768, 769), (1, 769), (769, 1)}
    frame = spark.createDataFrame(sorted(sizes), "width bigint, height bigint")
    for row in pages.plan_tiles(frame).collect():
        assert (row.tiles_w, row.tiles_h) == expected_tiles(row.width, row.height), row


def test_image_tokens_range(spark):
    frame = spark.createDataFrame([(100, 100), (1000, 1500), (3000, 500)], "width bigint, height bigint")
    planned = {r.width: r for r in pages.plan_tokens(frame).collect()}
    assert planned[100].image_tokens == 257
    assert planned[3000].image_tokens == 257 + 144 * 6
    plain = pages.plan_tokens(frame, crop_mode=False)
    assert {r.image_tokens for r in plain.collect()} == {257}


def test_tile_boxes_cover_the_resized_page(spark):
    frame = spark.createDataFrame([(3, 2)], "tiles_w int, tiles_h int")
    boxes = pages.tile_boxes(frame).orderBy("tile_index").collect()
    assert [(b.left, b.top) for b in boxes] == [(0, 0), (768, 0), (1536, 0), (0, 768), (768, 768), (1536, 768)]
    assert all(b.right - b.left == 768 and b.bottom - b.top == 768 for b in boxes)


def test_page_pixels(spark):
    frame = spark.createDataFrame([(612.0, 792.0), (595.28, 841.89)], "width_pt double, height_pt double")
    rows = pages.page_pixels(frame).collect()
    assert (rows[0].width, rows[0].height) == (1224, 1584)
    assert (rows[1].width, rows[1].height) == (1191, 1684)
    with pytest.raises(ValueError):
        geometry.page_pixels(F.lit(1.0), 0)
