import random

import pytest
from pyspark.sql import functions as F

from docflow import constants as C
from docflow.functions import markup as expressions
from docflow.operators import markup, pages, scoring


def tag(label, coords):
    return f"<|ref|>{label}<|/ref|><|det|>{coords}<|/det|>"


def frame(spark, *texts, width=999, height=1998):
    rows = [(0, i, text, width, height) for i, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "document_index bigint, page_index bigint, raw_text string, width bigint, height bigint"
    )


def one(spark, text, expression):
    return frame(spark, text).select(expression(F.col("raw_text")).alias("v")).first().v


def test_tags_over_several_lines(spark):
    rows = markup.ref_tags(frame(spark, tag("a\nb", "[[1,\n2, 3, 4]]") + tag("", ""))).collect()
    assert [(r.ref_index, r.label, r.coords) for r in rows] == [(0, "a\nb", "[[1,\n2, 3, 4]]"), (1, "", "")]


def test_unclosed_tag_reaches_to_the_next(spark):
    text = "<|ref|>x " + tag("image", "[[1,2,3,4]]")
    row = markup.ref_tags(frame(spark, text)).first()
    assert row.label == "x <|ref|>image" and row.is_image


def test_boxes_in_pixels(spark):
    text = tag("title", "[[0, 999, 500.5, -3], (1, 2, 3, 4),]")
    rows = markup.detections(frame(spark, text, width=999, height=1998)).collect()
    assert [r.bbox for r in rows] == [[0, 1998, 500, -6], [1, 4, 3, 8]]
    assert rows[0].bbox_norm == [0.0, 999.0, 500.5, -3.0]
    assert [r.box_index for r in rows] == [0, 1]


@pytest.mark.parametrize("coords", ["[[1, 2", "", "abc", "[[null, 1, 2, 3]]"])
def test_unreadable_boxes_are_skipped(spark, coords):
    df = frame(spark, tag("text", coords) + tag("text", "[[1,2,3,4]]"))
    assert markup.detections(df).count() == 1
    assert markup.wrong_detections(df).count() == 0


@pytest.mark.parametrize("coords", ["[[1, 2, 3]]", "[1, 2, 3, 4]", "5", "[[1,2,3,4],[1]]", '[["a",2,3,4]]'])
def test_wrong_boxes_are_errors(spark, coords):
    df = frame(spark, tag("text", coords))
    assert markup.wrong_detections(df).count() == 1
    scored = df.withColumn("error", F.lit(None).cast("string")).withColumn("batch_id", F.lit(0))
    assert scoring.page_results(scored).first().error is not None


def test_empty_box_list_is_fine(spark):
    df = frame(spark, tag("text", "[]"))
    assert markup.detections(df).count() == 0 and markup.wrong_detections(df).count() == 0


def test_clean_text(spark):
    text = f"　\x1f {tag('image', '[[1,2,3,4]]')}a\n\n\n\n\nb \\coloneqq c \\eqqcolon d\n\n{C.EOS_TOKEN}\xa0\n"
    assert one(spark, text, expressions.clean_text) == "a\n\nb := c =: d"
    assert one(spark, "", expressions.clean_text) == ""
    assert one(spark, " \n\t", expressions.clean_text) == ""


def test_links_count_tags_and_crops_count_boxes(spark):
    text = tag("image", "[[1,2,3,4],[5,6,7,8]]") + "x" + tag("image", "[[9,9,9,9]]") + C.EOS_TOKEN
    df = frame(spark, text)
    assert markup.markdown_pages(df).first().markdown == (
        "![](images/0_0.jpg)\nx![](images/0_1.jpg)\n\n\n<--- Page Split --->\n"
    )
    assert sorted(r.crop_name for r in markup.crop_manifest(df).collect()) == ["0_0.jpg", "0_1.jpg", "0_2.jpg"]


def test_equal_image_tags_share_the_first_link(spark):
    text = 2 * tag("image", "[[1,2,3,4]]") + C.EOS_TOKEN
    assert markup.markdown_pages(frame(spark, text)).first().markdown.count("images/0_0.jpg") == 2


def test_tidying_needs_a_removed_tag(spark):
    plain = "a\n\n\n\nb\\coloneqq" + C.EOS_TOKEN
    tagged = tag("text", "[[1,2,3,4]]") + plain
    pages_in = frame(spark, plain, tagged)
    text = markup.markdown_pages(pages_in).first().markdown
    assert text.split("\n\n<--- Page Split --->\n")[:2] == ["a\n\n\n\nb\\coloneqq", "a\n\nb:="]


def test_pages_without_end_token_are_left_out_and_numbers_close_up(spark):
    image = tag("image", "[[1,2,3,4]]")
    df = frame(spark, image, image + C.EOS_TOKEN, image, image + C.EOS_TOKEN)
    text = markup.markdown_pages(df).first().markdown
    assert "images/0_0.jpg" in text and "images/1_0.jpg" in text and "images/2_0" not in text


def test_long_document_comes_in_parts(spark):
    rng = random.Random(3)
    texts = [tag("image", f"[[{i},2,3,4]]") + (C.EOS_TOKEN if rng.random() < 0.7 else "") for i in range(50)]
    df = frame(spark, *texts)
    whole = markup.markdown_pages(df).first().markdown
    parts = markup.markdown_pages(df, block=4).orderBy("part_index").collect()
    assert len(parts) > 5
    assert "".join(p.markdown for p in parts) == whole
    tagged = markup.markdown_with_tags(df).first().markdown
    assert "".join(
        p.markdown for p in markup.markdown_with_tags(df, block=4).orderBy("part_index").collect()
    ) == tagged


def test_layout_of_titles(spark):
    df = frame(spark, tag("title", "[[0,5,9,9]]") + tag("text", "[[0,500,9,9]]") + C.EOS_TOKEN)
    rows = markup.layout_manifest(df).orderBy("ref_index").collect()
    assert [(r.line_width, r.label_x, r.label_y) for r in rows] == [(4, 0, 0), (2, 0, 985)]


def test_formulas(spark):
    text = r"a \[ x \quad (1) \] b \[y\] \[ broken" + "\n" + r"\] \[ z \quad\quad (2)(3) \]"
    assert one(spark, text, expressions.tidy_formulas) == (
        r"a \[x\] b \[y\] \[ broken" + "\n" + r"\] \[z \quad(3)\]"
    )


def test_eval_markdown_keeps_the_end_token(spark):
    text = "a\n\n\n\n" + tag("image", "[[1,2,3,4]]") + "b" + C.EOS_TOKEN
    assert one(spark, text, expressions.eval_markdown) == "a\n\nb" + C.EOS_TOKEN


def test_single_image_links(spark):
    text = tag("image", "[[1,2,3,4]]") + "a\n\n\n" + tag("text", "[]") + "\\coloneqq"
    assert one(spark, text, expressions.plain_image_links) == "![](images/0.jpg)\na\n\n\n:="


def test_figures_skip_what_does_not_parse(spark):
    text = (
        "{'Line': {'line': ['(1, 2) -- (3, 4)', 'oops', '(5,6) -- (7, -8.5)'], 'line_type': ['--', '-'],"
        " 'line_endpoint': ['A: (1, 2)']}, 'Circle': {'circle_center': ['O: (0, 0)', 'P: (1, 1)'], 'radius': [2.5]}}"
    )
    df = frame(spark, text, "no figure")
    lines = markup.geometry_lines(df, "raw_text").collect()
    assert [(r.line_index, r.line_type, r.x1, r.y1, r.x2, r.y2) for r in lines] == [(0, "--", 1.0, 2.0, 3.0, 4.0)]
    assert [(r.label, r.x, r.y) for r in markup.geometry_endpoints(df, "raw_text").collect()] == [("A", 1.0, 2.0)]
    circles = markup.geometry_circles(df, "raw_text").collect()
    assert [(r.label, r.radius) for r in circles] == [("O", 2.5)]


def repeats(ids, n, window, whitelist):
    found = []
    for t in range(n, len(ids)):
        gram = ids[t - n + 1 : t + 1]
        earlier = [i for i in range(max(0, t - window), t - n + 1) if ids[i : i + n] == gram]
        if n > 1 and earlier and ids[t] not in whitelist:
            found.append((t, earlier[-1]))
    return found


@pytest.mark.parametrize("n,window", [(1, 5), (2, 2), (2, 3), (3, 12), (4, 50), (5, 9)])
def test_repeats_match_brute_force(spark, n, window):
    rng = random.Random(n * 100 + window)
    arrays = [[rng.randint(0, 3) for _ in range(rng.randint(0, 60))] for _ in range(300)]
    arrays += [[1] * 40, [1, 2] * 30, []]
    df = spark.createDataFrame(
        [(0, i, a) for i, a in enumerate(arrays)], "document_index bigint, page_index bigint, token_ids array<int>"
    )
    rows = markup.repeated_ngrams(df, n, window, {2}).collect()
    got = {(r.page_index, r.position, r.earlier_start) for r in rows}
    assert got == {(i, *hit) for i, a in enumerate(arrays) for hit in repeats(a, n, window, {2})}
    assert len(got) == len(rows)


def test_snapshot_deltas_across_blocks(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for key in range(5):
        text = ""
        for step in range(30 if key else 200):
            new = "é" * rng.randint(0, 3) + str(step)
            text += new
            rows.append((key, step * (1 + key), text))
            expected[key, step * (1 + key)] = new
    df = spark.createDataFrame(rows, "key bigint, step bigint, full string")
    for block in (1, 7, 1024):
        got = markup.snapshot_deltas(df, ["key"], "step", "full", block=block).collect()
        assert {(r.key, r.step): r.delta for r in got} == expected


def test_prompts(spark):
    df = spark.createDataFrame([(None,), ("",), ("no image",), ("<image><image>",), ("<image>\nx",)], "prompt string")
    rows = pages.check_prompts(df).collect()
    assert [r.prompt_ok for r in rows] == [True, True, False, False, True]
    assert rows[0].prompt == rows[1].prompt == C.DEFAULT_PROMPT


@pytest.mark.parametrize("n,window", [(0, 5), (3, 0)])
def test_repeat_arguments(spark, n, window):
    with pytest.raises(ValueError):
        markup.repeated_ngrams(spark.range(1), n, window)
