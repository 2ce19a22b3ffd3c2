"""Pipeline inputs derived from the given tables.

Document texts become pages with model output; only integer arithmetic and
string functions are used, so any engine derives the same rows. Every input is
row-local on its table and grows with it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow import constants as C
from docflow.operators.batching import page_batches
from docflow.operators.pages import explode_pages, plan_tokens
from docflow.operators.scoring import score_batches
from docflow.session import materialize, new_folder
from docflow.streaming.runner import table_stream

PAGE_CHARS = 1800
BATCH_PAGES = 64
SNAPSHOT_CHARS = 300
PIECE_TOKENS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Documents with page count and text. With ``gaps``, one in fifty has no pages."""
    count = f"cast(ceil(n_chars / {PAGE_CHARS}.0) as bigint)"
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_index"),
        F.expr("concat(source, '/', lang, '/doc_', doc_id, '.pdf')").alias("document_path"),
        F.expr(f"case when doc_id % 50 = 49 then 0L else {count} end" if gaps else count).alias("page_count"),
        F.expr("(doc_id * 17) % 1000 / 1000").alias("render_s"),
        "text",
    )


WIDTH = "400 + (document_index * 131 + page_index * 17) % 2600"
HEIGHT = "500 + (document_index * 71 + page_index * 29) % 3000"
# All pieces of a text in one pass; a substring per page would scan it anew.
CHUNKS = f"regexp_extract_all(text, '(?s).{{1,{PAGE_CHARS}}}', 0)"


def page_sizes(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Pages with their size. Texts are not read."""
    return explode_pages(documents(spark, folder, gaps).drop("text")).select(
        "document_index",
        "document_path",
        "page_count",
        "page_index",
        F.expr(WIDTH).alias("width"),
        F.expr(HEIGHT).alias("height"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with size and text, as a renderer would give them."""
    return (
        documents(spark, folder)
        .filter("page_count > 0")
        .select("document_index", "document_path", "page_count", F.posexplode_outer(F.expr(CHUNKS)).alias("_at", "chunk"))
        .withColumn("page_index", F.col("_at").cast("bigint"))
        .select(
            "document_index",
            "document_path",
            "page_count",
            "page_index",
            F.expr(WIDTH).alias("width"),
            F.expr(HEIGHT).alias("height"),
            "chunk",
        )
    )


def ocr(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with model output and token counts."""
    box = """concat('[[', (document_index * 37 + page_index * 11) % 400, ', ',
      (document_index * 53 + page_index * 7) % 400, ', ',
      (document_index * 37 + page_index * 11) % 400 + 100 + document_index % 500, ', ',
      (document_index * 53 + page_index * 7) % 400 + 50 + page_index % 300, ']]')"""
    output = f"""concat(
      '<|ref|>', case (document_index + page_index) % 4
        when 0 then 'title' when 1 then 'text' when 2 then 'image' else 'table' end,
      '<|/ref|><|det|>', case when document_index % 29 = 7 then '[[1, 2' else {box} end,
      '<|/det|>\\n', chunk, '\\n\\n\\n\\n',
      case when page_index % 2 = 0
        then '<|ref|>image<|/ref|><|det|>[[10, 20, 500, 400], [0, 0, 999, 999]]<|/det|>' else '' end,
      case when (document_index * 7 + page_index) % 10 <> 0 then '{C.EOS_TOKEN}' else '' end)"""
    return (
        plan_tokens(pages(spark, folder).withColumn("raw_text", F.expr(output)))
        .withColumnRenamed("image_tokens", "input_tokens")
        .withColumn("output_tokens", F.expr("cast(size(split(raw_text, ' ', -1)) as bigint)"))
    )


def batched(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with model output and batch."""
    return page_batches(ocr(spark, folder), documents(spark, folder).drop("text"), BATCH_PAGES)


def with_outcome(pages: DataFrame) -> DataFrame:
    """Batched pages with what became of them: some batches failed. Stage times depend on the batch."""
    return (
        pages.withColumn("error", F.expr("case when batch_id % 17 = 3 then concat('fail batch ', batch_id) end"))
        .withColumn("preprocess_s", F.expr("(batch_id * 13) % 700 / 1000"))
        .withColumn("generate_s", F.expr("(batch_id * 97) % 5000 / 1000"))
        .withColumn("queue_wait_ms", F.expr("(document_index * 13 + page_index * 7) % 300"))
        .withColumn("gpu_ms", F.expr("(batch_id * 97) % 5000"))
        .withColumn("post_ms", F.expr("(batch_id * 31) % 50"))
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pages with their texts."""
    return with_outcome(batched(spark, folder))


def outcome_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pages by their keys, batches and times. Texts are not read."""
    docs = documents(spark, folder).drop("text")
    keys = explode_pages(docs).select("document_index", "page_index", "page_count")
    return with_outcome(page_batches(keys, docs, BATCH_PAGES))


def stored_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pages without their text, as a table: texts are read once."""
    return materialize(
        outcomes(spark, folder).drop("document_path", "chunk", "raw_text", "width", "height", "tiles_w", "tiles_h"),
        "outcomes",
    )


MODEL_OUTPUT = T.StructType([
    T.StructField("raw_text", T.StringType()),
    T.StructField("output_tokens", T.LongType()),
])


def echo_model(rows: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: gives back the prepared output."""
    texts = rows["payload"].tolist()
    # A null payload, None or NaN, has no count.
    tokens = [text.count(" ") + 1 if isinstance(text, str) else None for text in texts]
    return pd.DataFrame({"raw_text": texts, "output_tokens": tokens})


def failing_model(rows: pd.DataFrame) -> pd.DataFrame:
    """As :func:`echo_model`, but some batches fail."""
    batch = rows["batch_id"].iloc[0]
    if batch % 17 == 3:
        raise RuntimeError(f"fail batch {batch}")
    return echo_model(rows)


def rarely_failing_model(rows: pd.DataFrame) -> pd.DataFrame:
    """As :func:`echo_model`, but one batch in 97 fails."""
    batch = rows["batch_id"].iloc[0]
    if batch % 97 == 3:
        raise RuntimeError(f"fail batch {batch}")
    return echo_model(rows)


def down_for_some(rows: pd.DataFrame) -> pd.DataFrame:
    """As :func:`echo_model`, but down for every seventh user."""
    if rows["user_id"].iloc[0] % 7 == 3:
        raise RuntimeError("model down")
    return echo_model(rows)


def unscored(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as they go to the stand-in models, without a batch."""
    return ocr(spark, folder).withColumnRenamed("raw_text", "payload").drop("output_tokens", "chunk")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Pages scored batch by batch by the stand-in model."""
    ready = batched(spark, folder).withColumnRenamed("raw_text", "payload").drop("output_tokens", "chunk")
    kept = ["document_index", "page_index", "batch_id", "width", "height", "input_tokens"]
    return score_batches(ready, failing_model, MODEL_OUTPUT, kept)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of many kinds, from the URLs of web pages."""
    endings = """case page_id % 8 when 0 then '.pdf' when 1 then '.PNG' when 2 then '.Jpeg'
      when 3 then '.txt' when 4 then '.tiff' when 5 then '/.png' when 6 then '.pdf.bak' else '' end"""
    return table(spark, folder, "pages").select("page_id", F.expr(f"concat(url, {endings})").alias("path"))


def requests(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """JSON bodies with the pages of a document as base64 images; some are bad."""
    images = f"""case when page_count = 0 then array() else transform({CHUNKS},
      chunk -> base64(encode(chunk, 'UTF-8'))) end"""
    good = f"""to_json(named_struct(
      'images', case when document_index % 19 = 5 then array_append({images}, '*not base64*') else {images} end,
      'prompt', case document_index % 3 when 0 then '<image>\\nFree OCR.' when 1 then '' end))"""
    return documents(spark, folder, gaps).select(
        F.col("document_index").alias("request_id"),
        F.expr(f"case when document_index % 23 = 11 then concat('{{\"images\": [', document_index) else {good} end").alias("body"),
    )


def raw_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Raw bodies, images and PDFs, some of them empty."""
    return documents(spark, folder).select(
        F.col("document_index").alias("request_id"),
        F.expr("if(document_index % 2 = 0, 'pdf', 'image')").alias("kind"),
        F.expr("if(document_index % 5 = 3, '<image>\\nFree OCR.', null)").alias("prompt"),
        F.expr("case document_index % 13 when 2 then unhex('') when 5 then null else encode(text, 'UTF-8') end").alias("body"),
    )


def as_files(df: DataFrame, name: str) -> str:
    """Rows as a folder of files for a stream to read."""
    target = new_folder(df.sparkSession, name)
    df.write.parquet(target)
    return target


def image_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """First bytes of an image file per page, of five formats; some unreadable."""

    def little(side: str, count: int) -> str:
        pairs = [f"substr(lpad(hex({side}), {2 * count}, '0'), {2 * i - 1}, 2)" for i in range(count, 0, -1)]
        return f"unhex(concat({', '.join(pairs)}))"

    def big(side: str, count: int) -> str:
        return f"unhex(lpad(hex({side}), {2 * count}, '0'))"

    png = f"concat(unhex('89504E470D0A1A0A0000000D49484452'), {big('width', 4)}, {big('height', 4)})"
    bmp = f"concat(unhex('424D00000000000000003600000028000000'), {little('width', 4)}, {little('height', 4)})"
    jpeg = f"concat(unhex('FFD8FFE000040000FFC0001108'), {big('height', 2)}, {big('width', 2)}, unhex('03'))"
    webp = (
        "concat(unhex('524946460000000057454250565038580A00000000000000'), "
        f"{little('width - 1', 3)}, {little('height - 1', 3)})"
    )
    tiff = (
        f"concat(unhex('49492A000800000002000001040001000000'), {little('width', 4)}, "
        f"unhex('0101040001000000'), {little('height', 4)}, unhex('00000000'))"
    )
    return page_sizes(spark, folder).select(
        "document_index",
        "page_index",
        F.expr(
            f"""case page_index % 6 when 0 then {png} when 1 then {bmp} when 3 then {jpeg}
              when 4 then {webp} when 5 then {tiff} else unhex('00') end"""
        ).alias("payload"),
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Arrival times in microseconds, a user's request each."""
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("queued_us"),
    )


def arrival_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The arrivals as a stream, each with a request and a payload."""
    return table_stream(spark, f"{folder}/events.parquet").select(
        "event_id",
        "user_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("queued_us"),
        F.col("event_type").alias("request"),
        F.expr("concat(event_type, ' ', event_id)").alias("payload"),
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Timed steps in hundredths of a millisecond; some are negative."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("request_id"),
        F.expr("case event_type when 'click' then 'gpu_generate' when 'view' then 'cpu_preprocess' else event_type end").alias("step"),
        F.expr("cast(round(value * 100) as bigint) - 2000").alias("hundredths"),
    )


def timed_requests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Spans in milliseconds, and the total time of every request, of which a step may lack some."""
    rows = spans(spark, folder)
    total = F.sum(F.greatest("hundredths", F.lit(0))) + F.expr("request_id % 3 * 30")
    return (
        rows.select("request_id", "step", F.expr("cast(hundredths / 100 as decimal(18, 2))").alias("ms")),
        rows.groupBy("request_id").agg(total.alias("_total")).select("request_id", (F.col("_total") / 100).alias("total_ms")),
    )


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token arrays of pages: word lengths, so that repeats are frequent."""
    return pages(spark, folder).select(
        "document_index", "page_index", F.expr("transform(split(chunk, ' ', -1), w -> length(w))").alias("token_ids")
    )


def token_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The same tokens in pieces of ``PIECE_TOKENS``, with the position of the first."""
    starts = F.expr(f"explode(transform(sequence(0, (size(token_ids) - 1) div {PIECE_TOKENS}), i -> i * {PIECE_TOKENS}))")
    return tokens(spark, folder).filter("size(token_ids) > 0").withColumn("start", starts).withColumn(
        "token_ids", F.slice("token_ids", F.col("start").cast("int") + 1, PIECE_TOKENS)
    )


def formulas(spark: SparkSession, folder: str) -> DataFrame:
    """Model output with a one-line formula that carries an equation number."""
    text = """concat('\\\\[ x_', document_index, ' \\\\coloneqq y \\\\quad (', page_index, ') \\\\]\\n', raw_text)"""
    return ocr(spark, folder).withColumn("raw_text", F.expr(text))


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """Geometry figures as text, with numbers from the page."""
    text = """concat('{\\'Line\\': {\\'line\\': [\\'(', document_index, ', ', page_index, ') -- (3.5, -4)\\', \\'(0, 1) -- (',
      page_count, ', ', width, ')\\'], \\'line_type\\': [\\'--\\', \\'-\\'], \\'line_endpoint\\': [\\'A: (', document_index, ', ',
      page_index, ')\\', \\'B: (3.5, -4)\\']}, \\'Circle\\': {\\'circle_center\\': [\\'O: (', width, ', ', height,
      ')\\'], \\'radius\\': [', document_index, '.5]}}')"""
    return page_sizes(spark, folder).select("document_index", "page_index", F.expr(text).alias("figure"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Growing texts of a page: each shows some more characters than the last."""
    last = f"cast(ceil(length(chunk) / {SNAPSHOT_CHARS}.0) as bigint) - 1"
    return (
        pages(spark, folder)
        .filter("length(chunk) > 0")
        .withColumn("snapshot", F.expr(f"explode(sequence(0L, {last}))"))
        .select(
            "document_index",
            "page_index",
            "snapshot",
            F.expr(f"substring(chunk, 1, cast((snapshot + 1) * {SNAPSHOT_CHARS} as int))").alias("full_text"),
        )
    )
