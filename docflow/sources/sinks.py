"""Writing results, metrics and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import file_name
from docflow.operators import markup
from docflow.operators.results import result_lines
from docflow.session import task_count


def write_results(results: DataFrame, folder: str) -> None:
    """JSON lines in document order: files by range, sorted within.

    Reading the part files in name order gives all documents in order.
    """
    (
        result_lines(results)
        .repartitionByRange(task_count(results.sparkSession), "document_index", "part_index")
        .sortWithinPartitions("document_index", "part_index")
        .select("value")
        .write.text(folder)
    )


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """Each row as a JSON object with its keys in order."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value"))


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """A one-row frame as one JSON object."""
    metrics_lines(metrics).coalesce(1).write.text(folder)


def pdf_outputs(path: Column) -> Column:
    """Names of the files written for a PDF.

    In the plain markdown name every ``pdf`` is replaced, not just the suffix.
    """
    name = file_name(path)
    return F.struct(
        F.replace(name, F.lit(".pdf"), F.lit("_det.mmd")).alias("tagged"),
        F.replace(name, F.lit("pdf"), F.lit("mmd")).alias("markdown"),
        F.replace(name, F.lit(".pdf"), F.lit("_layouts.pdf")).alias("layout"),
    )


def image_output(path: Column) -> Column:
    """Name of the markdown file written for an image."""
    name = F.replace(file_name(path), F.lit(".jpg"), F.lit(".md"))
    return F.replace(name, F.lit(".png"), F.lit(".md"))


def markdown_files(pages: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """Markdown of one kind as pieces of files: ``file``, ``part_index`` and ``piece``.

    ``kind`` is ``tagged`` (``<name>_det.mmd``) or ``markdown`` (``<name>.mmd``) for whole
    documents, and ``eval`` (``<name>.md``), ``result`` (``result.mmd``) or ``original``
    (``result_ori.mmd``) for images, whose pages each are one file. Files stand in the folder of
    their document; those of one name for all documents have a folder for each.
    """
    path = F.col("document_path")
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)

    def beside(name: Column) -> Column:
        return F.array_join(F.concat(parts, F.array(name)), "/")

    if kind in ("tagged", "markdown"):
        texts = markup.markdown_with_tags(pages) if kind == "tagged" else markup.markdown_pages(pages)
        joined = texts.join(docs.select("document_index", "document_path"), "document_index")
        return joined.select(beside(pdf_outputs(path)[kind]).alias("file"), "part_index", F.col("markdown").alias("piece"))
    if kind == "eval":
        named, texts = beside(image_output(path)), markup.eval_markdown(pages)
    elif kind == "result":
        named, texts = F.concat(path, F.lit("/result.mmd")), markup.image_markdown(pages)
    elif kind == "original":
        named, texts = F.concat(path, F.lit("/result_ori.mmd")), pages.withColumn("markdown", F.col("raw_text"))
    else:
        raise ValueError(f"no such kind of markdown: {kind}")
    texts = texts.select("document_index", "page_index", "markdown")
    return texts.join(docs.select("document_index", "document_path"), "document_index").select(
        named.alias("file"), F.col("page_index").alias("part_index"), F.col("markdown").alias("piece")
    )


def write_markdown(named: DataFrame, folder: str, folders: bool = False) -> None:
    """Write rows of ``out_name``, ``part_index``, ``markdown``, and what tells documents apart.

    ``document_index`` and ``document_path`` are written too where there are
    such columns, so documents of one base name in different folders stay
    apart. By default JSON lines sorted by name and part, in as many files as
    tasks. With ``folders`` there is a text folder per document and
    ``out_name``: readable as files, for corpora small enough for that.
    """
    index = [c for c in ("document_index",) if c in named.columns]
    keys = [*index, *[c for c in ("document_path",) if c in named.columns]]
    order = ["out_name", *index, "part_index"]
    sorted_rows = named.repartitionByRange(task_count(named.sparkSession), *order).sortWithinPartitions(*order)
    if folders:
        sorted_rows.select(*index, "out_name", "markdown").write.option("lineSep", "\n").partitionBy(
            *index, "out_name"
        ).text(folder)
    else:
        sorted_rows.select(*keys, "out_name", "part_index", "markdown").write.json(folder)
