"""Scoring a corpus in waves, so that failed documents cost no more model time.

Pages stand in one order, documents one after the other. A wave is the next
``size`` batches of that order. Its batches run in parallel and are stored; then
the pages that documents failed in it still have ahead are passed over, and the
next wave's batches are packed from the first page left. Since a document's
pages are neighbours, only the document at the end of a wave can have any ahead,
so what is left is always one stretch, known by the position it begins at.

Without failures waves double, so a corpus takes a logarithmic number of them; after
a wave with a failure they halve, down to ``first``. A wave of one batch makes
exactly the calls that a single process would make. In a larger one the pages of
a document that failed in the same wave are scored in vain, and masked later on
by :func:`~docflow.operators.scoring.generated_pages`.

All pages are stored by position before the first wave, and a wave reads no more than the
folders it lies in; so the time of a wave does not grow with the corpus. With failures
the number of waves does, so a wave is one Spark job: what it must know of its failures
is observed as its pages are written, the driver writes the plan, and it looks up the
documents at the ends of waves in what it has read of them for many waves at once.

A wave's plan is stored before it runs and its pages are committed as a whole, so
a run that is started again goes on behind the last complete wave.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow import constants as C
from docflow.operators import scoring
from docflow.operators.ordering import join_by_block, running_offset
from docflow.session import materialize, new_folder, task_count

FIRST_WAVE = 16
# Batches of the pages that are stored in one folder.
FOLDER_BATCHES = 64
# Positions whose documents the driver reads at a time: at most as many rows.
SPAN = 1 << 17


@dataclass
class Wave:
    """One wave: its number, where it begins, its first batch and its number of batches."""

    wave: int
    position: int
    batch: int
    size: int


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _planned(spark: SparkSession, folder: str, number: int) -> Wave | None:
    path = f"{folder}/plans/{number}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        return None
    return Wave(**spark.read.schema("wave long, position long, batch long, size long").json(path).first().asDict())


def place_documents(docs: DataFrame) -> DataFrame:
    """Documents that have pages to score, with the position of their first page."""
    readable = docs.filter("page_count > 0")
    if "render_error" in docs.columns:
        readable = readable.filter("render_error is null")
    return running_offset(
        readable.select("document_index", "page_count"), "document_index", "page_count", out="first_position"
    )


def _write_plan(spark: SparkSession, folder: str, wave: Wave) -> None:
    """One JSON line, written by the driver; ``_SUCCESS`` comes last, as Spark's writers have it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = path(f"{folder}/plans/{wave.wave}")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(place, True)
    for name, text in (("part-00000.json", json.dumps(asdict(wave)) + "\n"), ("_SUCCESS", "")):
        out = store.create(path(place, name), True)
        out.write(text.encode())
        out.close()


def last_failed() -> F.Column:
    """Of page results the last failed batch."""
    return F.max(F.when(F.col("error").isNotNull(), F.col("batch_id"))).alias("last_failed")


class PlacedDocuments:
    """Where the document at a position begins and ends; the driver holds those of ``SPAN`` positions."""

    def __init__(self, placed: DataFrame) -> None:
        self.placed, self.since, self.until = placed, 0, -1

    def around(self, position: int) -> tuple[int, int, int] | None:
        """Number, first position and end of the document that begins before ``position`` and goes on at it."""
        if not self.since <= position < self.until:
            self.since, self.until = position, position + SPAN
            rows = (
                self.placed.filter((F.col("first_position") < self.until) & (F.col("first_position") + F.col("page_count") > self.since))
                .select("document_index", "first_position", "page_count")
                .toArrow()
            )
            numbers, begins, counts = (rows[name].to_numpy() for name in rows.column_names)
            order = np.argsort(begins)
            self.numbers, self.begins, self.ends = numbers[order], begins[order], (begins + counts)[order]
        i = int(np.searchsorted(self.begins, position)) - 1
        return (int(self.numbers[i]), int(self.begins[i]), int(self.ends[i])) if i >= 0 and self.ends[i] > position else None


def next_wave(
    done: Wave, failed: int | None, placed: PlacedDocuments, stored: Callable[[], DataFrame], batch_pages: int, first: int
) -> Wave:
    """The wave after a stored one, whose last failed batch is given.

    The pages of the document at its end are the last ones, so the stored pages are read only
    if the last failed batch is not before the batch of that document's first page.
    """
    end = done.position + done.size * batch_pages
    if failed is None:
        return Wave(done.wave + 1, end, done.batch + done.size, done.size * 2)
    cut = placed.around(end)
    if cut and failed >= done.batch + max(0, cut[1] - done.position) // batch_pages:
        pages = stored()
        own = pages.filter(F.col("document_index") == cut[0]).select("batch_id")
        if not own.join(pages.filter("error is not null").select("batch_id"), "batch_id", "left_semi").isEmpty():
            end = cut[2]
    return Wave(done.wave + 1, end, done.batch + done.size, max(first, done.size // 2))


def place_pages(pages: DataFrame, placed: DataFrame, batch_pages: int) -> DataFrame:
    """The pages of placed documents with their position, stored in folders of ``FOLDER_BATCHES`` batches.

    Without it each wave would go through the whole source for its pages.
    """
    spark = pages.sparkSession
    position = F.col("first_position") + F.col("page_index")
    ready = (
        join_by_block(pages, placed.withColumn("_pages", F.col("page_count")))
        .withColumn("_position", position)
        .withColumn("_folder", F.expr(f"_position div {FOLDER_BATCHES * batch_pages}"))
    )
    path = new_folder(spark, "placed_pages")
    ready.repartition(task_count(spark), "_folder").write.partitionBy("_folder").parquet(path)
    return spark.read.schema(ready.schema).parquet(path)


def wave_pages(stored: DataFrame, wave: Wave, batch_pages: int) -> DataFrame:
    """The pages of a wave with their ``batch_id``, from the folders that :func:`place_pages` made."""
    end = wave.position + wave.size * batch_pages
    step = FOLDER_BATCHES * batch_pages
    return (
        stored.filter(F.col("_folder").between(wave.position // step, (end - 1) // step))
        .filter((F.col("_position") >= wave.position) & (F.col("_position") < end))
        .filter((F.col("first_position") < end) & (F.col("first_position") + F.col("_pages") > wave.position))
        .withColumn("batch_id", F.expr(f"{wave.batch} + (_position - {wave.position}) div {batch_pages}"))
        .drop("first_position", "_pages", "_position", "_folder")
    )


def score_in_waves(
    pages: DataFrame,
    docs: DataFrame,
    scorer: scoring.Scorer,
    outputs: T.StructType,
    keep: list[str],
    folder: str,
    batch_pages: int = C.DEFAULT_BATCH_PAGES,
    first: int = FIRST_WAVE,
    make_scorer: Callable[[], scoring.Scorer] | None = None,
) -> DataFrame:
    """Score all pages but those of documents that failed in an earlier wave.

    Gives the page results of all waves with their ``wave``, stored below ``folder``,
    which executors share. A second call with the same folder goes on from there.
    ``keep`` names the page columns wanted, ``batch_id`` among them. A tag with a
    wrong box fails its batch like a model error.
    """
    if batch_pages < 1 or first < 1:
        raise ValueError("batch_pages and first must be at least 1")
    spark = pages.sparkSession
    # In order, so that what is asked of a document reads few rows.
    placed = materialize(
        place_documents(docs).repartitionByRange(task_count(spark), "first_position").sortWithinPartitions("first_position"), "placed"
    )
    documents = PlacedDocuments(placed)
    stored_pages: DataFrame | None = None
    total = placed.agg(F.max(F.col("first_position") + F.col("page_count"))).first()[0] or 0
    wave: Wave | None = None
    number = 0
    # An empty corpus still has one wave, which gives the table its schema.
    while wave is None or wave.position < total:
        wave = _planned(spark, folder, number) or wave or Wave(0, 0, 0, first)
        path = f"{folder}/pages/wave={number}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            _write_plan(spark, folder, wave)
            if stored_pages is None:
                stored_pages = place_pages(pages, placed, batch_pages)
            ready = wave_pages(stored_pages, wave, batch_pages)
            # All cores have work, and beyond that a task has some batches.
            tasks = min(task_count(spark), max(min(wave.size, 2 * spark.sparkContext.defaultParallelism), wave.size // 4))
            scored = scoring.score_batches(ready, scorer, outputs, keep, tasks, make_scorer)
            # A task that runs again adds nothing to a maximum.
            found = Observation()
            scoring.page_results(scored).observe(found, last_failed()).write.mode("overwrite").parquet(path)
            failed = found.get["last_failed"]
        else:
            failed = spark.read.parquet(path).agg(last_failed()).first()[0]
        wave = next_wave(wave, failed, documents, lambda: spark.read.parquet(path), batch_pages, first)  # noqa: B023
        number += 1
    return spark.read.option("basePath", f"{folder}/pages").parquet(f"{folder}/pages")
