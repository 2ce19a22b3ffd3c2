"""Token counts as rollups that are maintained by signed changes.

A change is a document that came, went, or was counted anew: rows of (doc_id,
source, lang, version, tokens) with sign +1 or -1; a revised count is the old
row with -1 and the new one with +1. A commit adds up the changes of a batch
per source, language and tokenizer version, adds them to the totals so far, and
writes the new totals with the numbers of the batches they hold, as one folder
that takes its place under the next version number in one rename. So the totals
are maintained: a read is one small table and a commit costs the batch and the
number of keys, however many batches came before. A batch that is committed
again, after a lost driver or a replay, is found in the totals and left as it is,
so it counts once; what a commit that did not end has left is never read. Of two
writers of one version the later finds it taken and adds to the new totals. The
rename must fail if its target is there, as on HDFS.

Sums are partially aggregated before the shuffle, so a source with a third of
all rows is a few rows by then. Tokenizing is row-local; whether the vocabulary
is there is checked in each task, its path is a parameter.

Defined results: null and empty texts have 0 tokens and count as documents; a
null source or language is a key of its own; a key whose documents all went
stays with 0 documents and 0 tokens; an empty batch commits nothing but itself.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import materialize

KEYS = ["source", "lang", "version"]
RANGES = "first long, last long"
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"
TOKENIZER_FOLDER = "/opt/tokenizers"
# The split of byte-level BPE into pieces, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokens(path: str):
    """Column function: number of tokens of a text by the vocabulary at ``path``."""

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in part], dtype="int64")

    return F.pandas_udf(count, "long")


class Rollup:
    """Totals below a folder that the cluster shares: v=N/totals and v=N/batches, ranges of batch numbers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._store = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, the last is the current one."""
        if not self._store.exists(self._path("")):
            return []
        names = [status.getPath().getName() for status in self._store.listStatus(self._path(""))]
        return sorted(int(name[2:]) for name in names if name.startswith("v="))

    def _table(self, version: int, name: str, schema: str) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v={version}/{name}")

    def _publish(self, work: str, version: int) -> bool:
        """Give the folder ``work`` its version number; False if another writer has taken it."""
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._fs.FileContext.getFileContext(self._store.getUri(), self._conf).rename(
                self._path(work), self._path(f"v={version}"), options
            )
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch of changes once; False if it is in the totals already.

        ``changes`` has the keys, ``tokens`` and ``sign``.
        """
        sums = None
        while True:
            version = (self.versions() or [0])[-1]
            ranges = self._table(version, "batches", RANGES)
            if not ranges.filter(F.lit(batch).between(F.col("first"), F.col("last"))).isEmpty():
                return False
            if sums is None:
                sums = materialize(
                    changes.groupBy(*KEYS).agg(
                        F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("n_tokens")
                    ),
                    "sums",
                )
            work = f"work-{uuid.uuid4().hex}"
            totals = self._table(version, "totals", SUMS).unionByName(sums)
            _added(totals).write.parquet(f"{self.folder}/{work}/totals")
            # The ranges next to the number grow together with it.
            beside = (F.col("last") == batch - 1) | (F.col("first") == batch + 1)
            number = F.lit(batch).cast("long")
            grown = ranges.filter(beside).agg(
                F.least(F.min("first"), number).alias("first"), F.greatest(F.max("last"), number).alias("last")
            )
            ranges.filter(~beside).unionByName(grown).coalesce(1).write.parquet(f"{self.folder}/{work}/batches")
            if self._publish(work, version + 1):
                return True

    def totals(self) -> DataFrame:
        """Documents and tokens of every key, over all committed batches."""
        return self._table((self.versions() or [0])[-1], "totals", SUMS)

    def drop_old(self, keep: int = 2) -> int:
        """Delete all but the last versions, when nothing reads them any more; their number."""
        old = self.versions()[: -max(1, keep)]
        for version in old:
            self._store.delete(self._path(f"v={version}"), True)
        return len(old)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, "tokens", F.lit(1).alias("sign"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, "tokens", F.lit(-1).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts taken back, the new ones added."""
    return deleted(old).unionByName(inserted(new))
