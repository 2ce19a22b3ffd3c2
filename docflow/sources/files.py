"""Reading documents, images and requests."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docflow import constants as C
from docflow.functions.markup import let
from docflow.functions.text import has_extension, or_default, path_parts
from docflow.operators.ordering import dense_position
from docflow.sources.named_files import file_system

UNREADABLE_ERROR = "cannot identify image file"
# Fixed value: the Exif tag that tells how an image is turned.
ORIENTATION = 274


def filter_documents(files: DataFrame, path: str = "path", extensions: tuple[str, ...] = C.DOCUMENT_EXTENSIONS) -> DataFrame:
    """Files with a document extension, in any case."""
    return files.filter(has_extension(F.col(path), extensions))


def discover(
    spark: SparkSession,
    folder: str,
    extensions: tuple[str, ...] = C.DOCUMENT_EXTENSIONS,
    content: bool = False,
) -> DataFrame:
    """Document files below a folder. File contents are read only on request.

    Spark's file listing leaves out names that begin with ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return filter_documents(files.select(*columns), "path", extensions)


def document_index(files: DataFrame, path: str = "path", tie: str | None = None) -> DataFrame:
    """Number files in path order, comparing paths folder by folder."""
    order = [path_parts(F.col(path)).alias("_parts")]
    keyed = files.withColumn("_parts", order[0])
    columns = ["_parts"] + ([tie] if tie else [])
    return dense_position(keyed, columns, "document_index").drop("_parts")


def limit_documents(files: DataFrame, limit: int, path: str = "path") -> DataFrame:
    """The first documents in path order; sorts no more than it returns."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return files.orderBy(path_parts(F.col(path)), path).limit(limit)


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel size of every image below a folder; ``error`` where it cannot be read."""
    images = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "false")
        .load(folder)
    )
    readable = F.col("image.width") > 0
    return images.select(
        F.col("image.origin").alias("path"),
        F.when(readable, F.col("image.width")).alias("width"),
        F.when(readable, F.col("image.height")).alias("height"),
        F.when(~readable, F.lit(UNREADABLE_ERROR)).alias("error"),
    )


def _tiff_tags(data: bytes, wanted: tuple[int, ...]) -> dict[int, int]:
    """First values of some tags in the first directory of TIFF bytes; Exif data has the same form."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return {}
    order = "<" if data[:2] == b"II" else ">"
    found = {}
    try:
        at = struct.unpack_from(order + "I", data, 4)[0]
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind = struct.unpack_from(order + "HH", data, at + 2 + 12 * i)
            if tag in wanted:
                found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
    except struct.error:
        pass
    return found


def _turned(size: tuple[int, int] | None, orientation: int | None) -> tuple[int, int] | None:
    """The size as it is seen: orientations 5 to 8 lie on their side."""
    return size[::-1] if size and orientation in (5, 6, 7, 8) else size


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of JPEG, WebP, TIFF, PNG or BMP bytes as they are seen, from their header.

    An Exif orientation in front of the image data is followed.
    """
    if data[:2] == b"\xff\xd8":
        at, orientation = 2, None
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if marker == 0xFF:  # a fill byte
                at += 1
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return _turned((width, height), orientation)
            elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
                at += 2
            else:
                if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and orientation is None:
                    orientation = _tiff_tags(data[at + 10 :], (ORIENTATION,)).get(ORIENTATION)
                at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            size = int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            at, orientation = 12, None
            while at + 8 <= len(data):
                length = int.from_bytes(data[at + 4 : at + 8], "little")
                if data[at : at + 4] == b"EXIF":
                    exif = data[at + 8 : at + 8 + length].removeprefix(b"Exif\0\0")
                    orientation = _tiff_tags(exif, (ORIENTATION,)).get(ORIENTATION)
                at += 8 + length + length % 2
            return _turned(size, orientation)
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if data[12:16] == b"VP8 ":
            width, height = struct.unpack_from("<HH", data, 26)
            return width & 0x3FFF, height & 0x3FFF
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        size = struct.unpack_from(">II", data, 16)
        at, orientation = 8, None
        while at + 8 <= len(data) and data[at + 4 : at + 8] != b"IDAT":
            length = struct.unpack_from(">I", data, at)[0]
            if data[at + 4 : at + 8] == b"eXIf":
                orientation = _tiff_tags(data[at + 8 : at + 8 + length], (ORIENTATION,)).get(ORIENTATION)
            at += 12 + length
        return _turned(size, orientation)
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return width, abs(height)
    found = _tiff_tags(data, (256, 257, ORIENTATION))
    if 256 in found and 257 in found:
        return _turned((found[256], found[257]), found.get(ORIENTATION))
    return None


IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
HEAD_BYTES = 1 << 16


def read_size(store: fs.FileSystem, path: str) -> tuple[int, int] | None:
    """Size of an image file from its first bytes; more are read only while the header goes on."""
    with store.open_input_file(path) as file:
        total, length = file.size(), HEAD_BYTES
        while True:
            data = file.read_at(min(length, total), 0)
            size = header_size(data)
            # The Exif data of a WebP file stand at its end.
            late = data[12:16] == b"VP8X" and len(data) > 20 and data[20] & 8 > 0
            if (size and not late) or length >= total or len(data) < 4:
                return size
            length *= 16


class _ImageReader(DataSourceReader):
    """Sizes of the image files of a folder, a partition for every ``files_per_task`` of them."""

    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        store, root = file_system(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(IMAGE_EXTENSIONS))
        return [InputPartition(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        for path in partition.value if partition is not None else []:
            try:
                width, height = read_size(store, path) or (None, None)
                yield path, width, height, UNREADABLE_ERROR if width is None else None
            except (OSError, struct.error) as error:
                yield path, None, None, str(error)


class ImageSizes(DataSource):
    """Data source of (path, width, height, error) for the images below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "docflow_image_sizes"

    def schema(self) -> str:
        return "path string, width bigint, height bigint, error string"

    def reader(self, schema) -> _ImageReader:
        return _ImageReader(self.options["path"], int(self.options.get("files_per_task", 1000)))


def header_sizes(spark: SparkSession, folder: str, files_per_task: int = 1000) -> DataFrame:
    """Pixel size as it is seen of every image below a folder, from the headers alone.

    As :func:`image_sizes`, but no image is read as a whole or decoded, and Exif turns are followed.
    ``folder`` must be in a file system that pyarrow reaches. The list of paths is planned on the
    driver, as Spark's own file sources do.
    """
    spark.dataSource.register(ImageSizes)
    return spark.read.format(ImageSizes.name()).option("files_per_task", files_per_task).load(folder)


def payload_sizes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Pixel size from the header of image bytes; ``error`` where there is none.

    An image that its Exif data turn on its side has the size it is seen in. PNG
    without such data and BMP are read natively, and their bytes never reach Python; JPEG,
    WebP and TIFF, whose sizes have no fixed place, are parsed in Arrow batches.
    A BMP height is negative if its rows run from the top.
    """
    data = F.hex(F.substring(F.col(payload), 1, 26))

    def number(first: int, little: bool) -> Column:
        at = [2 * (first + i) + 1 for i in range(4)]
        digits = F.concat(*[F.substring(data, i, 2) for i in (reversed(at) if little else at)])
        return F.conv(digits, 16, 10).try_cast("bigint")

    png = F.startswith(data, F.lit("89504E470D0A1A0A")) & (F.instr(F.col(payload).cast("string"), "eXIf") == 0)
    bmp = F.startswith(data, F.lit("424D"))
    signed = F.when(number(22, True) >= 1 << 31, (1 << 32) - number(22, True)).otherwise(number(22, True))

    def parse(parts: pd.Series) -> pd.Series:
        return pd.Series([list(header_size(x) or ()) if x is not None else None for x in parts], dtype=object)

    other = F.pandas_udf(parse, "array<bigint>")(F.when(~(png | bmp), F.col(payload)))
    sized = df.withColumn("_size", other)
    return (
        sized.withColumn("width", F.when(png, number(16, False)).when(bmp, number(18, True)).otherwise(F.get("_size", F.lit(0))))
        .withColumn("height", F.when(png, number(20, False)).when(bmp, signed).otherwise(F.get("_size", F.lit(1))))
        .withColumn("error", F.when(F.col("width").isNull(), F.lit(UNREADABLE_ERROR)))
        .drop("_size")
    )


def check_raw_requests(df: DataFrame, body: str = "body", kind: str = "kind") -> DataFrame:
    """Requests whose body is an image or, if ``kind`` is ``pdf``, a PDF.

    Fills in the default prompt and adds ``error`` for an empty body.
    """
    empty = F.coalesce(F.octet_length(body), F.lit(0)) == 0
    message = F.when(F.col(kind) == "pdf", C.EMPTY_PDF_ERROR).otherwise(C.EMPTY_IMAGE_ERROR)
    return df.withColumn("prompt", or_default(F.col("prompt"), C.DEFAULT_PROMPT)).withColumn(
        "error", F.when(empty, message)
    )


REQUEST_SCHEMA = T.StructType([
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("prompt", T.StringType()),
    T.StructField("_bad", T.StringType()),
])


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON request bodies as ``request``: ``struct<prompt, payloads, error>``.

    An image that is not base64 fails its whole request.
    """

    def decoded(text: Column) -> Column:
        # Only what is not plain base64 is cleaned: line ends and other characters outside
        # the alphabet are passed over.
        plain = F.try_to_binary(F.nullif(text, F.lit("")), F.lit("base64"))
        cleaned = F.nullif(F.regexp_replace(text, "[^A-Za-z0-9+/=]", ""), F.lit(""))
        return F.coalesce(plain, F.try_to_binary(cleaned, F.lit("base64")))

    def checked(read: Column) -> Column:
        def judged(payloads: Column) -> Column:
            error = (
                F.when(read.isNull() | read["_bad"].isNotNull(), F.lit(C.INVALID_JSON_ERROR))
                .when(F.coalesce(F.size(read["images"]), F.lit(0)) <= 0, F.lit(C.NO_IMAGES_ERROR))
                .when(F.exists(payloads, lambda payload: payload.isNull()), F.lit("image is not base64"))
            )
            return F.struct(
                or_default(read["prompt"], C.DEFAULT_PROMPT).alias("prompt"),
                payloads.alias("payloads"),
                error.alias("error"),
            )

        return let(F.transform(read["images"], decoded), judged)

    read = F.from_json(F.col(body), REQUEST_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    # A generator, since what reads several fields of a plain column would parse once for each.
    return df.select("*", F.explode(F.array(let(read, checked))).alias("request"))


def decode_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per image of the accepted requests, ``page_index`` from 0.

    Rejected requests are left out after the explode.
    """
    accepted = F.when(F.col("request.error").isNull(), F.col("request.payloads"))
    return (
        parse_requests(df, body)
        .select(
            *[c for c in df.columns if c != body],
            "request.prompt",
            F.posexplode_outer(accepted).alias("_at", "payload"),
        )
        .filter("payload is not null")
        .withColumn("page_index", F.col("_at").cast("bigint"))
        .drop("_at")
    )


def rejected_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Requests that were not accepted, with the reason."""
    return (
        parse_requests(df, body)
        .select(*[c for c in df.columns if c != body], F.explode(F.array_compact(F.array("request.error"))).alias("error"))
    )
