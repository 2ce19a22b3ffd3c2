import base64
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from docflow import constants as C
from docflow.sources import files, sinks


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    rows = b"".join(b"\0" + b"\xff" * (3 * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    names = ["b.PNG", "a/b.pdf", "a-1/x.Tiff", "a/c/d.webp", "note.txt", "a/pdf", "z.pdf.bak", "a/e.jpeg"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    return tmp_path


def test_discover_by_extension_and_path_order(spark, folder):
    found = files.discover(spark, str(folder))
    indexed = files.document_index(found).orderBy("document_index").collect()
    names = [r.path.split(f"{folder.name}/")[1] for r in indexed]
    assert names == ["a/b.pdf", "a/c/d.webp", "a/e.jpeg", "a-1/x.Tiff", "b.PNG"]
    assert [r.document_index for r in indexed] == list(range(5))
    first = files.limit_documents(found, 2).collect()
    assert [os.path.basename(r.path) for r in first] == ["b.pdf", "d.webp"]
    with pytest.raises(ValueError):
        files.limit_documents(found, 0)


def test_contents_are_read_on_request_only(spark, folder):
    plan = files.discover(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan
    assert files.discover(spark, str(folder), content=True).first().content == b"x"


def test_image_folder_sizes(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(png(30, 20))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "two.PNG").write_bytes(png(7, 9))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    rows = {os.path.basename(r.path): r for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert (rows["one.png"].width, rows["one.png"].height, rows["one.png"].error) == (30, 20, None)
    assert (rows["two.PNG"].width, rows["two.PNG"].height) == (7, 9)
    assert rows["bad.png"].width is None and rows["bad.png"].error == files.UNREADABLE_ERROR


def test_payload_sizes(spark):
    bmp = b"BM" + bytes(12) + struct.pack("<Iii", 40, 640, -480) + bytes(28)
    df = spark.createDataFrame([(bytearray(png(300, 70000)[:40]),), (bytearray(bmp),), (bytearray(b"GIF"),)], "payload binary")
    rows = files.payload_sizes(df).collect()
    assert [(r.width, r.height) for r in rows] == [(300, 70000), (640, 480), (None, None)]
    assert [r.error for r in rows] == [None, None, files.UNREADABLE_ERROR]


def test_requests(spark):
    image = base64.b64encode(png(2, 2)).decode()
    bodies = [
        json.dumps({"images": [image, image], "prompt": "<image>\nFree OCR."}),
        json.dumps({"images": [image[:8] + "\r\n" + image[8:] + "\n"], "prompt": ""}),
        json.dumps({"images": [image], "prompt": None}),
        json.dumps({"images": []}),
        json.dumps({"prompt": "x"}),
        "{not json",
        json.dumps({"images": [image, "***"]}),
        None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id bigint, body string")
    pages = files.decode_requests(df).orderBy("request_id", "page_index").collect()
    assert [(p.request_id, p.page_index) for p in pages] == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert pages[0].prompt == "<image>\nFree OCR." and pages[2].prompt == pages[3].prompt == C.DEFAULT_PROMPT
    assert bytes(pages[0].payload) == png(2, 2)
    errors = {r.request_id: r.error for r in files.rejected_requests(df).collect()}
    assert errors == {
        3: C.NO_IMAGES_ERROR, 4: C.NO_IMAGES_ERROR, 5: C.INVALID_JSON_ERROR,
        6: "image is not base64", 7: C.INVALID_JSON_ERROR,
    }


def test_output_names(spark):
    df = spark.createDataFrame([("in/my-pdf.pdf",), ("x.jpg",), ("y.png",)], "path string")
    names = df.select(sinks.pdf_outputs(F.col("path")).alias("n"), sinks.image_output(F.col("path")).alias("i")).collect()
    assert tuple(names[0].n) == ("my-pdf_det.mmd", "my-mmd.mmd", "my-pdf_layouts.pdf")
    assert [r.i for r in names[1:]] == ["x.md", "y.md"]


def test_markdown_folders(spark, tmp_path):
    df = spark.createDataFrame([("a.mmd", 0, "é\nx"), ("b.mmd", 0, "y")], "out_name string, part_index bigint, markdown string")
    sinks.write_markdown(df, str(tmp_path / "md"), folders=True)
    (path,) = (tmp_path / "md" / "out_name=a.mmd").glob("part-*")
    assert path.read_text(encoding="utf-8") == "é\nx\n"


def test_documents_of_one_base_name_stay_apart(spark, tmp_path):
    rows = [(0, "a/x.pdf", "x.mmd", 0, "first"), (1, "b/x.pdf", "x.mmd", 0, "second")]
    df = spark.createDataFrame(
        rows, "document_index bigint, document_path string, out_name string, part_index bigint, markdown string"
    )
    sinks.write_markdown(df, str(tmp_path / "lines"))
    read = spark.read.json(str(tmp_path / "lines")).orderBy("document_index").collect()
    assert [(r.document_path, r.markdown) for r in read] == [("a/x.pdf", "first"), ("b/x.pdf", "second")]
    sinks.write_markdown(df, str(tmp_path / "md"), folders=True)
    (path,) = (tmp_path / "md" / "document_index=1" / "out_name=x.mmd").glob("part-*")
    assert path.read_text() == "second\n"


def test_raw_requests(spark):
    df = spark.createDataFrame(
        [("image", bytearray(b"x"), None), ("image", bytearray(), ""), ("pdf", None, "p")],
        "kind string, body binary, prompt string",
    )
    rows = files.check_raw_requests(df).collect()
    assert [r.error for r in rows] == [None, C.EMPTY_IMAGE_ERROR, C.EMPTY_PDF_ERROR]
    assert [r.prompt for r in rows] == [C.DEFAULT_PROMPT, C.DEFAULT_PROMPT, "p"]


def test_sizes_from_other_headers():
    jpeg = bytes.fromhex("FFD8FFE000040000FFDA") + b""
    assert files.header_size(jpeg) is None
    assert files.header_size(bytes.fromhex("FFD8FFE000040000FFC000110800100020") + b"\3") == (32, 16)
    assert files.header_size(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (31 | 15 << 14).to_bytes(4, "little") + b"\0" * 8) == (32, 16)
    assert files.header_size(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\1\x2a\x20\0\x10\0") == (32, 16)
    big = b"MM\0*\0\0\0\x08\0\2\1\0\0\3\0\0\0\1\0\x20\0\0\1\1\0\3\0\0\0\1\0\x10\0\0"
    assert files.header_size(big) == (32, 16)
    assert files.header_size(big[:20]) is None and files.header_size(b"") is None


# -- turned images -----------------------------------------------------------


def exif(orientation, order="<"):
    """Exif data with one tag."""
    head = b"II*\0" if order == "<" else b"MM\0*"
    return head + struct.pack(order + "IHHHIHH", 8, 1, 274, 3, 1, orientation, 0) + struct.pack(order + "I", 0)


def jpeg(width, height, orientation=None, order="<", before=0):
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 2 + before) + b"x" * before
    if orientation:
        body = b"Exif\0\0" + exif(orientation, order)
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 3) + b"rest"


def png_with(width, height, orientation):
    chunk = exif(orientation)
    return (b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0) + b"crc0"
            + struct.pack(">I", len(chunk)) + b"eXIf" + chunk + b"crc0" + struct.pack(">I", 0) + b"IDAT")


def webp(width, height, orientation=None, image=0):
    body = b"VP8X" + struct.pack("<I", 10) + bytes([8 if orientation else 0, 0, 0, 0])
    body += (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little") + b"VP8 " + struct.pack("<I", image) + b"i" * image
    if orientation:
        body += b"EXIF" + struct.pack("<I", len(exif(orientation))) + exif(orientation)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def tiff(width, height, orientation):
    tags = [(256, 4, width), (257, 4, height), (274, 3, orientation)]
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4


SEEN = [
    *[(jpeg(30, 20, o), (20, 30) if o >= 5 else (30, 20)) for o in range(1, 9)],
    (jpeg(30, 20, 6, ">"), (20, 30)), (jpeg(30, 20), (30, 20)), (jpeg(30, 20, 8, before=60_000), (20, 30)),
    (png_with(30, 20, 6), (20, 30)), (png_with(30, 20, 3), (30, 20)), (webp(30, 20, 7), (20, 30)), (webp(30, 20), (30, 20)),
    (webp(30, 20, 5, image=200_000), (20, 30)), (tiff(30, 20, 8), (20, 30)), (tiff(30, 20, 2), (30, 20)),
    (b"", None), (b"\xff\xd8\xff", None), (jpeg(30, 20, 9), (30, 20)),
]


def test_sizes_are_those_of_the_turned_image(spark):
    rows = [(i, bytearray(data)) for i, (data, _) in enumerate(SEEN)]
    got = files.payload_sizes(spark.createDataFrame(rows, "i int, payload binary")).orderBy("i").collect()
    assert [(r.width, r.height) if r.error is None else None for r in got] == [size for _, size in SEEN]


def test_header_sizes_of_a_folder(spark, tmp_path):
    endings = {b"\xff": "JPG", b"\x89": "png", b"R": "webp", b"I": "tiff", b"": "bmp"}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for i, (data, _) in enumerate(SEEN):
        # A long tail, of which nothing may be needed.
        (tmp_path / "in" / ("sub" if i % 2 else ".") / f"{i}.{endings[data[:1]]}").write_bytes(data)
    (tmp_path / "in" / "notes.txt").write_bytes(jpeg(3, 3))
    got = {int(r.path.rpartition("/")[2].split(".")[0]): r for r in files.header_sizes(spark, str(tmp_path / "in"), 3).collect()}
    assert {i: (r.width, r.height) if r.error is None else None for i, r in got.items()} == {i: size for i, (_, size) in enumerate(SEEN)}


def test_only_the_head_of_an_image_is_read():
    class File:
        read = 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def size(self):
            return 50_000_000

        def read_at(self, length, at):
            File.read = max(File.read, at + length)
            return jpeg(30, 20, 6)

    class Store:
        def open_input_file(self, path):
            return File()

    assert files.read_size(Store(), "x.jpg") == (20, 30) and File.read == files.HEAD_BYTES
