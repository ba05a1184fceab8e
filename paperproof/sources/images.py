"""Scanned images to lines of text. The OCR itself is a plug-in, as is what cuts a file into pages; Tesseract and Pillow are used if they are installed.

A file or page that can't be read is a row with its error, and no fault of one ends the others' task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperproof.operators.ocr_lines import lines_from_words

_WORD = "struct<top:bigint,left:bigint,text:string,conf:double>"
_PAGE = pa.schema([("document_id", pa.string()), ("page", pa.int32()), ("words", pa.list_(pa.struct([("top", pa.int64()), ("left", pa.int64()), ("text", pa.string()), ("conf", pa.float64())]))), ("error", pa.string())])
#: bytes of a page to columns top, left, text, conf of its words
Ocr = Callable[[bytes], dict[str, list]]
#: bytes of a file to those of its pages, one after the other
Cut = Callable[[bytes], Iterator[bytes]]


def tesseract(image: bytes) -> dict[str, list]:
    import io

    import pytesseract
    from PIL import Image

    return pytesseract.image_to_data(Image.open(io.BytesIO(image)), output_type=pytesseract.Output.DICT)


def one_page(content: bytes) -> Iterator[bytes]:
    yield content


def frames(content: bytes) -> Iterator[bytes]:
    """The frames of an image file that may have several, as PNG; for Pillow."""
    import io

    from PIL import Image, ImageSequence

    for frame in ImageSequence.Iterator(Image.open(io.BytesIO(content))):
        out = io.BytesIO()
        frame.convert("RGB").save(out, "PNG")
        yield out.getvalue()


def words_from_columns(df: DataFrame) -> DataFrame:
    """Rows of parallel arrays (document_id, top, left, text, conf) to one row per word, as lines_from_words takes them."""
    zipped = df.select("document_id", F.posexplode(F.arrays_zip("top", "left", "text", "conf")).alias("word_idx", "w"))
    return zipped.select("document_id", "word_idx", F.col("w.top").cast("long").alias("top"), F.col("w.left").cast("long").alias("left"), "w.text", F.col("w.conf").cast("double").alias("conf"))


def read_images(spark: SparkSession, path: str, *, bytes_per_task: int = 32 << 20) -> DataFrame:
    """path, content of the files under a path, dealt to as many tasks as their bytes ask for: the scan alone would put thousands of small
    scans, minutes of OCR each, in one task. Sizes are read without contents."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    return files.select("path", "content").repartition(max(1, math.ceil(size / bytes_per_task)))


def read_pages(images: DataFrame, ocr: Ocr = tesseract, cut: Cut = one_page) -> DataFrame:
    """images(path, content) to document_id (the path), page (from 0), words (array of top, left, text, conf), error: a row for each page. A file
    that can't be cut has its error at the page where that was; a page that can't be read has its own. A task holds one file at a time."""

    def words(page: bytes) -> list[dict]:
        got = ocr(page)
        return [{"top": int(t), "left": int(x), "text": w, "conf": float(c)} for t, x, w, c in zip(got["top"], got["left"], got["text"], got["conf"], strict=True)]

    def of_file(path: str, content: bytes) -> Iterator[dict]:
        k, parts = 0, iter(())
        said = lambda e: f"{type(e).__name__}: {e}"
        while True:
            try:
                if k == 0:
                    parts = iter(cut(content))
                page = next(parts, None)
            except Exception as e:  # noqa: BLE001  whatever a library makes of broken bytes is this file's error
                yield {"document_id": path, "page": k, "words": [], "error": said(e)}
                return
            if page is None:
                return
            try:
                yield {"document_id": path, "page": k, "words": words(page), "error": None}
            except Exception as e:  # noqa: BLE001
                yield {"document_id": path, "page": k, "words": [], "error": said(e)}
            k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                for row in of_file(path.as_py(), content.as_py() or b""):
                    yield pa.RecordBatch.from_pylist([row], _PAGE)

    return images.select("path", "content").mapInArrow(run, f"document_id string, page int, words array<{_WORD}>, error string")


def read_words(images: DataFrame, ocr: Ocr = tesseract) -> DataFrame:
    """images(path, content) to words, as lines_from_words takes them; an image's path is its document_id. Images that can't be read have none."""
    return read_pages(images, ocr).select("document_id", F.posexplode("words").alias("word_idx", "w")).select("document_id", "word_idx", "w.*")


def lines_of_pages(pages: DataFrame, *, line_tolerance_px: int = 10) -> DataFrame:
    """Pages as read_pages gives them to document_id, line_idx, text, confidence, page, error. Lines are counted through a document's pages;
    a page with an error is a row without a line."""
    each = F.to_json(F.struct("document_id", "page"))  # lines never run over pages
    words = pages.select(each.alias("document_id"), F.posexplode("words").alias("word_idx", "w")).select("document_id", "word_idx", "w.*")
    at = F.from_json("document_id", "document_id string, page int")
    lines = lines_from_words(words, line_tolerance_px=line_tolerance_px).withColumn("at", at).select("at.document_id", "at.page", "line_idx", "text", "confidence")
    lines = lines.withColumn("line_idx", F.row_number().over(W.partitionBy("document_id").orderBy("page", "line_idx")) - 1)
    bad = pages.where("error IS NOT NULL").select("document_id", F.lit(None).cast("int").alias("line_idx"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"), "page", "error")
    return lines.select("document_id", "line_idx", "text", "confidence", "page", F.lit(None).cast("string").alias("error")).unionByName(bad)


def read_image_lines(spark: SparkSession, path: str, *, ocr: Ocr = tesseract, cut: Cut = one_page, line_tolerance_px: int = 10, bytes_per_task: int = 32 << 20, store: str | None = None) -> DataFrame:
    """The lines of the image files under a path; see lines_of_pages. OCR is slow and its pages are read twice, for lines and for errors: they are
    written once to ``store``, by default a new path in the shared folder."""
    from paperproof.sources.shared import new_path

    store = store or new_path(spark, "pages")
    read_pages(read_images(spark, path, bytes_per_task=bytes_per_task), ocr, cut).write.mode("overwrite").parquet(store)
    return lines_of_pages(spark.read.parquet(store), line_tolerance_px=line_tolerance_px)
