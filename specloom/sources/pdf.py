"""PDF pages, pictures and OCR as pluggable page functions; the libraries behind them are optional.

A Renderer gives page counts, texts and pictures of a PDF. Spark hands each task a stream of PDFs
and takes back a row per page, so a file's pages never wait for each other in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.views import best_attempts

DPI_STEPS = (200, 250, 300)
QUALITIES = (85, 70, 50, 30)
MAX_IMAGE_BYTES = 4 * 1024 * 1024


class Renderer(Protocol):
    def pages(self, pdf: bytes) -> int: ...
    def text(self, pdf: bytes, page: int) -> str: ...
    def has_images(self, pdf: bytes, page: int) -> bool: ...
    def picture(self, pdf: bytes, page: int, dpi: int, gray: bool) -> bytes: ...
    def read(self, picture: bytes) -> str: ...


def library_renderer() -> Renderer:
    """A renderer over PyMuPDF and Tesseract, where they are installed."""
    import fitz
    import pytesseract
    from PIL import Image

    class Installed:
        def pages(self, pdf):
            with fitz.open(stream=pdf, filetype="pdf") as doc:
                return doc.page_count

        def text(self, pdf, page):
            with fitz.open(stream=pdf, filetype="pdf") as doc:
                return doc[page].get_text("text")

        def has_images(self, pdf, page):
            with fitz.open(stream=pdf, filetype="pdf") as doc:
                return bool(doc[page].get_images())

        def picture(self, pdf, page, dpi, gray):
            with fitz.open(stream=pdf, filetype="pdf") as doc:
                return doc[page].get_pixmap(dpi=dpi, colorspace=fitz.csGRAY if gray else fitz.csRGB).tobytes("png")

        def read(self, picture):
            import io

            return pytesseract.image_to_string(Image.open(io.BytesIO(picture)))

    return Installed()


def page_rows(files: DataFrame, renderer: Callable[[], Renderer], first: int = 0, last: int | None = None) -> DataFrame:
    """files (spec_id, content) to spec_id, page_index, text, has_images for pages first to last, both included; bounds outside a file raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = renderer()
        for batch in batches:
            for spec, pdf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = own.pages(pdf)
                end = n - 1 if last is None else last
                if not 0 <= first <= end < n:
                    raise ValueError(f"pages {first} to {end} are not all in a file of {n}")
                for i in range(first, end + 1):
                    row = ([spec], [i], [own.text(pdf, i)], [own.has_images(pdf, i)])
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=["spec_id", "page_index", "text", "has_images"])

    return files.select("spec_id", "content").mapInArrow(run, "spec_id string, page_index int, text string, has_images boolean")


def routed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("route", T.page_route(F.col("text"), F.col("has_images")))


def read_attempts(pictures: DataFrame, renderer: Callable[[], Renderer]) -> DataFrame:
    """pictures (spec_id, page_index, dpi, picture) to the best reading of each page."""

    @F.pandas_udf("string")
    def read(data):
        own = renderer()
        return data.map(lambda x: own.read(bytes(x)) if x is not None else "")

    tried = pictures.withColumn("text", read("picture")).drop("picture")
    tried = tried.withColumn("alnum", T.alnum_count(F.col("text"))).withColumn("words", T.word_count(F.col("text")))
    return best_attempts(tried.withColumn("passes", T.passes_quality(F.col("alnum"), F.col("words"))), ["spec_id", "page_index"])


def compress(picture: bytes, encode: Callable[[bytes, int, float], bytes], most: int = MAX_IMAGE_BYTES) -> bytes:
    """The picture encoded at falling qualities, then at halved sizes, until it is small enough."""
    scale = 1.0
    while scale > 1 / 64:
        for quality in QUALITIES:
            out = encode(picture, quality, scale)
            if len(out) <= most:
                return out
        scale /= 2
    return out


def select_pages(files: DataFrame, build: Callable[[bytes, list[int]], bytes]) -> DataFrame:
    """files (spec_id, content, pages) to small PDFs of the pages listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specs, contents, pages = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(specs, pa.string()), pa.array([build(c, p) for c, p in zip(contents, pages, strict=True)], pa.binary())], names=["spec_id", "content"])

    return files.select("spec_id", "content", "pages").mapInArrow(run, "spec_id string, content binary")
