"""Adapters for what no column can do: rendering pages and recognising their text.

An adapter turns a file's bytes into pages; it runs on Arrow batches of the file source.
None is part of this package; ``pdfium_adapter`` is one for machines with pypdfium2.
The decisions around them (limits, stamped scans, the better of two passes, boxes back in
the original image) are columns in ``ingest`` and ``dateloom.operators.layout``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: dots per inch of rendered pages.
DPI = 200
PAGE = "sha256 string, n int, width int, height int, image binary, text string, failure string"
_SCHEMA = pa.schema(
    [("sha256", pa.string()), ("n", pa.int32()), ("width", pa.int32()), ("height", pa.int32())]
    + [("image", pa.binary()), ("text", pa.string()), ("failure", pa.string())]
)
#: (content) -> pages as dicts with n, width, height, image and text; raises ValueError("password" or "damaged").
Adapter = Callable[[bytes], Iterator[dict]]


def render_pages(files: DataFrame, adapter: Adapter) -> DataFrame:
    """One row per page of files (sha256, content); a file that fails gives one row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = [{"sha256": name, "failure": None, **page} for page in adapter(content)]
                except ValueError as e:
                    pages = [{"sha256": name, "failure": str(e)}]
                yield pa.RecordBatch.from_pylist([{f.name: p.get(f.name) for f in _SCHEMA} for p in pages], schema=_SCHEMA)

    return files.select("sha256", "content").mapInArrow(run, PAGE)


def pdfium_adapter(dpi: int = DPI) -> Adapter:
    """Pages of a PDF by pypdfium2, where that is installed."""

    def pages(content: bytes) -> Iterator[dict]:
        import pypdfium2

        try:
            document = pypdfium2.PdfDocument(content)
        except pypdfium2.PdfiumError as e:
            raise ValueError("password" if "password" in str(e).lower() else "damaged") from e
        for n, page in enumerate(document, 1):
            bitmap = page.render(scale=dpi / 72)
            yield {"n": n, "width": bitmap.width, "height": bitmap.height, "image": bytes(bitmap.buffer), "text": page.get_textpage().get_text_range()}

    return pages
