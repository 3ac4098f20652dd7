"""Main text of web pages: a recurrent labeller decides on every block with the whole page in view."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glossweave.llm import block_labeller
from glossweave.llm.common import map_arrow
from glossweave.llm.html_blocks import blocks, features

SCHEMA = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame, part: int = 200) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of each row of pages (page_id, url, html).

    Kept blocks are joined by line feeds in page order.  Null or empty html, and pages
    without main text, give the empty text.  Each row stands for itself; nulls in
    page_id and url stay.  An empty table gives no rows; other columns are not read.  A
    <br> ends a block, as a reader sees it.
    """
    weights = block_labeller.trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), part):
                rows = batch.slice(at, part)
                found = [blocks(h) for h in rows.column(2).to_pylist()]
                keep = block_labeller.label(weights, [features(b) for b in found])
                texts = ["\n".join(b.text for b, k in zip(bs, ks, strict=True) if k) for bs, ks in zip(found, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, SCHEMA)
