"""Main text of HTML pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. A bidirectional LSTM reads for each block the path of tags and markers above it and
hashed words of its text, and labels it with regard to the whole page; blocks of the main text are joined. The network is
trained on made-up pages of many layouts, so it needs no labels from the table. It is trained once, on the driver; the weights stay
in the shared folder for later sessions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, table
from .html_blocks import blocks
from .html_lstm import Labeller, trained

#: Pages labelled at once by a task; a block is main text from this probability.
PAGES, LEAST = 128, 0.5


def main_texts(htmls: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page; empty where there is none."""
    out = []
    for i in range(0, len(htmls), PAGES):
        pages = [blocks(h) for h in htmls[i : i + PAGES]]
        for found, p in zip(pages, labeller.probabilities(pages)):
            out.append(" ".join(b.text for b, k in zip(found, p) if k >= LEAST))
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null and empty html give an empty text, repeated rows alike. Null ids and urls stay null, other columns play no part, an empty table gives no rows. Nothing is shuffled."""
    sent = pages.sparkSession.sparkContext.broadcast(trained(folder=f"{shared_dir(pages.sparkSession)}/sparkscope/models"))

    def run(batches):
        for b in batches:
            text = main_texts(b.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
