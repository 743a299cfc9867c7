"""Extractors as plugs over Arrow batches, tried in the order of a chain.

An extractor is a function from batches of (file_path, content) to batches of ELEMENTS, as ``mapInPandas`` takes it; what loads a
model loads it once per task, not once per file. Files that an extractor leaves without sufficient text go on to the next of the chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ingest import sufficient
from corpusloom.session import cut

ELEMENTS = "file_path string, elem_no int, text string, type string, page int"
Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: At least this many characters of a paragraph's and of a whole page's text are kept by ``plain_text``.
MIN_PARAGRAPH, MIN_PAGE = 10, 30


def plain_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The plain-text extractor: pages at form feeds, paragraphs at blank lines; pages without any long enough stand whole.

    Contents that are null or blank give nothing.
    """
    for pdf in batches:
        made = []
        for path, content in zip(pdf["file_path"], pdf["content"]):
            n = 0
            for page, body in enumerate((content or "").split("\f"), 1):
                parts = [p.strip() for p in body.split("\n\n")]
                parts = [p for p in parts if len(p) > MIN_PARAGRAPH] or ([body.strip()] if len(body.strip()) > MIN_PAGE else [])
                for p in parts:
                    made.append((path, n, p, "Text", page))
                    n += 1
        yield pd.DataFrame(made, columns=["file_path", "elem_no", "text", "type", "page"])


def registered(name: str, registry: dict[str, Extractor]) -> Extractor:
    """The extractor of that name; an unknown one is an error that names those there are."""
    if name not in registry:
        raise ValueError(f"unknown extractor {name!r}; there are {', '.join(sorted(registry))}")
    return registry[name]


def extract(files: DataFrame, chain: list[str], registry: dict[str, Extractor]) -> DataFrame:
    """Elements of every file with the ``extractor`` that gave them: the first of the chain with sufficient text.

    ``files`` is (file_path, content). The last of the chain needs ten characters only. Files for which none
    suffices give no rows, nor do null paths; a path is extracted once. An empty chain gives no rows.
    """
    steps = [(name, registered(name, registry)) for name in chain]
    left = files.where(F.col("file_path").isNotNull()).select("file_path", "content").dropDuplicates(["file_path"])
    out = files.sparkSession.createDataFrame([], f"{ELEMENTS}, extractor string")
    for i, (name, run) in enumerate(steps):
        made = cut(left.mapInPandas(run, ELEMENTS))  # extraction is dear: once per file and step
        sums = made.groupBy("file_path").agg(F.sum(F.char_length("text")).alias("_c"), F.countDistinct("page").alias("_p"))
        good = sums.where(sufficient(F.col("_c"), F.col("_p"), F.lit(i + 1 == len(steps)))).select("file_path")
        out = out.unionByName(made.join(good, "file_path", "left_semi").withColumn("extractor", F.lit(name)))
        left = left.join(good, "file_path", "left_anti")
    return out
