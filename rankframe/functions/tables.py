"""Table functions that a session's SQL can call with LATERAL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="chunk_index int, start_sentence_index int, end_sentence_index int, text string")
class TextChunks:
    """text_chunks(text, target, least, most, overlap): a text's sentences packed as chunking.chunks does, a row for each chunk.

    The rules are those of `packed`, over one text at a time; a null or blank text gives no row. Column code is the faster way
    for a whole table; this one is for SQL.
    """

    def eval(self, text: str, target: int = 500, least: int = 200, most: int = 750, overlap: int = 4) -> Iterator[tuple[int, int, int, str]]:
        flat = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text or "")))
        flat = re.sub(r"^\s+|\s+\Z", "", flat, flags=re.ASCII)
        parts = [s for s in (x.strip(" ") for x in re.split(r"(?<=[.!?])\s+", flat, flags=re.ASCII)) if s]
        index = start = size = 0
        for i, sentence in enumerate(parts):
            if i > start and size + len(sentence) > target and size >= least or size >= most:
                yield index, start, i - 1, " ".join(parts[start:i])
                start, index = i - min(i - start, overlap), index + 1
                size = sum(map(len, parts[start:i]))
            size += len(sentence)
        if len(parts) > start:
            yield index, start, len(parts) - 1, " ".join(parts[start:])


def register_tables(spark: SparkSession) -> None:
    """Makes text_chunks known to a session."""
    spark.udtf.register("text_chunks", TextChunks)
