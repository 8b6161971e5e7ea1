"""Detection over a stream of papers, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect, exploded
from ..functions.text import tag_key


def findings_stream(papers: DataFrame) -> DataFrame:
    """A row for each finding; detection keeps no state, so it runs as it does on tables."""
    return exploded(detect(papers)).withColumn("key", tag_key(F.col("surface")))


def write_findings(papers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append findings as Parquet, exactly once; tags are numbered from that table (tags.numbered_values)."""
    return findings_stream(papers).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
