"""Incremental re-scan: new files of a tree are parsed once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.csharp import scan_declarations
from ..operators.xml_defs import extract_defs
from ..sources.files import stream_files


def rescan(spark: SparkSession, root: str, target: str, state: str) -> StreamingQuery:
    """Append the definitions and declarations of files not seen yet to
    ``target/defs`` and ``target/declarations``; stops when none is left.

    ``state`` is the stream's checkpoint folder: it remembers the files.  Each
    batch replaces its own partition, so a repeated batch leaves no copies."""

    def add(batch: DataFrame, number: int) -> None:
        for name, suffix, parse in (("defs", "xml", extract_defs), ("declarations", "cs", scan_declarations)):
            rows = parse(batch.where(F.col("ext") == suffix))
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return stream_files(spark, root).writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
