"""The line detectors over a stream of text rows.

Detection is stateless per row, so the batch plan runs unchanged; there is nothing to
window or to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from quietkey.operators.findings import public_findings
from quietkey.plans.scan import scan_text


def stream_findings(
    stream: DataFrame, path: Column, text: Column, project: Column, output: str, checkpoint: str
) -> StreamingQuery:
    """Append masked findings of new rows to a parquet folder and stop when caught up."""
    found = public_findings(scan_text(stream, path, text, project)).drop("ml_advisory")
    return (
        found.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(output)
    )
