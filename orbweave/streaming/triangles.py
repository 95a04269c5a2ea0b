"""An extension of our own: a running triangle count over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orbweave.operators.graph import normalised
from orbweave.operators.triangles import triangle_count


def running_triangles(edges: DataFrame, store: str, report, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each batch of a stream of (src, dst) to the edge table at store (one folder a batch, so a batch that runs again replaces itself), then calls report(batch, count) for all edges so far. trigger: how batches are started, as DataStreamWriter.trigger takes it."""

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch.select("src", "dst").write.mode("overwrite").parquet(f"{store}/batch={number}")
        report(number, triangle_count(normalised(spark.read.parquet(store).filter(f"batch <= {number}"))).first()[0])

    writer = edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
