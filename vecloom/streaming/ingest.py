"""Continuous ingest: files of chunks become points in every write target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.embed import Embedder
from vecloom.operators.mutate import prepare_chunks
from vecloom.sources.tables import PointTable, spread, write_checked
from vecloom.spec import PrefixPolicy


def ingest_stream(
    chunks: DataFrame,
    collection: str,
    targets: Sequence[PointTable],
    embedder: Embedder,
    checkpoint: str,
    policy: PrefixPolicy | None = None,
    *,
    rejected_path: str | None = None,
    ordinal: str | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch of the stream ``chunks`` into all targets, until the input is used up.

    Ids are given or hashed, and an upsert of the same rows changes nothing, so a batch that is replayed
    after a failure leaves the tables as one run would.  Chunks that break a rule, or whose vector a target cannot take, are
    written with their reason to ``rejected_path`` (by default beside the checkpoint), one folder per micro-batch.
    """
    rejects = rejected_path or f"{checkpoint.rstrip('/')}-rejected"

    def write(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch may be one small file; the model and the terms want all cores.
        chunks, bad_chunks = prepare_chunks(spread(batch), collection, embedder, policy)
        # Within a batch the last chunk of an id counts; without an order of arrival, the largest text.
        _, bad_points = write_checked(chunks.withColumn("_order", F.col(ordinal or "text")), targets, "_order")
        reasons = [df.select("id", "reason", F.to_json(F.struct(*[c for c in df.columns if c != "reason"])).alias("row")) for df in (bad_chunks, bad_points)]
        reasons[0].unionByName(reasons[1]).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return (
        chunks.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
