"""Placement of a stream of new rows by a frozen model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.refine import placed


def place_stream(rows: DataFrame, centres: DataFrame, floors: DataFrame, decided_path: str, checkpoint: str) -> StreamingQuery:
    """Append (row_id, cluster, sim, batch) for the rows of a stream, cluster null for those
    that reach no floor: they are decided too and not tried again.

    The model is static; each micro-batch drops repeated and already decided rows and writes
    a file set of its own, replaced when the batch is run again, so the sink is idempotent.
    """
    spark = rows.sparkSession
    kind = rows.schema["row_id"].dataType.simpleString()

    def sink(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["row_id"])
        try:
            known = spark.read.schema(f"row_id {kind}, batch long").parquet(decided_path).where(F.col("batch") < batch_id)
            fresh = fresh.join(known.select("row_id"), "row_id", "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise  # else nothing is decided yet
        found = fresh.select("row_id").join(placed(fresh, centres, floors), "row_id", "left").select("row_id", "cluster", "sim")
        found.write.mode("overwrite").parquet(f"{decided_path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
