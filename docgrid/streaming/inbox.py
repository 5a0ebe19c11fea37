"""Score maps that arrive in a folder, recovered batch by batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docgrid.plans.recovery import Limits, recover_tables
from docgrid.schemas import PIXEL


def recover_stream(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, limits: Limits | None = None) -> StreamingQuery:
    """Reads Parquet score maps as they arrive and writes their tables below outbox, a folder per batch.

    All pixels of a document arrive in one file. A batch that is done again after a failure replaces its folder.
    """

    def step(batch: DataFrame, number: int) -> None:
        recover_tables(batch, limits=limits).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    return spark.readStream.schema(PIXEL).parquet(inbox).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
