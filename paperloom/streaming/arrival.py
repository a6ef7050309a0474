"""Documents as they arrive: each micro-batch runs a batch function on its own rows.

Defined results: rows are handed on as they are, nulls and repeated ones too; files that were seen are not read again; a folder without
new files writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process(spark: SparkSession, source: str, schema: StructType, run: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """Run ``run`` once over every file that is new in ``source`` (Parquet) and end. A batch's result goes to a folder of its own
    below ``sink``, so a batch that is run again after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
