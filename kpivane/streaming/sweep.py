"""WHY sweep over a growing signal table, as bounded micro-batches.

The stream's own checkpoint remembers which files were taken and the ledger which signals are done:
those that were explained, and those that were reported with a reason. A batch replaces its own output
folders, so a repeated batch leaves the same rows; a signal that arrives again in a later file is held
back by the ledger, of which only the parts with the batch's id prefixes are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.why import pending, unexplained
from ..sources.stage import settled

LEDGER_SCHEMA = "signal_id string, batch bigint, prefix string"


def prefix_of(signal_id: str) -> Column:
    """Folder of an id in the ledger: its first two digits, 256 folders for hashed ids."""
    return F.concat(F.lit("p"), F.substring(signal_id, 1, 2))


def ledger_rows(spark: SparkSession, path: str, signals: DataFrame | None = None) -> DataFrame:
    """The ledger, or only its folders that can hold ids of some signals."""
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    if signals is None:
        return rows
    return rows.where(F.col("prefix").isin([r[0] for r in signals.select(prefix_of("signal_id")).distinct().collect()]))


def explain_new_signals(
    spark: SparkSession,
    signals_path: str,
    output: str,
    explain_batch: Callable[[DataFrame], DataFrame],
    schema: StructType,
    files_per_batch: int = 8,
    report: Callable[[DataFrame, DataFrame], DataFrame] = unexplained,
) -> int:
    """Explain every signal not yet in the ledger and stop. Returns the number of batches that had new ones.

    `explain_batch` turns signals into WHY rows (`output/whys`), `report` gives the signals that have none with
    the reason (`output/unexplained`). The ledger takes the signals of both and no others.
    """
    ledger_path, why_path, rest_path = (f"{output}/{name}" for name in ("ledger", "whys", "unexplained"))
    spark.createDataFrame([], "signal_id string").write.mode("ignore").parquet(f"{ledger_path}/batch=-1/prefix=p")

    def batches() -> int:
        return ledger_rows(spark, ledger_path).select("batch").distinct().count()

    before = batches()

    def handle(batch: DataFrame, batch_id: int) -> None:
        once = settled(batch.dropDuplicates(["signal_id"]))
        fresh = settled(pending(once, ledger_rows(spark, ledger_path, once).where(F.col("batch") < batch_id)))
        explain_batch(fresh).write.mode("overwrite").parquet(f"{why_path}/batch={batch_id}")
        whys = spark.read.parquet(f"{why_path}/batch={batch_id}")
        report(fresh, whys).write.mode("overwrite").parquet(f"{rest_path}/batch={batch_id}")
        rest = spark.read.parquet(f"{rest_path}/batch={batch_id}")
        done = whys.select("signal_id").distinct().unionByName(rest.select("signal_id")).withColumn("prefix", prefix_of("signal_id"))
        done.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{ledger_path}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(signals_path)
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{output}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return batches() - before
