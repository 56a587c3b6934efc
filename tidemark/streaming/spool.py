"""Spool folders, micro-batch scoring, drift monitoring and refitting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import drift
from tidemark.sources.logs import alert_documents


def read_spool(spark: SparkSession, folder: str, schema: str, kind: str = "csv", per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream, oldest first, with their path."""
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_batch).option("latestFirst", "false")
    if kind == "csv":
        reader = reader.option("header", "true")
    return reader.load(folder).withColumn("source_file", F.col("_metadata.file_path"))


def unseen_files(spark: SparkSession, folder: str, manifest: DataFrame | None) -> DataFrame:
    """Files whose (name, size, modification time) the manifest doesn't hold: a changed file counts as new."""
    now = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return now if manifest is None else now.join(manifest, ["path", "length", "modificationTime"], "left_anti")


def watch(stream: DataFrame, score: Callable[[DataFrame], DataFrame], alerts: str, checkpoint: str, emit_all: bool = False, once: bool = True) -> StreamingQuery:
    """Score each micro-batch and write alert documents, below ``alerts`` in a folder named by the batch.

    A batch that is replayed after a failure writes its folder anew, so each
    file's alerts are there once. ``score`` adds attack_probability,
    predicted_class, is_attack and recommended_action. With ``once`` the query
    handles what is there and stops.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch)
        chosen = scored if emit_all else scored.where("is_attack")
        docs = alert_documents(chosen, source=F.col("source_file"))
        docs.select("value").write.mode("overwrite").text(f"{alerts}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


class DriftMonitor:
    """Gathers micro-batches until there are ``window`` rows, then reports PSI against a reference and starts over.

    The reference is reduced once to edges and shares (one row per feature and
    bin). Nothing is kept in memory: below ``folder``, each batch has its rows
    (``buffer``) and the state after it (``state``: window, first batch of the
    window, rows in waiting), each window its report (``reports``), all written
    over when a batch is replayed. So a restarted monitor goes on where the last
    written batch ended, and no row counts twice. Batch ids must rise.
    """

    def __init__(self, reference: DataFrame, columns: Sequence[str], folder: str, window: int = 500, bins: int = 10) -> None:
        self.reference, self.columns, self.folder, self.window, self.bins = reference, list(columns), folder, window, bins

    def state(self, spark: SparkSession, before: int) -> tuple[int, int, int]:
        """(window, its first batch, rows in waiting) as the last batch before this one left them."""
        path = f"{self.folder}/state"
        if not _exists(spark, path):
            return 0, 0, 0
        last = spark.read.schema("window int, since long, waiting long, batch long").parquet(path).where(F.col("batch") < before).orderBy(F.desc("batch")).first()
        return (last["window"], last["since"], last["waiting"]) if last else (0, 0, 0)

    def observe(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: writes ``reports`` rows (window, feature, psi, drift)."""
        spark = batch.sparkSession
        number, since, waiting = self.state(spark, batch_id)
        here = f"{self.folder}/buffer/batch={batch_id}"
        batch.select(*self.columns).write.mode("overwrite").parquet(here)
        waiting += spark.read.schema(batch.select(*self.columns).schema).parquet(here).count()
        if waiting >= self.window:
            held = spark.read.parquet(f"{self.folder}/buffer").where(F.col("batch").between(since, batch_id)).select(*self.columns)
            drift.psi(self.reference, held, self.columns, self.bins).write.mode("overwrite").parquet(f"{self.folder}/reports/window={number}")
            number, since, waiting = number + 1, batch_id + 1, 0
        after = spark.createDataFrame([(number, since, waiting)], "window int, since long, waiting long").coalesce(1)
        after.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def prequential(batches: Sequence[DataFrame], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], first: DataFrame, refit_every: int = 0) -> list[DataFrame]:
    """Score each batch with what was learned before it, then learn: static (0) or refitted every n batches."""
    model, seen, out = fit(first), first, []
    for i, batch in enumerate(batches, 1):
        out.append(model(batch))
        seen = seen.unionByName(batch)
        if refit_every and i % refit_every == 0:
            model = fit(seen)
    return out


def windowed_counts(stream: DataFrame, time: str, by: Sequence[str], width: str, slide: str, late: str) -> DataFrame:
    """Events per sliding window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("events"))


def sessions(stream: DataFrame, time: str, by: Sequence[str], gap: str, late: str) -> DataFrame:
    """Sessions closed by a pause, with their event count."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("events"))
