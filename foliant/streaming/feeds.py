"""The same questions over streams: new files only once, events by day, scores of sessions as they go on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.runtime import checkpoint_folder

LATE = "1 day"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, with the schema of the files that are there.

    A table may be a folder of files or one file; of one file, the stream is over its folder.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def new_files(uploads: DataFrame) -> DataFrame:
    """Each content only once; state is kept until uploads are too late to matter."""
    return uploads.filter("content_hash is not null").withWatermark("created_at", LATE).dropDuplicatesWithinWatermark(["content_hash"])


def daily_events(events: DataFrame) -> DataFrame:
    """day, event_type, n, total of the events by day; a day is final once the stream is a day ahead."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def session_scores(evaluations: DataFrame) -> DataFrame:
    """session, answered, score whenever a session goes on: each item counts once, by its first evaluation.

    evaluations: session long, seq long, item string, points double. The state of a session is the items it has answered;
    of new rows only the first of each item is held, so a session of any length takes the room of its items.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, score = state.get if state.exists else ([], 0.0)
        known, first = set(seen), {}
        for batch in batches:
            for item, seq, points in zip(batch["item"], batch["seq"], batch["points"], strict=True):
                if item not in known and (item not in first or seq < first[item][0]):
                    first[item] = (seq, points)
        for item, (_, points) in sorted(first.items(), key=lambda x: x[1][0]):
            known.add(item)
            score += points
        state.update((sorted(known), score))
        yield pd.DataFrame({"session": [key[0]], "answered": [len(known)], "score": [round(score, 6)]})

    return evaluations.groupBy("session").applyInPandasWithState(fold, "session long, answered long, score double", "seen array<string>, score double", "update", GroupStateTimeout.NoTimeout)


def run(result: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now and give its last state of each batch, from the shared folder.

    Complete results replace one another; updates follow one another, with the number of their batch.
    """
    spark = result.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    query = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{folder}/rows")
