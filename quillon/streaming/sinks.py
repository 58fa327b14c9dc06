"""Write-behind and horizons: coalesced upserts, distinct windows, late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.versions.store import Store, Superseded


def coalesced(batch: DataFrame, key: str, at: str) -> DataFrame:
    """The newest time of each key."""
    return batch.groupBy(key).agg(F.max(at).alias(at))


def write_behind(stream: DataFrame, key: str, at: str, store: Store, dataset: str, table: str, upsert: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Upsert each micro-batch, coalesced, into a versioned table. Taking the newest time makes a repeated batch harmless."""

    def write(batch: DataFrame, _: int) -> None:
        rows = coalesced(batch, key, at)
        for last in range(attempts):
            now = store.current(dataset)
            tables = store.tables(dataset)
            try:
                store.publish(dataset, tables | {table: upsert(tables[table], rows)}, now["schema_version"], now["etag"])
                return
            except Superseded:
                if last == attempts - 1:
                    raise

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_windows(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """Each (keys, time) once within the horizon; later repeats and rows beyond it drop out."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([*keys, at])


def fresher_replica(replicas: DataFrame, key: str) -> DataFrame:
    """The replica of each key with the greatest (epoch, gen, pos), ties by node; torn ones don't count."""
    return replicas.filter(~F.col("torn")).groupBy(key).agg(F.max_by("node", F.struct("epoch", "gen", "pos", "node")).alias("node"), F.max(F.struct("epoch", "gen", "pos")).alias("stamp")).select(key, "node", "stamp.*")


def shipping(primary: DataFrame, follower: DataFrame, key: str, most: int) -> DataFrame:
    """What to ship by key: nothing, reset (from 0), or append (from the follower's place), and how many bytes."""
    f = follower.select(key, F.col("gen").alias("f_gen"), F.col("salt").alias("f_salt"), F.col("pos").alias("f_pos"))
    rows = primary.join(f, key, "left")
    anew = F.col("f_pos").isNull() | (F.col("gen") != F.col("f_gen")) | (F.col("salt") != F.col("f_salt")) | (F.col("f_pos") > F.col("extent"))
    start = F.when(anew, F.lit(0)).otherwise(F.col("f_pos"))
    size = F.least(F.col("extent") - start, F.lit(most))
    return rows.select(key, F.when(~anew & (size == 0), "nothing").when(anew, "reset").otherwise("append").alias("action"), start.cast("bigint").alias("start"), size.cast("bigint").alias("bytes"))
