"""Message topics and keyed stores as sources and sinks. Files stand in for a broker where there is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.functions.columns import safe_number
from millrace.operators.ranking import latest_per_key

Put = Callable[[DataFrame, int], None]


def topic_source(spark: SparkSession, servers: str, topic: str, *, group: str | None = None, start: str = "latest", most: int | None = None) -> DataFrame:
    """A topic as a stream; most bounds the messages of one batch."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    reader = reader.option("kafka.group.id", group) if group else reader
    return (reader.option("maxOffsetsPerTrigger", most) if most else reader).load()


def file_source(spark: SparkSession, path: str, *, files: int | None = None) -> DataFrame:
    """Text files as a stream of messages (value); files bounds those of one batch."""
    reader = spark.readStream.schema("value string")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).text(path)


def texts(messages: DataFrame, *, null_safe: bool = True) -> DataFrame:
    """value as text; messages without one become empty texts, or go."""
    value = F.col("value").cast("string")
    if null_safe:
        return messages.withColumn("value", F.coalesce(value, F.lit("")))
    return messages.withColumn("value", value).where("value is not null")


def typed_topic(messages: DataFrame, schema: str) -> DataFrame:
    """Messages as columns. Those that aren't JSON go; use streaming.events.parsed to keep them."""
    strict = F.from_json(F.col("value").cast("string"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = messages.select(strict.alias("row")).where("row is not null and row._bad is null")
    return rows.select("row.*").drop("_bad")


def messages(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row as a message: value is its JSON, key its keys joined by an underscore."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(row_key(*keys).alias("key"), value) if keys else df.select(value)


def routed_messages(df: DataFrame, route: Column, fallback: str) -> DataFrame:
    """Messages with the topic that each row names, else the fallback."""
    return df.select(F.coalesce(F.when(F.trim(route) != "", route), F.lit(fallback)).alias("topic"), F.to_json(F.struct(*df.columns)).alias("value"))


def row_key(*parts: str) -> Column:
    """Parts joined by an underscore; null if one is null, so that no two keys fall together."""
    return F.concat(*[p for k, name in enumerate(parts) for p in ([F.lit("_")] if k else []) + [F.col(name).cast("string")]])


def write_topic(df: DataFrame, servers: str, topic: str | None = None) -> None:
    """Write finished messages; acknowledged by all replicas, and without repeats by the producer."""
    writer = df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
    (writer.option("topic", topic) if topic else writer).save()


def upsert(put: Put, keys: list[str], order: list[str], *, deleted: Column | None = None) -> Put:
    """For foreachBatch: pass each batch's newest row per key on to `put`. Deleted rows and rows without a key go."""

    def newest(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(~F.coalesce(deleted, F.lit(False))) if deleted is not None else batch
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        put(latest_per_key(rows, keys, [F.desc(c) for c in order]), batch_id)

    return newest


def to_topic(servers: str, topic: str, keys: list[str] | None = None) -> Put:
    return lambda batch, _: write_topic(messages(batch, keys), servers, topic)


def write_topic_stream(df: DataFrame, servers: str, topic: str, checkpoint: str, keys: list[str] | None = None) -> DataStreamWriter:
    """A writer of a stream's rows as messages of a topic, acknowledged by all replicas."""
    writer = messages(df, keys).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint)


def keyed_table(path: str, keys: list[str], order: list[str], price: str | None = None, *, buckets: int = 64) -> Put:
    """For foreachBatch: merge a batch into a table of one row per key, the newest by `order`; read_keyed() reads it.

    Keys are dealt into buckets. A batch reads and writes the buckets that it
    touches only, into a folder of its version, and a manifest of one row per
    bucket says which version holds which bucket. So a batch that is run again
    writes its version again, none is read while it is written, and a table may begin
    at any batch number. Texts of `price` become numbers; rows without a key go.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(price, safe_number(F.col(price).cast("string"))[0]) if price else batch
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most `buckets` numbers
            held = _manifest(spark, path, n)
            old = [f"{path}/version={held[b]}/_bucket={b}" for b in touched if b in held]
            plain = rows.drop("_bucket")
            # One read of all of them; the bucket follows from the key.
            both = plain.unionByName(spark.read.schema(plain.schema).parquet(*old)) if old else plain
            newest = latest_per_key(both, keys, [F.desc(c) for c in order]).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            newest.repartition(len(touched) or 1, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/version={n}")
            now = held | dict.fromkeys(touched, n)
            spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={n}")
        finally:
            rows.unpersist()

    return put


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> version by the newest manifest of an earlier batch (of all batches without `before`)."""
    try:
        all_ = spark.read.schema("bucket int, version long, batch long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    some = all_ if before is None else all_.where(F.col("batch") < before)
    newest = some.agg(F.max("batch")).first()[0]
    return {r.bucket: r.version for r in some.where(F.col("batch") == newest).collect()} if newest is not None else {}


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that keyed_table() keeps in this folder, as its newest manifest has it."""
    held = _manifest(spark, path)
    paths = [f"{path}/version={v}/_bucket={b}" for b, v in held.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load_in_batches(df: DataFrame, path: str, ts: str, checkpoint: str, every: str = "15 seconds") -> DataStreamWriter:
    """A stream into day partitions, a batch every 15 seconds; the source's `most` bounds a batch's rows (200,000, say)."""
    return df.writeStream.foreachBatch(to_days(path, ts)).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def to_database(url: str, table: str, *, batch: int = 1000, **options: str) -> Put:
    """Append by prepared statements of `batch` rows; columns are bound by name."""
    return lambda rows, _: rows.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).save()


def to_days(path: str, ts: str) -> Put:
    """One folder per batch, with partitions by day below it; a repeated batch overwrites its own."""
    return lambda batch, n: batch.withColumn("ds", F.to_date(ts)).write.mode("overwrite").partitionBy("ds").parquet(f"{path}/batch={n}")


def preview(df: DataFrame, topic: str = "topic", order: list[str] | None = None) -> DataFrame:
    """One message per topic: of a table the first in order, of a stream the first that comes."""
    if df.isStreaming:
        return df.dropDuplicates([topic])
    return latest_per_key(df, [topic], [F.asc(c) for c in order or ["value"]])
