"""Domain inputs projected from the driver's tables: occurrences, utterances, media, regions, frames, reviews.

Times are whole microseconds since ORIGIN. Every projection names its columns as the operators expect them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str) -> Column:
    """Microseconds of a time-zone-free timestamp column since ORIGIN."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{ORIGIN}', `{name}`)")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One display interval per event: until the user's next event, four hours at most; errors have no content."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("start_us"))
    follow = F.lead("start_us").over(Window.partitionBy("user_id").orderBy("start_us", "event_id"))
    limit = F.col("start_us") + 4 * HOUR
    end = F.least(F.coalesce(follow, limit), limit)
    kind = F.when(F.col("value") < 5, "blank").when(F.col("end_us") - F.col("start_us") < 30 * MINUTE, "short").otherwise("stable")
    return (
        events.withColumn("end_us", end)
        .select(
            F.col("user_id").alias("media_id"),
            F.col("event_id").alias("occ_id"),
            "start_us",
            "end_us",
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("content_id"),
            kind.alias("state_kind"),
            "value",
        )
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One utterance per click or view, six hours after it, a second long per unit of value."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    start = micros("ts") + 6 * HOUR
    return events.select(
        F.col("user_id").alias("media_id"),
        F.col("event_id").alias("utt_id"),
        start.alias("start_us"),
        (start + F.round(F.col("value") * 100).cast("long") * SECOND).alias("end_us"),
        F.concat("event_type", "props").alias("text"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.lit(30 * DAY).alias("duration_us")).distinct()


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large interval table: each order until its customer's next one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", micros("o_orderdate").alias("start_us"))
    follow = F.lead("start_us").over(Window.partitionBy("o_custkey").orderBy("start_us", "o_orderkey"))
    return orders.select(F.col("o_custkey").alias("media_id"), F.col("o_orderkey").alias("occ_id"), "start_us", F.coalesce(follow, F.col("start_us") + DAY).alias("end_us"), F.col("o_orderstatus").alias("content_id"))


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large utterance table: each line item for as many days as its quantity."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", micros("l_shipdate").alias("start_us"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start_us")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("media_id"), key.alias("utt_id"), "start_us", (F.col("start_us") + F.col("l_quantity").cast("long") * DAY).alias("end_us"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region per line of a document: the first is its heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("reading_order", "text"))
    return lines.select(
        F.col("doc_id").alias("content_id"),
        F.col("source").alias("media_id"),
        "reading_order",
        F.when(F.col("reading_order") == 0, "heading").otherwise("paragraph").alias("kind"),
        F.when(F.col("reading_order") % 7 == 6, "application_ui").when(F.col("reading_order") % 5 == 4, "material_context").otherwise("material_body").alias("role"),
        "text",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray frames, one every 50 ms of a label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("media_id"),
        F.col("vec_id").alias("frame_id"),
        (F.col("vec_id") * 50_000).alias("t_us"),
        F.transform("embedding", lambda x: F.round((x.cast("double") + 0.6) * 200).cast("int")).alias("pixels"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per label row: what it is about, why, and whether it is open."""
    reason = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "vision:extraction_failed").when(F.col("quality") == 0, "vision:truncated_output").when(F.col("toxic") == 1, "asr:terms_not_on_screen").otherwise("timeline:check")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("target_ref"), reason.alias("reason"), F.when(F.col("quality") == 1, "resolved").otherwise("open").alias("review_status"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("latency_ms"), F.col("l_suppkey").alias("frame_id"), micros("l_shipdate").alias("created_us"))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as utterances that overlap by two seconds."""
    turns = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 10 * SECOND
    return turns.select(F.col("conv_id").alias("media_id"), F.concat_ws("-", "conv_id", "turn").alias("utt_id"), start.alias("start_us"), (start + 12 * SECOND).alias("end_us"), "text", F.col("role").alias("source"))
