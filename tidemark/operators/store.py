"""State tables as snapshots: every change is a new version of the rows it touches, none is done in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of old and new by key; a new row replaces the old one whole. Of several new rows of a key, the one of the
    largest __seq stays (if there is such a column), then that of the largest values as JSON text."""
    keys = list(keys)
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [F.to_json(F.struct(*[c for c in both.columns if c not in ("__new", "__seq", *keys)])).desc_nulls_last()] if len(both.columns) > len(keys) + 1 else []
    order = [F.desc("__new"), *([F.desc("__seq")] if "__seq" in both.columns else []), *rest]
    ranked = both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n", "__new", "__seq")


def replace_where(old: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """All rows of the scopes (such as media, track) that new has are replaced by those of new."""
    scope = list(scope)
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def cascade(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(kept.select(key), key, "left_semi")


def orphan_keys(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent; empty if the reference holds."""
    return children.join(parents.select(key), key, "left_anti").select(key).distinct()


def clear_open_reviews(reviews: DataFrame, reason_prefix: str = "", target_prefix: str = "") -> DataFrame:
    """Without the open reviews of the prefix; resolved ones stay. Prefixes are taken literally."""
    hit = F.col("reason").startswith(reason_prefix) & F.col("target_ref").cast("string").startswith(target_prefix)
    return reviews.filter(~(hit & (F.col("review_status") == "open")))


def resolve_review(reviews: DataFrame, review_id, status: str = "resolved") -> DataFrame:
    if status not in ("open", "resolved", "wontfix"):
        raise ValueError(status)
    return reviews.withColumn("review_status", F.when(F.col("review_id") == review_id, status).otherwise(F.col("review_status")))


def correct_region(regions: DataFrame, corrections: DataFrame, content_id, reading_order: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Regions with one text corrected (flag user_corrected; content_text keeps what was read) and the log with the
    change appended. Bodies are rebuilt from the result, so that they follow the correction."""
    hit = (F.col("content_id") == content_id) & (F.col("reading_order") == reading_order)
    log = regions.filter(hit).select("content_id", "reading_order", F.col("text").alias("original"), F.lit(text).alias("corrected"))
    flags = F.array_sort(F.array_union("flags", F.array(F.lit("user_corrected"))))
    fixed = regions.withColumn("flags", F.when(hit, flags).otherwise(F.col("flags"))).withColumn("text", F.when(hit, F.lit(text)).otherwise(F.col("text")))
    return fixed, corrections.unionByName(log)


def repaired(regions: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Takes regions out that repeat others of their content (regions: content_id, reading_order, text and more).

    Gives the regions, those that stay flagged where one stands for another that went, and a summary per content that
    changes: content_id, regions_before, regions_after, chars_before, chars_after. With dry_run, regions are as they were.
    """
    from .regions import drop_duplicates

    stay = drop_duplicates(regions).select("content_id", "reading_order", F.col("stands").alias("__stands"))
    told = regions.join(stay, ["content_id", "reading_order"], "left")
    size = F.coalesce(F.length("text"), F.lit(0))
    summary = told.groupBy("content_id").agg(F.count(F.lit(1)).alias("regions_before"), F.count("__stands").alias("regions_after"), F.sum(size).alias("chars_before"), F.sum(F.when(F.col("__stands").isNotNull(), size).otherwise(0)).alias("chars_after"))
    summary = summary.filter("regions_after < regions_before")
    if dry_run:
        return regions, summary
    kept = told.filter("__stands IS NOT NULL")
    if "flags" in regions.columns:
        flags = F.array_sort(F.array_union("flags", F.array(F.lit("duplicate_regions_removed"))))
        kept = kept.withColumn("flags", F.when(F.col("__stands"), flags).otherwise(F.col("flags")))
    return kept.drop("__stands"), summary


def append_metric(metrics: DataFrame, stage: str, name: str, value: float, unit: str = "") -> DataFrame:
    """The log of measures with one more row; earlier rows stay."""
    row = metrics.sparkSession.createDataFrame([(stage, name, float(value), unit)], "stage string, name string, value double, unit string")
    return metrics.unionByName(row, allowMissingColumns=True)


def shown_metrics(metrics: DataFrame) -> DataFrame:
    """stage, name, shown: values without decimals where they are whole, else with three, and the unit."""
    whole = F.abs(F.col("value") - F.col("value").cast("long")) <= 1e-9
    shown = F.when(whole, F.col("value").cast("long").cast("string")).otherwise(F.format_string("%.3f", "value"))
    return metrics.select("stage", "name", F.concat(shown, F.coalesce("unit", F.lit(""))).alias("shown"))


def status_counts(occurrences: DataFrame, utterances: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: occurrences, extracted, utterances, open_reviews."""
    n = F.count(F.lit(1))
    parts = (occurrences.agg(n.alias("occurrences"), F.count("content_id").alias("extracted")), utterances.agg(n.alias("utterances")), reviews.agg(F.count_if(F.col("review_status") == "open").alias("open_reviews")))
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # three tables of one row


def checks(df: DataFrame, **rules: str) -> DataFrame:
    """rule, violations: rows of df for which each rule (SQL) does not hold."""
    return df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()]).select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))


def write_snapshot(df: DataFrame, path: str, partition: str = "media_id") -> None:
    """Replaces the partitions that df has, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
