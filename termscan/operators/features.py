"""Per-message feature decisions: the view of features to scan, noise reduction, hit summaries, audits and output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The output tables' columns.
HIT_SUMMARY = "message_id string, run_date date, sent_date date, policy_engine_id string, pipeline_exec_id string, feature_name string, feature_type string, is_noise_reduction boolean, lexicon_terms string, regex_pattern string, total_count_of_terms int, hit_count_of_terms int, hit_details string, process_ts timestamp"
STAGE_AUDIT = "pipeline_exec_id string, process_id string, stage_name string, stage_status string, records_read long, records_written long, start_ts timestamp, end_ts timestamp, error_message string"
RECORD_AUDIT = "pipeline_exec_id string, message_id string, status string, features_applied string, process_ts timestamp"

#: Feature masters are small tables of definitions; they are broadcast up to this many rows.
BROADCAST_MASTER = 100_000


def feature_view(decisions: DataFrame, master: DataFrame) -> DataFrame:
    """Lexicon features of each message with their definitions.

    decisions: process_id, message_id, features array of (type, id, name, feature_op, is_noise_reduction, sub_feature array
    of (name, type)). master: policy_engine_id, feature_name, feature_type, feature_definition, sub_features array of
    (name, type, definition). Composite features count through their lexicon parts.
    """
    each = decisions.select("process_id", "message_id", F.explode("features").alias("f")).select("process_id", "message_id", F.col("f.type").alias("feature_type"), F.col("f.name").alias("feature_name"), F.col("f.feature_op").alias("feature_op"), F.coalesce("f.is_noise_reduction", F.lit(False)).alias("is_noise_reduction"), "f.sub_feature")
    shared = ["process_id", "message_id", "feature_op", "is_noise_reduction"]
    simple = each.where("feature_type = 'lexicon'").select(*shared, "feature_name")
    parts = each.where("feature_type = 'Composite'").select(*shared, F.explode("sub_feature").alias("s")).where("s.type = 'lexicon'").select(*shared, F.col("s.name").alias("feature_name"))
    plain = master.where("feature_type = 'lexicon'").select("policy_engine_id", F.col("feature_name").alias("name"), F.col("feature_definition").alias("definition"))
    nested = master.where("feature_type = 'Composite'").select("policy_engine_id", F.explode("sub_features").alias("s")).where("s.type = 'lexicon'").select("policy_engine_id", F.col("s.name").alias("name"), F.col("s.definition").alias("definition"))
    known = plain.unionByName(nested).distinct()
    known = F.broadcast(known) if master.count() <= BROADCAST_MASTER else known
    both = simple.unionByName(parts)
    return both.join(known, (both["process_id"] == known["policy_engine_id"]) & (both["feature_name"] == known["name"])).select(*shared, "feature_name", "definition")


def wanted_messages(messages: DataFrame, features: DataFrame) -> DataFrame:
    """Messages with at least one feature: a semi-join in place of a list of ids."""
    return messages.join(features.select("message_id"), "message_id", "left_semi")


def parts(messages: DataFrame) -> DataFrame:
    """Body and attachments as rows: part 'msg' and 'attachment-0', 'attachment-1' ..."""
    body = messages.select("message_id", F.lit("msg").alias("part"), F.col("body").alias("text"))
    files = messages.select("message_id", F.posexplode("attachments").alias("i", "text")).select("message_id", F.concat(F.lit("attachment-"), F.col("i").cast("string")).alias("part"), "text")
    return body.unionByName(files)


def grouped_features(features: DataFrame) -> DataFrame:
    """A message's features in one array."""
    return features.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("feature_name", "feature_op", "is_noise_reduction"))).alias("features"))


def featured_messages(messages: DataFrame, features: DataFrame) -> DataFrame:
    """Messages that have features, with all of theirs in one array."""
    return messages.join(grouped_features(features), "message_id")


def noise_decision(features: DataFrame) -> DataFrame:
    """Whether a message is skipped as noise.

    features: message_id, position, feature_op, is_noise_reduction, matched. The operator is the first that is not null, by
    position. OR skips if any noise feature matched, AND if all did; without noise features or operator nothing is skipped.
    """
    noise = F.col("is_noise_reduction")
    found = features.groupBy("message_id").agg(
        F.min(F.when(F.col("feature_op").isNotNull(), F.struct("position", "feature_op")))["feature_op"].alias("op"),
        F.bool_or(F.when(noise, F.col("matched"))).alias("any_noise"),
        F.bool_and(F.when(noise, F.col("matched"))).alias("all_noise"),
    )
    skip = F.when(F.col("op") == "OR", F.col("any_noise")).when(F.col("op") == "AND", F.col("all_noise"))
    return found.withColumn("skipped", F.coalesce(skip, F.lit(False)))


def decided_hits(features: DataFrame) -> DataFrame:
    """Matched features that are written: the noise ones of skipped messages, the standard ones of others."""
    return features.where("matched").join(noise_decision(features).select("message_id", "skipped"), "message_id").where("is_noise_reduction = skipped").select("message_id", "feature_name", F.when(F.col("skipped"), "NOISE_REDUCTION").otherwise("STANDARD").alias("hit_type"))


def hit_summary(hits: DataFrame, total_terms: int, keys: list[str]) -> DataFrame:
    """Of each group: terms hit, joined by commas, how many, and how many the lexicon has. hits: keys and term_id."""
    return hits.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("term_id")), ",").alias("lexicon_terms"), F.countDistinct("term_id").alias("hit_count_of_terms")).withColumn("total_count_of_terms", F.lit(total_terms).cast("long"))


def hit_details(hits: DataFrame) -> DataFrame:
    """Each message's matches as JSON by part. hits: message_id, part, term_id, match_text, byte_start, byte_end, delta."""
    match = F.struct(F.col("byte_start").alias("start_index"), F.col("byte_end").alias("end_index"), "term_id", "match_text", "delta")
    by_part = hits.groupBy("message_id", "part").agg(F.array_sort(F.collect_list(match)).alias("found"))
    ordered = F.transform("found", lambda m: F.struct(m["term_id"].alias("term_id"), m["match_text"].alias("match_text"), m["start_index"].alias("start_index"), m["end_index"].alias("end_index"), m["delta"].alias("delta")))
    by_part = by_part.select("message_id", F.struct("part", F.struct(ordered.alias("matches")).alias("x")).alias("entry"))
    return by_part.groupBy("message_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("entry")))).alias("hit_details"))


def record_audit(messages: DataFrame, decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Each message's state: SKIPPED as noise, PROCESSED, or FAILED without a body; and its hits."""
    counts = hits.groupBy("message_id").agg(F.count("*").alias("n_hits"))
    joined = messages.select("message_id", "body").join(decisions.select("message_id", "skipped"), "message_id", "left").join(counts, "message_id", "left")
    return joined.select("message_id", F.when(F.col("body").isNull(), "FAILED").when(F.col("skipped"), "SKIPPED").otherwise("PROCESSED").alias("status"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def stage_audit(records: DataFrame, stage: str) -> DataFrame:
    """Counts of a stage and its state: SUCCESS, PARTIAL or FAILED."""
    n, bad = F.count("*"), F.count_if(F.col("status") == "FAILED")
    return records.agg(F.lit(stage).alias("stage"), n.alias("records"), bad.alias("failed"), F.when(bad == 0, "SUCCESS").when(bad < n, "PARTIAL").otherwise("FAILED").alias("status"))


def shaped(rows: DataFrame, schema: str, **values: Column | object) -> DataFrame:
    """rows as an output table: its columns in order and type, from `values`, else from rows, else null."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    columns = []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        value = given[name] if name in given else F.col(name) if name in rows.columns else F.lit(None)
        columns.append(value.cast(kind).alias(name))
    return rows.select(*columns)


def write_outputs(path: str, hits: DataFrame, stages: DataFrame, records: DataFrame) -> None:
    """The three output tables: lexicon-hit-summary by run date (the runs in hits are replaced), and the two audits, appended."""
    shaped(hits, HIT_SUMMARY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{path}/lexicon-hit-summary")
    shaped(stages, STAGE_AUDIT).write.mode("append").parquet(f"{path}/pipeline_stage_audit")
    shaped(records, RECORD_AUDIT).write.mode("append").parquet(f"{path}/pipeline_record_audit")
