"""The commands as functions over a session folder and a store (sources.store) in which each leaves its results.

Nothing is changed in the session folder. What a flow finds is committed to the store and laid over the folder by the
next flow that reads it, so label-auto, relabel, filter, review, stats and export see each other's results. A flow that
is repeated adds the same rows again, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.hashing import change_ratios, hash_bits, image_statistics
from loomframe.operators import candidates, dedup, labels, quality, review, teaching
from loomframe.operators.split import numbered
from loomframe.runtime import checkpoint
from loomframe.sources import image_files, readers, writers
from loomframe.sources import store as stores
from loomframe.sources.taxonomy import Settings

KEYS = stores.KEYS


def _images(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """session_id, sample_id, image of the samples' pre.png or post.png that can be decoded."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder)
    return found.select(*readers.place(F.col("image.origin")), "image")


def load(spark: SparkSession, folder: str, store: str | None = None) -> DataFrame:
    """The samples as operators and writers take them: what folder and store hold together, effective label, flags of the
    last filter run, event as JSON (and its parts), image and its size, ord over all samples. Written once."""
    rows = labels.effective_label(stores.merged(spark, folder, store))
    sizes = _images(spark, folder, "pre.png").select(*KEYS, F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    flags = F.from_json(F.get_json_object("metadata", "$.filter.flags"), "array<string>")
    rows = rows.join(sizes, KEYS, "left").withColumn("flags", flags).withColumn("trigger", F.col("event"))
    rows = rows.withColumn("action", F.col("event.action")).withColumn("x", F.col("event.x"))
    rows = rows.withColumn("y", F.col("event.y")).withColumn("key", F.col("event.key")).withColumn("event", F.to_json("event"))
    return checkpoint(numbered(rows, KEYS, "ord"))


def _entries(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows of the metadata part: an entry for each name whose JSON isn't null."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items())))
    return rows.select(*KEYS, each.alias("e")).select(*KEYS, "e.*").where("value IS NOT NULL")


def _clusters(rows: DataFrame, hashes: DataFrame, threshold: int) -> DataFrame:
    """ord, leader, cluster_id, is_representative over all rows; hashes: session_id, sample_id, hash."""
    hashed = checkpoint(rows.select(*KEYS, "ord").join(hashes, KEYS, "left"))
    led = dedup.cluster_ids(hashed, "hash", "ord", threshold)
    return checkpoint(led.select("ord", "leader", "cluster_id", "is_representative"))


def _words(dims: dict[str, DataFrame], name: str, column: str) -> list[str]:
    return [r[0] for r in dims[name].orderBy("ord").select(column).collect()]  # a taxonomy's ids


def _requests(rows: DataFrame, dims: dict[str, DataFrame]) -> Column:
    """What the teacher gets: the event, the ids to choose from, the regions, the label so far, metadata, the image."""
    regions = F.array(*(F.lit(n) for n in _words(dims, "roi", "roi_name"))).cast("array<string>")
    now = F.when(F.col("label").isNotNull(), F.struct("label.page", "label.route_label", "label.confidence"))
    return teaching.payload(
        F.col("ord"),
        F.col("event"),
        _words(dims, "primitive", "primitive_id"),
        _words(dims, "situation", "situation_id"),
        rois=regions,
        metadata=F.col("metadata"),
        current_label=now,
        pre_image_b64=F.base64("content"),
    )


def _local(rows: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """ord, local: the whole label that hotkeys and regions give a row with an image."""
    at = candidates.event_position(F.col("metadata"), F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    placed = rows.withColumn("__at", at).withColumn("__x", F.col("__at.x")).withColumn("__y", F.col("__at.y"))
    found = labels.hotkey_match(labels.roi_hits(placed, dims["roi"], "__x", "__y"), dims["element"], "key")
    found = labels.local_labels(found, dims["situation"])
    primary = dims["situation"].select(
        F.col("situation_id").alias("__sid"), labels.primary_roi(F.col("roi_priority"), F.col("likely_rois")).alias("__roi"),
    )
    found = found.join(primary, F.col("situation_id") == F.col("__sid"), "left")
    evidence = F.to_json(
        F.struct(
            F.lit("local_routing_fallback").alias("mode"),
            F.col("signals").alias("signals_used"),
            F.parse_json("event").alias("event"),
            F.col("roi_hits").alias("matched_rois"),
        )
    )
    own = labels.routing_label(
        F.col("trigger"), F.col("primitive_id"), F.col("situation_id"), F.col("screen_type"), F.col("__roi"),
        F.lit(None).cast("array<double>"), F.col("confidence"), evidence,
    )
    return found.select("ord", F.when(F.col("width").isNotNull(), own).alias("local"))


def label_auto(
    spark: SparkSession,
    folder: str,
    dims: dict[str, DataFrame],
    store: str,
    teacher: Callable = teaching.offline,
    settings: Settings | None = None,
) -> DataFrame:
    """One row: unlabeled, clusters, labeled, teacher_calls, fallback, copied, blocked, calls_saved.

    Samples with an event and no label are clustered by near-equal screens, and the teacher is asked once a cluster (none
    with the provider local_vlm). Where it doesn't answer, the local labeler does if provider_fallback_to_local is set
    and the sample has an image; otherwise the cluster stays without labels. Samples without an image are clusters of
    one. Labels go to the store whole, and so do the metadata entries label_auto, label_auto_provider and filter.
    """
    settings = settings or Settings()
    own = settings.labeler
    rows = load(spark, folder, store).where("event IS NOT NULL AND label IS NULL")
    blocks = image_statistics(_images(spark, folder, "pre.png").select("image"))
    hashes = blocks.select(*readers.place(F.col("path")), hash_bits(F.col("block")).alias("hash"))
    led = _clusters(rows, hashes, settings.filter.dedup_hash_threshold)
    leaders = checkpoint(rows.join(led.where("is_representative").select("ord"), "ord"))
    asked = own.provider != "local_vlm"
    with_image = image_files.fetched(leaders, "image_path")
    requests = with_image.withColumn("request", _requests(with_image, dims))
    told = teaching.teach(requests, "ord", "request", teacher if asked else teaching.offline, settings.relabel.max_retries if asked else 1)
    local = _local(leaders, dims)
    both = leaders.join(told.select("ord", "chosen"), "ord").join(local, "ord")
    taught = F.col("chosen").isNotNull()
    usable = F.lit(own.provider_fallback_to_local or not asked) & F.col("local").isNotNull()
    # the sample has no label yet, so the teacher's answer has nothing to fall back to
    answer = labels.taught_label(F.lit(None).cast(labels.LABEL), F.col("chosen"), F.col("trigger"))
    result = both.select(
        F.col("ord").alias("leader"),
        F.col("sample_id").alias("source_sample_id"),
        F.when(taught, answer).when(usable, F.col("local")).alias("new"),
        F.when(taught, "teacher").when(usable, "fallback").otherwise("failed").alias("by"),
    )
    every = checkpoint(rows.drop("label").join(led, "ord").join(checkpoint(result), "leader"))
    has, first = F.col("by") != "failed", F.col("is_representative")
    provider = F.when(F.col("by") == "fallback", "local_vlm").otherwise(own.provider)
    status = F.when(first, F.when(has, "ok").otherwise("failed")).otherwise(
        F.when(has, "copied_from_representative").otherwise("blocked_by_representative_failure")
    )
    stamp = F.struct(
        provider.alias("provider"),
        F.when(provider != "local_vlm", settings.relabel.model_name).alias("model_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("processed_at"),
        status.alias("status"),
        F.when(first & (F.col("by") == "fallback") & F.lit(asked), own.provider).alias("fallback_from"),
        F.when(~first, F.col("source_sample_id")).alias("source_sample_id"),
        F.when(~first, F.when(has, "ok").otherwise("failed")).alias("source_provider_status"),
    )
    flags = quality.merge_flags(F.col("flags"), F.array().cast("array<string>"), first)
    filtered = F.struct(flags.alias("flags"), F.col("cluster_id"), first.alias("cluster_representative"))
    score = F.get_json_object("metadata", "$.filter.score").cast("double")
    label = F.col("new")
    auto = F.struct(label["page"].alias("page"), label["route_label"].alias("route_label"), label["confidence"].alias("confidence"), F.parse_json(label["evidence"]).alias("evidence"))
    entries = {
        "label_auto_provider": F.to_json(stamp),
        "filter": F.to_json(filtered.withField("score", score)),
        "label_auto": F.when(has, F.to_json(auto)),
    }
    stores.save(store, label=every.where(has).select(*KEYS, label.alias("label")), metadata=_entries(every, entries))
    n = lambda test: F.count_if(test)
    return every.agg(
        F.count("*").alias("unlabeled"),
        n(first).alias("clusters"),
        n(has).alias("labeled"),
        n(first & F.lit(asked)).alias("teacher_calls"),
        n(first & (F.col("by") == "fallback")).alias("fallback"),
        n(~first & has).alias("copied"),
        n(~first & ~has).alias("blocked"),
        n(~first & has & F.lit(asked)).alias("calls_saved"),
    )


def relabel(
    spark: SparkSession,
    folder: str,
    dims: dict[str, DataFrame],
    store: str,
    teacher: Callable = teaching.offline,
    settings: Settings | None = None,
) -> DataFrame:
    """processed, success, failed: ask the teacher again for labeled samples; answers become the samples' labels.

    A sample whose labels a review has edited keeps the corrections over the new label.
    """
    limits = (settings or Settings()).relabel
    rows = load(spark, folder, store).where("label IS NOT NULL AND trigger IS NOT NULL")
    taken = checkpoint(rows if limits.max_samples is None else rows.orderBy("ord").limit(limits.max_samples))
    with_image = image_files.fetched(taken, "image_path")
    requests = with_image.withColumn("request", _requests(with_image, dims))
    done = checkpoint(teaching.relabel(requests, "ord", "ord", "request", teacher, None, limits.max_retries))
    told = taken.join(done, "ord")
    raw = stores.merged(spark, folder, store).select(*KEYS, F.col("label").alias("raw"))
    new = told.where("status = 'ok'").join(raw, KEYS)
    stamp = F.struct(
        F.lit(limits.provider).alias("provider"),
        F.lit(limits.model_name).alias("model_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("processed_at"),
        F.col("status"),
        F.when(F.col("status") == "ok", "routing_only").alias("mode"),
    )
    stores.save(
        store,
        label=new.select(*KEYS, labels.taught_label(F.col("raw"), F.col("chosen"), F.col("trigger")).alias("label")),
        metadata=_entries(told, {"relabel": F.to_json(stamp)}),
    )
    return teaching.relabel_counts(done)


def filter_samples(spark: SparkSession, folder: str, store: str, settings: Settings | None = None) -> DataFrame:
    """drop_stage, n over labeled samples: invalid_action, quality, transition, dedup, and kept.

    The metadata entry filter (flags, score, cluster_id, cluster_representative) of every labeled sample goes to the
    store. Clusters are over all of them, dropped ones too, and nothing is rejected: reject() does that.
    """
    rows = checkpoint(_filtered(spark, folder, store, settings))
    entry = F.struct("flags", "score", "cluster_id", F.col("is_representative").alias("cluster_representative"))
    stores.save(store, metadata=_entries(rows, {"filter": F.to_json(entry)}))
    return quality.drop_counts(rows)


def _filtered(spark: SparkSession, folder: str, store: str | None, settings: Settings | None) -> DataFrame:
    """The labeled samples with drop_stage, flags, score and cluster."""
    limits = (settings or Settings()).filter
    rows = load(spark, folder, store).where("label IS NOT NULL AND event IS NOT NULL")
    before, after = _images(spark, folder, "pre.png"), _images(spark, folder, "post.png")
    stats = checkpoint(
        image_statistics(before.select("image")).select(
            *readers.place(F.col("path")), "blur", "brightness", hash_bits(F.col("block")).alias("hash"),
        )
    )
    pairs = before.withColumnRenamed("image", "before").join(after.withColumnRenamed("image", "after"), KEYS)
    ratios = change_ratios(pairs.withColumn("sample_id", F.concat_ws("/", *KEYS)))
    ratios = ratios.select(
        F.substring_index("sample_id", "/", 1).alias("session_id"), F.substring_index("sample_id", "/", -1).alias("sample_id"), "ratio",
    )
    rows = rows.drop("flags").join(stats, KEYS, "left").join(ratios, KEYS, "left")
    rows = rows.withColumn("__pre", F.col("blur").isNotNull()).withColumn("__post", F.col("ratio").isNotNull())
    invalid = quality.invalid_action(F.col("__pre"), F.col("__post"), F.coalesce("ratio", F.lit(0.0)), limits.min_diff_ratio)
    issue = quality.quality_issue(
        F.col("__pre"), F.col("blur"), F.col("brightness"), limits.blur_laplacian_threshold, limits.dark_overlay_threshold,
    )
    stages = {"invalid_action": invalid, "quality": issue, "transition": F.col("label.transition_detected")}
    rows = checkpoint(quality.cascade(rows, stages).withColumn("__issue", issue).withColumn("__invalid", invalid))
    stay = rows.where("drop_stage IS NULL")
    kept = checkpoint(dedup.deduplicate(stay, "hash", "ord", limits.dedup_hash_threshold).select("ord"))
    led = _clusters(rows, stats.select(*KEYS, "hash"), limits.dedup_hash_threshold)
    rows = rows.join(kept.withColumn("__kept", F.lit(True)), "ord", "left").join(led, "ord")
    rows = rows.withColumn(
        "drop_stage", F.when(F.col("drop_stage").isNull() & F.col("__kept").isNull(), "dedup").otherwise(F.col("drop_stage")),
    )
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    tests = {
        "quality_issue": F.col("__issue"),
        "missing_primitive_id": empty(F.col("label.route_label.primitive_id")),
        "missing_situation_id": empty(F.col("label.page.situation_id")),
        "legacy_invalid_action": F.col("__invalid"),
        "legacy_transition": F.col("label.transition_detected"),
        quality.DUPLICATE: ~F.col("is_representative"),
    }
    return rows.withColumn("flags", quality.flags(tests)).withColumn("score", quality.score(F.col("flags")))


def reject_filtered(spark: SparkSession, folder: str, store: str, settings: Settings | None = None) -> DataFrame:
    """rejected, left_alone: pending samples that the filter drops are rejected in the store (auto_filter_rejected), those
    already decided are left alone. No flow does this by itself."""
    rows = checkpoint(_filtered(spark, folder, store, settings))
    dropped = rows.where("drop_stage IS NOT NULL")
    marked = quality.reject_dropped(dropped.select(*KEYS, "ord", "review_status", "corrections"), dropped.limit(0).select("ord"), "ord", corrections="corrections")
    pending = dropped.where("review_status = 'pending'").select("ord")
    stores.save(store, review=marked.join(pending, "ord", "left_semi").select(*KEYS, "review_status", "corrections"))
    return dropped.agg(F.count_if(F.col("review_status") == "pending").alias("rejected"), F.count_if(F.col("review_status") != "pending").alias("left_alone"))


def stats(spark: SparkSession, folder: str, store: str | None = None) -> DataFrame:
    """One row of counts over all samples."""
    rows = load(spark, folder, store)
    flat = labels.flat_fields(F.col("label"))
    return quality.dataset_stats(
        rows,
        F.col("label.confidence"),
        flat["primitive_id"],
        flat["situation_id"],
        F.col("review_status"),
        F.col("flags"),
        F.col("label").isNotNull(),
    )


def review_queue(spark: SparkSession, folder: str, store: str, settings: Settings | None = None) -> DataFrame:
    """The labeled, pending, distinct samples with decision and priority; read it in order of (priority, ord).

    Samples that the settings approve are approved in the store.
    """
    limits = (settings or Settings()).review
    rows = load(spark, folder, store)
    confidence = F.col("label.confidence")
    queue = checkpoint(
        review.load_queue(
            rows, review.sample_priority("label", "metadata", "flags"), "ord", limits.auto_approve_confidence if limits.enable_auto_approve else None, confidence,
        )
    )
    approved = queue.where("decision = 'approved'")
    if limits.enable_auto_approve:
        stores.save(store, review=approved.select(*KEYS, F.lit("approved").alias("review_status"), "corrections"))
    return queue


def decide(spark: SparkSession, store: str, session_id: str, sample_id: str, status: str, corrections: str | None = None) -> int:
    """Approve, reject or edit one sample; returns the store's commit. store.decide takes a table of them."""
    row = [(session_id, sample_id, status, corrections)]
    return stores.decide(spark, store, spark.createDataFrame(row, "session_id string, sample_id string, review_status string, corrections string"))


FORMATS = ("router_full", "router_roi", "unified", "coco", "yolo", "grounding", "roi_state")


def export(
    spark: SparkSession,
    folder: str,
    out: str,
    dims: dict[str, DataFrame],
    formats: tuple[str, ...] = FORMATS[:2],
    settings: Settings | None = None,
    store: str | None = None,
) -> list[str]:
    """Write the formats asked for (router by default, FORMATS for all) below out; returns their folders."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(sorted(unknown))}; known: {', '.join(FORMATS)}")
    limits = (settings or Settings()).export
    rows = load(spark, folder, store).where("label IS NOT NULL AND event IS NOT NULL AND review_status <> 'rejected'")
    names = _words(dims, "element", "semantic_id")
    write = {
        "router_full": lambda at: writers.write_router_full(rows, at),
        "router_roi": lambda at: writers.write_router_roi(rows, at, dims["situation"], dims["roi"], limits.router_roi_fallbacks),
        "unified": lambda at: writers.write_text(writers.routing_rows(rows), "record", at),
        "coco": lambda at: writers.coco_parts(rows, names, at),
        "yolo": lambda at: writers.write_yolo(rows, names, at),
        "grounding": lambda at: writers.grounding_rows(rows, limits.normalizing_range).write.mode("overwrite").json(at),
        "roi_state": lambda at: writers.write_region_states(rows, at),
    }
    for name in formats:
        write[name](f"{out}/{name}")
    return [f"{out}/{name}" for name in formats]
