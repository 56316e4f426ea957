"""Dataset profiles, vocabularies and strategy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(rows: DataFrame, label: str, skip_blank: bool = False) -> DataFrame:
    """label, index: sorted distinct labels from 0. A vocabulary is a class list, small by contract."""
    names = rows.where(F.col(label).isNotNull()).select(label).distinct()
    names = names.where(F.trim(label) != "") if skip_blank else names
    return names.withColumn("index", F.row_number().over(Window.orderBy(label)) - 1)


def encode(rows: DataFrame, vocab: DataFrame, label: str, missing: int = -100) -> DataFrame:
    return rows.join(
        vocab.select(label, F.col("index").alias(f"{label}_index")), label, "left",
    ).withColumn(f"{label}_index", F.coalesce(f"{label}_index", F.lit(missing)))


def class_balance(rows: DataFrame, label: str, classes: Column | None = None) -> DataFrame:
    """balance: entropy over its largest value for the number of classes; one class: 1, no rows: 0 (with classes)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    k = F.col("k") if classes is None else classes
    entropy = F.ln("total") - F.col("s") / F.col("total")
    return sums.select(F.when(k <= 1, 1.0).when(F.coalesce("total", F.lit(0)) == 0, 0.0).otherwise(entropy / F.ln(k)).alias("balance"))


def complexity(images: Column, classes: Column, annotations_per_image: Column | None = None) -> Column:
    return F.when((images < 50) & (classes <= 1), "trivial").when((images < 200) & (classes <= 3), "simple").when(
        (images < 1000) | (classes <= 5), "moderate",
    ).otherwise("complex")


def profile(images: DataFrame, annotations: DataFrame, image: str, category: str, classes: int | None = None) -> DataFrame:
    """One row: counts, mean annotations an image, mean box share of its image (missing image: 640x480), balance.

    images: image, width, height; annotations: image, category, w, h. classes None: those that occur.
    """
    sized = annotations.join(images.select(image, (F.col("width") * F.col("height")).alias("__area")), image, "left")
    share = F.col("w") * F.col("h") / F.greatest(F.lit(1.0), F.coalesce(F.col("__area"), F.lit(640.0 * 480.0)).cast("double"))
    a = sized.agg(
        F.count("*").alias("num_annotations"), F.coalesce(F.avg(share), F.lit(0.0)).alias("ratio"), F.countDistinct(category).alias("k"),
    )
    n = images.agg(F.count("*").alias("num_images"))
    k = F.col("k") if classes is None else F.lit(classes)
    out = n.crossJoin(a).crossJoin(class_balance(annotations, category, F.lit(classes) if classes is not None else None))  # rows of one each
    mean = F.col("num_annotations") / F.greatest(F.lit(1), F.col("num_images"))
    return out.select(
        "num_images",
        "num_annotations",
        k.alias("num_classes"),
        F.round(mean, 2).alias("avg_annotations_per_image"),
        F.round("ratio", 4).alias("avg_box_area_ratio"),
        F.round("balance", 4).alias("class_balance_score"),
        complexity(F.col("num_images"), k).alias("estimated_complexity"),
    )


#: Model, task, epochs, batch, learning rate, search, trials of the four outcomes.
STRATEGIES = {
    "grounding": ("florence2", "microsoft/Florence-2-base", "grounding", 5, 4, 5e-5, False, 0),
    "small": ("yolo_ultralytics", "yolov8n.pt", "tool_button_detection", 30, 16, 1e-3, False, 0),
    "medium": ("yolo_ultralytics", "yolov8s.pt", "tool_button_detection", 50, 16, 1e-3, True, 10),
    "large": ("yolo_ultralytics", "yolov8m.pt", "tool_button_detection", 80, 8, 1e-3, True, 20),
}
STRATEGY_FIELDS = (
    "backend", "model_name", "task_name", "suggested_epochs", "suggested_batch_size", "suggested_lr", "use_hpo", "suggested_n_trials",
)


def strategy(profiles: DataFrame) -> DataFrame:
    """The profile's columns and the strategy's."""
    small = F.col("estimated_complexity").isin("trivial", "simple")
    struct = lambda k: F.struct(*(F.lit(v).alias(n) for n, v in zip(STRATEGY_FIELDS, STRATEGIES[k], strict=True)))
    pick = F.when(
        (F.col("avg_annotations_per_image") <= 1.0) & (F.col("num_classes") <= 2) & small, struct("grounding"),
    ).when((F.col("num_images") < 200) & (F.col("num_classes") <= 1), struct("small")).when((F.col("num_images") < 1000) & (F.col("num_classes") <= 5), struct("medium")).otherwise(struct("large"))
    return profiles.withColumn("__s", pick).select(*profiles.columns, *(F.col(f"__s.{n}") for n in STRATEGY_FIELDS))
