"""The model boundary: what a caller's model looks like to the engine, and how it is run over images.

A model is loaded once a Python worker and sees batches; everything around it is columns.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mean and deviation of the channels (red, green, blue) that image models are trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Fields of a row of the image source that pixels are made of.
PIXELS = ("height", "width", "nChannels", "data")


class FrameModel(ABC):
    """A detector over encoded images. Instances are sent to the workers, so load() does what is heavy."""

    def load(self) -> None:
        """Called once a worker before the first image."""

    @abstractmethod
    def predict(self, image: bytes) -> list[dict]:
        """label, bbox (four pixels), score of each element found."""


def predict(images: DataFrame, key: str, content: str, model: FrameModel) -> DataFrame:
    """key, at, label, x1, y1, x2, y2, score of a model's elements. Null images have none; a missing score is 0.5."""
    kind = dict(images.dtypes)[key]
    names = [key, "at", "label", "x1", "y1", "x2", "y2", "score"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        for f in frames:
            rows = []
            for k, image in zip(f[key], f[content], strict=True):
                for at, e in enumerate([] if image is None else model.predict(bytes(image))):
                    rows.append((k, at, e.get("label"), *map(float, e["bbox"]), float(e.get("score", 0.5))))
            yield pd.DataFrame(rows, columns=names)

    return images.select(key, content).mapInPandas(
        run, f"{key} {kind}, at int, label string, x1 double, y1 double, x2 double, y2 double, score double",
    )


def no_screen(image: bytes) -> str | None:
    """The screen classifier of a profile that has none."""
    return None


def classify_screens(images: DataFrame, key: str, content: str, classifier: Callable[[bytes], str | None] = no_screen) -> DataFrame:
    """key, screen_type by a profile's own rule; null where it has none."""
    kind = dict(images.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [None if c is None else classifier(bytes(c)) for c in f[content]]
            yield pd.DataFrame({key: f[key], "screen_type": pd.Series(found, dtype=object)})

    return images.select(key, content).mapInPandas(run, f"{key} {kind}, screen_type string")


def image_tensors(images: DataFrame) -> DataFrame:
    """path, channels, height, width, tensor of image-source rows: red, green, blue planes less MEAN over DEVIATION.

    A gray image counts as three equal channels, a fourth channel is left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rgb = np.repeat(pixels, 3, axis=2) if r.nChannels == 1 else pixels[:, :, 2::-1]  # the source has blue first
                scaled = (rgb / 255.0 - np.array(MEAN)) / np.array(DEVIATION)
                rows.append((r.path, 3, r.height, r.width, scaled.transpose(2, 0, 1).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["path", "channels", "height", "width", "tensor"])

    flat = images.select(F.col("image.origin").alias("path"), *(F.col(f"image.{c}").alias(c) for c in PIXELS))
    return flat.mapInPandas(run, "path string, channels int, height int, width int, tensor array<float>")
