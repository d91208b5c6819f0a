"""Cover style: colour features and palettes of images, clusters of titles by feature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import safe_id

FEATURES = ("brightness", "saturation", "colorfulness", "contrast", "warmth")
#: Pixels an image is sampled to.
HEIGHT, WIDTH = 96, 72


def read_covers(spark: SparkSession, root: str) -> DataFrame:
    """(safe_id, height, width, channels, data) of the images under a folder, named by their title's safe id."""
    image = spark.read.format("image").option("dropInvalid", True).load(root).select("image.*")
    name = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\.[^.]*$", "")
    return image.select(name.alias("safe_id"), "height", "width", F.col("nChannels").alias("channels"), "data")


def _sampled(row) -> np.ndarray:
    """At most HEIGHT by WIDTH pixels as RGB in 0..1; the source keeps blue first."""
    px = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
    px = px[np.linspace(0, row.height - 1, min(HEIGHT, row.height)).astype(int)][:, np.linspace(0, row.width - 1, min(WIDTH, row.width)).astype(int)]
    px = px[..., :3][..., ::-1] if row.channels >= 3 else np.repeat(px[..., :1], 3, -1)
    return px.reshape(-1, 3) / 255.0


def features_of(rgb: np.ndarray) -> tuple[float, ...]:
    """Brightness, saturation, colourfulness and warmth on a scale of 1; contrast in half scales, so that black and white in equal parts are about 1."""
    high, low = rgb.max(1), rgb.min(1)
    light = rgb @ np.array([0.299, 0.587, 0.114])
    rg, yb = rgb[:, 0] - rgb[:, 1], (rgb[:, 0] + rgb[:, 1]) / 2 - rgb[:, 2]
    colourful = np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())
    saturation = np.divide(high - low, high, out=np.zeros_like(high), where=high > 0).mean()
    found = (light.mean(), saturation, colourful, light.std() * 255 / 128, (rgb[:, 0] - rgb[:, 2]).mean())
    return tuple(round(float(x), 3) for x in found)


def palette_of(rgb: np.ndarray, k: int = 5, rounds: int = 8, seed: int = 0) -> list[str]:
    """Dominant colours as hex, most pixels first: a small k-means on the sample."""
    centres = rgb[np.random.default_rng(seed).choice(len(rgb), min(k, len(rgb)), replace=False)]
    for _ in range(rounds):
        near = ((rgb[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([rgb[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
    order = np.argsort(-np.bincount(near, minlength=len(centres)), kind="stable")
    return ["#" + "".join(f"{round(v * 255):02x}" for v in centres[j]) for j in order]


def color_features(images: DataFrame) -> DataFrame:
    """(safe_id, five features, palette) of images."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.safe_id, *features_of(px := _sampled(r)), palette_of(px)) for r in batch.itertuples()]
            yield pd.DataFrame(rows, columns=["safe_id", *FEATURES, "palette"])

    return images.mapInPandas(of, "safe_id string, " + ", ".join(f"{c} double" for c in FEATURES) + ", palette array<string>")


def style_name() -> Column:
    """A cluster's name from its centre; limits and names are fixed values."""
    brightness, saturation, colorfulness = F.col("brightness"), F.col("saturation"), F.col("colorfulness")
    return (
        F.when(brightness < 0.35, "Dark & moody").when((saturation > 0.55) & (colorfulness > 0.4), "Vivid & saturated")
        .when((brightness > 0.68) & (saturation < 0.4), "Bright & pastel").when((saturation < 0.3) & (colorfulness < 0.3), "Muted / monochrome")
        .when(F.col("warmth") > 0.05, "Warm & soft").otherwise("Cool & clean")
    )


def _apart(columns: tuple[str, ...], centre: list[float]) -> Column:
    return sum(((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(columns, centre, strict=True)), F.lit(0.0))


def _nearest(columns: tuple[str, ...], centres: list[list[float]]) -> Column:
    """(squared distance, number) of the nearest centre, the first of equals."""
    return F.least(*(F.struct(_apart(columns, x).alias("d"), F.lit(j).alias("j")) for j, x in enumerate(centres))) if len(centres) > 1 else F.struct(
        _apart(columns, centres[0]).alias("d"), F.lit(0).alias("j")
    )


def style_centres(features: DataFrame, key: str, *, k: int = 5, rounds: int = 10, columns: tuple[str, ...] = FEATURES) -> list[list[float]]:
    """At most ``k`` centres, in the order of their choice: that of the least ``key``, then each time the row farthest from all centres so far, the least key of
    equals; then ``rounds`` of k-means, each one aggregate.  Fewer distinct rows than ``k`` make fewer centres."""
    point = F.struct(*columns)
    first = features.agg(F.min_by(point, key)).first()[0]
    centres = [] if first is None else [list(first)]
    while centres and len(centres) < k:
        own = features.select(key, point.alias("p"), _nearest(columns, centres)["d"].alias("d"))
        far = own.filter("d > 0").agg(F.max("d").alias("d"), F.min_by("p", F.struct(-F.col("d"), F.col(key))).alias("p")).first()
        if far.d is None:
            break
        centres.append(list(far.p))
    for _ in range(rounds if len(centres) > 1 else 0):
        means = features.withColumn("_j", _nearest(columns, centres)["j"]).groupBy("_j").agg(*(F.avg(c).alias(c) for c in columns)).collect()
        for r in means:
            centres[r["_j"]] = [r[c] for c in columns]
    return centres


def style_clusters(features: DataFrame, key: str = "safe_id", *, k: int = 5, rounds: int = 10, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """``features`` with ``cluster``, by k-means on rows where all features are there; an empty table stays empty."""
    rows = features.na.drop(subset=list(columns))
    centres = style_centres(rows, key, k=k, rounds=rounds, columns=columns)
    return rows.withColumn("cluster", _nearest(columns, centres)["j"] if centres else F.lit(None).cast("int"))


def named_clusters(clustered: DataFrame) -> DataFrame:
    centres = clustered.groupBy("cluster").agg(*(F.avg(c).alias(c) for c in FEATURES), F.count(F.lit(1)).alias("n"))
    return centres.withColumn("style", style_name())


def with_style(clustered: DataFrame) -> DataFrame:
    """``clustered`` with the name of each row's cluster; the names are as few as the clusters."""
    return clustered.join(F.broadcast(named_clusters(clustered).select("cluster", F.col("style").alias("style_name"))), "cluster")


def style_join(titles: DataFrame, clustered: DataFrame) -> DataFrame:
    return titles.withColumn("safe_id", safe_id("comic_id")).join(clustered, "safe_id", "left")


def style_by_genre(styled: DataFrame, least: int = 3) -> DataFrame:
    return (
        styled.filter("genre IS NOT NULL").groupBy("genre")
        .agg(F.count("brightness").alias("n"), *(F.avg(c).alias(c) for c in ("brightness", "saturation", "colorfulness")))
        .filter(F.col("n") >= least)
    )
