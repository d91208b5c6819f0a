"""How large an audience a concept may find: boosted trees on genre.

The one feature is the genre's place in alphabetical order, so all that boosting needs of the titles is, for each genre, their number and the
sum of their targets.  Spark counts these in one aggregate, which combines before its shuffle; trees are then grown over as many numbers as there are genres, where a split's gain
follows from sums to its left and right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewer rows than this give no model, and the fallback score holds.
LEAST_ROWS = 10
#: Genres of a model, at most: its table travels to the driver.
MOST_GENRES = 1 << 16
#: What a missing genre counts as, and the usual step, penalty and smallest gain of boosted regression trees.
NO_GENRE = "Unknown"
STEP, PENALTY, LEAST_GAIN = 0.3, 1.0, 0.0


@dataclass(frozen=True)
class Concepts:
    """Genres in order with their predicted log1p(views); R squared on the held-out titles, null where they all have one target."""

    genres: list[str]
    values: list[float]
    r2: float | None

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.genres, self.values, strict=True)), "genre string, prediction double")


def boosted(n: np.ndarray, total: np.ndarray, *, trees: int, depth: int) -> np.ndarray:
    """Predictions of categories in order, of which ``n`` rows have targets that sum to ``total``: squared error, each tree fitted to what is left.

    A node is a run of categories and splits where the gain is greatest, the first of equals; a side must hold a row.
    """
    out = np.full(len(n), total.sum() / max(n.sum(), 1.0))
    for _ in range(trees):
        rest, step = n * out - total, np.zeros(len(n))
        nodes = [(0, len(n), depth)]
        while nodes:
            lo, hi, left = nodes.pop()
            g, h = np.cumsum(rest[lo:hi]), np.cumsum(n[lo:hi])
            if left and hi - lo > 1:
                rows = (h[:-1] >= 1) & (h[-1] - h[:-1] >= 1)
                gain = g[:-1] ** 2 / (h[:-1] + PENALTY) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + PENALTY) - g[-1] ** 2 / (h[-1] + PENALTY)
                gain = np.where(rows, gain, -np.inf)
                if gain.max() > LEAST_GAIN:
                    cut = lo + int(gain.argmax()) + 1
                    nodes += [(lo, cut, left - 1), (cut, hi, left - 1)]
                    continue
            step[lo:hi] = -STEP * g[-1] / (h[-1] + PENALTY)
        out = out + step
    return out


def _held_out(seed: int) -> Column:
    """A fifth of the titles, told by a checksum, so it stays the same however rows are dealt."""
    return F.crc32(F.concat(F.col("comic_id"), F.lit(f":{seed}")).cast("binary")) % 5 == 0


def train(titles: DataFrame, *, trees: int = 100, depth: int = 6, seed: int = 42) -> Concepts | None:
    """The model of log1p(views) by genre, or None for too few rows.  A null genre is a category, ``Unknown``."""
    rows = titles.filter("views IS NOT NULL").select(
        "comic_id", F.coalesce("genre", F.lit(NO_GENRE)).alias("genre"), F.log1p(F.col("views").cast("double")).alias("y"), _held_out(seed).alias("held")
    )
    of = lambda held, c: F.coalesce(F.sum(F.when(F.col("held") == held, c)), F.lit(0.0))
    counted = rows.groupBy("genre").agg(*(
        of(held, c).alias(f"{name}_{held}".lower())
        for held in (False, True) for name, c in (("n", F.lit(1.0)), ("y", F.col("y")), ("yy", F.col("y") * F.col("y")))
    ))
    table = counted.orderBy("genre").limit(MOST_GENRES + 1).collect()
    if len(table) > MOST_GENRES:
        raise ValueError(f"more than {MOST_GENRES} genres")
    sums = {c: np.array([r[c] for r in table], float) for c in counted.columns if c != "genre"}
    if sum(sums[c].sum() for c in ("n_false", "n_true") if len(table)) < LEAST_ROWS:
        return None
    values = boosted(sums["n_false"], sums["y_false"], trees=trees, depth=depth)
    n, y, yy = (sums[f"{c}_true"] for c in ("n", "y", "yy"))
    apart, spread = (yy - 2 * values * y + n * values**2).sum(), yy.sum() - y.sum() ** 2 / max(n.sum(), 1.0)
    return Concepts([r.genre for r in table], values.tolist(), float(1 - apart / spread) if spread > 1e-12 else None)


def predict(concepts: DataFrame, model: Concepts | None) -> DataFrame:
    """(genre, title) with predicted views and tier: S over a million, A over 100,000, else B; without a model a score of 50 and more.

    A genre that the model does not know, or none, counts as the first of its genres.
    """
    if model is None:
        genre = F.coalesce("genre", F.lit(""))
        bonus = (
            F.when(genre.contains("Romance"), 20).otherwise(0) + F.when(genre.contains("Fantasy"), 15).otherwise(0)
            + F.when(F.char_length("title") > 10, 5).otherwise(0)
        )
        return concepts.withColumns({"predicted": (F.lit(50) + bonus).cast("double"), "tier": F.lit("B")})
    known = F.broadcast(model.table(concepts.sparkSession))  # at most MOST_GENRES rows
    out = concepts.join(known, "genre", "left").withColumn("predicted", F.expm1(F.coalesce("prediction", F.lit(model.values[0]))))
    tier = F.when(F.col("predicted") > 1_000_000, "S").when(F.col("predicted") > 100_000, "A").otherwise("B")
    return out.withColumn("tier", tier).select(*concepts.columns, "predicted", "tier")
