"""The episode map: standardised descriptors, two principal components, min-max coordinates.

All that leaves the executors is sums: the means and the 19 x 19 matrix of centred products,
one row in all, whatever the number of episodes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.schema import FIELDS


@dataclass(frozen=True)
class Projection:
    mean: list[float]
    scale: list[float]
    loadings: list[list[float]]
    explained: list[float]


def fit(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> Projection:
    """Population scaling and the first two principal components; the largest loading of each is positive."""
    k = len(fields)
    means = rows.agg(*[F.avg(f).alias(f) for f in fields], F.count("*").alias("n")).first()
    if not means["n"]:
        return Projection([0.0] * k, [1.0] * k, [[0.0] * k] * 2, [0.0, 0.0])
    mean = [float(means[f]) for f in fields]
    centred = [F.col(f) - F.lit(m) for f, m in zip(fields, mean, strict=True)]
    products = [F.sum(centred[i] * centred[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    sums = rows.agg(*products).first()
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = sums[f"p{i}_{j}"] / means["n"]
    scale = np.sqrt(np.diag(cov))
    scale[scale < 1e-12] = 1.0  # a constant column stays constant
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    top = vectors[:, ::-1][:, :2].T
    top *= np.sign(top[np.arange(2), np.abs(top).argmax(axis=1)])[:, None]
    total = max(float(values.sum()), 1e-300)
    return Projection(mean, scale.tolist(), top.tolist(), (values[::-1][:2] / total).tolist())


def project(rows: DataFrame, projection: Projection, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """`rows` with `pc1` and `pc2`."""
    def score(c: int):
        parts = [(F.col(f) - F.lit(m)) / F.lit(s) * F.lit(w) for f, m, s, w in zip(fields, projection.mean, projection.scale, projection.loadings[c], strict=True)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    return rows.withColumns({"pc1": score(0), "pc2": score(1)})


def placed(scored: DataFrame) -> DataFrame:
    """`scored` with x and y in [0, 1], six places. The range is one row, hence the broadcast."""
    span = scored.agg(*[f(c).alias(f"{c}_{name}") for c in ("pc1", "pc2") for f, name in ((F.min, "lo"), (F.max, "hi"))])
    unit = lambda c: F.round((F.col(c) - F.col(f"{c}_lo")) / F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(1e-9)), 6)
    return scored.crossJoin(F.broadcast(span)).withColumns({"x": unit("pc1"), "y": unit("pc2")}).drop("pc1_lo", "pc1_hi", "pc2_lo", "pc2_hi")


def build(rows: DataFrame) -> tuple[DataFrame, Projection]:
    projection = fit(rows)
    return placed(project(rows, projection)), projection


def points(atlas: DataFrame) -> DataFrame:
    """The twelve columns that a map client draws; corpora are numbered in alphabetical order."""
    from pyspark.sql import Window

    corpora = atlas.select("corpus").distinct().select("corpus", (F.row_number().over(Window.orderBy("corpus")) - 1).alias("corpus_index"))
    joined = atlas.join(corpora, "corpus")  # one row a corpus: broadcast by its size
    names = {"x": "pc1", "y": "pc2", "turn_count": "turns", "switch": "switch_rate", "reach": "mean_target_span", "flags": "motif_flags", "edge_count": "eligible_edges", "nonadjacent": "nonadjacent_edges", "known": "known_action_fraction"}
    return joined.select("episode_id", *[F.col(a).alias(names.get(a, a)) for a in ("x", "y", "corpus_index", "turn_count", "speakers", "switch", "reach", "flags", "edge_count", "nonadjacent", "known")])


def top_loadings(spark, projection: Projection, fields: tuple[str, ...] = FIELDS, k: int = 5) -> DataFrame:
    """(component, place, field, loading): the largest absolute loadings of each component."""
    rows = []
    for c, weights in enumerate(projection.loadings):
        order = sorted(range(len(fields)), key=lambda i: (-abs(weights[i]), i))[:k]
        rows += [(c + 1, p + 1, fields[i], float(weights[i])) for p, i in enumerate(order)]
    return spark.createDataFrame(rows, "component int, place int, field string, loading double")
