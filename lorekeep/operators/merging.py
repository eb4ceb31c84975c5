"""Clusters whose centroids are near are merged, file by file, with the trace of the merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .speakers import _unit

#: Fixed value: centroids nearer than this are one speaker.
MERGE_MAX = 0.60
#: Places to which distances are compared; nearer ones are ties, which go to the least labels.
PLACES = 9


def merged(labels: list[int], sums: np.ndarray, limit: float) -> tuple[dict[int, int], list[tuple[int, int, float, bool]]]:
    """What each label becomes, and the trace (i, j, distance, merged). Of a merge only the distances of the new centroid are measured anew."""
    into, trace, left = {x: x for x in labels}, [], sorted(labels)
    at = [labels.index(x) for x in left]
    sums = sums[at].astype(np.float64)
    unit = _unit(sums)
    d = np.round(1 - unit @ unit.T, PLACES)
    d[np.tril_indices(len(left))] = np.inf
    while np.isfinite(d).any():
        i, j = np.unravel_index(np.argmin(d), d.shape)
        near = bool(d[i, j] < limit)
        trace.append((left[i], left[j], float(d[i, j]), near))
        if not near:
            break
        into = {x: left[i] if y == left[j] else y for x, y in into.items()}
        sums[i] += sums[j]
        unit[i] = _unit(sums[i])
        d[j], d[:, j] = np.inf, np.inf
        row = np.round(1 - unit @ unit[i], PLACES)
        alive = [k for k in range(len(left)) if into[left[k]] == left[k] and k != i]
        for k in alive:
            d[min(i, k), max(i, k)] = row[k]
    return into, trace


def merge_centroids(windows: DataFrame, limit: float = MERGE_MAX) -> DataFrame:
    """windows (file, label, embedding): rows (file, what, a, b, distance, step): `cluster` with what label a becomes (b), `merge` and at last `apart` with the two nearest centroids of each step.

    The two nearest are merged while they are nearer than the limit. A merge moves a centroid, and a moved one may come nearer to a third, so a file's merges follow
    one another. Vectors are summed by cluster and dimension before the shuffle; a task gets one sum for each of a file's clusters, which are its speakers.
    """
    each = windows.select("file", "label", F.posexplode("embedding").alias("pos", "x")).groupBy("file", "label", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    held = each.groupBy("file", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("sum"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        into, trace = merged(pdf["label"].tolist(), np.stack(pdf["sum"].to_numpy()), limit)
        rows = [("cluster", a, b, None, None) for a, b in into.items()] + [("merge" if near else "apart", i, j, d, k) for k, (i, j, d, near) in enumerate(trace)]
        return pd.DataFrame([(pdf["file"].iloc[0], *r) for r in rows], columns=["file", "what", "a", "b", "distance", "step"])

    kinds = dict(windows.dtypes)
    return held.groupBy("file").applyInPandas(run, f"file {kinds['file']}, what string, a {kinds['label']}, b {kinds['label']}, distance double, step int")
