"""Speakers: clustering of embeddings, learning of people's prints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

THRESHOLD = 0.60
MIN_WINDOWS = 3
MIN_SHARE = 0.06
DECAY = 0.92
MIN_STRENGTH = 0.25
MOST_PRINTS = 24
#: Prints that are held against all others at once.
STRIP = 512


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def agglomerated(vectors: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Labels by average linkage over cosine distance: the nearest two clusters join while nearer than the threshold. Distances of joined clusters are weighted means, so no pair is measured twice."""
    n = len(vectors)
    label = np.arange(n)
    if n < 2:
        return label
    unit = _unit(vectors.astype(np.float64))
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    while True:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] < threshold:
            return np.unique(label, return_inverse=True)[1]
        i, j = min(i, j), max(i, j)
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i


def absorbed(label: np.ndarray, vectors: np.ndarray, windows: int = MIN_WINDOWS, share: float = MIN_SHARE) -> np.ndarray:
    """Clusters of too few windows or too small a share go to the cluster with the nearest centroid, smallest first; one always stays."""
    label = label.copy()
    unit = _unit(vectors.astype(np.float64))
    while True:
        names, count = np.unique(label, return_counts=True)
        small = [(c, k) for k, c in zip(names, count, strict=True) if c < windows or c < share * len(label)]
        if len(names) < 2 or not small:
            return np.unique(label, return_inverse=True)[1]
        _, own = min(small)
        means = {k: _unit(unit[label == k].mean(0)) for k in names}
        label[label == own] = max((k for k in names if k != own), key=lambda k: (means[own] @ means[k], -k))


def renumbered(label: np.ndarray) -> np.ndarray:
    """Labels by first appearance."""
    order: dict = {}
    return np.array([order.setdefault(x, len(order)) for x in label.tolist()], np.int64)


def diarized(windows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """windows (file, at, embedding) with their speaker in the file, numbered by first appearance. A file's windows go to one task; it is a recording, not a corpus."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("at")
        v = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"file": rows["file"], "at": rows["at"], "speaker": renumbered(absorbed(agglomerated(v, threshold), v))})

    kinds = dict(windows.dtypes)
    return windows.groupBy("file").applyInPandas(cluster, f"file {kinds['file']}, at {kinds['at']}, speaker long")


def consolidated(prints: list[tuple[np.ndarray, float]], most: int = MOST_PRINTS) -> list[tuple[np.ndarray, float]]:
    """A person's learned prints (vector, strength) after decay: weak ones go, then the nearest two are merged, weighted by strength, until `most` are left. Each print knows its nearest, so a merge measures the new print only, and memory grows with the prints."""
    held = [(v, s * DECAY) for v, s in prints]
    held = [(_unit(np.asarray(v, np.float64)), s) for v, s in held if s >= MIN_STRENGTH]
    n = len(held)
    if n <= most:
        return held
    # slots in the list's order, merged ones at its end; best holds no less than each slot's nearness to another live one, and exactly that where `sure`
    slots, strength, live = np.zeros((2 * n - most, len(held[0][0]))), np.zeros(2 * n - most), np.zeros(2 * n - most, bool)
    slots[:n], strength[:n], live[:n] = [v for v, _ in held], [s for _, s in held], True
    best, near, sure = np.full(len(live), -np.inf), np.zeros(len(live), np.int64), np.zeros(len(live), bool)
    for k in range(0, n, STRIP):
        rows = slots[k : min(k + STRIP, n)] @ slots[:n].T
        rows[np.arange(len(rows)), np.arange(k, k + len(rows))] = -np.inf
        near[k : k + len(rows)] = rows.argmax(1)
        best[k : k + len(rows)] = rows.max(1)
    sure[:n] = True
    end, left = n, n
    while left > most:
        i = int(np.argmax(best[:end]))
        if not (sure[i] and live[near[i]]):
            row = np.where(live[:end], slots[:end] @ slots[i], -np.inf)
            row[i] = -np.inf
            near[i], best[i], sure[i] = int(np.argmax(row)), row.max(), True
            continue
        i, j = sorted((i, int(near[i])))
        new = _unit((slots[i] * strength[i] + slots[j] * strength[j]) / (strength[i] + strength[j]))
        live[[i, j]], best[[i, j]] = False, -np.inf
        slots[end], strength[end], live[end] = new, strength[i] + strength[j], True
        row = np.where(live[:end], slots[:end] @ new, -np.inf)
        nearer = row > best[:end]
        best[:end][nearer], near[:end][nearer], sure[:end][nearer] = row[nearer], end, True
        near[end], best[end], sure[end] = int(np.argmax(row)), row.max(), True
        end, left = end + 1, left - 1
        if end > 1024 and left * 2 < end:
            # closes the gaps that merged slots left; a neighbour that is gone is none
            kept = np.flatnonzero(live[:end])
            place = np.full(end, -1, np.int64)
            place[kept] = np.arange(left)
            room = 2 * left - most
            sure[kept] &= place[near[kept]] >= 0
            near = np.concatenate([np.maximum(place[near[kept]], 0), np.zeros(room - left, np.int64)])
            best, sure = (np.concatenate([x[kept], np.full(room - left, fill, x.dtype)]) for x, fill in ((best, -np.inf), (sure, False)))
            slots, strength = np.concatenate([slots[kept], np.zeros((room - left, slots.shape[1]))]), np.concatenate([strength[kept], np.zeros(room - left)])
            live, end = np.arange(room) < left, left
    return [(slots[k], float(strength[k])) for k in np.flatnonzero(live[:end])]


def learned(prints: DataFrame) -> DataFrame:
    """prints (person, embedding, strength) consolidated by person."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = consolidated([(np.asarray(v), s) for v, s in zip(pdf["embedding"], pdf["strength"], strict=True)])
        return pd.DataFrame({"person": [pdf["person"].iloc[0]] * len(held), "embedding": [v.tolist() for v, _ in held], "strength": [s for _, s in held]})

    return prints.groupBy("person").applyInPandas(run, f"person {dict(prints.dtypes)['person']}, embedding array<double>, strength double")
