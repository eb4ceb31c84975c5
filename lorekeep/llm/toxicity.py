"""Toxic spans by a linear-chain conditional random field, document scores from its forward-backward marginals."""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, written

#: Labelled documents that the model is fitted on at most, drawn by hash; all where there are fewer.
TRAIN_DOCS = 20_000
#: Evidence that a mark belongs to toxic documents: log-likelihood ratio, which of many marks must also pass 2 log(marks) lest some do by chance, and how many times likelier it is there.
MIN_EVIDENCE = 15.0
MIN_LIFT = 5.0
PREFIXES = (4, 5, 6)
#: Tokens of the training documents of either kind that the chain is fitted on: whole texts are drawn by hash until they have so many.
TRAIN_TOKENS = 200_000
#: Tokens of a run; training texts are cut into runs without loss.
SEGMENT = 48
STEPS = 120
#: Inverse variance of the normal prior of weights and transitions.
PENALTY = 0.3
#: Tokens that a lane of the forward and backward passes holds, and words whose marks a worker remembers.
LANE = 256
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; each is lowered by itself, so that offsets are those of the text."""
    return [w.lower() for w in _WORD.findall(text or "")]


def marks_of(word: str) -> list[str]:
    """The word itself and its longer prefixes, each with its kind."""
    return [f"={word}", *[f"{k}{word[:k]}" for k in PREFIXES if len(word) > k]]


@dataclass
class Tagger:
    """emission: weight of each mark; bias: of any token being toxic; transition[i, j]: from state i to j; start: of state 1 over 0. All are log scores."""

    emission: dict[str, float]
    bias: float = -3.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))
    _seen: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_seen": {}}

    def evidence(self, words: list[str]) -> list[float]:
        """The emission score of each word; marks are looked up once for each distinct word."""
        found = list(map(self._seen.get, words))
        if None in found:
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            weight = self.emission.get
            for w in {w for w, x in zip(words, found, strict=True) if x is None}:
                self._seen[w] = self.bias + sum(weight(m, 0.0) for m in marks_of(w))
            found = [self._seen[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return found

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The probability of the toxic state for each token of each document."""
        sizes = np.array([len(d) for d in docs], np.int64)
        e = np.concatenate([np.zeros(0), *[np.array(self.evidence(d)) for d in docs]])
        first = np.zeros(len(e), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return np.split(forward_backward(e, first, self.transition, self.start), np.cumsum(sizes)[:-1]) if docs else []

    @staticmethod
    def features(marginals: list[np.ndarray]) -> np.ndarray:
        """For each document 1, the log odds of its most toxic token and the logarithm of the expected number of toxic tokens."""
        out = np.zeros((len(marginals), 3))
        for k, p in enumerate(marginals):
            top = min(max(float(p.max()), 1e-6), 1 - 1e-6) if len(p) else 1e-6
            out[k] = 1.0, math.log(top / (1 - top)), math.log1p(float(p.sum()))
        return out

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(marginals) @ self.document, -30, 30)))

    @staticmethod
    def spans(text: str | None, marginals: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) in characters of each run of the text's tokens whose marginal is `least` or more."""
        out: list[tuple[int, int, float]] = []
        open_run = False
        for m, p in zip(_WORD.finditer(text or ""), marginals.tolist(), strict=True):
            if p >= least:
                if open_run:
                    out[-1] = (out[-1][0], m.end(), max(out[-1][2], p))
                else:
                    out.append((m.start(), m.end(), p))
            open_run = p >= least
        return out


def forward_backward(e: np.ndarray, first: np.ndarray, transition: np.ndarray, start: float) -> np.ndarray:
    """Marginals of state 1 over a row of tokens in which `first` begins a new chain. Exact.

    A token is a 2 x 2 matrix, that of a chain's first token having equal rows, which forgets what came before. Lanes of LANE
    tokens are multiplied out side by side, joined in turn, then walked again from their right entry states.
    """
    n = len(e)
    if not n:
        return np.zeros(0)
    lanes = -(-n // LANE)
    g = np.ones(lanes * LANE)
    g[:n] = np.exp(np.clip(e, -40, 40))
    new = np.ones(lanes * LANE, bool)
    new[:n] = first
    a = np.exp(transition)
    s = np.exp(np.clip(start, -40, 40))
    g, new = g.reshape(lanes, LANE), new.reshape(lanes, LANE)
    m = np.empty((LANE, 2, 2, lanes))  # m[t, i, j]: from i to j at the t-th token of each lane
    m[:, 0, 0], m[:, 1, 0] = np.where(new, 1.0, a[0, 0]).T, np.where(new, 1.0, a[1, 0]).T
    m[:, 0, 1], m[:, 1, 1] = np.where(new, s * g, a[0, 1] * g).T, np.where(new, s * g, a[1, 1] * g).T

    whole = m[0] / m[0].sum((0, 1))
    for t in range(1, LANE):
        x = m[t]
        whole = np.stack([np.stack([whole[i, 0] * x[0, j] + whole[i, 1] * x[1, j] for j in (0, 1)]) for i in (0, 1)])
        whole /= whole.sum((0, 1))
    entry, leave = np.empty((2, lanes)), np.empty((2, lanes))
    v, w = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    for k in range(lanes):
        entry[:, k] = v
        v = v @ whole[:, :, k]
        v /= v.sum()
    for k in range(lanes - 1, -1, -1):
        leave[:, k] = w
        w = whole[:, :, k] @ w
        w /= w.sum()
    forward, v = np.empty((LANE, 2, lanes)), entry
    for t in range(LANE):
        v = np.stack([v[0] * m[t, 0, j] + v[1] * m[t, 1, j] for j in (0, 1)])
        v /= v.sum(0)
        forward[t] = v
    w = leave
    for t in range(LANE - 1, -1, -1):
        forward[t] *= w
        w = np.stack([m[t, i, 0] * w[0] + m[t, i, 1] * w[1] for i in (0, 1)])
        w /= w.sum(0)
    return (forward[:, 1] / forward.sum(1)).T.reshape(-1)[:n]


def train_chain(marks: list[str], ids: np.ndarray, length: np.ndarray, labels: np.ndarray) -> Tagger:
    """Penalised maximum likelihood by Adam. ids[s, t, :]: marks of token t of segment s (0: none, k: marks[k - 1]); labels[s, t]: 0 or 1."""
    rng_steps = STEPS
    segments, size, _ = ids.shape
    w, bias, tr, st = np.zeros(len(marks) + 1), np.array([-3.0]), np.zeros((2, 2)), np.zeros(1)
    inside = np.arange(size)[None, :] < length[:, None]
    flat, moments = ids.reshape(-1), [[np.zeros_like(x), np.zeros_like(x)] for x in (w, bias, tr, st)]
    pairs = inside[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][pairs], labels[:, 1:][pairs]), 1)
    n = max(1, int(inside.sum()))
    for step in range(1, rng_steps + 1):
        g = np.exp(np.clip(w[ids].sum(2) + bias[0], -40, 40))
        a = np.exp(tr)
        alpha, beta = np.zeros((size, 2, segments)), np.ones((size, 2, segments))
        scale = np.ones((size, segments))
        for t in range(size):
            if t == 0:
                v = np.stack([np.ones(segments), np.exp(st[0]) * g[:, 0]])
            else:
                v = np.stack([alpha[t - 1, 0] * a[0, 0] + alpha[t - 1, 1] * a[1, 0], (alpha[t - 1, 0] * a[0, 1] + alpha[t - 1, 1] * a[1, 1]) * g[:, t]])
            scale[t] = v.sum(0)
            alpha[t] = v / scale[t]
        both = np.zeros((2, 2))
        for t in range(size - 1, 0, -1):
            q = np.stack([beta[t, 0], beta[t, 1] * g[:, t]]) / scale[t]
            q = np.where(inside[:, t], q, 0.0)
            both += np.einsum("is,ij,js->ij", alpha[t - 1], a, q)
            beta[t - 1] = np.where(inside[:, t], a @ q, 1.0)
        post = alpha * beta
        p = (post[:, 1] / post.sum(1)).T
        rest = np.where(inside, labels - p, 0.0)
        grad_w = np.bincount(flat, np.repeat(rest.reshape(-1), ids.shape[2]), len(w))
        grad_w[0] = 0
        grads = [(grad_w - PENALTY * w) / n, np.array([rest.sum() / n]), (seen - both - PENALTY * tr) / n, np.array([rest[:, 0].sum() / n])]
        for x, gr, (m1, m2) in zip((w, bias, tr, st), grads, moments, strict=True):
            m1 += 0.1 * (gr - m1)
            m2 += 0.001 * (gr * gr - m2)
            x += 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w[0] = 0
    return Tagger(dict(zip(marks, w[1:].tolist(), strict=True)), float(bias[0]), tr, float(st[0]))


def fit_documents(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge; for no or one-sided labels the prior."""
    if not len(y) or y.min() == y.max():
        return np.array([-4.0 if not len(y) or not y.max() else 4.0, 0.0, 0.0])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, toxic documents, documents) combined over each batch."""
    for b in batches:
        n, toxic = Counter(), Counter()
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            found = {m for w in set(words_of(text)) for m in marks_of(w)}
            n.update(found)
            if label:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([toxic[m] for m in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["mark", "toxic", "n"])


def _evidence(toxic: Column, n: Column, all_toxic: int, all_docs: int) -> Column:
    """Twice the log-likelihood gained by two rates in place of one; signed lift is checked apart."""
    rate = all_toxic / all_docs
    clean = n - toxic
    term = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    return 2 * (term(toxic, n * rate) + term(clean, n * (1 - rate)))


def toxic_marks(sample: DataFrame) -> list[str]:
    """Marks whose documents are toxic far more often than others, the strongest first. sample: distinct texts with their label."""
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return []
    counted = sample.mapInArrow(_mark_counts, "mark string, toxic long, n long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    counted = written(counted, "toxic-marks")
    least = max(MIN_EVIDENCE, 2 * math.log(max(1, counted.count())))
    lift = (F.col("toxic") / toxic) / ((F.col("n") - F.col("toxic") + 1) / (n - toxic))
    strong = counted.withColumn("evidence", _evidence(F.col("toxic"), F.col("n"), toxic, n)).where((F.col("evidence") >= least) & (lift >= MIN_LIFT))
    return [r["mark"] for r in strong.orderBy(F.desc("evidence"), "mark").select("mark").collect()]


def _segments(sample: DataFrame, marks: list[str]) -> pd.DataFrame:
    """Labelled token runs for training: whole texts, by hash, until those of their label have TRAIN_TOKENS words or more. Toxic texts without a mark are left out, as nothing tells which tokens are meant."""
    hashed, words = F.xxhash64("text"), F.size(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))
    sizes = sample.select("toxic", hashed.alias("h"), words.alias("n")).toPandas().sort_values("h")  # numbers of TRAIN_DOCS rows
    before = sizes.groupby("toxic")["n"].cumsum() - sizes["n"]
    last = sizes[before < TRAIN_TOKENS].groupby("toxic")["h"].max()
    drawn = [(F.col("toxic") == int(k)) & (hashed <= int(h)) for k, h in last.items()]
    sample = sample.where(reduce(operator.or_, drawn, F.lit(False)))
    known = sample.sparkSession.sparkContext.broadcast(frozenset(marks))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, runs, tags = [], [], []
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = words_of(text)
                tag = [int(bool(label) and any(m in known.value for m in marks_of(w))) for w in words]
                if label and not any(tag):
                    continue
                for k in range(0, len(words), SEGMENT):
                    toxic.append(int(label))
                    runs.append(words[k : k + SEGMENT])
                    tags.append(tag[k : k + SEGMENT])
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(runs, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32()))], ["toxic", "words", "tags"])

    return sample.select("text", "toxic").mapInArrow(cut, "toxic int, words array<string>, tags array<int>").toPandas()


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 5) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Tagger:
    """A tagger fitted on labelled documents that aren't held out, about TRAIN_DOCS of them at most, repeats of a text counted once.

    A document's label is 1 if half of its rows in labels or more say so; null labels don't count. Its tokens are labelled
    toxic if it is and they bear a mark of toxic documents. Without labels of both kinds every score is the prior.
    """
    each = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    each = each.where(~held_out(F.col("doc_id")))
    count = each.count()
    draw = F.xxhash64("doc_id", F.lit(5)).bitwiseAND((1 << 30) - 1) / float(1 << 30)
    chosen = each.where(draw < TRAIN_DOCS / max(1, count))  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-texts")
    few = F.xxhash64("text", F.lit(7)).bitwiseAND((1 << 30) - 1) / float(1 << 30) < TRAIN_DOCS / max(1, texts.count())
    sample = written(texts.where(few), "toxic-sample")  # a doc_id may have any number of rows
    marks = toxic_marks(sample)
    if not marks:
        share = sample.agg(F.avg("toxic")).first()[0]
        return Tagger({}, document=fit_documents(np.zeros((1, 3)), np.array([int((share or 0) >= 0.5)])))
    runs = _segments(sample, marks)
    number = {m: k for k, m in enumerate(marks, 1)}
    ids = np.zeros((len(runs), SEGMENT, 1 + len(PREFIXES)), np.int32)
    tags = np.zeros((len(runs), SEGMENT), np.int64)
    for s, (words, tag) in enumerate(zip(runs["words"], runs["tags"], strict=True)):
        tags[s, : len(tag)] = tag
        for t, w in enumerate(words):
            for k, m in enumerate(marks_of(w)):
                ids[s, t, k] = number.get(m, 0)
    model = train_chain(marks, ids, np.array([len(w) for w in runs["words"]]), tags)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shared.value.features(shared.value.marginals([words_of(t) for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *[pa.array(x[:, k]) for k in (1, 2)]], ["toxic", "top", "mass"])

    x = sample.mapInArrow(features, "toxic int, top double, mass double").toPandas()
    model.document = fit_documents(np.column_stack([np.ones(len(x)), x["top"], x["mass"]]), x["toxic"].to_numpy(np.float64))
    return model


def _slices(b: pa.RecordBatch, characters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many characters, so that marginals of few tokens are in memory at once."""
    sizes = np.cumsum([len(t or "") for t in b.column("text").to_pylist()])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // characters)) + 1).tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield b.slice(i, j - i)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, spans (array of start, end, probability in characters).

    Spans rest on the marginals of tokens alone, so documents with a score below 0.5 have them too. Only the whole text enters a
    score. Null and empty texts have no token and the lowest score; repeats have equal scores; an empty table gives no rows;
    further columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                texts = b.column("text").to_pylist()
                marginals = shared.value.marginals([words_of(t) for t in texts])
                s = shared.value.scores(marginals)
                spans = [[{"start": x, "end": y, "probability": p} for x, y, p in shared.value.spans(t, m)] if m.max(initial=0.0) >= 0.5 else [] for t, m in zip(texts, marginals, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: long, end: long, probability: double>>")


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() with the offending offsets as text, start:end joined by commas."""
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return score(docs, labels).select("doc_id", "held_out", "score", "predicted", spans.alias("spans"))
