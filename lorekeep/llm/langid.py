"""Language ID with a bit-sliced Bloom filter: each n-gram's probe returns a bitmask of all languages that contain it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

#: Bytes in an n-gram.
GRAM = 4
#: Labelled rows that a language is learned from at most, drawn by hash; all rows where there are fewer.
TRAIN_ROWS = 20_000
#: A language contains an n-gram if this share of its documents, and one at least, does: strays of other languages stand in nearly any large sample.
MIN_SHARE = 0.01
#: Positions of the filter for each (language, n-gram), and probes of an n-gram.
POSITIONS = 16
PROBES = 3
#: The pipeline rejects documents of which a smaller share of n-grams belongs to the decided language.
MIN_COVERAGE = 0.15
UNDECIDED = "und"
#: Languages of one bitmask; more take further masks.
MASK_LANGUAGES = 64

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_SEGMENT = 1 << 20


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; other characters of words, as fractions and raised figures, aren't."""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def grams(text: str) -> np.ndarray:
    """All byte n-grams of the lower-cased words, a space before and after each word, as uint32; whole text, in order."""
    clean = b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_LETTERS).split(), b""])
    if len(clean) < GRAM:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(clean, np.uint8)
    out = np.zeros(len(b) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        out |= b[k : len(b) - GRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class LanguageFilter:
    """masks: for each MASK_LANGUAGES languages, the languages that set each position. false_positive: for each language the chance that an unknown n-gram passes all probes."""

    languages: tuple[str, ...]
    masks: tuple[np.ndarray, ...]
    false_positive: np.ndarray

    @staticmethod
    def positions(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        for k in range(PROBES):
            yield (h >> np.uint64(k * 21)) & np.uint64((1 << bits) - 1)

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> LanguageFilter:
        """members: for each language its n-grams, which decide the filter's size."""
        bits = max(12, int(np.ceil(np.log2(POSITIONS * max([1, *map(len, members)])))))
        masks, wrong = [], []
        for at in range(0, len(languages), MASK_LANGUAGES):
            some = members[at : at + MASK_LANGUAGES]
            kind = np.uint8 if len(some) <= 8 else np.uint16 if len(some) <= 16 else np.uint32 if len(some) <= 32 else np.uint64
            mask = np.zeros(1 << bits, kind)
            for k, g in enumerate(some):
                for p in cls.positions(g, bits):
                    mask[p] |= kind(1 << k)
                wrong.append(float(np.count_nonzero(mask & kind(1 << k)) / len(mask)) ** PROBES)
            masks.append(mask)
        return cls(tuple(languages), tuple(masks), np.array(wrong))

    def languages_of(self, g: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the bitmasks of the languages that contain it."""
        found = [None] * len(self.masks)
        for p in self.positions(g, int(len(self.masks[0])).bit_length() - 1) if self.masks else ():
            found = [m[p] if f is None else f & m[p] for f, m in zip(found, self.masks, strict=True)]
        return found

    def counts(self, g: np.ndarray) -> np.ndarray:
        """For each language how many of the n-grams it contains, corrected for false positives: (count - n f) / (1 - f), 0 at least."""
        raw = np.zeros(len(self.languages))
        for at in range(0, len(g), _SEGMENT):
            found = self.languages_of(g[at : at + _SEGMENT])
            raw += [np.count_nonzero(f & f.dtype.type(1 << k % MASK_LANGUAGES)) for k in range(len(self.languages)) for f in found[k // MASK_LANGUAGES : k // MASK_LANGUAGES + 1]]
        return np.maximum(0, (raw - len(g) * self.false_positive) / (1 - self.false_positive))

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, coverage): the score is its part of all languages' counts, the coverage its part of the n-grams. Ties go to the first by name; unknown text to the first, with score 0."""
        if not has_letter(text) or not self.languages:
            return UNDECIDED, 0.0, 0.0
        g = grams(text)
        counts = self.counts(g)
        best = int(counts.argmax())
        total = counts.sum()
        return self.languages[best], float(counts[best] / total) if total else 0.0, float(min(1.0, counts[best] / len(g))) if len(g) else 0.0


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents) combined over each batch."""
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(np.unique(grams(text or "")))
        for lang, found in by.items():
            g, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(labelled: DataFrame) -> LanguageFilter:
    """The filter learned from labelled rows (text, lang): all n-grams that MIN_SHARE of a language's sampled documents hold, which by that are a bounded number."""
    labelled = labelled.where("lang is not null and text is not null").select("text", "lang")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return LanguageFilter.build([], [])
    draw = F.xxhash64("text").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    share = F.create_map(*[x for k, n in rows.items() for x in (F.lit(k), F.lit(TRAIN_ROWS / n))])
    sample = labelled.where(draw < share[F.col("lang")])
    counted = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*[x for k, n in rows.items() for x in (F.lit(k), F.lit(max(1.0, MIN_SHARE * min(n, TRAIN_ROWS))))])
    common = counted.where(F.col("n") >= least[F.col("lang")]).toPandas()
    languages, by = sorted(rows), dict(iter(common.groupby("lang")["gram"]))
    return LanguageFilter.build(languages, [by[k].to_numpy(np.uint32) if k in by else np.zeros(0, np.uint32) for k in languages])


def _decided(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.decide(t) for t in b.column("text").to_pylist()]
            columns = [*[c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "text"], *[pa.array([f[k] for f in found], pa.string() if not k else pa.float64()) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, [*[n for n in b.schema.names if n != "text"], "lang_pred", "score", "coverage"])

    return docs.mapInArrow(decide, "doc_id long, held_out boolean, lang_pred string, score double, coverage double")


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, coverage; learned from the rows that aren't held out.

    Only the whole text enters a prediction. `und` for null texts, texts without a letter, and where nothing could be learned.
    Each row stands for itself, so repeats have equal results; ties go to the first language by name; an empty table gives no
    rows; further columns aren't read.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return _decided(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)


def stage(docs: DataFrame) -> DataFrame:
    """docs whose language is decided and that are written in it: `und` (null and letterless texts too) and those below MIN_COVERAGE go.

    Streamed, all columns as they were; repeats go or stay together, an empty table stays empty.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.decide(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([lang != UNDECIDED and coverage >= MIN_COVERAGE for lang, _, coverage in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
