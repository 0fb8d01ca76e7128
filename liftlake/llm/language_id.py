"""Language id (op 1) by string kernels.

A text is the set of its character n-grams of length 1 to 3 (blended spectrum,
presence only); the kernel of two texts is the number of n-grams they share
over the geometric mean of their numbers. Landmark texts give a Nystroem
feature map, on which one-versus-rest kernel ridge regression is solved in
closed form. A block of texts is scored by two matrix products: presence by
landmarks, then by the coefficients. Every letter of the sample counts as itself
whatever its script (class 0 is anything but a letter, class 1 a letter that the
sample lacks, whose n-grams are none of its features).

The model is fitted on a bounded sample of the labelled rows outside the
held-out fold: the ``per_language`` smallest hashes of each language, at most
``sample_rows`` in all, texts of at most ``max_fit_chars``. Prediction reads
every text whole and nothing but the text.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties between languages fall by code point; with no labelled row every text
is ``und``; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, text_chunks

FOLDS = 5
PER_LANGUAGE = 200
SAMPLE_ROWS = 4000
MAX_FIT_CHARS = 20_000
LANDMARKS = 128
RIDGE = 1e-3
# Texts scored at once and, with many n-grams, presence cells at once.
BLOCK_TEXTS = 256
BLOCK_CELLS = 1 << 26
# Gram codes are looked up in a table up to this size, else by binary search.
TABLE_CODES = 1 << 20


@functools.lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def code_points(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a run of texts and the bounds of each text in them."""
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, starts[bounds]


def grams(classes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Codes of the n-grams of a run of classes below ``base``."""
    code = classes[: len(classes) - n + 1].astype(np.int32 if base**n < 1 << 31 else np.int64)
    for i in range(1, n):
        code = code * base + classes[i : len(classes) - n + 1 + i]
    return code


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # by code point
    base: int  # number of classes
    codes: list[np.ndarray]  # for each length, the sample's gram codes in order
    tables: list[np.ndarray | None]  # for each length, gram code to feature or -1 where that is a small table
    size: int  # features
    marks: np.ndarray  # features x landmarks, as packed bits
    norms: np.ndarray  # by landmark
    weights: np.ndarray  # landmarks x languages

    @property
    def block(self) -> int:
        """Texts whose presence fits a task's memory."""
        return max(1, min(BLOCK_TEXTS, BLOCK_CELLS // max(1, self.size)))

    def features(self, code: np.ndarray, n: int) -> np.ndarray:
        if self.tables[n - 1] is not None:
            return self.tables[n - 1][code]
        own = self.codes[n - 1]
        at = np.minimum(np.searchsorted(own, code), len(own) - 1)
        return np.where(own[at] == code, at + sum(map(len, self.codes[: n - 1])), -1)

    def presence(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts by the features that occur in them, 1 where the text has the
        n-gram, and those features."""
        classes = self.classes[points]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        place, every = np.zeros(self.size, np.int32), []
        for n in range(1, len(self.codes) + 1):
            if len(classes) < n or not len(self.codes[n - 1]):
                continue
            found = self.features(grams(classes, n, self.base), n)
            last = len(found)
            ok = (found >= 0) & (text[:last] == text[n - 1 : n - 1 + last])
            every.append((text[:last][ok], found[ok]))
            place[found[ok]] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        out = np.zeros((len(bounds) - 1, len(used)), np.float32)
        for rows, found in every:
            out[rows, place[found]] = 1
        return out, used

    def kernel(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        presence, used = self.presence(points, bounds)
        shared = np.zeros((len(presence), len(self.norms)), np.float32)
        for a in range(0, len(used), 1 << 15):
            marks = np.unpackbits(self.marks[used[a : a + (1 << 15)]], axis=1, count=len(self.norms))
            shared += presence[:, a : a + (1 << 15)] @ marks.astype(np.float32)
        return shared / np.sqrt(np.maximum(presence.sum(axis=1), 1))[:, None] / self.norms

    def scores(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.kernel(points, bounds) @ self.weights


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``texts`` in a fixed order; landmarks are taken from each language in
    turn until there are enough."""
    languages = sorted(set(labels))
    points, bounds = _flat(texts)
    lowered = _lowered()
    alphabet = np.flatnonzero(np.bincount(lowered[points], minlength=2)[1:]) + 1
    by_letter = np.ones(0x110000, np.int32)
    by_letter[0] = 0
    by_letter[alphabet] = np.arange(2, 2 + len(alphabet))
    classes = by_letter[lowered]
    base = 2 + len(alphabet)
    codes, tables, size = [], [], 0
    for n in (1, 2, 3):
        found = [np.zeros(0, np.int64)]
        for a in range(0, len(texts), BLOCK_TEXTS):
            at = bounds[a : a + BLOCK_TEXTS + 1]
            own, text = classes[points[at[0] : at[-1]]], np.repeat(np.arange(len(at) - 1), np.diff(at))
            if len(own) >= n:
                found.append(np.unique(grams(own, n, base)[text[: len(own) - n + 1] == text[n - 1 :]]))
        codes.append(np.unique(np.concatenate(found)))
        tables.append(None)
        if base**n <= TABLE_CODES:
            tables[-1] = np.full(base**n, -1, np.int32)
            tables[-1][codes[-1]] = np.arange(size, size + len(codes[-1]))
        size += len(codes[-1])
    turn: dict[str, int] = {}
    order = []
    for i, label in enumerate(labels):
        turn[label] = turn.get(label, 0) + 1
        order.append((turn[label], label, i))
    picked = [i for _, _, i in sorted(order)[:landmarks]]
    norms = np.ones(len(picked), np.float32)
    model = Model(languages, classes, base, codes, tables, size, np.zeros((size, -(-len(picked) // 8)), np.uint8), norms, np.zeros((1, 1), np.float32))
    for j, i in enumerate(picked):
        _, used = model.presence(points[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
        model.marks[used, j >> 3] |= np.uint8(128 >> (j & 7))
        norms[j] = np.sqrt(max(1, len(used)))
    kernel = np.concatenate([
        model.kernel(points[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        for a in range(0, len(texts), model.block) for b in [min(a + model.block, len(texts))]
    ]).astype(np.float64)
    among = kernel[picked]
    # Nystroem map: the inverse square root of the landmarks' own kernel.
    value, vector = np.linalg.eigh((among + among.T) / 2)
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    mapped = kernel @ root
    goal = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    # Rows of a language share its weight, so that rare ones count alike.
    weight = 1 / np.array([labels.count(x) for x in labels], float)
    gram = mapped.T @ (mapped * weight[:, None]) + ridge * len(languages) * np.eye(mapped.shape[1])
    model.weights = (root @ np.linalg.solve(gram, mapped.T @ (goal * weight[:, None]))).astype(np.float32)
    return model


def fit_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS, max_chars: int = MAX_FIT_CHARS) -> DataFrame:
    """The bounded sample (lang, text) of labelled rows outside the fold."""
    spread = F.xxhash64("doc_id", "text")
    chosen = (
        docs.where("lang is not null and text is not null").where(~held_out()).where(F.length("text") <= max_chars)
        .where(F.col("text").rlike(r"\p{L}"))
        .select("lang", "text", spread.alias("h"))
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h")))
        .where(F.col("place") <= per_language)
    )
    return chosen.orderBy("place", "lang").limit(rows).select("lang", "text")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


_RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        lowered = _lowered()
        for batch in batches:
            names, scores = [], []
            for _, raw, bounds in text_chunks(batch.column("text")):
                points, at = code_points(raw, bounds)
                letter = np.concatenate(([0], np.cumsum(lowered[points] > 0)))
                known = letter[at[1:]] > letter[at[:-1]]
                step = model.block if model else BLOCK_TEXTS
                for a in range(0, len(known), step):
                    b = min(a + step, len(known))
                    if model is None:
                        names += ["und"] * (b - a)
                        scores += [0.0] * (b - a)
                        continue
                    found = model.scores(points[at[a] : at[b]], at[a : b + 1] - at[a])
                    best = found.argmax(axis=1)
                    sure = np.clip((found.max(axis=1) + 1) / 2, 0, 1)
                    names += [model.languages[j] if k else "und" for j, k in zip(best.tolist(), known[a:b].tolist())]
                    scores += np.where(known[a:b], sure, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=_SCHEMA
            )

    return predict


def predict_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document."""
    sample = fit_sample(docs, per_language).collect()
    model = fit([r["text"] for r in sample], [r["lang"] for r in sample], landmarks) if sample else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), _RESULT)


def op1(spark, sf_dir: str) -> DataFrame:
    return predict_languages(documents(spark, sf_dir).select("doc_id", "text", "lang"))
