"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (n = 1..``MAX_N``, blended) that occur in both, normalised
by the geometric mean of their own numbers: a presence kernel, so length and repetition do not matter. N-grams are
counted exactly: three code points fit into one long. Nystroem's method
maps a text to its kernel values with ``LANDMARKS`` texts, whitened by the landmarks' own kernel matrix; one-versus-rest
kernel ridge regression is then a linear model on that map. Scoring a batch is two matrix products: presence rows over the
landmarks' n-grams that occur in the batch times the landmarks' own, and kernel values times the model.

The classifier is fitted on a bounded sample: the ``SAMPLE`` labelled training rows per language with the smallest hash
of their id and text (a documented parameter; the same rows for any layout of the table). The driver gets the distinct
n-grams of the ``LANDMARKS`` first rows of each language and, from the executors, the kernel values of all sample rows.

Only the text enters a prediction. Defined results: null texts and texts without a letter are ``und`` with score 0; when no
labelled row is left to learn from, every text is ``und``; equal scores go to the smaller language name; null
``doc_id`` counts as held out only if crc32 of its text form says so, which null never does; repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from receivables.llm.common import pieces_of, written

MAX_N = 3
COLUMNS = 1 << 14  # n-grams of one matrix product
SAMPLE = 400  # labelled rows per language
LANDMARKS = 48  # per language
RIDGE = 1e-3
UNKNOWN = "und"
CHUNK_CHARS = 1 << 19


def grams(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct n-grams of each text, code points packed into one number without loss. Letters are lower-cased,
    everything else is one space."""
    out = []
    for text in texts:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        clean = np.where(_letter(codes), codes, 0x20).astype(np.int64)
        double = np.zeros(len(clean), dtype=bool)
        double[1:] = (clean[1:] == 0x20) & (clean[:-1] == 0x20)
        clean = clean[~double]
        found, h = [], np.zeros(len(clean), dtype=np.int64)
        for n in range(1, min(MAX_N, len(clean)) + 1):
            h = (h[: len(clean) - n + 1] << 21) | clean[n - 1 :]
            found.append(np.unique(h))  # no code is 0, so different n never meet
        out.append(np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64))
    return out


class Landmarks:
    """Exact n-gram sets of the landmark texts, by n-gram."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.grams, column = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)
        order = np.argsort(column, kind="stable")
        self.owner = owner[order]
        self.start = np.searchsorted(column[order], np.arange(len(self.grams) + 1))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of every set with every landmark."""
        size = np.array([len(x) for x in sets], dtype=np.int64)
        shared = np.zeros((len(sets), len(self.sizes)), dtype=np.float32)
        if len(self.grams) and size.sum():
            row, every = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
            at = np.minimum(np.searchsorted(self.grams, every), len(self.grams) - 1)
            hit = self.grams[at] == every
            met, column = np.unique(at[hit], return_inverse=True)
            row = row[hit]
            for lo in range(0, len(met), COLUMNS):
                part = met[lo : lo + COLUMNS]
                here = (column >= lo) & (column < lo + COLUMNS)
                rows = np.zeros((len(sets), len(part)), dtype=np.float32)
                rows[row[here], column[here] - lo] = 1
                marks = np.zeros((len(part), len(self.sizes)), dtype=np.float32)
                times = self.start[part + 1] - self.start[part]
                entry = np.arange(times.sum()) + np.repeat(self.start[part] - np.cumsum(times) + times, times)
                marks[np.repeat(np.arange(len(part)), times), self.owner[entry]] = 1
                shared += rows @ marks
        return shared / np.sqrt(np.outer(np.maximum(size, 1), np.maximum(self.sizes, 1))).astype(np.float32)


_LETTERS: np.ndarray | None = None


def _letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters (by Python's str.isalpha)."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS[codes]


class KernelRidge:
    """Nystroem map over landmarks and one ridge regression per language. ``own``: the landmarks' kernel with each other,
    ``values``: that of the sample rows with the landmarks."""

    def __init__(self, landmarks: Landmarks, own: np.ndarray, values: np.ndarray, langs: list[str], ridge: float = RIDGE):
        self.names = sorted(set(langs))
        y = np.array([self.names.index(x) for x in langs])
        self.landmarks = landmarks
        if len(self.names) < 2:
            self.weights = None
            return
        value, vector = np.linalg.eigh(own.astype(np.float64))
        good = value > 1e-6 * value[-1]
        whiten = vector[:, good] / np.sqrt(value[good])
        z = values @ whiten
        z1 = np.hstack([z, np.ones((len(z), 1))])
        target = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        weight = 1.0 / np.bincount(y)[y]  # every language weighs the same
        gram = (z1 * weight[:, None]).T @ z1
        solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), (z1 * weight[:, None]).T @ target)
        self.weights = (np.vstack([whiten @ solved[:-1], solved[-1:]])).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = lettered(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.weights is None:
            margin = np.ones((len(texts), 1), dtype=np.float32)
        else:
            margin = self.landmarks.kernel(grams([t or "" for t in texts])) @ self.weights[:-1] + self.weights[-1]
        best = margin.argmax(axis=1)
        top = margin[np.arange(len(texts)), best]
        score = 1 / (1 + np.exp(-2.0 * np.clip(top, -20, 20)))
        return (
            [self.names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)],
            [float(s) if ok else 0.0 for s, ok in zip(score, known, strict=True)],
        )


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def lettered(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and has_letter(t) for t in texts], dtype=bool)


def training_sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """N-grams of the labelled training rows with the smallest hashes, ``per_language`` of each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    keyed = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text", "doc_id").alias("g"))
    # The smallest hashes of each language: every task keeps its own first, then the few are ranked together.
    part = Window.partitionBy("lang", F.pmod("g", F.lit(64))).orderBy("h", "g")
    some = keyed.withColumn("r", F.row_number().over(part)).where(F.col("r") <= per_language).drop("r")
    order = Window.partitionBy("lang").orderBy("h", "g")
    chosen = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    texts = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text", "doc_id").alias("g"))
    met = texts.join(F.broadcast(chosen.select("lang", "h", "g", "rank")), ["lang", "h", "g"])  # at most per_language rows a language

    def featurise(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", CHUNK_CHARS):
                found = grams(batch.column("text")[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang")[lo:hi], batch.column("rank")[lo:hi], pa.array([x.tobytes() for x in found], pa.binary())], ["lang", "rank", "grams"]
                )

    found = met.select("lang", "rank", "text").mapInArrow(featurise, "lang string, rank int, grams binary")
    return found.dropDuplicates(["lang", "rank"])  # repeated rows share a rank


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.int64) for x in column.to_pylist()]


def fit(docs: DataFrame) -> KernelRidge:
    sample = written(training_sample(docs), "language-sample")
    # The first rows of each language, in the sample's own hash order, are its landmarks.
    first = sample.where(F.col("rank") <= LANDMARKS).orderBy("lang", "rank").toArrow()
    landmarks = Landmarks(unpacked(first.column("grams")))
    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def values(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "grams", 8 * CHUNK_CHARS):
                found = shared.value.kernel(unpacked(batch.column("grams")[lo:hi]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("lang", "rank")), pa.array([x.tobytes() for x in found], pa.binary())], ["lang", "rank", "kernel"])

    rows = sample.mapInArrow(values, "lang string, rank int, kernel binary").orderBy("lang", "rank").collect()  # SAMPLE rows a language
    of = np.frombuffer(b"".join(r["kernel"] for r in rows), np.float32).reshape(len(rows), len(landmarks.sizes))
    own = of[[r["rank"] <= LANDMARKS for r in rows]]
    return KernelRidge(landmarks, own, of, [r["lang"] for r in rows])


def identify(docs: DataFrame, pred: str = "lang_pred", score: str = "score", letter: str | None = None) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score (named so that they clash with no column), and
    on demand whether the text has a letter, which holds with or without a model."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")))
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    if letter is not None:
        schema = schema.add(letter, BooleanType())

    def predict(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", CHUNK_CHARS):
                for at in range(lo, hi, 512):  # presence rows of 512 texts at a time
                    part = batch.slice(at, min(512, hi - at))
                    texts = part.column("text").to_pylist()
                    langs, scores = model.value.predict(texts)
                    more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                    if letter is not None:
                        more.append(pa.array(lettered(texts)))
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)

    return docs.mapInArrow(predict, schema)


def language_rows(docs: DataFrame) -> DataFrame:
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = identify(kept)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
