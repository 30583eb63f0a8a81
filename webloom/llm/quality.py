"""Quality scores from compression against good and bad text.

Two zstandard dictionaries are made of labelled text, one of each label.  A text
is compressed with either; the difference of the two sizes by their sum says
which of the dictionaries knows its like, and a logistic curve, fitted on
labelled text that is in neither dictionary, turns it into a probability.

What is compressed is the shape of a text and not its words: runs of letters of
one case are one letter, runs of digits one digit, and a word that repeats the
one before it is its place in the run.  Labels speak of how a text is written, and the shape
says that in a tenth of the bytes and in any language.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import append, keyed_texts

#: Labelled rows of either label that a fit uses at most.
SAMPLE_PER_LABEL = 3000
#: Labelled texts above this many characters are not used to fit.
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 1 << 17
LEVEL = 6
#: Scores from here on count as good.
THRESHOLD = 0.3

_SHAPE = bytes(
    ord("A") if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else ord("a") if b >= 128 or chr(b).isalpha() else ord("9") if chr(b).isdigit() else b
    for b in range(256)
)
_RUN = re.compile(rb"a{2,}|A{2,}|9{2,}")


def shape(text: str) -> bytes:
    words = text.encode("utf-8", "surrogatepass").split(b" ")
    forms = _RUN.sub(lambda run: run[0][:1], b" ".join(words).translate(_SHAPE)).split(b" ")
    repeats = 0
    for k in range(1, len(words)):
        repeats = repeats + 1 if words[k] == words[k - 1] else 0
        if repeats:
            # Counted, or a long run would be one short match in any dictionary.
            forms[k] = b"=%d" % (repeats % 1000)
    return b" ".join(forms)


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the weights of the curve; a few hundred kilobytes.

    Without text of both labels there is nothing to compare, and ``constant`` is
    the score of every text.
    """

    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()
    constant: float | None = None

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        features, weights = _features(self.good, self.bad), np.array(self.weights)
        return lambda texts: _curve(features(texts) @ weights)


def _curve(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


def _features(good: bytes, bad: bytes) -> Callable[[list[str]], np.ndarray]:
    by_good, by_bad = _compressor(good), _compressor(bad)

    def features(texts: list[str]) -> np.ndarray:
        sizes = np.array(
            [(len(by_good.compress(s)), len(by_bad.compress(s))) for s in map(shape, texts)], dtype=float
        ).reshape(-1, 2)
        total = sizes.sum(axis=1)
        difference = (sizes[:, 1] - sizes[:, 0]) / np.maximum(total, 1)
        return np.column_stack([np.ones(len(texts)), difference, difference * np.log(np.maximum(total, 1))])

    return features


def _dictionary(texts: list[str]) -> bytes:
    held, size = [], 0
    for text in texts:
        if size >= DICTIONARY_BYTES:
            break
        held.append(shape(text))
        size += len(held[-1]) + 1
    return b"\n".join(held)[:DICTIONARY_BYTES] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; the ridge keeps separable samples finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _curve(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(texts: list[str], labels: list[int]) -> QualityModel:
    """A model of labelled texts in a fixed order."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return QualityModel(constant=float(y.mean()) if len(y) else 0.5)
    # Two texts in three go to the dictionaries; the curve sees the others.
    in_dictionary = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        in_dictionary[own[np.arange(len(own)) % 3 != 2]] = True
    good, bad = (_dictionary([t for t, q, d in zip(texts, y, in_dictionary) if q == label and d]) for label in (1, 0))
    curve = ~in_dictionary if len(set(y[~in_dictionary])) == 2 else np.ones(len(y), dtype=bool)
    x = _features(good, bad)([t for t, c in zip(texts, curve) if c])
    return QualityModel(good, bad, tuple(_logistic(x, y[curve].astype(float))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
) -> QualityModel:
    """Fit on at most ``per_label`` rows of each label, chosen by a hash of their id.

    The sample is the only thing that reaches the driver, and it is bounded by
    ``per_label`` and ``SAMPLE_CHARS``.  Labels other than 0 and 1, and null ids,
    are not used; neither is a text that is null.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)")
    picked = [
        (r.doc_id, r.label)
        for label in (0, 1)
        for r in known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()
    ]
    if not picked:
        return QualityModel(constant=0.5)
    spark = docs.sparkSession
    wanted = spark.createDataFrame(picked, "doc_id long, label int")
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sample = (
        given.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
        .join(F.broadcast(wanted), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text")
        .limit(4 * per_label)
        .toArrow()
    )
    return fit_texts(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list[str]], list[pa.Array]]:
        scorer = shared.value.scorer()
        return lambda texts: [pa.array(scorer(texts), pa.float64())]

    return append(docs, text_col, pa.schema([(score_col, pa.float64())]), start, keep)


def held_out(id_col: F.Column = None) -> F.Column:
    """Rows that no fit may learn from: every fifth id by its checksum."""
    key = F.col("doc_id") if id_col is None else id_col
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_on_rest(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model of the catalogue and the pipeline: held-out rows are not learned from."""
    return fit(docs, labels.where(~held_out(labels["doc_id"])))
