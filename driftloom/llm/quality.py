"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text gives a fixed vector of transformed statistics. The fit gathers, for each class,
the count, the sums and the cross products of the vectors of labelled training rows (about FIT_ROWS
at most, by hash): a table of fixed size, summed on the executors. Class covariances are shrunk towards the pooled covariance and
its mean variance, and scores are differences of the two log-densities (plus log priors), with
Mahalanobis distances from Cholesky factors that are computed once and cached in the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FEATURES = (
    "word_length", "word_length_sd", "upper", "digits", "punctuation",
    "symbols", "pipes", "exclamations", "marked_words", "upper_words", "distinct_words",
    "repeated_lines", "line_words", "sentence_ends", "stop_words", "short_words",
)
#: Shrinkage of each class covariance towards the pooled one, and of that towards its mean variance.
TO_POOLED, TO_SPHERE = 0.3, 0.02
#: Log-odds are divided by this before the logistic function, which leaves order and sign.
TEMPER = 4.0
#: Labelled rows that the fit takes at most, about: a model of 2 x 152 numbers has long settled then.
FIT_ROWS = 100_000
#: The held-out fold: crc32(doc_id as text) mod 3 is 1.
FOLDS, HELD_OUT = 3, 1
_KIND = np.full(256, 0, np.uint8)  # 1 upper, 2 digit, 3 punctuation, 4 symbol, 5 pipe, 6 exclamation mark, 7 sentence end, 8 space
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b",;:'\"()-?", 3), (b"#$%&*@^~=+<>[]{}\\/_`", 4), (b"|", 5), (b"!", 6), (b".", 7), (b" \t\n\x0b\x0c\r", 8)):
    _KIND[list(_chars)] = _k
#: Short function words of the languages of the corpus; their share tells prose from lists.
_STOP = frozenset(b"the of and to in is that it for on with as by de la le les des et en un que el los las y del der die das und von zu mit den ein eine".split())


def features(text: str | None) -> np.ndarray:
    """The statistics of one whole text; null and empty texts give zeros."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9)
    n, chars = len(words), len(raw)
    sizes = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    lines = [s for x in raw.split(b"\n") if (s := x.strip())]
    marked = sum(1 for w in words if w[-1] in b"#$%&*!|")
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    stop = sum(1 for w in words if w.lower() in _STOP)
    share = lambda x, of, few=8: np.sqrt(x / (of + few))  # noqa: E731  spreads small shares, damps those of short texts
    out[:] = (
        np.log((sizes.sum() + 40) / (n + 8)), np.log1p(sizes.std()), share(kinds[1], chars), share(kinds[2], chars), share(kinds[3], chars),
        share(kinds[4], chars), share(kinds[5], chars), share(kinds[6], chars), share(marked, n), share(upper, n), np.log(len(distinct) / n),
        share(len(lines) - len(set(lines)), len(lines)), np.log((n + 40) / (len(lines) + 4)), share(kinds[7], n), share(stop, n), share(int((sizes <= 2).sum()), n),
    )
    return out


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, i, j, s) of a task: sums of products of the features, 1 standing before them."""
    d, sums = len(FEATURES) + 1, {}
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False)
        x = np.concatenate((np.ones((b.num_rows, 1)), _matrix(b.column(1))), axis=1)
        for label in np.unique(y):
            part = x[y == label]
            sums[label] = sums.get(label, 0) + part.T @ part
    i, j = np.triu_indices(d)
    for label, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), label, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], names=["label", "i", "j", "s"])


@dataclass(frozen=True)
class Discriminant:
    """Class 1 against class 0: priors, means and covariances."""

    prior: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """For each class the inverse of the Cholesky factor and half the log-determinant."""
        out = []
        for c in self.covariance:
            low = np.linalg.cholesky(c)
            out.append((np.linalg.inv(low), float(np.log(np.diag(low)).sum())))
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        logs = [np.log(p) - half - 0.5 * ((((x - m) @ inv.T) ** 2).sum(axis=1))
                for p, m, (inv, half) in zip(self.prior, self.mean, self.factors, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / TEMPER, -700, 700)))


def fit(moments: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """From the (d+1) x (d+1) product sums of each class. A class without rows takes the moments of
    the other; without any rows, all scores are one half."""
    d = len(FEATURES)
    both = [moments.get(k) for k in (0, 1)]
    if all(m is None for m in both):
        return Discriminant(np.array([0.5, 0.5]), np.zeros((2, d)), np.array([np.eye(d)] * 2))
    n = np.array([0.0 if m is None else m[0, 0] for m in both])
    both = [next(x for x in both if x is not None) if m is None else m for m in both]
    mean = np.array([m[0, 1:] / m[0, 0] for m in both])
    scatter = [m[1:, 1:] - m[0, 0] * np.outer(u, u) for m, u in zip(both, mean, strict=True)]
    pooled = sum(scatter) / max(sum(m[0, 0] for m in both) - 2, 1)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-4))  # also where a statistic is constant
    covariance = []
    for s, m in zip(scatter, both, strict=True):
        c = (1 - to_pooled) * s / max(m[0, 0] - 1, 1) + to_pooled * pooled
        covariance.append((1 - to_sphere) * c + to_sphere * floor)
    prior = (n + 1) / (n.sum() + 2)
    return Discriminant(prior, mean, np.array(covariance))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fits on the labelled rows of ``docs`` (doc_id, text) in the training folds; labels: (doc_id,
    quality). Of more labels than ``fit_rows`` those with the smallest hashes of doc_id are taken, so
    that only their texts are read twice. Null or other labels are left out; a label given
    twice counts once, a doc_id held twice twice."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    marked = marked.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(0x51), "doc_id"), 1)  # 63 bits
    known = marked.count()
    if known > fit_rows:
        marked = marked.where(spread < int(fit_rows / known * 2**63))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")  # fit_rows of 12 bytes, about
    sums = rows.select("label", "text").mapInArrow(_moments, "label int, i int, j int, s double")
    d, out = len(FEATURES) + 1, {}
    for r in sums.groupBy("label", "i", "j").agg(F.sum("s").alias("s")).collect():  # 2 classes of fixed size
        m = out.setdefault(r.label, np.zeros((d, d)))
        m[r.i, r.j] = m[r.j, r.i] = r.s
    return fit(out)


def _scorer(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...).

    Only the text enters a score. Null and empty texts have the same statistics and so the same
    score; a null doc_id is not held out; repeated rows are scored each; other columns are
    ignored. An empty table gives no rows; without labels every score is one half.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scorer(train(docs, labels)), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score 0.5 or more), with all their columns;
    labels only train. Null and empty texts share one score, so all of them stay or go; equal texts
    stay or go together. An empty table gives no rows; without labels every row stays."""
    model, names = train(docs, labels), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            yield b.filter(pa.array(model.score(_matrix(b.column(at))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
