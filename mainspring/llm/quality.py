"""Quality by regularised quadratic discriminant analysis.

Whole texts become a few transformed statistics. Each class has a mean and a covariance that
is shrunk towards the pooled one and towards a multiple of the identity; how far is chosen by
cross-validated log loss. A score is the logistic of the difference of the two Mahalanobis log
densities, computed with Cholesky factors that are kept in the model.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, fit_platt, held_out, sigmoid, texts
from .toxicity import _sample

NAMES = ("chars", "words", "word_length", "long_words", "upper", "digits", "marks", "odd_marks", "runs_of_marks", "distinct", "commonest", "repeated_next", "repeated_pairs", "lines", "repeated_lines", "bars", "stops", "entropy", "compression")
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 usual mark, 5 odd mark, 6 space
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 6 if _c.isspace() or _i < 32 else 4 if _c in ".,;:'\"!?()-" else 5
_RUN = re.compile(r"[^\w\s]{2,}")


def _logit(share: float) -> float:
    return float(np.log((share + 0.005) / (1.005 - share)))


def statistics(text: str | None) -> np.ndarray:
    """One value for each of NAMES: logarithms of sizes, log odds of shares."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, len(data))
    kinds = np.bincount(_CLASS, weights=counts, minlength=7) / total
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / total
    size = 0
    squeeze = zlib.compressobj(1)
    for at in range(0, len(data), 1 << 16):
        size += len(squeeze.compress(data[at : at + (1 << 16)]))
    size += len(squeeze.flush())
    ends = sum(x.rstrip()[-1:] in ".!?" for x in lines)
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(sum(map(len, words)) / n), _logit(sum(len(w) > 15 for w in words) / n),
        _logit(kinds[2]), _logit(kinds[3]), _logit(kinds[4]), _logit(kinds[5]), _logit(min(1.0, len(_RUN.findall(text)) / n)),
        _logit(len(seen) / n), _logit(max(seen.values(), default=0) / n),
        _logit(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), _logit(1 - len(pairs) / max(1, n - 1) if pairs else 0.0),
        np.log1p(len(lines)), _logit(1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0), _logit(data.count(b"|") / n if data.count(b"|") < n else 1.0),
        _logit(ends / max(1, len(lines))), float(-(p * np.log2(p)).sum()), np.log1p(size / total),
    ])


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the lower Cholesky factor
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return -0.5 * (z * z).sum(-1) - 0.5 * self.log_det


@dataclass
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian]
    slope: float = 1.0
    intercept: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -12, 12)
        return np.clip(self.classes[1].log_density(z) - self.classes[0].log_density(z), -200, 200)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.intercept)


def _gaussians(z: np.ndarray, y: np.ndarray, pool: float, round_: float) -> tuple[Gaussian, Gaussian]:
    own = [np.cov(z[y == c].T, bias=True) if (y == c).sum() > 1 else np.eye(z.shape[1]) for c in (0, 1)]
    pooled, out = sum(own[c] * (y == c).mean() for c in (0, 1)), []
    for c in (0, 1):
        s = (1 - pool) * own[c] + pool * pooled
        s = (1 - round_) * s + round_ * (np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        out.append(Gaussian(z[y == c].mean(0), np.linalg.inv(low), 2 * float(np.log(np.diag(low)).sum())))
    return tuple(out)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 4) -> QualityModel:
    center, scale = x.mean(0), x.std(0) + 1e-6
    z, fold = np.clip((x - center) / scale, -12, 12), np.arange(len(y)) % folds
    best = (np.inf, 0.1, 0.1, 1.0, 0.0)
    for pool in (0.0, 0.1, 0.3, 0.6, 1.0):
        for round_ in (0.003, 0.03, 0.1, 0.3):
            m = np.zeros(len(y))
            for f in range(folds):
                out, rest = fold == f, fold != f
                if len(set(y[rest].tolist())) < 2 or not out.any():
                    continue
                g = _gaussians(z[rest], y[rest], pool, round_)
                m[out] = np.clip(g[1].log_density(z[out]) - g[0].log_density(z[out]), -200, 200)
            a, b = fit_platt(m, y.astype(float), weight, ridge=1e-2)
            p = np.clip(sigmoid(a * m + b), 1e-9, 1 - 1e-9)
            loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
            best = min(best, (loss, pool, round_, a, b))
    return QualityModel(center, scale, _gaussians(z, y, best[1], best[2]), best[3], best[4])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, seed: int = 23) -> QualityModel | None:
    """None if there is no example of both labels to learn from."""
    sample, counts = _sample(docs, labels, "quality", 3, 1, per_class, seed)

    def run(batch):
        return {"id": batch.column("doc_id"), "y": batch.column("y"), "x": [statistics(t).tolist() for t in texts(batch)]}

    got = arrow_map(sample, run, "id long, y int, x array<double>").toPandas().sort_values(["id", "y"], kind="stable")
    y = got["y"].to_numpy(int)
    if not len(y) or y.min() == y.max():
        return None
    share = {c: counts[c] / (y == c).sum() for c in (0, 1)}
    return fit(np.array(got["x"].tolist()), y, np.array([share[c] for c in y]))


def score_quality(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """The probability that a text's quality label is 1.

    Returns doc_id, held_out, score, predicted. Null texts count as empty and get a score like
    others. Labels other than 0 and 1, null labels and null ids teach nothing; repeated label
    rows each count. Without examples of both labels every score is 0.5. Repeated documents
    each get a row; other columns of docs are left out.
    """
    model = model or train(docs, labels, **options)

    def run(batch):
        own = texts(batch)
        score = np.full(len(own), 0.5) if model is None else model.score(np.stack([statistics(t) for t in own]))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")
