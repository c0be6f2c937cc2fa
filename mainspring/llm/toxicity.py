"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index.

Terms are all words of the sample's texts, of both labels, and the beginnings of longer ones.
A term weighs (1 + log tf) * idf * g / (g + DISCOUNT): idf counts all texts, and g is the
likelihood ratio of the term against the labels of the sample, so words that tell nothing
about the label weigh little and none is left out. Terms of many examples are bounded by block
maxima: the cosine of an example is finished only if its bound reaches the k best, which
leaves the result as it is. Votes weighted by distance give a margin, which a logistic curve
fitted on leave-one-out votes turns into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, class_sample, fit_platt, held_out, one_text_each, remainder, sigmoid, slices, texts

BLOCK = 64
DISCOUNT = 30.0


_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """Runs of ASCII letters and characters beyond ASCII of the lower-cased text."""
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).decode().split()


def term_counts(text: str | None, prefixes: tuple = (5,)) -> Counter:
    """Counts of words, and of the first letters of longer ones, marked with a star."""
    words = Counter(words_of(text))
    out = Counter(words)
    for w, n in words.items():
        for k in prefixes:
            if len(w) >= k:
                out[w[:k] + "*"] += n
    return out


class _Codes(dict):
    """The row of each known word in `rows`, its number and that of its beginning; other words have the row of their beginning."""

    def __init__(self, terms: dict[str, int], width: int) -> None:
        begun = {w[:-1]: i for w, i in terms.items() if w[-1] == "*"}
        whole = [w for w in terms if w[-1] != "*"]
        super().__init__(zip(whole, range(len(whole))))
        self.width, self.begun = width, {w: len(whole) + k for k, w in enumerate(begun)}
        pairs = [(terms[w], begun.get(w[:width], -1) if len(w) >= width else -1) for w in whole]
        self.rows = np.array([*pairs, *((i, -1) for i in begun.values()), (-1, -1)], np.int64)

    def __missing__(self, word: str) -> int:
        return self.begun.get(word[: self.width], len(self.rows) - 1) if len(word) >= self.width else len(self.rows) - 1


def known_terms(terms: dict[str, int], width: int = 5) -> Callable:
    """A function from a text to the numbers of its terms, ascending, and their counts, without those not in `terms`."""
    codes = _Codes(terms, width)

    def look_up(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        own = codes.rows[list(map(codes.__getitem__, words_of(text)))].reshape(-1)
        return np.unique(own[own >= 0], return_counts=True)

    return look_up


def ratios(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio statistics of terms in `ones` of n1 and `zeros` of n0 examples."""
    share, g = (ones + zeros) / (n1 + n0), np.zeros(len(ones))
    for seen, total in ((ones, n1), (zeros, n0)):
        for part, q in ((seen, share), (total - seen, 1 - share)):
            some = (part > 0) & (q > 0)
            g[some] += 2 * part[some] * np.log(part[some] / (total * q[some]))
    return np.maximum(g, 0.0)


@dataclass
class Index:
    """Inverted index over unit vectors. Terms of few examples have their postings one after
    another; those of many have a dense row, and the row's maximum in every block of examples.
    """

    ids: np.ndarray
    labels: np.ndarray
    ptr: np.ndarray = field(init=False)
    places: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    row: np.ndarray = field(init=False)
    dense: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> Index:
        n, blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        sizes = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if n else np.zeros(0)
        place = np.repeat(np.arange(n, dtype=np.int32), sizes)
        seen = np.bincount(term, minlength=terms)
        common = np.flatnonzero(seen > max(8, n // 16))
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), blocks * BLOCK))
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], place[often]] = weight[often]
        self.most = self.dense.reshape(len(common), blocks, BLOCK).max(2)
        term, place, weight = term[~often], place[~often], weight[~often]
        order = np.lexsort((place, term))
        self.places, self.weights = place[order], weight[order]
        self.ptr = np.searchsorted(term[order], np.arange(terms + 1))
        return self

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest with a positive cosine, ties to earlier places; never the one at `leave`.

        The cosines of what can reach the k best by its bound are finished for those examples
        alone, or for all if they are many.
        """
        n = len(self.ids)
        row = self.row[terms]
        rare = row < 0
        first, size = self.ptr[terms[rare]], self.ptr[terms[rare] + 1] - self.ptr[terms[rare]]
        own = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.places[own], np.repeat(weights[rare], size) * self.weights[own], minlength=n)[:n]
        row, often = row[~rare], weights[~rare]
        bound = np.repeat(often @ self.most[row], BLOCK)[:n]
        if 0 <= leave < n:
            score[leave] = bound[leave] = -1.0
        edge = np.partition(score, n - k)[n - k] if n > k else 0.0
        maybe = np.flatnonzero(score + bound >= edge - 1e-12)
        rest = often @ self.dense[np.ix_(row, maybe)] if 4 * len(maybe) < n else (often @ self.dense[row])[maybe]
        score = np.round(np.where(maybe == leave, 0.0, score[maybe] + rest), 12)
        best = np.lexsort((maybe, -score))[:k]
        best = best[score[best] > 0]
        return maybe[best], score[best]


@dataclass
class ToxicityModel:
    terms: dict[str, int]
    idf: np.ndarray  # times what the labels say of the term
    index: Index
    k: int
    slope: float = 1.0
    intercept: float = 0.0
    prior: float = 0.0
    weights: tuple[float, float] = (1.0, 1.0)

    def vector(self, counts: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ascending term numbers and their unit weights, from counts of terms."""
        get = self.terms.get
        own = sorted((t, n) for w, n in counts.items() if (t := get(w)) is not None)
        return self.unit(np.array([t for t, _ in own], np.int64), np.array([n for _, n in own], np.int64))

    def unit(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm else w

    def margin(self, at: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of the votes of the nearest examples, their places and cosines."""
        return self.vote(*self.index.nearest(at, w, self.k, leave))

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Each vote is weighted by 1 / (distance + 0.1) and its class's sampling."""
        vote = 1 / (1.1 - np.minimum(1, cosine))
        y = self.index.labels[place]
        pro, con = (vote * y).sum() * self.weights[1], (vote * (1 - y)).sum() * self.weights[0]
        # k votes at no distance outweigh what is known without any
        return float(np.log(pro + self.prior) - np.log(con + 1 - self.prior)), place, cosine


def _sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, value: int, per_class: int, seed: int):
    """Documents of a seeded sample of labelled rows that may be learnt from, and label counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != value))
    sample, counts = class_sample(rows.select("doc_id", F.col(label).cast("int").alias("y")), "doc_id", "y", per_class, seed)
    sample = sample.select(F.col("doc_id").alias("_id"), "y")
    return one_text_each(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")), counts


def frequencies(docs: DataFrame, terms: dict[str, int]) -> np.ndarray:
    """The number of rows of docs, and for each term of those that hold it; a task sends each term once."""
    shared, size = docs.sparkSession.sparkContext.broadcast(terms), len(terms)

    def count(batches):
        import pyarrow as pa

        look_up, n, rows = known_terms(shared.value), np.zeros(size, np.int64), 0
        for batch in slices(batches):
            for t in texts(batch):
                rows += 1
                n[look_up(t)[0]] += 1
        at = np.flatnonzero(n)
        for k in range(0, max(1, len(at)), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"t": np.append(part, -1).astype(np.int32), "n": np.append(n[part], 0 if k else rows)})

    seen = docs.select("text").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(size + 1, np.int64)
    out[seen.column("t").to_numpy() + 1] = seen.column("n").to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, k: int = 15, seed: int = 17) -> ToxicityModel | None:
    """Fit on a sample of about per_class labelled texts of each label; None if there is no example of both.

    The sample, at most 8 * per_class rows with their terms, comes to the driver; nothing else
    is bounded: every term of every text of the sample is used.
    """
    sample, counts = _sample(docs, labels, "toxic", 4, 2, per_class, seed)

    def bags(batch):
        own = [term_counts(t) for t in texts(batch)]
        return {"id": batch.column("doc_id"), "y": batch.column("y"), "t": [list(b) for b in own], "n": [list(b.values()) for b in own]}

    got = arrow_map(sample, bags, "id long, y int, t array<string>, n array<int>").toArrow().combine_chunks()
    got = got.sort_by([("id", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy().astype(int)
    size = {c: int((y == c).sum()) for c in (0, 1)}
    if not size[0] or not size[1]:
        return None
    lists = [(t, n) for t, n in zip(got.column("t").to_pylist(), got.column("n").to_pylist(), strict=True)]
    chosen: dict[str, int] = {}
    for w in sorted({w for t, _ in lists for w in t}):
        chosen[w] = len(chosen)
    in_class = np.zeros((2, len(chosen)), np.int64)
    for (t, _), c in zip(lists, y.tolist(), strict=True):
        in_class[c, [chosen[w] for w in t]] += 1
    g = ratios(in_class[1], in_class[0], size[1], size[0])
    seen = frequencies(docs, chosen)
    idf = (np.log((1 + seen[0]) / (1 + seen[1:])) + 1) * g / (g + DISCOUNT)
    ids = got.column("id").to_numpy()
    model = ToxicityModel(chosen, idf, Index(ids, y), k)
    vectors = [model.vector(dict(zip(t, n, strict=True))) for t, n in lists]
    strongest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
    order = sorted(range(len(vectors)), key=lambda i: (strongest[i], i))  # like examples share blocks
    vectors, y = [vectors[i] for i in order], y[order]
    model.index = Index(ids[order], y).build(vectors, len(chosen))
    weights = {c: counts[c] / max(1, size[c]) for c in (0, 1)}
    most = max(weights.values())
    model.weights, model.prior = (weights[0] / most, weights[1] / most), counts[1] / (counts[0] + counts[1])
    x = np.array([model.margin(*v, leave=i)[0] for i, v in enumerate(vectors)])
    model.slope, model.intercept = fit_platt(x, y.astype(float), np.array([weights[c] for c in y]), ridge=1e-2)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, threshold: float = 0.3, **options) -> DataFrame:
    """The probability that a text's toxic label is 1, and the examples that speak for it.

    Returns doc_id, held_out, score, predicted, evidence (array of example id, cosine, label
    of every example that votes, nearest first). Null and empty texts have no terms and get
    the score of a text without neighbours, as do texts that share no term with any example.
    doc_id is a whole number (long); null ids stay null and are not held out. Labels other than
    0 and 1, null labels and null ids teach nothing; rows that repeat an id teach once for each
    label, by the text with the smallest hash. Without examples of both labels every score is
    0. Ties in cosine go to the example first in the index. Repeated rows each get a row, an
    empty table none; other columns of docs are left out.
    """
    model = model or train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        look_up = known_terms(model.terms) if model else None
        for batch in slices(batches):
            known = {}
            for t in texts(batch):
                if t not in known and model:
                    margin, place, cosine = model.margin(*model.unit(*look_up(t)))
                    known[t] = float(sigmoid(model.slope * margin + model.intercept)), place, cosine
            rows = [known.get(t, (0.0, np.zeros(0, np.int64), np.zeros(0))) for t in texts(batch)]
            score, place = np.array([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            fields = [model.index.ids[place], np.concatenate([r[2] for r in rows]), model.index.labels[place].astype(np.int32)] if model else [place, place.astype(float), place.astype(np.int32)]
            votes = pa.StructArray.from_arrays(list(map(pa.array, fields)), names=["example", "cosine", "label"])
            evidence = pa.ListArray.from_arrays(np.cumsum([0] + [len(r[1]) for r in rows], dtype=np.int32), votes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<example: long, cosine: double, label: int>>")
