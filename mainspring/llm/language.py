"""Language identification with error-correcting output codes.

Every language gets a codeword of +1 and -1. One logistic classifier over hashed byte
n-grams predicts each bit; loss-weighted decoding compares the predicted margins with every
codeword, each bit weighted by how well it was predicted for that language on rows kept
apart, and takes the nearest. A small gap to the second nearest is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, class_sample, held_out, one_text_each, remainder, sigmoid, slices, texts

BIGRAMS, TRIGRAMS = 1 << 10, 1 << 12
WIDTH = BIGRAMS + TRIGRAMS
CHUNK = 1 << 20
_LETTERS = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of the whole lower-cased text."""
    data, counts = text.lower().encode("utf-8", "replace"), np.zeros(WIDTH)
    for at in range(0, max(1, len(data)), CHUNK):
        raw = _LETTERS[np.frombuffer(data[at : at + CHUNK + 2], np.uint8)].astype(np.uint32)
        raw = raw[(raw != 32) | (np.roll(raw, 1) != 32)] if len(raw) > 1 else raw
        if len(raw) >= 3:
            pair = raw[:-2] * 31 + raw[1:-1] * 1021
            counts[:BIGRAMS] += np.bincount((pair ^ (pair >> 7)) & (BIGRAMS - 1), minlength=BIGRAMS)
            triple = pair * 2654435761 + raw[2:] * 40503
            counts[BIGRAMS:] += np.bincount((triple ^ (triple >> 15)) & (TRIGRAMS - 1), minlength=TRIGRAMS)
    return np.sqrt(counts / max(1.0, counts[:BIGRAMS].sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Exhaustive codes for up to six classes, else the best of many seeded random ones."""
    if classes <= 6:
        bits = max(1, (1 << (classes - 1)) - 1)
        code = np.array([[1 if c == 0 or (b >> (c - 1)) & 1 else -1 for b in range(bits)] for c in range(classes)])
        return code if classes > 1 else np.ones((classes, 1), int)
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes))), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (classes, bits))
        apart = (bits - code @ code.T) / 2
        least = min((apart + np.eye(classes) * bits).min(), (classes - np.abs(code.sum(0))).min() * bits)
        if least > most:
            best, most = code, least
    return best


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    sharpness: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code[None] * margin[:, None])
        far = (self.bit_weights[None] * loss).sum(2)
        z = np.exp(-self.sharpness * (far - far.min(1, keepdims=True)))
        return z / z.sum(1, keepdims=True)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        r = (sigmoid(x @ w + b) - (y > 0)).astype(np.float32) / len(x)
        for p, g, m1, v1 in ((w, x.T @ r + ridge * w, m, v), (b, r.sum(0), mb, vb)):
            m1 += 0.1 * (g - m1)
            v1 += 0.01 * (g * g - v1)
            p -= 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit(x: np.ndarray, labels: list[str], steps: int = 80, ridge: float = 1e-5) -> LanguageModel:
    langs = sorted(set(labels))
    y, code = np.array([langs.index(v) for v in labels]), codewords(len(langs))
    apart = np.arange(len(y)) % 5 == 0
    if len(langs) < 2 or len(y) < 10:
        apart[:] = False
    w, b = _logistic(x[~apart], code[y[~apart]], steps, ridge)
    judge, truth = (x[apart], y[apart]) if apart.any() else (x, y)
    margin, weight = judge @ w + b, np.full(code.shape, 0.5)
    for c in range(len(langs)):
        if (truth == c).any():
            weight[c] = np.maximum(0.05, (np.sign(margin[truth == c]) == code[c]).mean(0))
    model = LanguageModel(langs, code, w, b, weight / weight.sum(1, keepdims=True), 1.0)
    best = (np.inf, 1.0)
    for sharp in (0.5, 1, 2, 4, 8):
        model.sharpness = sharp
        p = model.probabilities(judge)[np.arange(len(truth)), truth]
        best = min(best, (-np.log(p + 1e-9).mean(), sharp))
    model.sharpness = best[1]
    return model


def train(docs: DataFrame, per_class: int = 500, seed: int = 11, most: int = 8000) -> LanguageModel | None:
    """Fit on about per_class texts of each language, `most` in all; None if no row can be learnt from.

    The sample comes to the driver as 10 KB of features a text, which `most` bounds. Rows that
    repeat an id teach once for each language, by the text with the smallest hash.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    keys, _ = class_sample(rows.select("doc_id", "lang"), "doc_id", "lang", per_class, seed, most)
    ids = keys.select(F.col("doc_id").alias("_id")).distinct()
    sample = one_text_each(rows.select("doc_id", "text", "lang").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi"))

    def extract(batch):
        own, langs, x = texts(batch), texts(batch, "lang"), []
        keep = [i for i, t in enumerate(own) if has_letter(t)]
        for i in keep:
            x.append(features(own[i]).astype(np.float16).tobytes())
        return {"id": [batch.column("doc_id")[i].as_py() for i in keep], "lang": [langs[i] for i in keep], "x": x}

    got = arrow_map(sample, extract, "id long, lang string, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["id", "lang"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), WIDTH).astype(np.float32)
    return fit(x, list(got["lang"]))


def _decide(model: LanguageModel | None, own: list) -> dict[str, list]:
    """Language, score, ambiguity margin and runner-up of each text."""
    n = len(own)
    lang, score, gap, second = ["und"] * n, [0.0] * n, [1.0] * n, [None] * n
    keep = [i for i, t in enumerate(own) if has_letter(t)] if model else []
    for at in range(0, len(keep), 256):
        part = keep[at : at + 256]
        p = model.probabilities(np.stack([features(own[i]) for i in part]))
        order = np.argsort(-p, 1, kind="stable")
        for i, q, o in zip(part, p, order, strict=True):
            lang[i], score[i] = model.langs[o[0]], float(min(1.0, q[o[0]]))
            if len(o) > 1:
                second[i], gap[i] = model.langs[o[1]], float(q[o[0]] - q[o[1]])
    return {"lang_pred": lang, "score": score, "gap": gap, "runner_up": second}


def identify_language(docs: DataFrame, model: LanguageModel | None = None, per_class: int = 500, ambiguity: float = 0.2) -> DataFrame:
    """The language of every whole text.

    Returns doc_id, held_out, lang_pred, score, ambiguous, runner_up. A null text, or one
    without a letter, is `und` with score 0, as is every text if there is nothing to learn
    from. Null ids are never learnt from and not held out. Repeated rows each get a row, other
    columns are left out, and languages equally near go to the first by code point. ambiguous:
    the two best probabilities differ by less than `ambiguity`.
    """
    model = model or train(docs, per_class)

    def predict(batch):
        found = _decide(model, texts(batch))
        vague = [g < ambiguity for g in found.pop("gap")]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "ambiguous": vague} | found

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return arrow_map(rows, predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, runner_up string")


def keep_known(docs: DataFrame, model: LanguageModel | None = None, per_class: int = 500, langs: set[str] | None = None, ambiguity: float = 0.2) -> DataFrame:
    """docs, all columns as they are, without the rows of no language.

    A row goes if its predicted language is `und` (null text, no letter), or ambiguous, that is
    if the two best probabilities differ by less than `ambiguity`, or not in langs, where these
    are stated; None takes every learnt one. Languages are those of identify_language(). All
    rows go if there is nothing to learn from. Rows are judged by their texts alone, whatever
    their ids and repeats; no row moves, so nothing is shuffled.
    """
    import pyarrow as pa

    model = model or train(docs, per_class)

    def run(batches):
        for batch in slices(batches):
            found = _decide(model, texts(batch))
            own = zip(found["lang_pred"], found["gap"], strict=True)
            yield batch.filter(pa.array([g != "und" and gap >= ambiguity and (langs is None or g in langs) for g, gap in own], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
