"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words of training texts are looked up among the words of the test items, so word n-grams that
some item has, in a row or around one other word, are found in one pass. Each is a seed, however
common. A text is aligned with the item around its seeds, which also scores edited or
paraphrased copies, unless it has too few of the item's words there for any alignment to count.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, texts

TOKEN = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, 1
_P = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def patterns(n: int) -> list[tuple[int, ...]]:
    """n words in a row, and n words around one that may differ, so single edits leave seeds.

    Both hash alike: a word that is changed leaves the second kind in item and text, one that is
    dropped the second in the item and the first in the text, one that is added the reverse.
    """
    return [tuple(range(n)), tuple(k + (k >= n // 2) for k in range(n))]


def grams(ids: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """A 64-bit hash of the ids at the pattern's offsets from every place; ids are non-negative where it matters."""
    n = max(0, len(ids) - pattern[-1])
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.full(n, len(pattern), np.uint64)
    for k in pattern:
        h = (h * _P) ^ (x[k : k + n] * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
    return h


class Items:
    """One block of test items: word ids, and n-grams with their places.

    Items of equal words are one class, named by its smallest id.
    """

    def __init__(self, rows: list[tuple[int, str]], n: int) -> None:
        own: dict[tuple, list] = defaultdict(list)
        for item, text in rows:
            if words := tuple(tokens(text)):
                own[words].append(item)
        self.words: dict[str, int] = {}
        self.ids, self.seqs, self.members = [], [], []
        for words, members in sorted(own.items()):
            self.seqs.append(np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64))
            known = [m for m in members if m is not None]
            self.ids.append(min(known) if known else None)
            self.members.append(len(members))
        self.n = n
        self.patterns = sorted({p for s in self.seqs for p in (self._own(s) if len(s) < n else patterns(n))})
        own = [(grams(s, p), k) for k, s in enumerate(self.seqs) for p in self._own(s)]
        every = np.concatenate([h for h, _ in own]) if own else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.every, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))  # the places of n-gram g are first[g] to first[g + 1]
        self.item = np.concatenate([np.full(len(h), k, np.int32) for h, k in own])[order] if own else np.zeros(0, np.int32)
        self.place = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in own])[order] if own else np.zeros(0, np.int32)
        self.bags = [np.unique(s, return_counts=True) for s in self.seqs]

    def _own(self, seq: np.ndarray) -> list[tuple[int, ...]]:
        """The patterns that fit an item; one of its whole length if it is short."""
        return [p for p in patterns(self.n) if p[-1] < len(seq)] or [tuple(range(len(seq)))]

    def encode(self, words: list[str]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pattern: positions in ids and their n-grams' numbers in `every`."""
        out, known = [], ids >= 0
        for p in self.patterns:
            n = len(ids) - p[-1]
            if n <= 0:
                continue
            whole = known[:n].copy()
            for j in p[1:]:
                whole &= known[j : n + j]
            at = np.flatnonzero(whole)
            if len(at):
                h = grams(np.where(known, ids, 0), p)[at]
                i = np.minimum(np.searchsorted(self.every, h), len(self.every) - 1)
                hit = self.every[i] == h
                if hit.any():
                    out.append((at[hit], i[hit]))
        return out

    def seeds(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """For each item that ids have an n-gram of: where it would start by each of them, ascending."""
        items, starts = [], []
        for at, gram in self.found(ids):
            n = self.first[gram + 1] - self.first[gram]
            own = np.repeat(self.first[gram], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            items.append(self.item[own])
            starts.append(np.repeat(at, n) - self.place[own])
        if not items:
            return {}
        item, start = np.concatenate(items), np.concatenate(starts)
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        return dict(zip(item[np.append(0, cuts)].tolist(), np.split(start, cuts), strict=True))

    def most(self, k: int, ids: np.ndarray) -> int:
        """What an alignment of item k with ids scores at most: all words they share match."""
        words, counts = self.bags[k]
        i = np.minimum(np.searchsorted(words, ids), len(words) - 1)
        return MATCH * int(np.minimum(np.bincount(i[words[i] == ids], minlength=len(words)), counts).sum())


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment with linear gaps: score, and its first and last place in doc."""
    def forward(a, b):
        ramp, above, best, end, row_at = GAP * np.arange(len(b) + 1), np.zeros(len(b) + 1, np.int64), 0, 0, 0
        for i, x in enumerate(a):
            row = np.zeros(len(b) + 1, np.int64)
            row[1:] = np.maximum(above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] - GAP)
            row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + ramp) - ramp, 0)
            j = int(row.argmax())
            if row[j] > best:
                best, end, row_at = int(row[j]), j, i + 1
            above = row
        return best, end, row_at

    score, end, rows = forward(item, doc)
    if not score:
        return 0, 0, 0
    _, back, _ = forward(item[:rows][::-1], doc[:end][::-1])
    return score, end - back, end


def _needed(length: int, share: float, enough: int, least: int) -> float:
    return MATCH * max(min(share * length, enough), least)


def _blocks(items: DataFrame, block_items: int, block_chars: int):
    """Blocks of test items, each bounded in rows and characters, one after another."""
    rows = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).first()
    n = max(1, math.ceil(total["n"] / block_items), math.ceil((total["c"] or 0) / block_chars))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows
        yield [(r["i"], r["t"]) for r in part.toLocalIterator()]


class Finder:
    """Finds the items of a block in texts. Alignments of equal stretches are remembered, up to MEMO bytes."""

    MEMO = 16 << 20

    def __init__(self, block: Items, share: float, enough: int, least: int) -> None:
        self.block, self.rule, self.known, self.held = block, (share, enough, least), {}, 0

    def _windows(self, starts, m: int, length: int) -> list[list[int]]:
        """Stretches of the text around the seeds of one item, merged where they meet."""
        slack, out = m // 2 + 8, []
        for low in starts.tolist():
            a, b = max(0, low - slack), min(length, low + m + slack)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def _aligned(self, k: int, part: np.ndarray) -> tuple[int, int, int]:
        key = (k, part.tobytes())
        if key not in self.known:
            size = len(key[1]) + 256
            if size > self.MEMO // 16:
                return align(self.block.seqs[k], part)
            if self.held + size > self.MEMO:
                self.known.clear()
                self.held = 0
            self.held += size
            self.known[key] = align(self.block.seqs[k], part)
        return self.known[key]

    def matches(self, text: str | None):
        """(item, score, first token, last token, seeds) of each item that the text holds."""
        block = self.block
        ids = block.encode(tokens(text))
        for k, own in block.seeds(ids).items():
            needed, best = _needed(len(block.seqs[k]), *self.rule), (0, 0, 0)
            if needed > MATCH * len(block.seqs[k]):
                continue
            for a, b in self._windows(own, len(block.seqs[k]), len(ids)):
                if block.most(k, ids[a:b]) >= needed:
                    s, i, j = self._aligned(k, ids[a:b])
                    if s > best[0]:
                        best = (s, a + i, a + j)
            if best[0] >= needed:
                yield k, best[0] / (MATCH * len(block.seqs[k])), best[1], best[2], len(own)


def _align(docs: DataFrame, block: Items, rule: tuple) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_items", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("seeds", pa.int64())])

    def run(batches):
        finder = Finder(block, *rule)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                spots = None
                for k, score, i, j, seeds in finder.matches(text):
                    if spots is None:
                        low = text.lower()
                        same = len(low) == len(text)  # lower-casing may change a text's length
                        spots = [m.span() for m in TOKEN.finditer(low)]
                    rows.append((doc, block.ids[k], block.members[k], score, spots[i][0] if same else None, spots[j - 1][1] if same else None, seeds))
            if rows:
                yield pa.RecordBatch.from_pydict({f.name: pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True), strict=True)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, n_items long, score double, start long, end long, seeds long")


def contaminated(docs: DataFrame, items: DataFrame, n: int = 4, share: float = 0.5, enough: int = 40, least: int = 5, block_items: int = 2000, block_chars: int = 8_000_000) -> DataFrame:
    """Pairs of a text of docs and a test item (item_id, text) that it holds; all ids are whole numbers (long).

    Returns doc_id, item_id, n_items, score, start, end, seeds: score is the best alignment as
    a share of the item's own, start and end its place in the text in code points (null where
    lower-casing changes the text's length), seeds the number of seed places. A pair counts if
    the alignment is worth `share` of the item's words or `enough` words, and `least` words in
    any case: an item of fewer words than that is no evidence and matches nothing. Items of
    equal words are one class under their smallest id, n_items many. Test items are taken in
    blocks of bounded size, a pass over docs each; each text is read whole. Null or wordless
    texts and items match nothing; null ids stay null; repeated rows each give their pairs;
    equal alignments take the first place. Other columns of both tables are left out.
    """
    out = None
    for rows in _blocks(items, block_items, block_chars):
        block = Items(rows, n)
        if not block.seqs and out is not None:
            continue
        pairs = _align(docs, block, (share, enough, least))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 4, share: float = 0.5, enough: int = 40, least: int = 5, block_items: int = 2000, block_chars: int = 8_000_000) -> DataFrame:
    """docs, all columns as they are, without the rows whose own text holds a test item by the rule of contaminated().

    Every row is judged by its text alone, so a null or repeated doc_id makes no difference, and
    rows of null texts stay. Each block of items is a filter in the same pass: nothing is
    shuffled and no row moves.
    """
    schema = docs.schema

    def without(block: Items):
        def run(batches):
            finder = Finder(block, share, enough, least)
            for batch in slices(batches):
                yield batch.filter(pa.array([next(finder.matches(t), None) is None for t in texts(batch)], pa.bool_()))

        return run

    for rows in _blocks(items, block_items, block_chars):
        block = Items(rows, n)
        if block.seqs:
            docs = docs.mapInArrow(without(block), schema)
    return docs
