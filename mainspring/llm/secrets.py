"""Secret scanning: fixed patterns, and novelty under dictionary-primed zstandard.

The patterns find known shapes. For the rest, long tokens in a sensitive context are
candidates: the marginal compressed size of a candidate, after the code around it, under a
compressor primed with common identifiers and those of the text itself, says how new it is. Ordinary
names are made of known parts and cost few bytes; random keys cost nearly all of theirs. A long
word whose parts the dictionary and the text around it lack costs as much as a key.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, slices, texts

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# The same matches as runs of [0-9a-f]+ of 32 or more: a match starts where its run starts.
HEX = re.compile(r"[0-9a-f]{32,}")
# Of 16 characters or more; a = belongs to it as padding only, so a key's name and its value stay apart.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{14,}(?:=+(?![A-Za-z0-9+/_=-]))?")
NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
CONTEXT = re.compile(r"(key|secret|token|passw|passphrase|pwd|auth|credential|bearer|private|signature|jwt|session|cookie|login)", re.ASCII | re.IGNORECASE)
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9]+")
NAMES = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")  # the parts of identifiers
IDENTIFIERS = b" ".join(
    b"""access account address api args array async auth authorization await aws base64 bearer bool
    boolean break bucket byte bytes case catch char class client cloud code config connection const
    constructor content context cookie create credential credentials data database date debug
    default delete description dict digest document double element else email encode endpoint env
    environment error event except export extends false field file filename final finally float
    from function get github google handler hash header headers host html http https id identifier
    import index input instance int integer interface item json key keys lambda length list local
    localhost logger login long map message method model module name namespace new node none null
    number object options output package param parameter password path port private public query
    raise read record request require response result return row schema script secret select self
    server service session set setting settings signature size source static status stdout str
    string struct super table template test text this throw time timestamp title token true try
    type uint undefined update url user username uuid value values variable version void while
    width window write xml yaml abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
    0123456789abcdef""".split()
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the pattern matches, in code points."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of a candidate, as a share of its length."""

    def __init__(self, names: bytes = b"", level: int = 6) -> None:
        prime = zstandard.ZstdCompressionDict(names + b" " + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=prime, write_checksum=False, write_content_size=False).compress

    def share(self, candidate: str, around: str) -> float:
        near = around.encode("utf-8", "replace")
        own = candidate.encode()
        return (len(self.compress(near + b"\n" + own)) - len(self.compress(near + b"\n"))) / max(1, len(own))


def names_of(text: str, spots: list[tuple[int, int]]) -> bytes:
    """The parts of identifiers in the text outside the candidates at `spots`, in order of place, once each.

    Identifiers of 16 characters or more that a candidate holds are left out: a secret that
    stands elsewhere too is no less new.
    """
    own, at = {}, 0
    held = "\n".join(text[i:j] for i, j in spots)
    for i, j in [*spots, (len(text), len(text))]:
        for m in IDENTIFIER.finditer(text, at, i):
            if len(m[0]) < 16 or m[0] not in held:
                for part in NAMES.findall(m[0]):
                    own.setdefault(part)
        at = j
    return " ".join(own).encode()


def in_context(text: str, i: int, context: int) -> bool:
    """Whether a sensitive word is among the characters before i, or in the name that i's value is assigned to."""
    if CONTEXT.search(text, max(0, i - context), i):
        return True
    k = i
    while k and text[k - 1] in " \"'=:":
        k -= 1
    if not any(c in "=:" for c in text[k:i]):
        return False
    while k and text[k - 1] in NAME_CHARACTERS:
        k -= 1
    return CONTEXT.search(text, k, i) is not None


def without(own: str, around: str) -> str:
    """The text around a candidate, blank where it repeats the candidate, which is no less new for that."""
    body = own.rstrip("=")
    return around.replace(body, " " * len(body))


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans (start, kind, end), sorted by start, cover."""
    starts, ends = [], []
    for s, _, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def novel_spans(text: str, base: list, least: float = 0.75, reach: int = 256, context: int = 48) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the candidates in sensitive context, apart from the base spans, of which at least `least` is new."""
    starts, ends = _merged(base)
    spots = []
    for m in CANDIDATE.finditer(text):
        i, j = m.span()
        if j - i < 16 or not in_context(text, i, context):
            continue
        k = bisect_right(ends, i)  # the first stretch that ends behind i
        if k == len(starts) or starts[k] >= j:
            spots.append((i, j))
    if not spots:
        return []
    novelty, found = Novelty(names_of(text, spots)), []
    parts, at = [], 0
    for i, j in spots:  # candidates are no surroundings of each other: many random ones would make any cheap
        parts += [text[at:i], " " * (j - i)]
        at = j
    plain = "".join(parts) + text[at:]
    for i, j in spots:
        own = text[i:j]
        before, behind = without(own, plain[max(0, i - reach - len(own)) : i])[-reach:], without(own, plain[j : j + reach + len(own)])[:reach]
        if novelty.share(own, before + behind) >= least:
            found.append((i, 3, j))
    return found


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """Secrets of every whole text, with spans in code points, end exclusive.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel. A null text counts
    as empty: no spans, and the digest of the empty string. Equal starts are ordered by kind as
    listed in KINDS. A novel span never overlaps a pattern's. doc_id is a whole number (long);
    repeated rows and null ids each get a row, an empty table none; other columns are left out.
    """
    def run(batch):
        rows = []
        for t in texts(batch):
            base = base_spans(t or "")
            new = novel_spans(t or "", base, least)
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(sorted(base + new)), len(new)))
        cols = zip(*rows, strict=True)
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
        return {"doc_id": batch.column("doc_id")} | {c: list(v) for c, v in zip(names, cols, strict=True)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame, mask: str = "[secret]", least: float = 0.75) -> DataFrame:
    """docs with every secret of `text` replaced by the mask and n_chars set to the new length.

    Overlapping spans are masked once. Null texts stay null, empty ones empty; n_chars is set
    only where docs has such a column; all other columns stay as they are, whatever their names.
    Every row stays, repeated ones and null ids too.
    """
    import pyarrow as pa

    schema = docs.schema

    def run(batches):
        for batch in slices(batches):
            out = []
            for t in texts(batch):
                spans = base_spans(t) if t else []
                spans = sorted(spans + novel_spans(t, spans, least)) if t else []
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [t[at:s], mask]
                    at = max(at, e)
                out.append(t if not spans else "".join(parts) + t[at:])
            columns = batch.columns
            columns[batch.schema.get_field_index("text")] = pa.array(out, batch.schema.field("text").type)
            if "n_chars" in batch.schema.names:
                k = batch.schema.get_field_index("n_chars")
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if t is None else len(t) for o, t in zip(old, out, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
