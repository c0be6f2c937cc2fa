"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions trained in numpy.

The tagger learns from windows whose spans the patterns label and from seeded synthetic ones
that also show other spellings. A text is decoded as a whole: each character takes its
emissions from the overlapping window in which it stands farthest from an edge, and one Viterbi
path runs over them under hard constraints: a span begins with a begin tag, and a kind's tags
stand only in runs of that kind's characters that hold a digit or an at sign. Outside those runs
every tag is "outside", so the path falls apart into one for each run, and windows without such
a run need not be computed; the spans are those of tagging every window (a test holds it so).
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WIDTH, STRIDE = 64, 32
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_LOCAL_SET = frozenset(_LOCAL)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the pattern can only start where a run of digits does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Runs in which an email may stand, and those in which the three kinds of numbers may.
_MAIL_RUN = re.compile(r"[A-Za-z0-9._%+-]*@[A-Za-z0-9._%+@-]*")
_NUMBER_RUN = re.compile(r"[\x20().+-]*[0-9][\x20().0-9+-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _valid(kind: int, s: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    own = _digits(s)
    return 13 <= len(own) <= 19 and luhn(own) if kind == 2 else 9 <= len(own) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the pattern matches, by kind, then start."""
    found, at, last = [], 0, -1
    while (a := text.find("@", last + 1)) >= 0:
        run = text[max(at, last + 1) : a]
        size = len(run) - len(run.rstrip(_LOCAL))
        if size and (m := _DOMAIN.match(text, a + 1)):
            found.append((0, a - size, m.end()))
            at = m.end()
        last = a
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return found


def encode(chars: str) -> np.ndarray:
    code = np.frombuffer(chars.encode("utf-32-le", "replace"), np.uint32)
    return np.where(code < 128, code, np.where(code < 0x250, 128, 129)).astype(np.int16)


def stretches(text: str) -> list[tuple[int, int, list]]:
    """(start, end, runs) of the disjoint stretches of a text in which spans may stand; runs are (start, end, is mail)."""
    runs = [(m.start(), m.end(), False) for m in _NUMBER_RUN.finditer(text)]
    if "@" in text:
        runs = sorted(runs + [(i, j, True) for i, j in _mail_runs(text)])
    out: list = []
    for i, j, mail in runs:
        if out and i <= out[-1][1]:
            out[-1][1] = max(j, out[-1][1])
            out[-1][2].append((i, j, mail))
        else:
            out.append([i, j, [(i, j, mail)]])
    return [tuple(x) for x in out]


def _mail_runs(text: str):
    """The matches of _MAIL_RUN, found from their at signs so that long runs without one cost nothing."""
    at = 0
    while (a := text.find("@", at)) >= 0:
        i = a
        while i > at and text[i - 1] in _LOCAL_SET:
            i -= 1
        m = _MAIL_RUN.match(text, i)
        yield i, m.end()
        at = m.end()


def window_starts(text: str, spots: list[tuple[int, int]] | None = None) -> list[int]:
    """Starts of the windows that hold a character of a stretch, or of the given ones."""
    spots = [(i, j) for i, j, _ in stretches(text)] if spots is None else spots
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    cells = {min(last, c) for i, j in spots for c in range(max(0, i // STRIDE - 1), (j - 1) // STRIDE + 1)}
    return [c * STRIDE for c in sorted(cells)]


def tag_row(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    row = np.zeros(length, np.int8)
    for kind, i, j in spans:
        if not row[i:j].any():
            row[i:j] = 2 + 2 * kind
            row[i] = 1 + 2 * kind
    return row


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions; 130 is padding."""

    def __init__(self, hidden: int = 16, size: int = 12, seed: int = 3) -> None:
        rng, draw = np.random.default_rng(seed), lambda *s: None
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"E": draw(131, size) * 3, "O": draw(2 * hidden, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"X{d}": draw(size, 4 * hidden), f"H{d}": draw(hidden, 4 * hidden), f"B{d}": bias}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        p, n, k = self.p, self.hidden, x.shape[0]
        table, h, c = p["E"] @ p[f"X{d}"] + p[f"B{d}"], np.zeros((k, n := self.hidden), np.float32), np.zeros((k, n), np.float32)
        out, tape = np.empty((x.shape[1], k, n), np.float32), []
        for t in range(x.shape[1]):
            z = table[x[:, t]] + h @ p[f"H{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * n]))
            g, before, old = np.tanh(z[:, 3 * n :]), c, h
            c = s[:, n : 2 * n] * c + s[:, :n] * g
            e = np.tanh(c)
            h = s[:, 2 * n :] * e
            out[t] = h
            if keep:
                tape.append((s, g, before, e, old))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """[width, windows, tags]"""
        f, b = self._run(x, "f", False)[0], self._run(x[:, ::-1], "b", False)[0][::-1]
        return np.concatenate((f, b), 2) @ self.p["O"] + self.p["o"]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        emit, back = self.emissions(x), []
        score = emit[0]
        for t in range(1, len(emit)):
            step = score[:, :, None] + self.p["T"][None]
            back.append(step.argmax(1))
            score = step.max(1) + emit[t]
        path = [score.argmax(1)]
        for step in reversed(back):
            path.append(step[np.arange(len(step)), path[-1]])
        return np.array(path[::-1]).T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, n, k = self.p, self.hidden, len(x)
        f, tape_f = self._run(x, "f", True)
        b, tape_b = self._run(x[:, ::-1], "b", True)
        both = np.concatenate((f, b[::-1]), 2)
        emit, trans, steps = both @ p["O"] + p["o"], p["T"], x.shape[1]

        def lse(v, axis):
            top = v.max(axis, keepdims=True)
            return np.log(np.exp(v - top).sum(axis)) + top.squeeze(axis)

        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        d_emit = np.exp(alpha + beta - z[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + trans + (emit[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        gold = np.arange(k)
        loss = z.sum() - sum(emit[t, gold, y[:, t]].sum() for t in range(steps)) - trans[y[:, :-1], y[:, 1:]].sum()
        for t in range(steps):
            d_emit[t, gold, y[:, t]] -= 1
        np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
        d_emit, pair = d_emit / k, pair / k
        flat = d_emit.reshape(-1, TAGS)
        grad = {"O": both.reshape(-1, 2 * n).T @ flat, "o": flat.sum(0), "T": pair, "E": 0}
        d_both = d_emit @ p["O"].T
        for d, tape, own, dh_all in (("f", tape_f, x, d_both[:, :, :n]), ("b", tape_b, x[:, ::-1], d_both[::-1, :, n:])):
            d_table, d_h = np.zeros((131, 4 * n), np.float32), np.zeros((n, 4 * n), np.float32)
            dh, dc = np.zeros((k, n), np.float32), np.zeros((k, n), np.float32)
            for t in range(steps - 1, -1, -1):
                s, g, before, e, old = tape[t]
                i, forget, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - e * e)
                dz = np.concatenate((dc * g * i * (1 - i), dc * before * forget * (1 - forget), dh * e * o * (1 - o), dc * i * (1 - g * g)), 1)
                np.add.at(d_table, own[:, t], dz)
                d_h += old.T @ dz
                dh, dc = dz @ p[f"H{d}"].T, dc * forget
            grad |= {f"X{d}": p["E"].T @ d_table, f"H{d}": d_h, f"B{d}": d_table.sum(0)}
            grad["E"] = grad["E"] + d_table @ p[f"X{d}"].T
        return float(loss / k), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
        rng, m, v = np.random.default_rng(seed), {k: 0 for k in self.p}, {k: 0 for k in self.p}
        for t in range(1, steps + 1):
            part = rng.integers(0, len(x), batch)
            _, grad = self.gradients(x[part], y[part])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / (size + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                now = rate * (1 - 0.9 * t / steps)
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def synthetic(count: int = 1200, seed: int = 9) -> list[tuple[str, list]]:
    """Seeded sentences with labelled spans, in more spellings than the patterns know."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda low=2, high=10: "".join(rng.choice(list("abcdefghijklmnoprstuvwéöñ"), int(rng.integers(low, high)), p=[0.04] * 22 + [0.04] * 3))
    ascii_ = lambda: "".join(rng.choice(list(string.ascii_lowercase), int(rng.integers(2, 9))))

    def card():
        body = num(int(rng.choice([14, 15, 15, 15, 15])))
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = str(rng.choice(["", "", " ", "-"]))
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep else full

    def phone():
        a, b, c = num(3), num(3), num(4)
        return str(rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {num(2)} {num(4)} {num(4)}", f"{a}.{b}.{c}"]))

    makers = (
        lambda: f"{ascii_()}{rng.choice(['.', '_', ''])}{rng.choice([num(2), ascii_()])}@{ascii_()}{rng.choice(['', num(1)])}.{rng.choice(['com', 'org', 'net', 'co.uk', 'de'])}",
        lambda: ".".join(str(int(x)) for x in rng.integers(1, 256, 4)), card, phone,
    )
    noise = (lambda: num(int(rng.integers(1, 9))), lambda: f"{num(1)}.{num(1)}", lambda: f"20{num(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}", lambda: "@" + ascii_(), lambda: f"{num(2)}:{num(2)}", lambda: hashlib.md5(num(9).encode()).hexdigest(), lambda: f"{num(3)}.{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(1)}")
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(6, 16))):
            kind = int(rng.integers(0, 14))
            part = makers[kind]() if kind < 4 else noise[int(rng.integers(0, len(noise)))]() if kind == 4 else word() + str(rng.choice(["", "", ",", "."]))
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + str(rng.choice([" ", " ", " ", "\n"]))
        out.append((text, spans))
    return out


def _windows(text: str, spans: list | None, spots: list | None = None):
    code, tags = encode(text), None if spans is None else tag_row(spans, len(text))
    for s in window_starts(text, spots):
        x = np.full(WIDTH, 130, np.int16)
        x[: min(WIDTH, len(text) - s)] = code[s : s + WIDTH]
        if tags is None:
            yield s, x
        else:
            y = np.zeros(WIDTH, np.int8)
            y[: min(WIDTH, len(text) - s)] = tags[s : s + WIDTH]
            yield x, y


def train(docs: DataFrame | None, rows: int = 300, windows: int = 3000, seed: int = 29) -> Tagger:
    """Fit on synthetic windows and on those of a sample of texts, labelled by pattern.

    The sample is bounded: about `rows` texts with a digit or an at sign, by the hash of their id
    and text, and of their windows the `windows` with the least hashes.
    """
    own = [w for text, spans in synthetic() for w in _windows(text, spans)]
    if docs is not None:
        some = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
        total = some.count()
        unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = some.where(unit < min(1.0, rows / max(1, total)))

        def extract(batch):
            own = [(x.tobytes(), y.tobytes()) for t in texts(batch) for x, y in _windows(t, base_spans(t))]
            return {"x": [x for x, _ in own], "y": [y for _, y in own]}

        every = arrow_map(some, extract, "x binary, y binary").distinct()
        got = every.orderBy(F.xxhash64("x", F.lit(seed)), "x", "y").limit(windows).toPandas().sort_values(["x", "y"])
        own += [(np.frombuffer(x, np.int16), np.frombuffer(y, np.int8)) for x, y in zip(got["x"], got["y"], strict=True)]
    return Tagger().fit(np.stack([x for x, _ in own]), np.stack([y for _, y in own]).astype(np.int64))


_SHAPES = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), _IP, _CARD, re.compile(r"(?=.*[ ().+-])[+(0-9][\x20().0-9-]*[0-9]"))
_NEVER = np.float32(-1e9)
_FOLLOWS = np.zeros((TAGS, TAGS), np.float32)  # an inside tag follows the begin or inside tag of its kind only
for _k in range(len(KINDS)):
    _FOLLOWS[:, 2 + 2 * _k] = _NEVER
    _FOLLOWS[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0


def best_window(place: np.ndarray, length: int) -> np.ndarray:
    """The start of the window in which each place stands farthest from an edge; the earlier of two equal ones."""
    last = max(0, -(-(length - WIDTH) // STRIDE))
    late = np.minimum(last, place // STRIDE)
    early = np.maximum(0, late - 1)

    def inner(cell):
        k = place - cell * STRIDE
        left = np.where(cell == 0, WIDTH, k)
        right = np.where(cell * STRIDE + WIDTH >= length, WIDTH, WIDTH - 1 - k)
        return np.where(k < WIDTH, np.minimum(left, right), -1)

    return np.where(inner(early) >= inner(late), early, late) * STRIDE


def allowed(i: int, j: int, runs: list) -> np.ndarray:
    """Penalties [j - i, tags] that keep each kind's tags within its runs."""
    out = np.full((j - i, TAGS), _NEVER, np.float32)
    out[:, 0] = 0
    for a, b, mail in runs:
        out[a - i : b - i, slice(1, 3) if mail else slice(3, TAGS)] = 0
    return out


def decode(emissions: list[np.ndarray], trans: np.ndarray) -> list[list[int]]:
    """The best tags of stretches that have "outside" before and behind them; all run at once, longest first."""
    order = sorted(range(len(emissions)), key=lambda k: -len(emissions[k]))
    sizes = np.array([len(emissions[k]) for k in order])
    trans, out = trans + _FOLLOWS, [[] for _ in emissions]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate([emissions[k] for k in order])
    score, back, alive = trans[0][None] + flat[starts[:-1]], [], len(order)
    final = np.empty((len(order), TAGS), np.float32)
    for t in range(1, int(sizes[0]) + 1):
        still = int(np.searchsorted(-sizes, -t, "left"))  # stretches longer than t
        final[still:alive] = score[still:alive]
        alive = still
        if not alive:
            break
        step = score[:alive, :, None] + trans[None]
        back.append(step.argmax(1).astype(np.int8))
        score = step.max(1) + flat[starts[:alive] + t]
    tag = (final + trans[:, 0][None]).argmax(1)
    for r, k in enumerate(order):
        own = [int(tag[r])]
        for t in range(int(sizes[r]) - 2, -1, -1):
            own.append(int(back[t][r, own[-1]]))
        out[k] = own[::-1]
    return out


def spans_of(tags: list[int], first: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the runs of begin and inside tags; tags[0] stands at `first`."""
    spans, begin, kind = [], 0, -1
    for i, tag in enumerate([*tags, 0], first):
        if kind >= 0 and tag != 2 + 2 * kind:
            spans.append((kind, begin, i))
            kind = -1
        if tag % 2:
            kind, begin = (tag - 1) // 2, i
    return spans


def tagged_spans(texts_: list[str], tagger: Tagger, batch: int = 1024, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text, decoded globally; `every` computes all windows, to the same end."""
    out: list = [[] for _ in texts_]
    place, held = [], 0

    def flush():
        windows = [w for _, _, own, _ in place for w in own]
        emit = np.concatenate([tagger.emissions(np.stack([x for _, x in windows[i : i + batch]])) for i in range(0, len(windows), batch)], 1)
        at, parts, owners = 0, [], []
        for k, text, own, spots in place:
            number = {s: at + n for n, (s, _) in enumerate(own)}
            at += len(own)
            for i, j, runs in spots:
                here = np.arange(i, j)
                start = best_window(here, len(text))
                column = np.fromiter((number[s] for s in start.tolist()), np.int64, len(start))
                parts.append(emit[here - start, column] + allowed(i, j, runs))
                owners.append((k, i))
        for (k, i), tags in zip(owners, decode(parts, tagger.p["T"]), strict=True):
            out[k] += spans_of(tags, i)
        place.clear()

    for k, text in enumerate(texts_):
        spots = stretches(text)
        if spots:
            own = list(_windows(text, None, [(0, len(text))] if every else [(i, j) for i, j, _ in spots]))
            place.append((k, text, own, spots))
            held += len(own)
            if held >= 4 * batch:
                flush()
                held = 0
    if place:
        flush()
    return out


def added_spans(texts_: list[str], tagger: Tagger, base: list[list], batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """What the tagger finds in each text beyond the patterns: trimmed of blanks and stops, apart from the patterns' spans, and
    well formed, which means: an email of the base shape, an ip with parts up to 255, a card that passes Luhn, 9 to 15 digits for a phone.
    """
    out: list = [[] for _ in texts_]
    for k, spans in enumerate(tagged_spans(texts_, tagger, batch)):
        cover = sorted((s, e) for _, s, e in base[k])
        ends = list(accumulate((e for _, e in cover), max))
        for kind, i, j in spans:
            own = texts_[k][i:j].strip(" ,;.")
            i += texts_[k][i:j].find(own) if own else 0
            j = i + len(own)
            n = bisect_left(cover, (j,)) - 1  # the last pattern's span that starts before j
            if own and _SHAPES[kind].fullmatch(own) and (kind == 0 or _valid(kind, own)) and not (n >= 0 and ends[n] > i):
                out[k].append((kind, i, j))
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in sorted(spans))


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None, **options) -> DataFrame:
    """Personal data of every whole text, with spans in code points, end exclusive.

    Returns doc_id, n_email, n_ip, n_card, n_phone (matches of the patterns), base_sha256,
    spans (those and the tagger's), n_added. Null texts count as empty: no spans, and the
    digest of the empty string. The tagger's spans never overlap a pattern's of any kind and are
    well formed (see added_spans). doc_id is a whole number (long); repeated rows and null ids
    each get a row, an empty table none; other columns are left out.
    """
    tagger = tagger or train(docs, **options)

    def run(batch):
        own = [t or "" for t in texts(batch)]
        base = [base_spans(t) for t in own]
        new = added_spans(own, tagger, base)
        counts = {f"n_{name}": [sum(s[0] == k for s in b) for b in base] for k, name in enumerate(KINDS)}
        return {"doc_id": batch.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(render(b).encode()).hexdigest() for b in base], "spans": [render(b + n) for b, n in zip(base, new, strict=True)], "n_added": [len(n) for n in new]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
