"""Every corpus operator against brute force and on odd rows: nulls, empty and very long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from mainspring.llm import chat, decontam, language, mixing, pii, quality, secrets, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, t int, _id long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 0.5, 1, 2, 3) for i, t, g, s in rows], DOCS)


def words(seed, n, alphabet="abcdefghij"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, an empty and a blank text, a very long one, repeated rows."""
    rows = [(1, None, None, None), (None, "plain words here", "en", "a"), (2, "", "en", "b"), (3, " \t\n", None, "b"), (4, words(1, 60_000), "en", "a"), (5, "same text", "en", "a"), (5, "same text", "en", "a"), (6, "12345 !!!", "fr", None)]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


LABELS = "doc_id long, quality int, toxic int, text string"


def test_language(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, words(i, 40, "aeioulmn" if i % 2 else "krstvwxz"), "vo" if i % 2 else "co", "s") for i in range(400)]
    rows += [(1000 + i, words(i, rng.randint(3, 9), "aeioulmn"), None, None) for i in range(5)]
    got = language.identify_language(docs_of(spark, rows)).toPandas().set_index("doc_id")
    truth = {i: g for i, _, g, _ in rows}
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    assert np.mean([got.lang_pred[i] == (truth[i] or "vo") for i in got.index]) > 0.99
    assert got.score.between(0, 1).all()
    odds = language.identify_language(odd).collect()
    assert len(odds) == 8 and {r.lang_pred for r in odds if r.doc_id in (1, 2, 3, 6)} == {"und"}
    assert not next(r for r in odds if r.doc_id is None).held_out
    assert language.identify_language(none).count() == 0
    unlearnt = docs_of(spark, [(7, "some words", None, None)])
    assert language.identify_language(unlearnt).first().lang_pred == "und"
    one = docs_of(spark, [(0, "some words", "en", None), (3, "more words", "en", None)])
    assert {r.lang_pred for r in language.identify_language(one).collect()} == {"en"}
    two = docs_of(spark, [*rows, (2000, "12 34", None, None), (2001, None, "co", None)])
    assert language.keep_known(two).count() == len(rows) and language.keep_known(unlearnt).count() == 0
    assert {r.doc_id for r in language.keep_known(two, langs={"vo"}).collect()} == {i for i in got.index if got.lang_pred[i] == "vo"}


@pytest.mark.parametrize("classes", [2, 4, 6, 9, 20])
def test_codewords_tell_classes_and_bits_apart(classes):
    code = language.codewords(classes)
    assert len({tuple(r) for r in code.tolist()}) == classes
    assert (np.abs(code.sum(0)) < classes).all()


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark, odd, none):
    rng, parts = random.Random(1), ["password=", "Token: ", "api_key = '", "APIKEY:\"", "AKIA", "AKIAAKIA", "x ", "\n", "é", "deadbeef" * 4, "deadbeef" * 3, "ABCDEFGH1234", "hunter2hunter2", "a1", "'", "Key=", "secret=AKIA"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 12))), None, None) for i in range(300)]
    for r in secrets.find_secrets(docs_of(spark, rows)).collect():
        base = plain_secrets(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
    key = "auth credentials: " + "kJ8s2LxQ9vTz4RmW7bYc1NdF" + " end"
    name = "the session key is authorization_token_header_name1 end"
    new, old = secrets.find_secrets(docs_of(spark, [(0, key, None, None), (1, name, None, None)])).orderBy("doc_id").collect()
    assert new.spans == f"novel:{key.index('kJ8')}:{key.index(' end')}" and old.spans == ""
    odds = secrets.find_secrets(odd).collect()
    assert len(odds) == 8 and next(r for r in odds if r.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(none).count() == 0
    masked = {r.doc_id: r for r in secrets.redact(docs_of(spark, [(0, key, "en", None), (1, None, None, None)])).collect()}
    assert masked[0].text == "auth credentials: [secret] end" and masked[0].n_chars == len(masked[0].text) and masked[1].text is None


def test_secrets_in_assignments_without_spaces(spark):
    key = "kJ8s2LxQ9vTz4RmW7bYc1NdF"
    heads = ["PRIVATE_KEY=", "private_key=", "signature=", "session=", "export AUTH=", "url?a=1&session=", "session_" + "of_the_long_name_" * 5 + "x=", "cookie: name=", "session=="]
    rows = [(i, h + key + e, None, None) for i, (h, e) in enumerate([(h, "") for h in heads] + [("signature=", "=="), ("plain=", "")])]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    assert got == {i: f"novel:{t.index(key)}:{len(t)}" if "plain" not in t else "" for i, t, *_ in rows}
    masked = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, rows)).collect()}
    assert all(key not in masked[i] for i, t, *_ in rows if "plain" not in t) and masked[0] == "PRIVATE_KEY=[secret]"


def test_repeated_and_one_sided_secrets(spark):
    key, letters, digits = "kJ8s2LxQ9vTz4RmW7bYc1NdF", "kJQsmLxQovTzgRmWqbYcuNdF", "48201957730164829375"
    twice = f"login: {key}, then retry with the same login: {key}"
    far = f"login: {key} " + "and so on, word by word, " * 9 + f"login: {key}"
    rows = [(i, t, None, None) for i, t in enumerate([twice, far, f"secret=={key}= login: {key}", f"password={key} and login: {key}", f"login: {letters}", f"session: {digits}", "login: " + "-" * 40, "login: authorization_token_header_name"])]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    spots = lambda t, own: [(m.start(), m.end()) for m in re.finditer(own, t)]
    for i, own in ((0, key), (1, key), (4, letters), (5, digits)):
        assert got[i] == ",".join(f"novel:{s}:{e}" for s, e in spots(rows[i][1], own))
    assert got[6] == got[7] == ""
    masked = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, rows)).collect()}
    assert not any(own in masked[i] for i in range(6) for own in (key, letters, digits))


def plain_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 30))
        score, i, j = decontam.align(a, b)
        assert score == plain_align(a, b)
        assert score == 0 or plain_align(a, b[i:j]) == score


@pytest.mark.parametrize("block", [2000, 3])
def test_decontamination(spark, odd, none, block):
    items = [(i, words(100 + i, 12 + i, "abcdefghijklmnop")) for i in range(10)] + [(50, words(100, 12, "abcdefghijklmnop")), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rng, rows, want = random.Random(3), [], set()
    for i in range(60):
        own = words(i, 80, "qrstuvwxyz").split()
        if i % 3 == 0:
            k = i // 3 % 10
            copy = items[k][1].split()
            if i % 2:
                copy[rng.randrange(len(copy))] = "changed"
            own[20:20] = [w.upper() for w in copy]
            want.add((i, k))
        rows.append((i, " ".join(own), None, None))
    got = decontam.contaminated(docs_of(spark, rows), bench, block_items=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} - want in (set(), {(i, 50) for i, k in want if k == 0}) and want <= {(r.doc_id, r.item_id) for r in got}
    for r in got:
        assert rows[r.doc_id][1][r.start : r.end].lower().split()[0] in items[r.item_id if r.item_id < 50 else 0][1].split()
    assert {r.doc_id for r in decontam.decontaminate(docs_of(spark, rows), bench).collect()} == {i for i in range(60) if i % 3}
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.decontaminate(odd, bench).count() == 8
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench.limit(0)).count() == 8


def test_decontamination_finds_edited_copies(spark):
    """Against aligning every text with every item: a fifth of the words changed, dropped or added."""
    rng = random.Random(11)
    items = [(i, words(300 + i, 40, "abcdefghijklmnop")) for i in range(12)]
    rows = []
    for i in range(120):
        own, copy = words(i, 60, "qrstuvwxyz").split(), []
        for k, w in enumerate(items[i % 12][1].split()):
            edit = rng.random() if i % 3 else float(k % 4 == 3) - 0.99
            copy += [] if edit < 0.03 and i % 3 else ["new", w] if 0.03 <= edit < 0.06 else ["other"] if 0.06 <= edit < 0.2 or edit == 1 - 0.99 else [w]
        own[30:30] = copy if i % 2 == 0 else []
        rows.append((i, " ".join(own), None, None))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    names: dict = {}
    code = lambda t: np.array([names.setdefault(w, len(names)) for w in decontam.tokens(t)])
    want = {(i, k) for i, t, *_ in rows for k, u in items if decontam.align(code(u), code(t))[0] >= 40}
    assert len(want) > 50 and got <= want and len(got & want) / len(want) > 0.98


def test_decontamination_finds_hot_groups_of_edited_copies(spark):
    """However often a part of an item occurs, the texts that hold only that part are found."""
    items = [(i, words(500 + i, 40, "abcdefghijklmnop")) for i in range(3)]
    edited = " ".join("other" if k % 4 == 3 else w for k, w in enumerate(items[0][1].split()))
    parts = [" ".join(items[i][1].split()[:n]) for i, n in ((1, 20), (2, 21))]
    hot = [(edited, 300, 0), (items[0][1], 5, 0), (parts[0], 300, 1), (items[1][1], 1, 1), (parts[1], 300, 2), (items[2][1], 1, 2)]
    rows, want = [], set()
    for own, n, item in hot:
        for _ in range(n):
            want.add((len(rows), item))
            rows.append((len(rows), f"{words(len(rows), 20, 'qrstuvwxyz')} {own} {words(-len(rows), 20, 'qrstuvwxyz')}", None, None))
    short = len(rows)
    rows.append((short, " ".join(items[1][1].split()[:19]), None, None))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_decontamination_finds_regular_edits(spark):
    """Against aligning every text with every item: words dropped, added or changed at regular places."""
    items = [(i, words(700 + i, n, "abcdefghijklmnop")) for i, n in enumerate((40, 12, 25, 12))]
    rows = []
    for _, text in items:
        own = text.split()
        for step in (3, 4, 5, 6):
            for at in range(step):
                hit = [k % step == at for k in range(len(own))]
                rows.append(" ".join(w for w, h in zip(own, hit, strict=True) if not h))
                rows.append(" ".join(w + " new" * h for w, h in zip(own, hit, strict=True)))
                rows.append(" ".join("other" if h else w for w, h in zip(own, hit, strict=True)))
    rows = [(i, f"{words(i, 30, 'qrstuvwxyz')} {t} {words(-1 - i, 30, 'qrstuvwxyz')}", None, None) for i, t in enumerate(rows)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    names: dict = {}
    code = lambda t: np.array([names.setdefault(w, len(names)) for w in decontam.tokens(t)])
    want = {(i, k) for i, t, *_ in rows for k, u in items if decontam.align(code(u), code(t))[0] >= min(40, len(u.split()))}
    assert got == want and len(want) > 150


@pytest.mark.parametrize("block", [4096, 2])
def test_topk(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4) / 4], 0) for i in range(150)]
    rows += [(200, None, 1), (300, [1.0, None, 0.0, 0.0], 1), (400, [float("nan"), 0.0, 0.0, 0.0], 1), (500, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (600, [], 1), (700, [1e9, 1.0, 2.0, 1e9], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.search(vectors, vectors.where("vec_id % 10 = 0"), 5, block=block).collect()
    exact = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in exact if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[c], strict=True)), c) for c in exact if c != q)[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0
    two = vectors.where("vec_id < 2")
    assert topk.search(two, two, 10).count() == 2


def toxic_rows(n):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        own, bad = words(i, rng.randint(20, 60)).split(), i % 4 == 0
        for w in rng.sample(["vileword", "foulterm", "nastyone"], 2) if bad else []:
            own.insert(rng.randrange(len(own)), w)
        rows.append((i, " ".join(own), None, None))
        labels.append((i, 1, int(bad), "x"))
    return rows, labels


def test_toxicity(spark, odd, none):
    rows, labels = toxic_rows(400)
    labels += [(None, 1, 1, "x"), (7, None, None, "x"), (9999, 1, 1, "x"), (8, 1, 5, "x")]
    table = spark.createDataFrame(labels, LABELS)
    got = toxicity.score_toxicity(docs_of(spark, rows), table).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    assert all(got.predicted[i] == (i % 4 == 0) for i in got.index) and got.score.between(0, 1).all()
    assert got.evidence[0] and got.evidence[0][0]["label"] == 1
    model = toxicity.train(docs_of(spark, rows), table)
    assert toxicity.score_toxicity(odd, table, model).where("predicted = 0").count() == 8
    assert toxicity.score_toxicity(none, table).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, table.limit(0)).collect()} == {0.0}


def test_toxicity_shows_every_vote(spark):
    rows, labels = toxic_rows(400)
    model = toxicity.train(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))
    for r in toxicity.score_toxicity(docs_of(spark, rows[:8]), None, model).collect():
        counts = {w: n for w, n in toxicity.term_counts(rows[r.doc_id][1]).items() if w in model.terms}
        _, place, cosine = model.margin(*model.vector(counts))
        assert [(e.example, e.cosine) for e in r.evidence] == [(model.index.ids[p], c) for p, c in zip(place, cosine, strict=True)]
        assert len(r.evidence) > 5 or r.doc_id % 4


def test_block_max_index_is_exact():
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(400):
        t = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.Index(np.arange(400), np.zeros(400, int)).build(vectors, 30)
    dense = np.zeros((400, 30))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(60):
        t, w = vectors[i]
        place, cosine = index.nearest(t, w, 7, leave=i)
        all_ = np.round(dense[:, t] @ w, 12)
        all_[i] = 0
        best = np.lexsort((np.arange(400), -all_))[:7]
        best = best[all_[best] > 0]
        assert np.allclose(all_[best], cosine) and sorted(np.round(all_[place], 9)) == sorted(np.round(all_[best], 9))


def test_block_max_index_of_rare_and_common_terms_is_exact():
    """Against all cosines, for many vectors at once, of terms from one example's to every example's."""
    rng = np.random.default_rng(16)
    n, terms = 1000, 500
    chance = np.minimum(1, 3 / np.arange(1, terms + 1) ** 0.8)
    vectors = []
    for _ in range(n):
        t = np.flatnonzero(rng.random(terms) < chance)
        w = rng.random(len(t)) * np.where(chance[t] > 0.1, 0.1, 1)
        vectors.append((t, w / max(1e-9, np.sqrt((w * w).sum()))))
    index = toxicity.Index(np.arange(n), np.zeros(n, int)).build(vectors, terms)
    assert 5 < len(index.dense) < terms - 5
    dense = np.zeros((n, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i, (place, cosine) in enumerate(index.nearest(*v, 15) for v in vectors[:150]):
        all_ = np.round(dense @ dense[i], 12)
        best = np.lexsort((np.arange(n), -all_))[:15]
        best = best[all_[best] > 0]
        assert np.allclose(all_[best], cosine) and np.allclose(all_[place], cosine, atol=1e-9)
    none = (np.zeros(0, np.int64), np.zeros(0))
    assert [len(index.nearest(*v, 4)[0]) for v in (none, vectors[3])] == [0, 4]


def test_quality(spark, odd, none):
    good = [(i, ". ".join(words(i * 7 + k, 9).capitalize() for k in range(8)), None, None) for i in range(150)]
    bad = [(200 + i, ("!!! ".join(words(i, 3, "ABCDEF").split()) + " $$$ ") * 9, None, None) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i < 200), 0, "x") for i, *_ in good + bad] + [(None, 1, 0, "x"), (5, None, 0, "x")], LABELS)
    got = quality.score_quality(docs_of(spark, good + bad), labels).toPandas().set_index("doc_id")
    assert (got.predicted == (got.index < 200)).all() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    model = quality.train(docs_of(spark, good + bad), labels)
    assert quality.score_quality(odd, labels, model).where("score between 0 and 1").count() == 8
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, None: 30}, {"x": 1, "y": 1000}, {"a": 0}, {f"s{i}": i * i for i in range(9)}])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert sum(got.values()) == sum(sizes.values()) * 3 / 2
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    assert all(got[s] <= 2 * sizes[s] for s in sizes)
    rates = {got[s] / weight[s] for s in sizes if got[s] < 2 * sizes[s]}
    assert len(rates) <= 1 and all(got[s] / weight[s] <= min(rates, default=1e99) for s in sizes)


def test_fill_reaches_the_best_subset_sum():
    rng = random.Random(9)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randint(1, 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = rng.randint(0, total)
        take = mixing.fill(lengths, counts, budget)
        got = sum(n * k for n, k in zip(lengths, take, strict=True))
        assert got <= budget and all(0 <= k <= c for k, c in zip(take, counts, strict=True))
    every = list(range(1, 200))
    for budget in (1, 777, 19_000):
        take = mixing.fill(every, [3] * 199, budget)
        assert sum(n * k for n, k in zip(every, take, strict=True)) == budget


def test_mixing(spark, odd, none):
    rows = [(i, words(i, 1 + i % 50), None, "abc"[i % 7 % 3]) for i in range(600)] + [(1000 + i, "one two three four", None, "a") for i in range(900)] + [(5000, None, None, None), (5001, "x y", None, None), (None, "p q", None, "b")]
    frame = docs_of(spark, rows)
    got = mixing.mix(frame).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    source = {i: s for i, _, _, s in rows}
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = mixing.targets(sizes)
    for s, part in got.groupby(got.doc_id.map(lambda i: source[None if np.isnan(i) else i]).fillna("-")):
        s = None if s == "-" else s
        assert (part.target == float(want[s])).all() and (part.source_size == sizes[s]).all()
        assert 0 <= want[s] - part.taken.sum() < 2
    again = mixing.mix(frame.repartition(7)).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert mixing.mix(odd).count() == 8 and mixing.mix(none).count() == 0


def plain_fingerprint(text):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))] if own else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    own, rng = simhash.masks(radius), random.Random(0)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & flip == 0 for m in own)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_simhash(spark, odd, none, bucket):
    rng, rows = random.Random(2), []
    for i in range(120):
        own = words(i % 40, 60).split()
        if i >= 40:
            own[rng.randrange(60)] = "É" + str(rng.randrange(5))
        rows.append((500 - i, (" ".join(own) + "  X\n").upper() if i % 5 else " ".join(own), None, None))
    rows += [(600, "", None, None), (601, None, None, None), (602, "lone", None, None), (None, rows[0][1], None, None), (None, "only null ids", None, None)]
    got = simhash.near_duplicates(docs_of(spark, rows), bucket_rows=bucket).collect()
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    roots, least = plain_components(prints), {}
    for (i, *_), r in zip(rows, roots, strict=True):
        least.setdefault(r, []).extend([] if i is None else [i])
    want = sorted((str(i), f"{p:016x}", str(min(least[r], default=None))) for (i, *_), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(odd).count() == 8 and simhash.near_duplicates(none).count() == 0


def test_bucket_grid_keeps_every_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    for bucket in (4096, 16):
        tree = {r.node: r.root for r in simhash.components(simhash.candidate_edges(frame, 4, bucket)).collect()}
        roots, mine = plain_components(prints), {}
        for p, r in zip(prints, roots, strict=True):
            mine.setdefault(r, set()).add(tree.get(simhash._signed(p), simhash._signed(p)))
        assert all(len(v) == 1 for v in mine.values()) and len({next(iter(v)) for v in mine.values()}) == len(mine)


def test_buckets_of_many_blocks_keep_every_link():
    low = np.random.default_rng(0).integers(0, 1 << 63, 1500, np.uint64)
    high = low | np.uint64(1 << 63)
    for order in ((high, low), (low, high)):
        forest = simhash.Forest()
        simhash.link(np.concatenate(order), 4, forest)
        assert all(forest.root(a) == forest.root(b) for a, b in zip(low.tolist(), high.tolist(), strict=True))


def test_preferences(spark):
    turn = "array<struct<turn: long, role: string, text: string>>"
    a = [(0, "user", "Hi"), (1, "assistant", "Hello"), (2, "user", "More"), (3, "assistant", "Yes é")]
    pairs = [(1, a, a[:3] + [(3, "assistant", "No")]), (2, a, a), (3, a, None), (4, None, None), (5, [(0, None, None)], [(0, None, "")]), (6, a, a[:2]), (6, a, a[:2])]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(pairs, f"pair_id long, chosen {turn}, rejected {turn}")).collect()}
    assert got[1].common == 3 and got[1].prompt.endswith("<|user|>\nMore<|end|>\n")
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            spans = [tuple(map(int, m.split(":"))) for m in mask.split(",") if m]
            assert [text[i:j] for i, j in spans] == [m + "<|end|>\n" for m in re.findall(r"<\|assistant\|>\n(.*?)<\|end\|>\n", text)]
    assert got[2].chosen == got[2].rejected == "" and got[3].common == 0 and got[3].rejected == "" and got[5].common == 0
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "x"), (1, 2, "user", "r"), (1, 3, "assistant", "y"), (1, 4, "user", "z"), (2, 0, "user", "q"), (None, 0, "user", "q"), (3, None, None, None), (3, 1, "assistant", "k")], "conv_id long, turn long, role string, text string")
    made = {r.pair_id: r for r in chat.format_preferences(chat.revisit_pairs(conv)).collect()}
    assert set(made) == {1, 3} and made[1].common == 3 and made[1].rejected == "<|assistant|>\nx<|end|>\n" and made[3].common == 2
    assert chat.format_preferences(chat.revisit_pairs(conv.limit(0))).count() == 0


def plain_personal(text):
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub(r"\D", "", m[0])]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            found.append((2, m.start(), m.end()))
    return found + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


@pytest.fixture(scope="module")
def tagger():
    return pii.train(None)


def test_personal_data(spark, odd, none, tagger):
    rng, parts = random.Random(6), ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (449) 555-9658", "+", "1-", " ", ".", "é", "\n", "m@n.o@p.q", "12", "٣", "+44 20 7946 0958 1"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 14))), None, None) for i in range(400)]
    for r in pii.find_personal_data(docs_of(spark, rows), tagger).collect():
        base = plain_personal(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{i}:{j}" for k, i, j in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in base) for n in range(4)]
        assert set(f"{pii.KINDS[k]}:{i}:{j}" for k, i, j in base) <= set(r.spans.split(",")) | {""}
    odds = pii.find_personal_data(odd, tagger).collect()
    assert len(odds) == 8 and all(r.spans == "" for r in odds if r.doc_id in (1, 2, 3))
    assert pii.find_personal_data(none, tagger).count() == 0
    assert pii.base_spans("7" * 9000) == [] and pii.base_spans("1" * 9000 + ".1.1.1") == []


def test_tagger_learns_other_spellings(tagger):
    held = pii.synthetic(300, seed=77)
    found = pii.added_spans([t for t, _ in held], tagger, [[] for _ in held])
    want = {(n, *s) for n, (_, spans) in enumerate(held) for s in spans}
    got = {(n, *s) for n, spans in enumerate(found) for s in spans}
    assert len(want & got) / len(want) > 0.8 and len(want & got) / len(got) > 0.85


def test_tagger_gradients():
    rng = np.random.default_rng(1)
    own = pii.Tagger(hidden=3, size=4)
    own.p = {k: v.astype(np.float64) for k, v in own.p.items()}
    x, y = rng.integers(0, 131, (3, 6)).astype(np.int16), rng.integers(0, pii.TAGS, (3, 6))
    _, grad = own.gradients(x, y)
    for name in ("O", "T", "Hf", "Xb", "Bf"):
        at = tuple(rng.integers(0, s) for s in own.p[name].shape)
        old, loss = own.p[name][at], []
        for step in (1e-3, -1e-3):
            own.p[name][at] = old + step
            loss.append(own.gradients(x, y)[0])
        own.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[name][at]) < 1e-3


def test_windows_hold_every_anchor():
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(rng.choices("abc 1@", weights=[9, 9, 9, 9, 1, 1], k=rng.randint(1, 400)))
        starts = pii.window_starts(text)
        assert all(any(s <= m.start() < s + pii.WIDTH for s in starts) for m in re.finditer("[0-9@]", text))


def test_language_features_and_decoding_against_plain_versions():
    """Hashed pairs and triples one by one, and the loss-weighted distance of every codeword one by one."""
    text = "Ça va, the  quick-brown Fox 12"
    raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()]
    raw = [b for k, b in enumerate(raw) if b != 32 or raw[k - 1] != 32]
    pairs, triples = [0.0] * language.BIGRAMS, [0.0] * language.TRIGRAMS
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        pair = (a * 31 + b * 1021) % 2**32
        triple = (pair * 2654435761 + c * 40503) % 2**32
        pairs[(pair ^ (pair >> 7)) % language.BIGRAMS] += 1
        triples[(triple ^ (triple >> 15)) % language.TRIGRAMS] += 1
    plain = np.sqrt(np.array(pairs + triples) / sum(pairs))
    assert np.allclose(language.features(text), plain, atol=1e-6) and not language.features("").any()
    rng = np.random.default_rng(4)
    for classes in (3, 8):
        code = language.codewords(classes)
        weights = rng.random(code.shape)
        model = language.LanguageModel([f"l{k}" for k in range(classes)], code, rng.standard_normal((language.WIDTH, code.shape[1])) * 5, rng.standard_normal(code.shape[1]), weights / weights.sum(1, keepdims=True), 2.0)
        x = rng.random((20, language.WIDTH)) * 0.1
        for row, p in zip(x, model.probabilities(x), strict=True):
            margin = [sum(row * model.weights[:, b]) + model.bias[b] for b in range(code.shape[1])]
            far = [sum(model.bit_weights[c, b] * np.log1p(np.exp(-code[c, b] * margin[b])) for b in range(code.shape[1])) for c in range(classes)]
            odds = np.exp(-2.0 * (np.array(far) - min(far)))
            assert np.allclose(p, odds / odds.sum()) and np.argmax(p) == np.argmin(far)


def test_ambiguous_texts_are_flagged_and_rejected(spark):
    """A text half in one language and half in the other is kept only if ambiguity is of no account."""
    rows = [(i, words(i, 40, "aeioulmn" if i % 2 else "krstvwxz"), "vo" if i % 2 else "co", "s") for i in range(300)]
    model = language.train(docs_of(spark, rows))
    pieces = [words(k, 30, "aeioulmn") + " " + words(900 + k, n, "krstvwxz") for k in range(40) for n in range(24, 37)]
    mixed = docs_of(spark, [(1000 + k, t, None, None) for k, t in enumerate(pieces)])
    found = language.identify_language(mixed, model).collect()
    vague = {r.doc_id for r in found if r.ambiguous}
    assert vague and {r.doc_id for r in language.keep_known(mixed, model).collect()} == {r.doc_id for r in found} - vague
    assert language.keep_known(mixed, model, ambiguity=0.0).count() == len(pieces)
    assert language.keep_known(docs_of(spark, rows), model).count() == len(rows)


def test_samples_do_not_depend_on_partitions(spark):
    rows = [(i % 700, words(i, 20, "aeioulmn" if i % 2 else "krstvwxz"), "vo" if i % 700 % 2 else "co", "s") for i in range(1400)] + [(3, "the same row again", "vo", "s")] * 500
    frame = docs_of(spark, rows)
    a, b = (language.train(f, per_class=50) for f in (frame.repartition(7), frame.coalesce(1)))
    assert np.allclose(a.weights, b.weights) and a.langs == b.langs


def test_planted_secrets_of_many_shapes(spark):
    """Recall on random keys of several alphabets and lengths, and precision on names, numbers in prose and paths."""
    rng = random.Random(21)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    heads = ["private_key: ", "session=", "Authorization: Bearer ", "signature = ", "the login credential is ", "client cookie -> "]
    prose = "the service reads its configuration and opens a connection for every request that a client sends "
    rows, want = [], {}
    for k in range(240):
        key = "".join(rng.choices(alphabets[k % 4], k=rng.choice([20, 24, 32, 40, 64])))
        rows.append((k, prose * rng.randint(0, 3) + rng.choice(heads) + key + " " + prose, None, None))
        want[k] = key
    parts = ["request", "configuration", "connection", "authorization", "handler", "service", "client", "reader", "session", "token", "default", "internal"]
    for k in range(240, 480):
        name = rng.choice("_-/").join(rng.choices(parts, k=rng.randint(3, 5)))
        rows.append((k, prose + rng.choice(heads) + name + " " + prose, None, None))
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    hit = sum(any(s.startswith(("novel", "hex", "assign")) and rows[k][1][int(s.split(":")[1]) : int(s.split(":")[2])].endswith(want[k]) for s in got[k].split(",") if s) for k in want)
    wrong = sum(bool(got[k]) for k in range(240, 480))
    assert hit / len(want) > 0.95 and wrong / 240 < 0.05


def test_identifiers_of_the_text_prime_the_dictionary():
    name = "zorbulator_quintflex_handle"
    near, far = "session = " + name, "zorbulator and quintflex are our words. " + "x " * 400 + "session = " + name
    assert secrets.novel_spans(near, []) and not secrets.novel_spans(far, [])
    assert secrets.names_of("Alpha betaGamma DELTA", [(6, 15)]) == b"Alpha DELTA"
    key = "kJQsmLxQovTzgRmWqbYcuNdF"
    assert secrets.novel_spans(f"{key} and far from it " + "x " * 400 + f"login: {key}", [])


def test_many_secrets_in_one_text_take_one_walk():
    rng = random.Random(2)
    text = " ".join(f"password=hunter{k:06d}x login: " + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=24)) for k in range(3000))
    base = secrets.base_spans(text)
    starts, ends = secrets._merged(base)
    assert starts == sorted(starts) and all(e <= s for e, s in zip(ends, starts[1:], strict=False))
    new = secrets.novel_spans(text, base)
    assert len(base) == 3000 and len(new) > 2900 and all(not (s < j and i < e) for (i, _, j), (s, _, e) in zip(new, base, strict=False))


def test_short_items_are_no_evidence(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "one two three four"), (3, "red green blue black white")], "item_id long, text string")
    docs = docs_of(spark, [(1, "yes indeed", None, None), (2, "one two three four", None, None), (3, "so red green blue black white it is", None, None), (None, "red green blue black white", None, None), (4, "red green blue", None, None)])
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).orderBy("doc_id").collect()] == [(None, 3), (3, 3)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [1, 2, 4]
    twice = docs_of(spark, [(7, "clean words only here", None, None), (7, "red green blue black white", None, None)])
    assert [r.text for r in decontam.decontaminate(twice, bench, block_items=1).collect()] == ["clean words only here"]


def test_alignments_are_remembered_within_bounds():
    rng = np.random.default_rng(3)
    block = decontam.Items([(1, words(1, 30))], 4)
    finder = decontam.Finder(block, 0.5, 40, 5)
    finder.MEMO = 20_000
    for _ in range(200):
        part = rng.integers(0, 30, 40)
        assert finder._aligned(0, part) == decontam.align(block.seqs[0], part)
        assert sum(len(k[1]) + 256 for k in finder.known) <= 20_000
    finder._aligned(0, np.zeros(2000, np.int64))
    assert all(len(k[1]) < 2000 for k in finder.known)


def plain_best(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


def test_fill_against_every_subset_sum():
    rng = random.Random(19)
    assert mixing.fill([34, 2], [2, 3], 68) == [2, 0]
    for _ in range(1500):
        lengths = rng.sample(range(0, 60), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        take = mixing.fill(lengths, counts, budget)
        assert sum(n * k for n, k in zip(lengths, take, strict=True)) == plain_best(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
    for _ in range(100):  # beyond the capacity the last words are still fitted
        lengths = rng.sample(range(1, 300), 30)
        counts = [rng.randint(1, 50) for _ in lengths]
        budget = rng.randint(5000, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        take = mixing.fill(lengths, counts, budget, capacity=2000)
        assert sum(n * k for n, k in zip(lengths, take, strict=True)) == min(budget, sum(n * c for n, c in zip(lengths, counts, strict=True)))


def test_taking_what_the_mix_takes(spark, tmp_path):
    """take() and mix() agree row by row; a hot id, equal rows, nulls, and columns with the mix's own names."""
    rows = [(i, words(i, 1 + i % 20), None, "abc"[i % 3]) for i in range(400)] + [(7, "a hot id of six words", None, "a")] * 300 + [(None, "null id here", None, "b")] * 20 + [(900, None, None, None), (901, "x y", None, None)]
    frame = spark.createDataFrame([(i, t, s, 5, "y", 1.0, "k", 2) for i, t, _, s in rows], "doc_id long, text string, source string, size int, taken string, Target double, s string, m int").repartition(5)
    frame.write.parquet(f"{tmp_path}/docs")
    frame = spark.read.parquet(f"{tmp_path}/docs")
    whole = mixing.mix(frame).where("taken > 0").groupBy("doc_id", "size", "taken", "target").count()
    taken = mixing.take(frame)
    assert taken.columns == ["doc_id", "text", "source", "s", "m", "size", "source_size", "target", "taken"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, taken.groupBy("doc_id", "size", "taken", "target").count().collect())) == sorted(map(key, whole.collect()))
    for r in taken.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert 0 <= r["max(target)"] - r["sum(taken)"] < 2


def test_one_row_of_each_component_stays(spark):
    base = [(5, "alpha beta gamma delta epsilon", "en", "a"), (3, "alpha beta gamma delta epsilon", "en", "b"), (None, "alpha beta gamma delta epsilon", None, None), (3, "quite other words stand in this one", "en", "a"), (3, "quite other words stand in this one", "en", "a"), (None, "only null ids have this text here", None, None), (None, "only null ids have this text here", "en", None), (None, "and a second text of null ids", None, None), (9, None, None, None), (8, "", None, None)]
    got = simhash.one_of_each(docs_of(spark, base)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", "alpha beta gamma delta epsilon"), ("3", "quite other words stand in this one"), ("None", "only null ids have this text here"), ("None", "and a second text of null ids"), ("8", "")])
    assert simhash.one_of_each(docs_of(spark, [])).count() == 0


def test_masks_of_many_turns(spark):
    """Against plain positions, with repeated turns and more of them than one piece of running sums holds."""
    rows = [(k % 3, k // 3, "assistant" if k % 2 else "user", f"turn {k}" * (k % 5)) for k in range(900)] + [(0, 4, "assistant", "again")] * 3
    conv = spark.createDataFrame([(a, b, c, d, "x", 1) for a, b, c, d in rows], "conv_id long, turn long, role string, text string, lang string, pair_id int")
    own = chat.turns(conv).selectExpr("conv_id AS pair_id", "turns AS chosen", "slice(turns, 1, 2) AS rejected")
    for r in chat.format_preferences(own).collect():
        spans = [tuple(map(int, m.split(":"))) for m in r.chosen_mask.split(",")]
        want = [m.span(1) for m in re.finditer(r"<\|assistant\|>\n((?:(?!<\|end\|>).)*<\|end\|>\n)", r.chosen)]
        assert spans == want and len(spans) > 90
    pairs = chat.revisit_pairs(conv)
    assert chat.format_preferences(pairs.union(pairs.selectExpr("pair_id + 10", "chosen", "chosen")), equal="drop").count() == 3


def test_windows_that_are_left_out_lose_no_span(tagger):
    """Tagging all windows of whole texts gives the same spans; tags keep to the hard constraints."""
    rng = random.Random(12)
    texts = [t for t, _ in pii.synthetic(120, seed=5)] + ["x" * 3000, "a@" * 400, "1 " * 700, "", "Ünï 5 @", "m@n.o " * 300]
    texts += ["".join(rng.choices(["word ", "a.b@c.de ", "555-123-4567 ", "(449) 555-9658", " ", "éé", "+", "@", "7"], k=60)) for _ in range(60)]
    part = pii.tagged_spans(texts, tagger, batch=64)
    assert part == pii.tagged_spans(texts, tagger, every=True) and sum(map(len, part)) > 300
    for text, spans in zip(texts, part, strict=True):
        for (kind, i, j), (_, k, _) in zip(spans, [*spans, (0, len(text) + 1, 0)][1:], strict=True):
            assert j <= k and set(text[i:j]) <= set(pii._LOCAL + "@" if kind == 0 else "0123456789 ().+-")


def test_one_path_over_stretches_is_the_best_one():
    """Against scoring every allowed path of short stretches."""
    import itertools

    rng = np.random.default_rng(8)
    trans = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    parts = [rng.standard_normal((n, pii.TAGS)).astype(np.float32) for n in (1, 4, 2, 3, 4)]
    for emit, tags in zip(parts, pii.decode(parts, trans), strict=True):
        def score(path, emit=emit):
            whole = [0, *path, 0]
            return sum(emit[k, t] for k, t in enumerate(path)) + sum(trans[a, b] + pii._FOLLOWS[a, b] for a, b in zip(whole, whole[1:], strict=False))

        best = max(itertools.product(range(pii.TAGS), repeat=len(emit)), key=score)
        assert list(best) == tags
    assert pii.spans_of([0, 1, 2, 2, 1, 3, 4, 0, 7], 10) == [(0, 11, 14), (0, 14, 15), (1, 15, 17), (3, 18, 19)]


def test_quality_densities_against_solving():
    """Log densities by solve and slogdet of the shrunk covariances, and statistics counted one by one."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5)) + y[:, None] * 2
    model = quality.fit(x, y, np.ones(300))
    z = np.clip((x - model.center) / model.scale, -12, 12)
    for pool, round_ in ((0.0, 0.1), (0.6, 0.3)):
        pair = quality._gaussians(z, y, pool, round_)
        own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
        pooled = own[0] * (y == 0).mean() + own[1] * (y == 1).mean()
        for c in (0, 1):
            s = (1 - pool) * own[c] + pool * pooled
            s = (1 - round_) * s + round_ * (np.trace(s) / 5 + 1e-6) * np.eye(5)
            d = z - z[y == c].mean(0)
            plain = -0.5 * (d * np.linalg.solve(s, d.T).T).sum(1) - 0.5 * np.linalg.slogdet(s)[1]
            assert np.allclose(pair[c].log_density(z), plain)
    margin = model.classes[1].log_density(z) - model.classes[0].log_density(z)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.slope * np.clip(margin, -200, 200) + model.intercept)))) and ((model.score(x) > 0.5) == (y == 1)).mean() > 0.8
    text = "One two two.\nOne two two.\nAN extraordinarily-long word! || 42"
    got, own = dict(zip(quality.NAMES, quality.statistics(text), strict=True)), text.split()
    share = lambda k, n: np.log((k / n + 0.005) / (1.005 - k / n))
    assert np.isclose(got["chars"], np.log1p(len(text))) and np.isclose(got["words"], np.log1p(len(own)))
    assert np.isclose(got["distinct"], share(len(set(own)), len(own))) and np.isclose(got["commonest"], share(max(map(own.count, own)), len(own)))
    assert np.isclose(got["upper"], share(sum(c.isupper() for c in text), len(text))) and np.isclose(got["digits"], share(2, len(text)))
    assert np.isclose(got["lines"], np.log1p(3)) and np.isclose(got["repeated_lines"], share(1, 3)) and np.isclose(got["repeated_next"], share(0, len(own)))
    assert np.isfinite(quality.statistics(None)).all() and (quality.statistics(None) == quality.statistics("")).all()


def test_long_and_huge_vectors(spark):
    """Exact integers, by Python's own, for vectors whose products pass 2 ** 53."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-(2**12), 2**12)) for _ in range(3000)]) for i in range(30)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(vectors, vectors.where("vec_id % 15 = 0"), 4, block_bytes=1000).collect()}
    exact = [[int(x * 1024) for x in v] for _, v in rows]
    for q in (0, 15):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[c], strict=True)), c) for c in range(30) if c != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(c, -s) for s, c in best]


def test_toxicity_scores_of_odd_rows_are_those_of_no_neighbour(spark, odd):
    rows, labels = toxic_rows(200)
    model = toxicity.train(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))
    alone = float(toxicity.sigmoid(model.slope * model.vote(np.zeros(0, np.int64), np.zeros(0))[0] + model.intercept))
    got = {r.doc_id: r for r in toxicity.score_toxicity(odd, None, model).collect()}
    assert all(got[i].score == alone and got[i].evidence == [] for i in (1, 2, 3))
    text = rows[0][1]
    again = docs_of(spark, [(0, text, None, None), (0, text, None, None), (None, text, None, None)])
    same = toxicity.score_toxicity(again, None, model).collect()
    assert len(same) == 3 and len({r.score for r in same}) == 1 and [r.held_out for r in same if r.doc_id is None] == [False]
