"""The pipeline's stages against brute force on small documents."""

import pytest
from test_operators import docs_of, plain_components, plain_fingerprint, words

import corpus_pipeline
from mainspring.llm import mixing


def test_stages(spark, tmp_path):
    item = words(900, 30, "abcdefghijklmnop")
    rows = [(i, words(i, 50), "en", "ab"[i % 2]) for i in range(40)]
    rows += [(100 + i, words(i, 50), "en", "a") for i in range(10)] + [(100, words(0, 50), "en", "a")]
    rows += [(200, "123 456", "en", "a"), (201, None, "en", "a"), (202, words(5, 20, "qrst") + " " + item, "en", "b"), (203, words(77, 30) + " password=0123456789abcdef01", "en", None)]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    alive = [r for r in rows if r[0] not in (200, 201)]
    roots = plain_components([plain_fingerprint(t) for _, t, *_ in alive])
    least = {}
    for (i, *_), r in zip(alive, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    kept = {i for i in least.values() if i != 202}
    assert set(got) <= kept and not set(got) & {100, 200, 201, 202}
    texts = {i: t.replace("password=0123456789abcdef01", "[secret]") for i, t, *_ in alive}
    assert all(r.text == texts[i] and r.n_chars == len(r.text) for i, r in got.items())
    sizes = {}
    for i in kept:
        source = next(r[3] for r in rows if r[0] == i)
        sizes[source] = sizes.get(source, 0) + len(texts[i].split())
    want = mixing.targets(sizes)
    for s in sizes:
        assert 0 <= want[s] - sum(r.taken for r in got.values() if r.source == s) < 60


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_the_columns_of_documents(spark, tmp_path, stage):
    frame = docs_of(spark, [(1, "some words here", "en", "a"), (None, "null id words", None, None), (2, "", None, None), (3, None, None, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "one two three four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, frame, str(tmp_path)).columns == frame.columns
    assert run(spark, frame.limit(0), str(tmp_path)).count() == 0


ODD = [(1, "some words here to count", "en", "a"), (1, "some words here to count", "en", "a"), (None, "null id words", None, None), (2, "", None, None), (3, None, None, "b"), (3, "another text of the same id", "en", "b"), (4, words(4, 30_000), "en", "a")]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    """Null ids and texts, repeated rows and ids, a very long text, columns with the stages' own names, and no row at all."""
    docs_of(spark, [(*r,) for r in ODD]).select("doc_id", "text", "lang", "source", "n_chars", "score", "size", "t", "_id").selectExpr("*", "5 AS taken", "'x' AS target", "1 AS m", "2 AS h", "'k' AS key", "3 AS least").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, "one two three four five"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/docs")
    out = dict(corpus_pipeline.STAGES)[stage](spark, frame, str(tmp_path))
    rows = [(r.doc_id, r.text) for r in out.collect()]
    if stage == "mixing":
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "t", "_id", "m", "h", "key", "least", "size", "source_size", "target", "taken"]
        assert all(r.taken in (r["size"], 2 * r["size"]) and r["size"] == len(r.text.split()) for r in out.collect()) and rows
    else:
        assert out.columns == frame.columns
        want = {"language": [r[:2] for r in ODD if r[1]], "near_duplicates": [(1, ODD[0][1]), (None, "null id words"), (2, ""), (3, ODD[5][1]), (4, ODD[6][1])]}.get(stage, [r[:2] for r in ODD])
        assert sorted(map(str, rows)) == sorted(map(str, want))
    assert dict(corpus_pipeline.STAGES)[stage](spark, frame.limit(0), str(tmp_path)).count() == 0
