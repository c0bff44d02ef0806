"""The pipeline's stages against plain-Python versions, on the smallest tables."""

import re

import brute

import corpus_pipeline as cp
from tidewheel.llm import quality
from tidewheel.llm._util import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, rows = [n for n, _ in cp.STAGES], {r.doc_id: r for r in docs.collect()}
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    one = written(cp.quality_stage(spark, docs, sf), "t")
    assert one.columns == docs.columns
    passed = {i for i, r in rows.items() if (s := quality.text_stats(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert {r.doc_id for r in one.collect()} == passed  # no host of this table fails
    two = written(cp.near_duplicates_stage(spark, one, sf), "t")
    groups = brute.components({i: rows[i].text for i in passed})
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i in passed if groups[i][1] == i)
    three = written(cp.decontamination_stage(spark, two, sf), "t")
    assert three.columns == docs.columns and three.join(two, "doc_id", "leftanti").isEmpty()
    four = written(cp.personal_data_stage(spark, three, sf), "t")
    assert four.count() == three.count() and four.columns == docs.columns
    for r in four.collect():
        if not brute.base_spans(rows[r.doc_id].text):
            continue
        assert r.n_chars == len(r.text) and not any(s[2] == "email" for s in brute.base_spans(r.text))
    five = cp.packing_stage(spark, four, sf).toPandas()
    assert set(five.doc_id) == {r.doc_id for r in four.select("doc_id").collect()}
    assert cp.run(spark, sf).toPandas().length.sum() == five.length.sum()


def test_stages_carry_any_columns(spark, sf):
    """Columns with the names that operators use come through each stage with their values."""
    text = " ".join(f"w{i}" for i in range(60))
    columns = ("host_bad", "host_docs", "kept", "n_words", "base_failed", "pii", "row", "w", "word", "key", "id1", "digest", "__host")
    docs = spark.createDataFrame([(1, text, "en", "h", 5, *[f"{c}!" for c in columns])], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in columns))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert [tuple(r)[5:] for r in got.collect()] == [tuple(f"{c}!" for c in columns)], name


def test_decontamination_by_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    words = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    wins = {tuple(w[s : s + 13]) for b in bench if (w := words(b.text)) for s in range(max(1, len(w) - 12))}
    by_size: dict = {}
    for x in wins:
        by_size.setdefault(len(x), set()).add(x)
    clean = set()
    for r in docs.collect():
        w, hit = words(r.text), set()
        for n, some in by_size.items():
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in some:
                    hit |= set(range(s, s + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in cp.decontamination_stage(spark, docs, sf).collect()} == clean


def test_decontamination_without_ids(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    clean = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, item), (None, clean), (1, item), (2, clean)], "doc_id long, text string")
    assert {tuple(r) for r in cp.decontamination_stage(spark, docs, sf).collect()} == {(None, clean), (2, clean)}


def test_near_duplicates_by_row(spark, sf):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(7, one), (7, one), (7, two), (None, one), (None, two + " b"), (None, "x y"), (8, " "), (8, " "), (9, two)], "doc_id long, text string")
    got = sorted((tuple(r) for r in cp.near_duplicates_stage(spark, docs, sf).collect()), key=str)
    assert got == sorted([(7, one), (7, two), (None, "x y"), (8, " ")], key=str)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0
