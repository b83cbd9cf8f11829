"""The pipeline stage by stage against brute-force versions, and with odd rows."""

import collections

import corpus_pipeline
from lexiloom.llm import queries
from tests.llm.test_dedup import brute_exact, brute_groups


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language ID"](spark, docs, sf_dir)
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {i for i, r in rows.items() if r.text and any(map(str.isalpha, r.text))}

    two = stages["exact dedup"](spark, one, sf_dir).cache()
    kept = {x[0] for x in brute_exact([(r.doc_id, r.text) for r in one.collect()]) if x[3]}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == kept

    three = stages["n-gram Jaccard join"](spark, two, sf_dir).cache()
    assert three.columns == columns
    assert {r.doc_id for r in three.collect()} == {i for i, _, c in brute_groups([(r.doc_id, r.text) for r in two.collect()]) if i == c}

    four = stages["benchmark decontamination"](spark, three, sf_dir).cache()
    items = [r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == columns and not any(x in t.lower() for t in left.values() for x in items)
    gone = [r.text.lower() for r in three.collect() if r.doc_id not in left]
    assert all(any(len(set(x.split()) & set(t.split())) >= 0.5 * len(set(x.split())) for x in items) for t in gone)

    five = stages["mixing sources to target weights"](spark, four, sf_dir).collect()
    copies = collections.Counter(r.doc_id for r in five)
    assert set(copies) <= set(left) and max(copies.values()) <= 2 and all(r.text == left[r.doc_id] for r in five)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert 0.9 <= words(five) / (1.5 * words(four.collect())) <= 1.0


def test_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_id int, copy_no int, gone_id int, taken_id int, taken_n int, all_n int"
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
    rows = [(1, text), (1, text), (1, "another text with the very same id as before, quite long"), (None, text + " ..."), (None, "a lonely text without any id in this table"), (2, None), (3, ""), (4, "12 34"), (5, "  " + text)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 1, 1, 1, 1, 1) for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    texts = sorted(r.text for r in docs.collect())
    assert len(texts) == 3 and sum("quick" in t for t in texts) == 1
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert last.columns[:-1] == docs.columns and last.count() >= 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_mix_takes_some_of_alike_rows(spark, sf_dir):
    """Where the mix takes some of many alike rows, each copy is one row, numbered, with all columns."""
    rows = [(1, "one two three", "s")] * 40 + [(k, "word " * k, "s" if k % 2 else "t") for k in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs, sf_dir)
    want = collections.Counter()
    for r in queries.mixed_sample(corpus_pipeline._with_row_id(docs)[0], id_col="row_id").collect():
        want[r["size"]] += r.n_copies
    got = mixed.collect()
    assert mixed.columns == [*docs.columns, "copy_no"]
    assert collections.Counter(len(r.text.split()) for r in got) == +want
