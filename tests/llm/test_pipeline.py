"""The pipeline, stage by stage, and its place among the queries."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm import bpe, language_id, queries
from tests.llm.test_text_operators import SCHEMA, _near_groups, _odd_rows, _removed

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == columns and [f.dataType for f in done.schema] == [f.dataType for f in docs.schema]
        done.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before
        before = docs.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [
        f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minmax_dedup", "substring_dedup", "decontaminate", "bpe"]


#: Names that the operators use for columns of their own.
CLASHING = ["_rk", "_n", "_kept", "_starts", "_copy", "_anchors", "_n_removed", "_n_words", "_intervals", "_empty",
            "_removed", "_stands", "node", "component", "component_id", "row", "last", "e", "c0", "score", "lang_pred", "a b"]


@pytest.fixture(scope="module")
def odd_table(spark):
    """Nulls, empty, long, repeated and copied texts among documents, with columns that clash."""
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame(_odd_rows(), SCHEMA).withColumn("doc_id", F.col("doc_id") + 1000).drop("kept", "n")
    rows = some.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    return rows.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING]).cache()


def _untouched(rows):
    """The clashing columns hold what they held, beside their own id."""
    for r in rows:
        assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING)


def _ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_language_stage_equals_a_plain_loop(spark, odd_table):
    got = corpus_pipeline.identify_language(spark, odd_table, SF).collect()
    model = language_id.train_on(odd_table)
    assert _ids(got) == _ids(r for r in odd_table.collect() if model.has_language(r["text"]))
    _untouched(got)


def test_near_duplicate_stage_equals_all_pairs(spark, odd_table):
    got = corpus_pipeline.drop_near_duplicates(spark, odd_table, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_table.collect() if r["doc_id"] is not None]
    want = {i for i, (_, _, kept) in _near_groups(dict(rows).items(), corpus_pipeline.SIMILARITY).items() if kept}
    # Of the two without an id one is a copy of another document, one is empty and stays.
    assert _ids(got) == Counter(dict.fromkeys(want, 1)) + Counter([None])
    _untouched(got)


def test_substring_stage_equals_counted_windows(spark, odd_table):
    got = corpus_pipeline.drop_repeated_passages(spark, odd_table, SF).collect()
    rows = [(i, r["text"]) for i, r in enumerate(odd_table.collect())]
    ids = [r["doc_id"] for r in odd_table.collect()]
    want = Counter(ids[i] for i, n, removed, _ in _removed(rows, 35) if n == 0 or removed < n)
    assert _ids(got) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    _untouched(got)


def test_benchmark_stage_drops_documents_with_an_item(spark, odd_table):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").first()["text"]
    before = _ids(corpus_pipeline.drop_benchmark_leaks(spark, odd_table, SF).collect())
    leak = F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", F.lit("so"), F.lit(item), F.lit("it is"))).otherwise(F.col("text"))
    got = corpus_pipeline.drop_benchmark_leaks(spark, odd_table.withColumn("text", leak), SF).collect()
    assert _ids(got) == Counter({i: n for i, n in before.items() if i is None or i % 5})
    _untouched(got)


def test_encoding_stage_decodes_to_the_text(spark, odd_table):
    got = corpus_pipeline.encode_texts(spark, odd_table, SF)
    want = bpe.query(odd_table.select("doc_id", "text"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    texts = odd_table.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d"))
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got.collect()) == Counter(map(tuple, texts.collect()))
