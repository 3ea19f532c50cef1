"""Queries against their SQL, and counts, on rows that the given tables lack."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from foliant.functions import text as T
from foliant.llm import quality
from foliant.llm.common import BATCH_BYTES
from foliant.operators import rewrite
from foliant.plans import reports


def same(spark, tmp_path, name, texts):
    """The query and its SQL over lines that the fixture leaves as they are."""
    rows = [(20 + 32 * k, "en", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_book_headings_of_rows_with_accents(spark, tmp_path):
    same(spark, tmp_path, "book_headings", ["0693 èai ètre que", "3 le èai ètre que", "3 le la ètre que", "3 le laé ètre que", "3 le la tre que", "3 le la ñ", "12é le la tre", "3 le la — tre"])


@pytest.mark.parametrize("broadcast_ids", [quality.BROADCAST_IDS, 0])
def test_quality_learns_from_every_labelled_row(spark, broadcast_ids):
    """The bad documents are those that a bounded sample, the least hashes of the ids, leaves out."""
    ids = spark.range(9000).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id")
    ids = [r["id"] for r in ids.collect()]
    assert len(ids) > 6300
    bad = set(ids[6000:])
    docs = spark.createDataFrame([(i, "!!! <> " * 9 + str(i) if i in bad else f"A plain text about {i} words of it") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    model = quality.train(docs, labels, broadcast_ids)
    assert {r["doc_id"] for r in quality.score(docs, model).where("predicted = 0").collect()} == bad


def test_pipeline_stages_send_small_batches(spark):
    """Rows of 10 KB: by rows alone they would be one batch of 30 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1)
        corpus_pipeline.tokenize(spark, docs, "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert max(r["n"] for r in sizes) <= BATCH_BYTES + 20_000
    finally:
        spark.conf.set(key, before)


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_rule_report_reads_documents_once_and_counts_odd_cases(spark):
    rules = rewrite.additional_rules()
    texts = ["Wonld you , wonld", "ſhonld and WEſL , or eaſl", "Bnt İ smiılh ; on", "", None, "Knone  .  marıvel playhonse", "BABONT babont about"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, n, matched = docs.withColumn("text", F.coalesce("text", F.lit(""))), 0, 0
    for p, to in rules:
        k = one.agg(F.sum(T.count(F.col("text"), p, True))).first()[0]
        n, matched = n + k, matched + (k > 0)
        one = spark.createDataFrame(one.withColumn("text", T.sub(F.col("text"), p, T.java_replacement(to), True)).collect(), one.schema) if k else one
    got = reports.rule_report(docs, rules)
    assert reads(got) == 1
    after = sorted((r["doc_id"], r["text"]) for r in one.collect())
    assert sorted((r["doc_id"], r["text"]) for r in rewrite.pattern_rules(docs, rules).collect()) == after
    assert tuple(got.first()) == (len(rules), matched, n, sum(len(t or "") for t in texts), sum(len(t) for _, t in after))
    assert tuple(reports.rule_report(docs.limit(0), rules).first()) == (len(rules), 0, 0, 0, 0)


@pytest.mark.parametrize("query", ["book_steps", "book_status"])
def test_book_steps_read_documents_once(spark, query):
    assert reads(entry.queries()[query](spark, "/root/testdata/sf0.001")) == 1


def test_white_space_is_pythons_and_costs_no_pattern(spark):
    odd = [" a　b  ", " ", "", "a", "​ a ", "\t\x0b x- ", "\x1c a", "é\u0085", "ab cd ef gh", " ab  cd ef ", None]
    docs = spark.createDataFrame([(t,) for t in odd], "x string")
    x, old = F.col("x"), r"(?U)^\s+|\s+\z"
    got = docs.select(x, *(f(x).alias(f.__name__) for f in (T.strip, T.lstrip, T.rstrip, T.blank)), F.regexp_replace(x, old, "").alias("s"), *(T.more_words(x, k).alias(f"w{k}") for k in range(4)), T.word_count(x).alias("w"))
    assert "regexp_replace" not in T.strip(x)._jc.toString()
    for r in got.collect():
        if r["x"] is None:
            assert not any(v is not None and v is not False for v in r)
            continue
        assert r["strip"] == r["s"] and r["blank"] == (r["s"] == "") and [r[f"w{k}"] for k in range(4)] == [r["w"] > k for k in range(4)]
        assert r["x"].endswith(r["lstrip"]) and r["lstrip"].startswith(r["s"]) and r["x"].startswith(r["rstrip"]) and r["rstrip"].endswith(r["s"])
