"""Files in and out, settings, and the stream."""

import json
import shutil

from foliant.plans.book import BookConfig
from foliant.sources import files
from foliant.streaming.documents import clean_stream


def test_markdown_in_three_ways(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# É\ntext\n".encode())
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    whole = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_markdown(spark, str(tmp_path / "a.md")).collect()}
    assert whole == {"a.md": "# É\ntext\n"}
    both = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_any_encoding(spark, str(tmp_path)).collect()}
    assert both == {"a.md": "# É\ntext\n", "b.md": "café"}
    loose = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_ignoring_bad_bytes(spark, str(tmp_path)).collect()}
    assert loose == {"a.md": "# É\ntext\n", "b.md": "caf"}


def test_rules_and_settings(tmp_path):
    (tmp_path / "r.json").write_text('{"a": "b", "c": "d"}')
    assert files.read_rules(str(tmp_path / "r.json")) == (("a", "b"), ("c", "d"))
    assert files.read_rules(str(tmp_path / "none.json"), (("x", "y"),)) == (("x", "y"),)
    (tmp_path / "bad.json").write_text("{")
    assert files.read_rules(str(tmp_path / "bad.json")) == ()
    (tmp_path / "p.toml").write_text('[tool.book-pipeline]\nmax_header_depth = 3\nother = 1\n')
    assert files.read_config(str(tmp_path / "p.toml")) == BookConfig(max_header_depth=3)
    assert files.read_config(str(tmp_path / "none.toml")) == BookConfig()
    files.write_config(str(tmp_path / "p.toml"), max_header_depth=5, out_suffix="-x")
    assert files.read_config(str(tmp_path / "p.toml")) == BookConfig(max_header_depth=5, out_suffix="-x") and "other = 1" in (tmp_path / "p.toml").read_text()
    (tmp_path / "q.toml").write_text('[project]\nname = "a"\n')
    files.write_config(str(tmp_path / "q.toml"), long_line_threshold=99)
    assert files.read_config(str(tmp_path / "q.toml")) == BookConfig(long_line_threshold=99) and 'name = "a"' in (tmp_path / "q.toml").read_text()


def test_versions_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [files.write_versioned(df, str(tmp_path / "out")) for _ in range(3)] == [1, 2, 3]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    shutil.rmtree(tmp_path / "out/run_version=2")
    assert [files.write_versioned(df, str(tmp_path / "out"), first_gap=True) for _ in range(2)] == [2, 4]
    assert files.versioned_names("book", 4) == ("book_header_corrected_v4.md", "book_header_corrected_report_v4.md")
    files.write_summary(spark.createDataFrame([("s", "m", 1)], "step string, metric string, n long"), str(tmp_path / "sum"))
    line = spark.read.text(str(tmp_path / "sum")).first()[0]
    assert json.loads(line) == {"step": "s", "metric": "m", "n": 1}
    rows = spark.createDataFrame([('x, "y"', "1\t2")], "a string, b string")
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        files.write_table(rows, str(tmp_path / kind), kind)
        assert spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(str(tmp_path / kind)).collect() == rows.collect()
    files.write_report(rows, str(tmp_path / "rep"))


def test_stream_cleans_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "> end of the\n>\n> road\n\n12\n\n† a ![x](y.png)"), (2, "plain")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # removing images drops blank lines, so the page number no longer stands alone
    assert got == {1: "end of the road\n12\n† a", 2: "plain"}
