"""Reading and writing documents, rules and settings."""

import json
import re
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.book import BookConfig


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): each file whole. doc_id is a hash of the path, so it doesn't change with the order."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_markdown``; files that are no UTF-8 are read as Latin-1."""
    df = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.coalesce(F.expr("try_validate_utf8(CAST(content AS STRING))"), F.decode("content", "ISO-8859-1"))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", text.alias("text"))


def read_ignoring_bad_bytes(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_markdown``; bytes that are no UTF-8 are left out. Only files that hold some go through Python."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    df = spark.read.format("binaryFile").load(path).withColumn("good", F.expr("try_validate_utf8(CAST(content AS STRING))"))
    mended = text(F.when(F.col("good").isNull(), F.col("content")))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", F.coalesce("good", mended).alias("text"))


def read_rules(path: str, default: tuple[tuple[str, str], ...] = ()) -> tuple[tuple[str, str], ...]:
    """Ordered (wrong, right) pairs from a JSON object; ``default`` if the file is missing or no such object."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default
    return tuple((str(a), str(b)) for a, b in found.items()) if isinstance(found, dict) else default


def read_config(path: str) -> BookConfig:
    """Settings from the table ``[tool.book-pipeline]`` of a TOML file; defaults for what it lacks."""
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("tool", {}).get("book-pipeline", {})
    except (OSError, tomllib.TOMLDecodeError):
        found = {}
    return BookConfig(**{k: v for k, v in found.items() if k in BookConfig.__dataclass_fields__})


def write_config(path: str, **settings: int | str | bool) -> None:
    """Sets values of the table ``[tool.book-pipeline]`` in a TOML file; all other lines stay as they are."""
    unknown = set(settings) - set(BookConfig.__dataclass_fields__)
    if unknown:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    file = Path(path)
    lines = file.read_text(encoding="utf-8").splitlines() if file.exists() else []
    table = "[tool.book-pipeline]"
    at = next((k for k, x in enumerate(lines) if x.strip() == table), None)
    if at is None:
        lines += [""] * bool(lines) + [table]
        at = len(lines) - 1
    end = next((k for k in range(at + 1, len(lines)) if lines[k].lstrip().startswith("[")), len(lines))
    kept = [x for x in lines[at + 1 : end] if x.split("=")[0].strip() not in settings]
    lines[at + 1 : end] = [*(f"{k} = {json.dumps(v)}" for k, v in settings.items()), *kept]
    file.write_text("\n".join(lines) + "\n", encoding="utf-8")


def _versions(spark: SparkSession, path: str) -> set[int]:
    """The run_versions under ``path``, from the names of its folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []
    return {int(n.removeprefix("run_version=")) for n in names if re.fullmatch(r"run_version=\d+", n)}


def next_version(spark: SparkSession, path: str, first_gap: bool = False) -> int:
    """One more than the highest run_version under ``path``, 1 if there is none; with ``first_gap`` the least free one."""
    found = _versions(spark, path)
    if first_gap:
        return next(k for k in range(1, len(found) + 2) if k not in found)
    return max(found, default=0) + 1


def versioned_names(stem: str, version: int, suffix: str = "_header_corrected") -> tuple[str, str]:
    """The names of a versioned output file and of its report."""
    return f"{stem}{suffix}_v{version}.md", f"{stem}{suffix}_report_v{version}.md"


def write_versioned(docs: DataFrame, path: str, first_gap: bool = False) -> int:
    """Writes ``docs`` as a new run_version, a folder of its own; earlier versions stay. Returns the version."""
    version = next_version(docs.sparkSession, path, first_gap)
    docs.withColumn("run_version", F.lit(version)).write.partitionBy("run_version").mode("append").parquet(path)
    return version


def write_report(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON object a line: step, metric, n."""
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Parsed rows as comma- or tab-separated files with a head; quotes only where needed."""
    rows.write.mode("overwrite").option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)
