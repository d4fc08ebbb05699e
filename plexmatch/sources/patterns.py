"""Pattern files: local or on any file system Spark reaches, one by one or by directory."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.pattern import Pattern


def read_pattern(path: str, spark: SparkSession | None = None, label_mode: str = "first_char") -> Pattern:
    """From a local file; with a session, from any path Spark reads. Patterns are small: the driver reads them."""
    if spark is None:
        text = Path(path).read_text()
    else:
        text = "\n".join(content for _, content in sorted(spark.sparkContext.wholeTextFiles(path, 1).collect()))
    return Pattern.parse(text, label_mode, path.rstrip("/").rsplit("/", 1)[-1])


def read_patterns(path: str, spark: SparkSession | None = None, label_mode: str = "first_char") -> list[Pattern]:
    """Every file of a directory, by name; a file gives one pattern."""
    if spark is None:
        at = Path(path)
        files = sorted(p for p in at.iterdir() if p.is_file()) if at.is_dir() else [at]
        return [read_pattern(str(p), None, label_mode) for p in files]
    found = sorted(spark.sparkContext.wholeTextFiles(path, 1).collect())
    return [Pattern.parse(text, label_mode, name.rsplit("/", 1)[-1]) for name, text in found]
