"""Writers: mappings as text, rolling part files, and guards for existing output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.materialise import cut
from ..plans.pattern import Pattern


def match_lines(mappings: DataFrame, pattern: Pattern) -> DataFrame:
    """A record a mapping: `# Match`, then `<query vertex> <data vertex>` lines; column value."""
    pairs = [F.concat_ws(" ", F.lit(str(u)), F.col(pattern.column(u)).cast("string")) for u in pattern.labels]
    return mappings.select(F.concat_ws("\n", F.lit("# Match"), *pairs).alias("value"))


def write_lines(lines: DataFrame, path: str, overwrite: bool = False, lines_per_file: int = 0) -> None:
    """Text part files of `lines_per_file` lines at most (0: no limit); fails if path exists, unless overwrite."""
    writer = lines.select("value").write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("maxRecordsPerFile", lines_per_file) if lines_per_file else writer).text(path)


def write_mappings(mappings: DataFrame, pattern: Pattern, path: str, overwrite: bool = False, lines_per_file: int = 0) -> None:
    write_lines(match_lines(mappings, pattern), path, overwrite, lines_per_file)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upload(spark: SparkSession, local: str, target: str, overwrite: bool = False) -> None:
    """Copy a local file or directory to target; fails if it exists, unless overwrite."""
    if exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(target)
    p.getFileSystem(conf).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(local), p)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, lines numbered from 0 in each file, however the files are split.

    Lines are written to the shared folder once, with the split they come from; a split's first
    number is the number of lines in the file's splits before it.
    """
    lines = spark.read.text(path)
    at = lines.metadataColumn("_metadata")
    read = cut(lines.select(at["file_path"].alias("file"), at["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("id"), "value"))
    splits = read.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("lines"))  # a row a split
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", "first", before.alias("before"))
    return read.join(starts, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "value")


def fastq_sequences(lines: DataFrame) -> DataFrame:
    """Of FASTQ text (columns line_no from 0, value, any others) the sequences: the second line of every four."""
    return lines.filter(F.col("line_no") % 4 == 1)


def put_fastq(spark: SparkSession, source: str, target: str, overwrite: bool = False, lines_per_file: int = 0) -> None:
    """Write the sequences of FASTQ files, in the order of files and lines, as text part files."""
    found = fastq_sequences(numbered_lines(spark, source)).orderBy("file", "line_no")
    write_lines(found, target, overwrite, lines_per_file)
