"""Directories of TSV files: joined by column names, and split into parts in file order."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .media import literal_path
from .recording_files import write_line_files
from .scratch import stored
from .transcripts import decoded, path_below

TSV = "*.[tT][sS][vV]"


def is_splittable_name(name: Column) -> Column:
    """A .tsv file that is not itself a generated part."""
    return F.lower(name).endswith(".tsv") & ~name.rlike(r".*\.part[0-9]+(\.[^/]*)?$")


def text_lines(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    """(address, block, at, value): lines of files; `at` ascends along a block of a file without gaps."""
    return spark.read.option("pathGlobFilter", pattern).text(paths).select(
        F.col("_metadata.file_path").alias("address"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def union_tsv_dir(spark: SparkSession, paths: str | list[str], multi_line: bool = False, pattern: str = TSV) -> DataFrame:
    """The TSV files of directories concatenated by column name; a column that a file lacks is null.

    Files are grouped by their header line and read with one scan per header; of each header its files' paths reach
    the driver. Columns come in the order in which the files, by path, bring them up.
    """
    lines = text_lines(spark, paths, pattern)
    heads = lines.filter("block = 0").groupBy("address").agg(F.min_by("value", "at").alias("header"))
    layouts = heads.groupBy("header").agg(F.array_sort(F.collect_list(decoded(F.col("address")))).alias("paths")).collect()
    if not layouts:
        raise ValueError(f"no file {pattern} in {paths}")
    out = None
    for row in sorted(layouts, key=lambda r: r.paths[0]):
        names = next(csv.reader([row.header.removeprefix("\ufeff")], delimiter="\t"), [])
        if len(set(names)) < len(names):
            raise ValueError(f"repeated column in the header of {row.paths[0]}: {names}")
        table = (
            spark.read.schema(", ".join(f"`{n.replace('`', '``')}` string" for n in names))
            .options(header=True, sep="\t", multiLine=multi_line, quote='"', escape='"').csv([literal_path(p) for p in row.paths]))
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def numbered_lines(lines: DataFrame, name: Column) -> DataFrame:
    """(name, line, value, n_lines, error): lines of text_lines with their number in the file, from 0.

    A file's blocks count their lines apart, and their counts are summed up; no file is read in one piece and no
    line needs a key. `error` tells why a file cannot be split between lines.
    """
    kept = stored(lines.withColumn("name", name), "lines")  # so that both uses see the same blocks
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = kept.groupBy("name", "block").agg(
        F.min("at").alias("first"), F.count("*").alias("n"),
        F.max(~F.is_valid_utf8("value")).alias("garbled"), F.max(quotes % 2 == 1).alias("open"))
    file, earlier = Window.partitionBy("name"), Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        F.col("name").alias("_name"), F.col("block").alias("_block"), "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(file).alias("n_lines"),
        F.when(F.max("garbled").over(file), "not UTF-8").when(F.max("open").over(file), "line break within quotes").alias("error"))
    return kept.join(placed, (F.col("name") == F.col("_name")) & (F.col("block") == F.col("_block"))).select(
        "name", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value", "n_lines", "error")


def split_tsv_dir(spark: SparkSession, source: str, target: str, max_rows: int = 100_000) -> DataFrame:
    """Split every .tsv file in `source` into <base>.part<N>.tsv below `target`, each with the header.

    Parts hold `max_rows` rows in file order, the last one fewer; there is no empty part. Returns a row per file:
    name, status (split, empty, failed or skipped), n_rows, n_parts, error. Files of other kinds and generated parts
    are skipped; a file that cannot be split does not touch the others. A row is a line: a file with line breaks
    within quotes fails.
    """
    name = path_below(source)
    files = spark.read.format("binaryFile").load(source).select(name.alias("name"))
    given = text_lines(spark, source, TSV).filter(is_splittable_name(F.col("address")))
    lines = numbered_lines(given, F.substring_index(decoded(F.col("address")), "/", -1))
    lines = stored(lines.withColumn("n_parts", F.ceil((F.col("n_lines") - 1) / max_rows)), "numbered")
    good = lines.filter("error is null")
    base = F.substring(F.col("name"), F.lit(1), F.length("name") - 4)

    def part(number: Column) -> Column:
        return F.concat(base, F.lit(".part"), number.cast("string"), F.lit(".tsv"))

    rows = good.filter("line > 0").select(part(F.floor((F.col("line") - 1) / max_rows) + 1).alias("name"), "line", "value")
    heads = (
        good.filter("line = 0 AND n_parts > 0").withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_parts")))
        .select(part(F.col("part")).alias("name"), "line", "value"))
    write_line_files(rows.unionByName(heads), "line", target)
    read = lines.filter("line = 0").select(
        F.col("name").alias("_name"), (F.col("n_lines") - 1).alias("n_rows"), F.when(F.col("error").isNull(), F.col("n_parts")).alias("n_parts"), "error")
    status = (
        F.when(~is_splittable_name(F.col("name")), "skipped").when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce("n_rows", F.lit(0)) > 0, "split").otherwise("empty"))
    return files.join(read, F.col("name") == F.col("_name"), "left").select("name", status.alias("status"), "n_rows", "n_parts", "error")
