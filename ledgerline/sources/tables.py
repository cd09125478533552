"""Readers: parquet tables, nested JSON documents, TSV with exact cells, commented TSV, file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document a file, with a declared schema; a malformed file fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def optional(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    """read(), or an empty relation when its path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A header line and text cells; no quoting, an empty cell is an empty string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, sep="\t", quote="", header=True, enforceSchema=False)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def numbered_lines(df: DataFrame, text: str, *keys: str, skip: str | None = "#") -> DataFrame:
    """keys, line (from 1) and value of each line; lines that are blank or start with ``skip`` are left out, not renumbered."""
    lines = df.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)).alias("line", "value"))
    lines = lines.withColumn("line", F.col("line") + 1).where(F.trim("value") != "")
    return lines.where(~F.col("value").startswith(skip)) if skip else lines


def read_commented_tsv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with _line and the columns, problems as path, line, message) of TSV files with a ``#`` preamble."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = numbered_lines(raw, "value", "path")
    first = lines.groupBy("path").agg(F.min("line").alias("head"))
    lines = lines.join(first, "path").withColumn("cells", F.split("value", "\t", -1))
    want = F.array(*[F.lit(c) for c in columns])
    bad = F.when((F.col("line") == F.col("head")) & (F.col("cells") != want), "header differs").when((F.col("line") > F.col("head")) & (F.size("cells") != len(columns)), F.concat(F.size("cells").cast("string"), F.lit(" cells")))
    problems = lines.withColumn("message", bad).where("message is not null").select("path", "line", "message")
    good = lines.where((F.col("line") > F.col("head")) & (F.size("cells") == len(columns)))
    return good.select("path", F.col("line").alias("_line"), *[F.col("cells")[i].alias(c) for i, c in enumerate(columns)]), problems


def flatten(df: DataFrame, groups: str, rows: str, group_key: str, fields: list[str]) -> DataFrame:
    """Nested groups of rows -> group key, 1-based row, fields; a field that a present row lacks is empty."""
    g = df.select(F.explode(groups).alias("g"))
    r = g.select(F.col(f"g.{group_key}").alias(group_key), F.posexplode(f"g.{rows}").alias("row", "r"))
    return r.select(group_key, (F.col("row") + 1).alias("row"), *[F.coalesce(F.col(f"r.{f}"), F.lit("")).alias(f) for f in fields])


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, modified and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def png_size(content: Column) -> Column:
    """struct<width, height> of a PNG by its header, else null."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def view_box_size(svg: Column) -> Column:
    """struct<width, height> from an SVG's viewBox, rounded; else null."""
    box = F.split(F.trim(F.regexp_extract(svg, r'viewBox="([^"]*)"', 1)), r"[\s,]+")
    return F.when(F.size(box) == 4, F.struct(F.round(F.get(box, F.lit(2)).try_cast("double")).cast("int").alias("width"), F.round(F.get(box, F.lit(3)).try_cast("double")).cast("int").alias("height")))


def fragments(df: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """Distinct matches of a pattern in each page: key, fragment."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))).alias("fragment"))


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, y, values) of 8-bit images, as gray levels."""
    img = spark.read.format("image").load(path).select("image.*")
    px = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.conv(F.hex(F.substring("data", i * F.col("nChannels") + 1, F.lit(1))), 16, 10).cast("int"))
    return img.withColumn("px", px).select(F.col("origin").alias("path"), F.explode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.struct(y.alias("y"), F.slice("px", y * F.col("width") + 1, F.col("width")).alias("values")))).alias("r")).select("path", "r.y", "r.values")
