"""Writers as text: TSV lines, Markdown rows, JSON, section splices; deterministic, in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv_cell(c: Column) -> Column:
    """Minimal quoting: only a cell with a tab, a quote or a line end is quoted."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike('[\t"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def tsv_line(cells: list[Column], end: str = "", quote: bool = True) -> Column:
    return F.concat(F.concat_ws("\t", *[tsv_cell(c) if quote else F.coalesce(c, F.lit("")) for c in cells]), F.lit(end))


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))


def clean(c: Column) -> Column:
    """The cell; one with a tab or a line end may not be written unquoted and raises an error."""
    return F.when(c.rlike("[\t\r\n]"), F.raise_error(F.concat(F.lit("tab or line end in a cell: "), c))).otherwise(c)


def splice(text: Column, header: str, table: Column) -> Column:
    """The text with the block from ``header`` to the next blank line replaced; raises if it is not there."""
    at = F.locate(header, text)
    rest = F.substring(text, at, F.length(text))
    end = F.locate("\n\n", rest)
    tail = F.when(end > 0, F.substring(rest, end, F.length(rest))).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), table, tail)).otherwise(F.raise_error(F.lit(f"no section {header}")))


def json_text(columns: list[str], sort_keys: bool = False) -> Column:
    return F.to_json(F.struct(*(sorted(columns) if sort_keys else columns)))


def json_pretty(columns: list[str], indent: int = 1) -> Column:
    """A JSON object with sorted keys, a member a line."""
    members = [F.concat(F.lit(" " * indent + f'"{c}": '), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)) for c in sorted(columns)]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *members), F.lit("\n}"))


def write_lines(df: DataFrame, line: str, order: list[str], path: str) -> None:
    """Text files of the lines, in order across the files (part by part, then line by line): the cluster sorts ranges."""
    df.orderBy(*order).select(line).write.mode("overwrite").text(path)
