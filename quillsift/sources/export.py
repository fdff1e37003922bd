"""Results as files and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(value: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_line(columns: list[Column]) -> Column:
    """One CSV line: guarded, quoted where needed."""
    cells = []
    for c in columns:
        text = F.coalesce(guarded(c.cast("string")), F.lit(""))
        cells.append(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *cells)


def write_csv(df: DataFrame, path: str) -> None:
    """A report for spreadsheets; every text cell is guarded, and each file starts with a byte order mark."""
    kinds = dict(df.dtypes)
    cells = [(guarded(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(c if i else "\ufeff" + c) for i, c in enumerate(df.columns)]
    out = df.select(*cells).write.options(header=True, lineSep="\r\n", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out.csv(path)


#: Columns by bit, as a caller may ask for them (fixed values).
ASKED = {0x01: "name", 0x04: "path", 0x08: "ext", 0x10: "size", 0x20: "created", 0x40: "modified"}


def asked(df: DataFrame, mask: int) -> DataFrame:
    """id and the columns of a mask's bits, lowest first; a scan reads no others. Unknown bits are none's."""
    return df.select("id", *[column for bit, column in ASKED.items() if mask & bit])


def long_line() -> Column:
    """Size, time (UTC) and path between tabs; - for what is unknown."""
    time = F.when(F.col("modified") > 0, F.date_format(F.timestamp_seconds("modified"), "yyyy-MM-dd HH:mm:ss"))
    return F.concat_ws("\t", F.coalesce(F.col("size").cast("string"), F.lit("-")), F.coalesce(time, F.lit("-")), "path")


def write_paths(df: DataFrame, path: str, nul: bool = False) -> None:
    """A path a line, or each path before a NUL, which no path holds."""
    df.select("path").write.option("lineSep", "\0" if nul else "\n").text(path)


def json_lines(df: DataFrame) -> DataFrame:
    """A JSON object for each row; unknown values are nulls, not left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def snapshot(df: DataFrame, path: str) -> None:
    """A compact durable copy: written beside the old one, so a reader sees a whole version."""
    df.write.mode("error").option("compression", "zstd").parquet(path)
