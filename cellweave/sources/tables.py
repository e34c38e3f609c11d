"""Object tables from and to files. CSV cells are typed by rule; xlsx needs an optional library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.coerce import NUMERIC, col, lossy, text_number
from cellweave.operators.relatives import ROW_ID

EXTENSIONS = {"csv": "csv", "parquet": "parquet", "orc": "orc", "xlsx": "xlsx", "xlsm": "xlsx", "xls": "xlsx"}


def _is_number(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(NUMERIC)


def typed(df: DataFrame) -> DataFrame:
    """All-text columns as booleans or doubles where every cell that is not empty reads as one; others stay text, empty cells null.

    One pass decides for all columns.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    cell = {c: F.nullif(F.trim(col(c)), F.lit("")) for c in texts}
    is_bool = {c: F.coalesce(F.lower(cell[c]).isin("true", "false"), F.lit(True)) for c in texts}
    checks = [F.bool_and(is_bool[c]).alias(f"b{i}") for i, c in enumerate(texts)] + [F.bool_and(F.coalesce(_is_number(cell[c]), F.lit(True))).alias(f"n{i}") for i, c in enumerate(texts)]
    checks += [F.count(cell[c]).alias(f"c{i}") for i, c in enumerate(texts)]
    found = df.agg(*checks).first() if texts else None
    out = {}
    for i, c in enumerate(texts):
        empty = not found[f"c{i}"]
        out[c] = cell[c] if empty else F.lower(cell[c]) == "true" if found[f"b{i}"] else text_number(cell[c]) if found[f"n{i}"] else cell[c]
    return df.withColumns(out)


def read_csv(spark: SparkSession, path: str | list[str], infer: bool = True) -> DataFrame:
    """A CSV table with a header, cells trimmed; short rows end in nulls, fields beyond the header go. Row order is in ``_row_id``."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False, multiLine=True, escape='"')
    raw = raw.withColumn(ROW_ID, F.monotonically_increasing_id())
    return typed(raw) if infer else raw


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, its first row the header; needs openpyxl. A workbook is read on the driver."""
    import openpyxl

    rows = list(openpyxl.load_workbook(path, read_only=True, data_only=True).worksheets[0].values)
    names = [str(x) for x in rows[0]]
    shape = ", ".join(f"`{n}` string" for n in names)
    texts = [tuple(None if v is None else str(v) for v in (*r, *([None] * len(names)))[: len(names)]) for r in rows[1:]]
    return typed(spark.createDataFrame(texts, shape).withColumn(ROW_ID, F.monotonically_increasing_id()))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's extension."""
    kind = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no table format for {path!r}")
    if kind == "csv":
        return read_csv(spark, path)
    return read_xlsx(spark, path) if kind == "xlsx" else spark.read.format(kind).load(path)


def as_text(df: DataFrame, missing: str = "") -> DataFrame:
    """Every cell as it is written: whole numbers without a fraction, NaN as NaN, missing cells as given."""
    shown = {c: F.when(col(c).isNull(), F.lit(missing)).otherwise(lossy(df, c)) for c in df.columns if c != ROW_ID}
    return df.select(*(v.alias(c) for c, v in shown.items()))


def write_csv(df: DataFrame, path: str, overwrite: bool = False, missing: str = "", one_file: bool = False) -> None:
    """A folder of CSV files with headers; refuses to replace one unless told to. Rows keep their order within a file."""
    ordered = df.sortWithinPartitions(ROW_ID) if ROW_ID in df.columns else df
    out = as_text(ordered.coalesce(1) if one_file else ordered, missing)
    out.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, emptyValue="", quote='"', escape='"')
