"""Tables put together: formula joins over shared keys, and unions of positions and experiments."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.coerce import NAN, alike, col, key, number, or_nan
from cellweave.functions.formula import FUNCTIONS, FormulaError, parse
from cellweave.operators.relatives import ROW_ID

#: Columns by which tables are joined, as far as all of them have them.
INDEX_COLUMNS = ("experiment_folderpath", "experiment_foldername", "Position_n", "frame_i", "Cell_ID")


def safe_name(name: str) -> str:
    """A column's name as a formula may write it."""
    out = re.sub(r"\W", "_", name, flags=re.ASCII)
    return f"_{out}" if out[:1].isdigit() else out


def combine_metrics(tables: Sequence[DataFrame], formulas: dict[str, str], names: Sequence[str] | None = None) -> DataFrame:
    """One row per key of any table, with the value of each formula.

    A value is called ``table1_column`` or ``column_table1``. Of repeated keys a table's first row counts; a value that is
    missing is NaN, and so is a formula that cannot be read or names something else. Tables without a common key column
    are never matched: every row stands alone, under ``__row_index``, its table's number.
    """
    names = list(names or (f"table{i + 1}" for i in range(len(tables))))
    shared = [c for c in INDEX_COLUMNS if all(c in t.columns for t in tables)]
    aliases: dict[str, str] = {}
    parts = []
    for i, (t, n) in enumerate(zip(tables, names)):
        values = [c for c in t.columns if c not in shared and c != ROW_ID]
        own = {c: f"__{i}_{j}" for j, c in enumerate(values)}
        aliases |= {a: own[c] for c in values for a in (f"{n}_{safe_name(c)}", f"{safe_name(c)}_{n}")}
        columns = [or_nan(number(t, c)).alias(own[c]) for c in values]
        if shared:
            keys = [key(t, c).alias(f"__k{j}") for j, c in enumerate(shared)]
            first = Window.partitionBy(*(f"__k{j}" for j in range(len(shared)))).orderBy(ROW_ID)
            rows = t.select(*(col(c) for c in shared), *keys, *columns, ROW_ID).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", ROW_ID)
        else:
            rows = t.select(F.lit(i).cast("long").alias("__row_index"), *columns)
        parts.append(rows)
    if shared:
        on = [f"__k{j}" for j in range(len(shared))]

        def join(a: DataFrame, b: DataFrame) -> DataFrame:
            joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on], "full_outer")
            both = [F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")).alias(c) for c in (*shared, *on)]
            rest = [F.col(f"{s}.`{c}`") for s, t in (("a", a), ("b", b)) for c in t.columns if c not in shared and c not in on]
            return joined.select(*both, *rest)

        rows, keys = reduce(join, parts), shared
    else:
        rows, keys = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), ["__row_index"]

    def value(name: str) -> Column:
        if name not in aliases:
            raise FormulaError(f"no value is called {name!r}")
        return or_nan(F.col(aliases[name]))

    out = {}
    for result, formula in formulas.items():
        try:
            out[result] = or_nan(parse(formula, value, FUNCTIONS))
        except FormulaError:
            out[result] = F.lit(NAN)
    return rows.select(*map(col, keys), *(v.alias(k) for k, v in out.items()))


def concat_positions(tables: dict[str, DataFrame], experiment: str, path: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """All positions' rows under the names of their columns, with the position and experiment they come from.

    Cells that a position lacks are null. With ``columns`` the result has exactly those; provenance only if it is listed.
    """
    given = {"experiment_folderpath": path or experiment, "experiment_foldername": experiment}
    parts = [t.withColumns({c: F.lit(v) for c, v in given.items()} | {"Position_n": F.lit(n)}) for n, t in tables.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out if columns is None else out.select(*(col(c) if c in out.columns else F.lit(None).alias(c) for c in columns))


def _counted(digits: Column) -> Column:
    """Digits that sort by value, of any length: their number comes first."""
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def natural_key(name: str) -> Column:
    """A key under which names sort as people count: digits by value, however many."""
    parts = F.expr(rf"regexp_extract_all(lower(`{name}`), '([0-9]+|[^0-9]+)', 1)")
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), _counted(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p))
    return F.array_join(padded, "")


__all__ = ["INDEX_COLUMNS", "alike", "combine_metrics", "concat_positions", "natural_key"]
