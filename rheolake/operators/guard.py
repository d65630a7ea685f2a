"""Grouped functions whose failures are rows: what one case breaks does not end the job for all.

Inside ``with guarded():`` a grouped kernel's result has a column more, ``note`` (error, seconds): null in the kernel's rows,
and set in one row more per group, whose other columns but case_id are null.  A group that raises has only that row.
Outside, nothing is added, and an exception ends the job as ever.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = "note struct<error:string,seconds:double>"
_ON: ContextVar[bool] = ContextVar("guarded", default=False)


@contextmanager
def guarded() -> Iterator[None]:
    token = _ON.set(True)
    try:
        yield
    finally:
        _ON.reset(token)


def is_guarded() -> bool:
    return _ON.get()


def with_note(out: pd.DataFrame | None, case: object, began: float, error: Exception | None, columns: list[str]) -> pd.DataFrame:
    text = None if error is None else f"{type(error).__name__}: {error}"
    last = pd.DataFrame({c: pd.Series([None], dtype=object) for c in columns})
    last.at[0, "case_id"] = case
    last["note"] = pd.Series([{"error": text, "seconds": time.time() - began}], dtype=object)
    if out is None or not len(out):
        return last
    # nulls among numbers: whole columns as objects keep integers what they are
    rows = out[columns].astype(object).assign(note=None)
    return pd.concat([rows, last], ignore_index=True)


def noted(run: Callable[..., pd.DataFrame], columns: list[str]) -> Callable[..., pd.DataFrame]:
    """run with its note; the case is that of the first frame that has rows."""

    def guarded_run(*args: object) -> pd.DataFrame:
        began = time.time()
        frames = [a for a in args if isinstance(a, pd.DataFrame) and len(a)]
        case = frames[0]["case_id"].iloc[0] if frames else None
        try:
            out, error = run(*args), None
        except Exception as raised:
            out, error = None, raised
        return with_note(out, case, began, error, columns)

    return guarded_run


def names_of(schema: object) -> list[str]:
    from pyspark.sql.types import StructType

    return (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names


def apply_groups(df: DataFrame, keys: list[str], run: Callable, schema: object, other: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """applyInPandas over the groups, or over those of df and other together; guarded where asked.

    keyed: run takes the key first.
    """
    groups = df.groupBy(*keys) if other is None else df.groupBy(*keys).cogroup(other.groupBy(*keys))
    if not is_guarded():
        return groups.applyInPandas(run, schema)
    safe = noted(run, names_of(schema))
    if other is not None:  # the number of arguments tells Spark whether the key is wanted
        shaped = (lambda key, a, b: safe(key, a, b)) if keyed else (lambda a, b: safe(a, b))
    else:
        shaped = (lambda key, a: safe(key, a)) if keyed else (lambda a: safe(a))
    return groups.applyInPandas(shaped, noted_schema(schema))


def noted_schema(schema: object):
    from pyspark.sql.types import StructField, StructType

    base = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    may_be_null = [StructField(f.name, f.dataType) for f in base.fields]  # as they are in a note's row
    return StructType([*may_be_null, *StructType.fromDDL(NOTE).fields])


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a guarded and written result, and its notes (case_id, error, seconds)."""
    notes = found.where("note IS NOT NULL").select("case_id", "note.error", "note.seconds")
    return found.where(F.col("note").isNull()).drop("note"), notes
