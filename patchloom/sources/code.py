"""The code index of all languages, and what resolves its imports: one map over files, then joins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import javascript_code, python_code

#: Suffixes of the languages (fixed values).
PYTHON = (".py", ".pyi")
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")


def language(path: Column) -> Column:
    """python, typescript, javascript or null, by a path's suffix."""
    low = F.lower(path)
    ends = lambda *suffixes: reduce(or_, [low.endswith(s) for s in suffixes])
    return F.when(ends(*PYTHON), "python").when(ends(".ts", ".tsx", ".mts", ".cts"), "typescript").when(ends(*SCRIPTS), "javascript")


def indexed(files: DataFrame, *parts: str, once: bool = False) -> DataFrame:
    """change_id, side, path, text to a row a file of a known language, as ``python_code.indexed`` gives it; of what is found
    only these parts if any are named. With ``once`` a file that a change leaves as it is may be one row of the side ``both``."""
    parser = lambda path: python_code.index if path.lower().endswith(PYTHON) else javascript_code.index
    return python_code.parsed(files.where(language(F.col("path")).isNotNull()), parser, *parts, once=once)


def of_head(index: DataFrame) -> DataFrame:
    """The rows of files that the head has."""
    return index.where("side in ('head', 'both')")
