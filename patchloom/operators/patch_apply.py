"""Apply a file's hunks to its base text: one fold a file, tolerant of drifted line numbers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far from its stated place a hunk is looked for, in lines (fixed value).
REACH = 300
#: Files whose lines are held at once (fixed value).
FILES = 32


def place(lines: list[str], block: list[str], want: int, least: int) -> int | None:
    """Where a block stands: at the wanted place, else the nearest within reach (earlier first), never before least."""
    fits = lambda at: least <= at <= len(lines) - len(block) and lines[at : at + len(block)] == block
    return next((at for d in range(REACH + 1) for at in (want - d, want + d) if fits(at)), None)


def applied(text: str, hunks: list[tuple[int, list[tuple[str, str, bool]]]]) -> tuple[str | None, str | None]:
    """(head text, error). Hunks are (old start, [(kind, content, no_newline)]) in order; each one's drift moves those after it."""
    lines = text.split("\n")
    out: list[str] = []
    at = drift = 0
    for start, body in hunks:
        block = [c for k, c, _ in body if k != "add"]
        # an insertion without context names the line it follows
        want = (start - 1 if block else start) + drift
        found = place(lines, block, want, at)
        if found is None:
            return None, f"hunk at line {start} doesn't fit"
        drift += found - want
        out += lines[at:found] + [c for k, c, _ in body if k != "del"]
        at = found + len(block)
        # a last line without its end on one side only: the empty piece behind the last line end comes or goes
        old_open, new_open = any(m for k, _, m in body if k != "add"), any(m for k, _, m in body if k != "del")
        if new_open and not old_open and lines[at:] == [""]:
            at += 1
        elif old_open and not new_open and at == len(lines):
            lines.append("")
    return "\n".join(out + lines[at:]), None


def head_files(base: DataFrame, diff: DataFrame) -> DataFrame:
    """base (change_id, path, text) and diff lines to change_id, path, text, error of the files that the patch touches.

    Added texts end with a line end. Deleted files have neither text nor error; a modified file that base lacks has an
    error. Files with hunks that don't fit have an error and no text. A file's hunks are gathered into one row and joined
    to its text, so its size bounds the memory, and files that the patch leaves alone don't go to Python.
    """
    good = diff.where("error is null and path is not null")
    lines = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("hunk", "i", "kind", "content", "old_line", "new_line", (F.col("no_newline") if "no_newline" in diff.columns else F.lit(False)).alias("no_newline")))))
    touched = good.groupBy("change_id", "path", F.coalesce("old_path", "path").alias("old_path")).agg(F.max("status").alias("status"), lines.alias("lines"))
    both = touched.join(base.select("change_id", F.col("path").alias("old_path"), "text", F.lit(True).alias("there")).hint("merge"), ["change_id", "old_path"], "left")

    schema = pa.schema([(c, pa.string()) for c in ("change_id", "path", "text", "error")])

    def head(r: dict) -> tuple[str | None, str | None]:
        if r["status"] == "deleted":
            return None, None
        if r["status"] != "added" and not r["there"]:
            return None, "no base text"
        return applied("" if r["status"] == "added" else r["text"] or "", gathered(r["lines"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few files at once: their lines as Python objects take many times their texts
        for b in (whole.slice(k, FILES) for whole in batches for k in range(0, whole.num_rows, FILES)):
            rows = [(r["change_id"], r["path"], *head(r)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], schema=schema)

    return both.select("change_id", "path", "status", "lines", "text", "there").mapInArrow(run, "change_id string, path string, text string, error string")


def gathered(lines: list) -> list[tuple[int, list[tuple[str, str, bool]]]]:
    """A file's hunks as (old start, [(kind, content, no_newline)]), from its lines in order."""
    hunks, net = [], 0
    for _, part in groupby(lines, key=lambda x: x["hunk"]):
        h = list(part)
        old = [x["old_line"] for x in h if x["old_line"] is not None]
        # without old lines, the place follows from the new one and what the hunks before have added
        hunks.append((min(old) if old else min(x["new_line"] for x in h) - 1 - net, [(x["kind"], x["content"], bool(x["no_newline"])) for x in h]))
        net += sum((x["kind"] == "add") - (x["kind"] == "del") for x in h)
    return hunks
