"""Dependency manifests as rows: requirements files by columns, package.json by its maps, pyproject.toml by the standard parser."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"npm": r"(^|/)package\.json$", "pyproject": r"(^|/)pyproject\.toml$", "requirements": r"(?i)(^|/)requirements[\w.-]*\.(txt|in)$"}
#: Sections of package.json that name dependencies (fixed values).
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
NAME, SPEC = r"^([A-Za-z0-9][\w.-]*)", r"^[A-Za-z0-9][\w.-]*\s*(?:\[[^\]]*\])?\s*\(?\s*([^;)]*)"
ROW = "change_id string, side string, path string, n int, name string, spec string"


def kind(path: Column) -> Column:
    """npm, pyproject, requirements or null."""
    return F.coalesce(*[F.when(path.rlike(p), name) for name, p in KINDS.items()])


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def of_entries(rows: DataFrame) -> DataFrame:
    """change_id, side, path, n, entry (a requirement's line) to rows of ``dependencies``."""
    line = F.trim(F.regexp_replace("entry", r"(^|\s)#.*$", ""))
    plain = rows.where(~line.startswith("-") & (F.instr(line, "://") == 0) & ~line.startswith("git+"))
    spec = F.regexp_replace(F.trim(F.regexp_extract(line, SPEC, 1)), r"\s+", "")
    return plain.select("change_id", "side", "path", "n", normal_name(F.regexp_extract(line, NAME, 1)).alias("name"), spec.alias("spec")).where("name <> ''")


def toml_entries(text: str | None) -> Iterator[tuple[str | None, str]]:
    """(null, requirement) of the project and its groups, (name, spec) of a table of names. Broken texts have none."""
    try:
        data = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return
    table = lambda *path: _inner(data, path)
    lists = [table("project").get("dependencies"), *table("project", "optional-dependencies").values(), *table("dependency-groups").values()]
    for entries in lists:
        yield from ((None, e) for e in entries or [] if isinstance(e, str))
    for name, spec in table("tool", "poetry", "dependencies").items():
        if name.lower() != "python":
            yield name, spec if isinstance(spec, str) else str(spec.get("version", "")) if isinstance(spec, dict) else ""


def _inner(data: object, path: tuple[str, ...]) -> dict:
    for key in path:
        data = data.get(key) if isinstance(data, dict) else None
    return data if isinstance(data, dict) else {}


def dependencies(files: DataFrame) -> DataFrame:
    """change_id, side, path, text of manifests to change_id, side, path, name, spec; the last entry of a name counts.

    Names are normal (lower case, runs of ``-_.`` as one dash) but for package.json. Options, urls and comments of
    requirements aren't dependencies. Null and broken texts have none.
    """
    known = files.where("text is not null").withColumn("manifest", kind(F.col("path"))).where("manifest is not null")
    keep = ["change_id", "side", "path"]
    lines = known.where("manifest = 'requirements'").select(*keep, F.posexplode(F.split("text", "\r?\n")).alias("n", "entry"))
    sections = F.from_json("text", ", ".join(f"{s} map<string, string>" for s in SECTIONS))
    each = F.posexplode(F.array(*[F.coalesce(F.col("d")[s], F.create_map().cast("map<string, string>")) for s in SECTIONS])).alias("n", "m")
    npm = known.where("manifest = 'npm'").select(*keep, sections.alias("d")).select(*keep, each).select(*keep, "n", F.explode("m").alias("name", "spec"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, s, p, k, name, spec) for c, s, p, text in b.itertuples(index=False) for k, (name, spec) in enumerate(toml_entries(text))]
            yield pd.DataFrame(rows, columns=["change_id", "side", "path", "n", "name", "spec"])

    toml = known.where("manifest = 'pyproject'").select(*keep, "text").mapInPandas(parsed, ROW)
    listed = of_entries(toml.where("name is null").select(*keep, "n", F.col("spec").alias("entry")))
    tables = toml.where("name is not null").withColumn("name", normal_name(F.col("name")))
    every = of_entries(lines).unionByName(npm).unionByName(listed).unionByName(tables)
    return every.groupBy(*keep, "name").agg(F.max_by("spec", "n").alias("spec"))
