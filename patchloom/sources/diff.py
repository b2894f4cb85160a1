"""Unified diffs as a table of lines: one map over documents, strict about hunk counts, errors as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)")
COLUMNS = {
    "change_id": "string", "path": "string", "old_path": "string", "status": "string", "hunk": "int", "i": "int", "kind": "string", "content": "string", "old_line": "int", "new_line": "int", "no_newline": "boolean", "section": "string",
    "is_binary": "boolean", "old_mode": "string", "new_mode": "string", "similarity": "int", "format": "string", "subject": "string", "error": "string",
}
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
FIELDS = pa.schema([(c, ARROW[t]) for c, t in COLUMNS.items()])
SQL = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
MOST_LINES, MOST_FILES = 200_000, 500
#: Characters of patches, and lines, that are handed on at once (fixed values); a patch stays whole.
MOST_CHARS, MOST_ROWS = 1 << 21, 20_000


class DiffError(ValueError):
    pass


def checked(path: str) -> str:
    """The path if it stays inside the repository."""
    if not path or len(path) > 1024 or "\\" in path or path.startswith("/") or re.match(r"[A-Za-z]:", path) or ".." in path.split("/") or any(ord(c) < 32 for c in path):
        raise DiffError(f"unsafe path: {path[:80]!r}")
    return path


def unquoted(name: str) -> str:
    """A path as git writes it: in quotes with octal bytes if it needs them, else up to a tab."""
    name = name.rstrip("\n")
    if not name.startswith('"'):
        return name.split("\t")[0]
    raw = bytearray()
    plain = {"n": 10, "t": 9, "r": 13, '"': 34, "\\": 92, "a": 7, "b": 8, "f": 12, "v": 11}
    for m in re.finditer(r"\\([0-7]{3})|\\(.)|([^\\]+)", name[1 : name.rindex('"')]):
        raw += bytes([int(m[1], 8) & 255]) if m[1] else bytes([plain.get(m[2], 63)]) if m[2] else m[3].encode()
    return raw.decode("utf-8", "replace")


@dataclass
class Section:
    """One file of a patch while it is read."""

    old: str | None
    new: str | None
    git: bool
    renamed: str | None = None
    is_binary: bool = False
    old_mode: str | None = None
    new_mode: str | None = None
    similarity: int | None = None
    lines: list[tuple] = field(default_factory=list)

    @property
    def path(self) -> str:
        return self.new if self.new is not None else self.old or ""

    @property
    def status(self) -> str:
        if self.old is None or self.new is None:
            return "added" if self.old is None else "deleted"
        if self.renamed == "copied":
            return "copied"
        return "renamed" if self.git and self.old != self.new else "modified"


def header_paths(text: str) -> tuple[str | None, str | None, bool]:
    """Old and new path of what follows ``diff --git``, and whether they had a/ and b/; without quotes the two are alike."""
    parts = [unquoted(x) for x in re.findall(r'"(?:\\.|[^"\\])*"|\S+', text)] if '"' in text else []
    half = (len(text) - 1) // 2
    if not parts and text[half : half + 1] == " " and text[:half].partition("/")[2] == text[half + 1 :].partition("/")[2]:
        parts = [text[:half], text[half + 1 :]]
    if not parts and (m := re.fullmatch(r"(a/.*) (b/.*)", text)):
        parts = [m[1], m[2]]
    if len(parts) != 2:
        return None, None, True
    marked = parts[0].startswith("a/") and parts[1].startswith("b/")
    return *(x[2:] if marked else x for x in parts), marked


def side(name: str, prefix: str) -> str | None:
    name = unquoted(name)
    return None if name == "/dev/null" else name.removeprefix(prefix)


class Reader:
    """Reads a patch line by line into its sections."""

    def __init__(self, text: str):
        if "\0" in text:
            raise DiffError("binary input")
        self.body = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
        if len(self.body) > MOST_LINES:
            raise DiffError("too many lines")
        self.at = 0
        self.sections: list[Section] = []
        self.mail, self.subject = False, None
        while self.at < len(self.body):
            self.step()
        if not self.sections:
            raise DiffError("no file")
        self.close()

    def here(self, k: int = 0) -> str:
        return self.body[self.at + k] if self.at + k < len(self.body) else ""

    def add(self, section: Section) -> None:
        self.sections.append(section)
        if len(self.sections) > MOST_FILES:
            raise DiffError("too many files")

    def step(self) -> None:
        line = self.here()
        if line.startswith("diff --git "):
            self.git_section(line[len("diff --git ") :])
        elif line.startswith("--- ") and self.here(1).startswith("+++ "):
            self.add(Section(side(line[4:], ""), side(self.here(1)[4:], ""), False))
            self.at += 2
            self.hunks()
        elif line.startswith("@@ ") and not self.sections:
            raise DiffError(f"line {self.at + 1}: bad hunk header")
        else:
            self.mail |= re.match(r"From [0-9a-f]{7,40} ", line) is not None
            if line.startswith("Subject: ") and self.subject is None:
                self.subject = re.sub(r"^\[PATCH[^\]]*\]\s*", "", line[9:].strip())[:200] or None
            self.at += 1

    def git_section(self, header: str) -> None:
        old, new, marked = header_paths(header)
        s, start = Section(old, new, True), self.at + 1
        self.add(s)
        self.at += 1
        gone = made = False
        while self.at < len(self.body) and not self.here().startswith(("diff --git ", "@@ ", "--- ")):
            line = self.here()
            if m := re.fullmatch(r"(old|new|deleted file|new file) mode (\d+)", line):
                made, gone = made or m[1] == "new file", gone or m[1] == "deleted file"
                if m[1].startswith("new"):
                    s.new_mode = m[2]
                else:
                    s.old_mode = m[2]
            elif m := re.fullmatch(r"similarity index (\d+)%", line):
                s.similarity = int(m[1])
            elif m := re.fullmatch(r"(rename|copy) (from|to) (.*)", line):
                s.renamed = "copied" if m[1] == "copy" else "renamed"
                if m[2] == "from":
                    s.old = unquoted(m[3])
                else:
                    s.new = unquoted(m[3])
            elif line == "GIT binary patch":
                s.is_binary = True
                while self.at < len(self.body) and not self.here().startswith("diff --git "):
                    self.at += 1
                break
            elif line.startswith("Binary files ") and line.endswith(" differ"):
                s.is_binary = True
            elif not line.startswith(("index ", "dissimilarity index ")):
                break
            self.at += 1
        if self.here().startswith("--- "):
            if not self.here(1).startswith("+++ "):
                raise DiffError(f"line {self.at + 1}: no +++ line follows")
            s.old, s.new = side(self.here()[4:], "a/" if marked else ""), side(self.here(1)[4:], "b/" if marked else "")
            self.at += 2
            self.hunks()
        s.old, s.new = None if made else s.old, None if gone else s.new
        if s.old is None and s.new is None:
            raise DiffError(f"line {start}: neither an old nor a new path")

    def hunks(self) -> None:
        s, n = self.sections[-1], 0
        while self.here().startswith("@@"):
            n += 1
            self.hunk(s, n)
        if n and (self.here().startswith(("+", " ")) or (self.here().startswith("-") and self.here() != "-- " and not self.here().startswith("--- "))):
            raise DiffError(f"line {self.at + 1}: more lines than the hunk has")

    def hunk(self, s: Section, number: int) -> None:
        m = HUNK.fullmatch(self.here())
        if not m:
            raise DiffError(f"line {self.at + 1}: bad hunk header")
        left, right = int(m[2] or 1), int(m[4] or 1)
        o, n, i, section = int(m[1]), int(m[3]), 0, m[5].strip()
        self.at += 1
        while left or right or self.here().startswith("\\"):
            if self.at >= len(self.body):
                raise DiffError("hunk ends early")
            mark, content = self.here()[:1], self.here()[1:]
            self.at += 1
            if mark == "\\":  # speaks of the line before it
                if i:
                    s.lines[-1] = (*s.lines[-1][:6], True, section)
                continue
            if mark not in ("", " ", "+", "-"):
                raise DiffError(f"line {self.at}: not part of a hunk")
            kind = {"+": "add", "-": "del"}.get(mark, "context")
            left, right = left - (kind != "add"), right - (kind != "del")
            if left < 0 or right < 0:
                raise DiffError(f"line {self.at}: more lines than the hunk has")
            s.lines.append((number, i, kind, content, o if kind != "add" else None, n if kind != "del" else None, False, section))
            o, n, i = o + (kind != "add"), n + (kind != "del"), i + 1

    def close(self) -> None:
        """Paths as ``patch -p1`` reads them, if the sides of every file of a plain diff differ in their first part at most."""
        plain = not any(s.git for s in self.sections)
        tails = [{x.partition("/")[2] if x.partition("/")[0] not in ("", ".", "..") and "/" in x and not x.partition("/")[0].endswith(":") else None for x in (s.old, s.new) if x is not None} for s in self.sections]
        if plain and all(len(t) == 1 and None not in t for t in tails):
            for s in self.sections:
                s.old, s.new = (x and x.partition("/")[2] for x in (s.old, s.new))
        seen = set()
        for s in self.sections:
            for x in (s.old, s.new):
                if x is not None:
                    checked(x)
            if s.path in seen:
                raise DiffError(f"file twice: {s.path}")
            seen.add(s.path)

    def rows(self) -> Iterator[tuple]:
        """Values of COLUMNS but the first and last; a file without hunks is one row."""
        form = "format-patch" if self.mail else "git" if any(s.git for s in self.sections) else "unified"
        for s in self.sections:
            for line in s.lines or [(0, 0, None, None, None, None, None, None)]:
                yield (s.path, s.old, s.status, *line, s.is_binary, s.old_mode, s.new_mode, s.similarity, form, self.subject)


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FIELDS)], schema=FIELDS)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        size = 0
        for change, text in zip(b.column("change_id").to_pylist(), b.column("patch_text").to_pylist(), strict=True):
            try:
                out += [(change, *r, None) for r in Reader(text or "").rows()]
            except DiffError as e:
                out.append((change, *[None] * (len(COLUMNS) - 2), str(e)))
            size += len(text or "")
            if size >= MOST_CHARS or len(out) >= MOST_ROWS:
                yield arrow(out)
                out, size = [], 0
        if out:
            yield arrow(out)


def diff_lines(changes: DataFrame) -> DataFrame:
    """change_id, patch_text to diff lines. A patch that can't be read gives one row with its error and nothing else.
    Lines go on in pieces, so that a batch of patches isn't held as rows all at once."""
    return changes.select("change_id", "patch_text").mapInArrow(pieces, SQL)
