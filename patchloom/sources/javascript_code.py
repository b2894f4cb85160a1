"""JavaScript and TypeScript files as the same rows as Python ones: tokens, a bracket tree, and declarations read from it.

A slash starts a regular expression where a value can't stand before it. Brackets are paired once; every declaration is
then a short look at the tokens around a keyword, and bodies are ranges between paired brackets.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff#@][\w$\u0080-\U0010ffff]*")
NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
BLANK = re.compile(r"\s+|//[^\n]*|/\*.*?\*/", re.S)
STRING = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.S)
PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
MARKS = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|\*\*|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
#: A slash after these words starts a pattern; they aren't called either, nor are the heads of statements.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await default extends".split())
NOT_CALLED = BEFORE_VALUE | frozenset("if for while switch catch function with import super constructor".split())
DECLARING = frozenset("const let var".split())
MODIFIERS = frozenset("static public private protected readonly abstract override declare async get set accessor".split())
BRANCHES = frozenset("if for while case catch && || ?? ?".split())
PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}"}
TEST_CALLS = frozenset(("it", "test", "describe", "it.only", "test.only", "it.skip", "test.skip"))


class Broken(ValueError):
    def __init__(self, message: str, line: int):
        super().__init__(message)
        self.line = line


class Token(NamedTuple):
    kind: str  # word, number, string, pattern, mark
    text: str
    line: int
    start: int


def tokens(text: str) -> list[Token]:
    """All tokens but blanks and comments. A template is a string token for each plain piece, with ${ and } around code."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out: list[Token] = []
    open_braces: list[str] = []
    at = 0

    def add(kind: str, end: int) -> int:
        out.append(Token(kind, text[at:end], bisect_right(starts, at), at))
        return end

    def piece(begin: int) -> tuple[int, bool]:
        """End of a template's plain piece from begin on, and whether code follows."""
        k = begin
        while k < len(text):
            if text[k] == "\\":
                k += 2
            elif text[k] == "`":
                return k + 1, False
            elif text.startswith("${", k):
                return k, True
            else:
                k += 1
        raise Broken("unterminated template", bisect_right(starts, begin))

    while at < len(text):
        if m := BLANK.match(text, at):
            at = m.end()
            continue
        c, code = text[at], False
        if c == "`" or (c == "}" and open_braces and open_braces[-1] == "${"):
            if c == "}":
                at = add("mark", at + 1)
                open_braces.pop()
                end, code = piece(at)
            else:
                end, code = piece(at + 1)
            at = add("string", end)
            if code:
                open_braces.append("${")
                at = add("mark", at + 2)
        elif c in "'\"":
            if not (m := STRING.match(text, at)):
                raise Broken("unterminated string", bisect_right(starts, at))
            at = add("string", m.end())
        elif c == "/" and value_may_follow(out) and (m := PATTERN.match(text, at)):
            at = add("pattern", m.end())
        elif (c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit())) and (m := NUMBER.match(text, at)):
            at = add("number", m.end())
        elif c not in "@" and (m := WORD.match(text, at)):
            at = add("word", m.end())
        elif m := MARKS.match(text, at):
            if c == "{":
                open_braces.append("{")
            elif c == "}" and open_braces:
                open_braces.pop()
            at = add("mark", m.end())
        else:
            raise Broken(f"unexpected character {c!r}", bisect_right(starts, at))
    return out


def value_may_follow(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    return last.text in BEFORE_VALUE if last.kind == "word" else last.kind == "mark" and last.text not in (")", "]", "}", "++", "--")


def paired(ts: list[Token]) -> dict[int, int]:
    """Every opening bracket's partner."""
    out, todo = {}, []
    for k, t in enumerate(ts):
        if t.kind != "mark":
            continue
        if t.text in PAIRS:
            todo.append(k)
        elif t.text in ")]}":
            if not todo or PAIRS[ts[todo[-1]].text] != t.text:
                raise Broken(f"unexpected {t.text!r}", t.line)
            out[todo.pop()] = k
    if todo:
        raise Broken(f"{ts[todo[-1]].text!r} is never closed", ts[todo[-1]].line)
    return out


class File:
    """One file's index while it is read."""

    def __init__(self, text: str):
        self.text = text
        self.ts = tokens(text)
        self.pair = paired(self.ts)
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.calls: list[dict] = []
        self.exported: set[str] = set()
        #: Token ranges of functions with their names, to name what encloses a call.
        self.ranges: list[tuple[int, int, str]] = []

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.ts) and self.ts[k].text in texts and self.ts[k].kind != "string"

    def word(self, k: int) -> str | None:
        return self.ts[k].text if 0 <= k < len(self.ts) and self.ts[k].kind == "word" else None

    def quoted(self, k: int) -> str | None:
        return self.ts[k].text[1:-1] if 0 <= k < len(self.ts) and self.ts[k].kind == "string" and self.ts[k].text[0] in "'\"`" else None

    def source(self, lo: int, hi: int) -> str:
        return " ".join(t.text for t in self.ts[lo:hi])

    def split(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges between the commas of lo to hi, brackets skipped, and angles too where they hold types."""
        out, begin, k, angle = [], lo, lo, 0
        while k < hi:
            if self.is_(k, *PAIRS) and k in self.pair:
                k = self.pair[k]
            elif self.is_(k, "<"):
                angle += 1
            elif self.is_(k, ">") and angle:
                angle -= 1
            elif self.is_(k, ",") and not angle:
                out.append((begin, k))
                begin = k + 1
            k += 1
        return [(a, z) for a, z in [*out, (begin, hi)] if a < z]

    def find(self, lo: int, hi: int, *texts: str) -> int | None:
        """First of these marks at the level of lo."""
        k = lo
        while k < hi:
            if self.is_(k, *texts):
                return k
            k = self.pair[k] + 1 if self.is_(k, *PAIRS) and k in self.pair else k + 1
        return None

    def params(self, opening: int) -> list[dict]:
        rows = []
        for a, z in self.split(opening + 1, self.pair[opening]):
            rest = self.is_(a, "...")
            a += rest
            while self.word(a) in MODIFIERS and self.word(a + 1):
                a += 1
            if self.is_(a, "this"):
                continue
            after = self.pair[a] + 1 if self.is_(a, *PAIRS) else a + 1
            optional = self.is_(after, "?")
            value = self.find(after, z, "=")
            kind = self.find(after, value if value is not None else z, ":")
            rows.append({
                "name": self.source(a, after), "kind": "var_positional" if rest else "positional", "has_default": optional or value is not None,
                "default": self.source(value + 1, z) if value is not None else None, "annotation": self.source(kind + 1, value if value is not None else z) if kind is not None else None,
            })
        return rows

    def add(self, name: str, kind: str, above: list[str], lo: int, hi: int, params: list[dict] | None = None, returns: str | None = None, is_async: bool | None = None, exported: bool = False) -> None:
        inner = self.ts[lo:hi]
        marks = [t.text for t in inner if t.kind != "string"]
        called = [t.text for t, n in zip(inner, inner[1:], strict=False) if t.kind == "word" and n.text == "("]
        self.symbols.append({
            "ord": len(self.symbols), "name": name, "qualname": ".".join([*above, name]), "kind": kind, "start_line": self.ts[lo].line, "end_line": self.ts[max(lo, hi - 1)].line, "params": params, "returns": returns, "is_async": is_async,
            "parent": ".".join(above) or None, "exported": exported or (bool(above) and not name.startswith(("#", "_"))), "decorators": [], "complexity": 1 + sum(t in BRANCHES for t in marks), "body": self.source(lo, hi),
            "try_blocks": marks.count("try"), "assertions": sum(c.startswith(("expect", "assert")) for c in called),
        })

    def function(self, lo: int, name: str, opening: int, above: list[str], kind: str, exported: bool) -> int:
        """A function whose parameters open at ``opening``; returns the place behind its body."""
        is_async = any(self.is_(k, "async") for k in range(max(0, lo - 1), opening))
        close = self.pair[opening]
        body = self.find(close + 1, len(self.ts), "{", "=>", ";")
        # a return type may be an object type of its own, before the body or the arrow
        if body is not None and self.is_(body, "{") and self.is_(close + 1, ":") and body == close + 2:
            body = self.find(self.pair[body] + 1, len(self.ts), "{", "=>", ";")
        returns = self.source(close + 2, body) if body is not None and self.is_(close + 1, ":") else None
        if body is not None and self.is_(body, "=>"):
            body += 1
            end = self.pair[body] + 1 if self.is_(body, "{") else (self.find(body, len(self.ts), ";", ",", ")", "]", "}") or len(self.ts))
        elif body is not None and self.is_(body, "{"):
            end = self.pair[body] + 1
        else:  # an overload or abstract method
            end = body if body is not None else len(self.ts)
        self.add(name, kind, above, lo, end, self.params(opening), returns, is_async, exported)
        self.ranges.append((lo, end, ".".join([*above, name])))
        if body is not None and self.is_(body, "{"):
            self.statements(body + 1, self.pair[body], [*above, name], False)
        return end

    def value(self, k: int) -> int | None:
        """Where the parameters of a function value open that starts at k, or null: function (…), async (…) =>, x => …"""
        k += self.is_(k, "async")
        if self.is_(k, "function"):
            return self.find(k, len(self.ts), "(")
        if self.is_(k, "<"):
            k = self.find(k, len(self.ts), "(") or k
        if self.is_(k, "("):
            close = self.pair[k]
            arrow = self.find(close + 1, len(self.ts), "=>", ";", "{", ",", "=") if self.is_(close + 1, ":") else close + 1
            return k if arrow is not None and self.is_(arrow, "=>") else None
        return None

    def importing(self, k: int) -> int:
        """An import statement, or a re-export with its from."""
        line, end = self.ts[k].line, self.find(k, len(self.ts), ";")
        source = next((j for j in range(k + 1, min(len(self.ts), k + 400)) if self.quoted(j) is not None and (self.is_(j - 1, "from") or j == k + 1)), None)
        if source is None or (end is not None and end < source):
            return k + 1
        module = self.quoted(source)
        row = lambda imported, local, kind: self.imports.append({"line": line, "module": module, "imported_name": imported, "local_name": local, "kind": kind, "level": 0})
        if source == k + 1:
            row(None, "", "module")
        j = k + 1 + (self.is_(k + 1, "type") and not self.is_(k + 2, "from", ","))
        while j < source:
            if self.is_(j, "*"):
                local = self.word(j + 2) if self.is_(j + 1, "as") else ""
                row(None, local or "", "namespace" if local else "wildcard")
                j += 3 if local else 1
            elif self.is_(j, "{"):
                for a, z in self.split(j + 1, self.pair[j]):
                    a += self.is_(a, "type") and z - a > 1
                    row(self.word(a) or self.quoted(a), self.word(z - 1) or "", "name")
                j = self.pair[j] + 1
            else:
                if (name := self.word(j)) and name != "from":
                    row("default", name, "default")
                j += 1
        return source + 1

    def required(self, lo: int, hi: int, equals: int) -> bool:
        """const … = require("…"), by name or by its parts."""
        if not (self.is_(equals + 1, "require") and self.is_(equals + 2, "(") and self.quoted(equals + 3) is not None):
            return False
        names = [(None, self.word(lo), "namespace")] if self.word(lo) else [(self.word(a), self.word(z - 1), "name") for a, z in self.split(lo + 1, self.pair[lo])] if self.is_(lo, "{") else []
        self.imports += [{"line": self.ts[lo].line, "module": self.quoted(equals + 3), "imported_name": i, "local_name": local or "", "kind": kind, "level": 0} for i, local, kind in names]
        return True

    def variables(self, k: int, above: list[str], exported: bool) -> int:
        end = self.find(k + 1, len(self.ts), ";", *DECLARING, "export", "import", "class", "function") or len(self.ts)
        done = k + 1
        for a, z in self.split(k + 1, end):
            equals = self.find(a, z, "=")
            if equals is None:
                equals = z
            opening = self.value(equals + 1) if equals < z else None
            name = self.word(a)
            if equals < z and self.required(a, z, equals):
                done = max(done, equals + 4)
            elif name and opening is not None:
                done = max(done, self.function(a, name, opening, above, "function", exported))
            elif name and equals < z and self.word(equals + 1) and self.is_(equals + 2, "=>"):
                stop = self.pair[equals + 3] + 1 if self.is_(equals + 3, "{") else z
                one = [{"name": self.word(equals + 1), "kind": "positional", "has_default": False, "default": None, "annotation": None}]
                self.add(name, "function", above, a, stop, one, None, False, exported)
                self.ranges.append((a, stop, ".".join([*above, name])))
            elif name and not above:
                self.add(name, "variable", above, a, min(z, equals + 2), exported=exported)
        return done

    def members(self, lo: int, hi: int, above: list[str]) -> None:
        k = lo
        while k < hi:
            begin = k
            while self.is_(k, "@"):  # a decorator with its arguments
                k = k + 2 if not self.is_(k + 2, "(") else self.pair[k + 2] + 1
            while self.word(k) in MODIFIERS and not self.is_(k + 1, "(", "=", ";", ":"):
                k += 1
            k += self.is_(k, "*")
            name = self.word(k) or self.quoted(k)
            opening = k + 1 + self.is_(k + 1, "?", "!")
            if name and self.is_(opening, "<"):
                opening = self.find(opening, hi, "(") or opening
            if name and self.is_(opening, "("):
                k = self.function(begin, name, opening, above, "method", False)
            elif name and (equals := self.find(k + 1, hi, "=", ";", "}")) is not None and self.is_(equals, "=") and (opening := self.value(equals + 1)) is not None:
                k = self.function(begin, name, opening, above, "method", False)
            else:
                k = (self.find(k, hi, ";") or hi) if name else k
                k += 1

    def statements(self, lo: int, hi: int, above: list[str], top: bool) -> None:
        k = lo
        while k < hi:
            exported = self.is_(k, "export") and top
            if exported:
                k += 1
                if self.is_(k, "default"):
                    self.exported.add("default")
                    k += 1
                    if (name := self.word(k)) and name not in ("function", "class", "async", "abstract"):
                        self.exported.add(name)
                elif self.is_(k, "{", "*") or (self.is_(k, "type") and self.is_(k + 1, "{", "*")):
                    opening = self.find(k, hi, "{")
                    if opening is not None and self.is_(self.pair[opening] + 1, "from") or self.is_(k, "*"):
                        k = self.importing(k - 1)
                    elif opening is not None:
                        self.exported |= {self.word(a) or "" for a, _ in self.split(opening + 1, self.pair[opening])}
                        k = self.pair[opening] + 1
                    continue
            word = self.word(k)
            if word in ("abstract", "declare") and self.word(k + 1):
                k, word = k + 1, self.word(k + 1)
            if word == "async" and self.is_(k + 1, "function"):
                k, word = k + 1, "function"
            if word == "import" and top and not self.is_(k + 1, "(", "."):
                k = self.importing(k)
            elif word == "function" and (opening := self.find(k, hi, "(")) is not None:
                named = k + 1 + self.is_(k + 1, "*")
                k = self.function(k, (self.word(named) if named < opening else None) or "default", opening, above, "function", exported)
            elif word == "class" and self.word(k + 1) and (body := self.find(k, hi, "{")) is not None:
                name = self.word(k + 1) or ""
                self.add(name, "class", above, k, self.pair[body] + 1, exported=exported)
                self.members(body + 1, self.pair[body], [*above, name])
                k = self.pair[body] + 1
            elif word in ("interface", "enum", "type") and self.word(k + 1) and top:
                end = self.find(k, hi, ";") if word == "type" else self.find(k, hi, "{")
                end = hi if end is None else self.pair[end] + 1 if self.is_(end, "{") else end
                self.add(self.word(k + 1) or "", "type", above, k, end, exported=exported)
                k = end
            elif word in DECLARING:
                k = self.variables(k, above, exported)
            elif word in ("module", "exports") and top and self.is_(k + 1, "."):
                k = self.assigned(k)
            elif word in ("it", "test", "describe") and self.tested(k, hi, above):
                k = self.pair[self.find(k, hi, "(")] + 1
            elif self.is_(k, *PAIRS) and k in self.pair:
                if self.is_(k, "{"):
                    self.statements(k + 1, self.pair[k], above, False)
                k = self.pair[k] + 1
            else:
                k += 1

    def assigned(self, k: int) -> int:
        """module.exports = {a, b}, module.exports = a, exports.a = …, module.exports.a = …"""
        j = k + 2 if self.is_(k, "exports") else k + 4 if self.is_(k + 3, ".") else k + 3
        if self.is_(k, "exports") or self.is_(k + 3, "."):
            self.exported.add(self.word(j) or "")
        elif self.is_(j, "=") and self.is_(j + 1, "{"):
            self.exported |= {self.word(a) or "" for a, _ in self.split(j + 2, self.pair[j + 1])}
        elif self.is_(j, "=") and self.word(j + 1):
            self.exported |= {"default", self.word(j + 1) or ""}
        return j + 1

    def tested(self, k: int, hi: int, above: list[str]) -> bool:
        """it("name", …) and its kin are symbols under their names; what describe holds is read on."""
        opening = self.find(k, min(hi, k + 4), "(")
        if opening is None or self.source(k, opening).replace(" ", "") not in TEST_CALLS or (name := self.quoted(opening + 1)) is None:
            return False
        close = self.pair[opening]
        if self.is_(k, "describe"):
            body = next((j for j in range(opening, close) if self.is_(j, "{")), None)
            if body is not None:
                self.statements(body + 1, self.pair[body], [*above, name], False)
            return True
        self.add(name, "test", above, k, close + 1)
        self.ranges.append((k, close + 1, ".".join([*above, name])))
        return True

    def all_calls(self) -> None:
        inner = sorted(self.ranges, key=lambda r: (r[0], -r[1]))
        open_, r = [], 0
        for k, t in enumerate(self.ts):
            while r < len(inner) and inner[r][0] <= k:
                open_.append(inner[r])
                r += 1
            while open_ and open_[-1][1] <= k:
                open_.pop()
            if t.kind != "word" or t.text in NOT_CALLED or self.is_(k - 1, "function", "class", "interface"):
                continue
            opening = k + 1 + self.is_(k + 1, "?.")
            if self.is_(opening, "<"):  # type arguments, if they are closed right before the parenthesis
                close = self.find(opening, min(len(self.ts), opening + 40), ">")
                opening = close + 1 if close is not None else opening
            if self.is_(opening, "(") and t.text == "async" and self.is_(self.pair[opening] + 1, "=>", ":"):
                continue
            if not self.is_(opening, "(") or (open_ and open_[-1][2].endswith(t.text) and any(a <= k < a + 4 and n.endswith(t.text) and self.declared(k, a) for a, _, n in open_)):
                continue
            first, names = k, [t.text]
            while self.is_(first - 1, ".", "?.") and self.word(first - 2):
                first -= 2
                names.insert(0, self.word(first) or "")
            whole = not self.is_(first - 1, ".", "?.")
            args = self.split(opening + 1, self.pair[opening])
            self.calls.append({
                "line": t.line, "end_line": self.ts[self.pair[opening]].line, "callee": ".".join(names), "name": t.text, "receiver": ".".join(names[:-1]) or (None if whole else "?"), "positional": sum(not self.is_(a, "...") for a, _ in args),
                "keywords": [], "star_args": any(self.is_(a, "...") for a, _ in args), "star_kwargs": False, "awaited": self.is_(first - 1, "await"), "enclosing": open_[-1][2] if open_ else None, "first": self.first(args),
            })

    def first(self, args: list[tuple[int, int]]) -> str | None:
        """text for a plain string, built for one that is put together, other, or null without arguments."""
        if not args:
            return None
        a, z = args[0]
        kinds = {self.ts[k].kind for k in range(a, z)}
        if kinds == {"string"} and z - a == 1:
            return "text"
        return "built" if "string" in kinds and any(self.is_(k, "+", "${") for k in range(a, z)) else "other"

    def declared(self, k: int, begin: int) -> bool:
        """Whether the name at k is that of a method, not a call: only modifiers stand between its start and it."""
        return all(self.word(j) in MODIFIERS or self.is_(j, "*") for j in range(begin, k))


def index(text: str) -> dict:
    """A file's symbols, imports, calls and identifiers; a file whose tokens or brackets are broken has its error alone."""
    out: dict = {"error": None, "error_line": None, "symbols": [], "imports": [], "calls": [], "identifiers": []}
    try:
        f = File(text)
        f.statements(0, len(f.ts), [], True)
        f.all_calls()
    except Broken as e:
        return out | {"error": str(e), "error_line": e.line}
    except RecursionError:
        return out | {"error": "nested too deeply"}
    for s in f.symbols:
        s["exported"] = s["exported"] or (s["parent"] is None and s["name"] in f.exported)
    words = [{"name": t.text, "line": t.line} for t in f.ts if t.kind == "word" and t.text not in NOT_CALLED and t.text not in DECLARING]
    return out | {"symbols": f.symbols, "imports": f.imports, "calls": f.calls, "identifiers": words}
