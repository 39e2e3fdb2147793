"""Declarations of TypeScript and JavaScript text: top-level statements and the members of top-level classes.

Statements are found on the token stream: brackets are matched first, types and expressions are skipped by their
shape, and line ends close a statement where the next token can't go on with it.  Namespaces, nested functions,
require() and import() are not visited.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from tessera.parsers import Parsed, Symbol, one_line, useful
from tessera.parsers.script_lexer import Lexer, Token

# fixed values: handler names and the files in which they are routes
VERBS = {"GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"}
ROUTE_FILE = re.compile(r"(^|/)(route|\+server|\+page\.server|api)\.[mc]?[jt]sx?$")

_PAIRS = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = {"export", "default", "declare", "async", "abstract"}
_MEMBER_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "async", "declare", "accessor", "get", "set", "export"}
_GOES_ON = {".", "?.", "(", "[", ",", "=", "=>", "?", ":", "&&", "||", "??", "|", "&", "^", "+", "-", "*", "/", "%", "**", "<", ">", "<=", "==", "!=", "===", "!==", "<<", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "&&=", "||=", "??=", "instanceof", "in"}
_WANTS_MORE = (_GOES_ON - {"in"}) | {"!", "~", "...", "new", "typeof", "void", "delete", "await", "in", "of", "as", "satisfies", "extends", "keyof", "readonly", "infer", "is", "unique"}
_TYPE_PREFIX = {"keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract", "|", "&"}
_BLOCKS = {"if", "for", "while", "do", "try", "switch", "namespace", "module", "global", "with", "{"}


class _Reader:
    def __init__(self, path: str, text: str) -> None:
        self.path, self.text = path, text
        lexer = Lexer(text, jsx=bool(re.search(r"\.(?:[tj]sx|[mc]?js)$", path)))
        self.t, self.comments = lexer.tokens, lexer.comments
        self.comment_ends = [e for _, e in self.comments]
        self.line_starts = [0, *(m.end() for m in re.finditer("\r\n|[\n\r\u2028\u2029]", text))]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, tok in enumerate(self.t):
            if tok.kind != "punct":
                continue
            if tok.text in _PAIRS:
                stack.append(i)
            elif tok.text in ")]}":
                while stack and _PAIRS[self.t[stack[-1]].text] != tok.text:
                    self.match[stack.pop()] = i
                if stack:
                    self.match[stack.pop()] = i
        for i in stack:
            self.match[i] = len(self.t) - 1
        self.starts = [tok.start for tok in self.t]
        self.out = Parsed()
        self.later: set[str] = set()

    # --- tokens

    def at(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].kind in ("name", "punct") and self.t[i].text in texts

    def kind(self, i: int) -> str:
        return self.t[i].kind if i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return self.kind(i) == "name" and not self.t[i].text.startswith("#")

    def past(self, i: int) -> int:
        """After the bracket that i opens."""
        return self.match.get(i, i) + 1

    def new_line(self, i: int) -> bool:
        return i < len(self.t) and i > 0 and bool(re.search("[\n\r\u2028\u2029]", self.text[self.t[i - 1].end : self.t[i].start]))

    def line(self, place: int) -> int:
        return bisect_right(self.line_starts, place)

    # --- shapes

    def angles(self, i: int) -> int:
        """After the type parameters or arguments that start with < at i."""
        depth = 0
        while i < len(self.t):
            if self.at(i, "<"):
                depth += 1
            elif self.at(i, "<<"):
                depth += 2
            elif self.at(i, ">"):
                depth -= 1
                if depth <= 0:
                    return i + 1
            elif self.at(i, "(", "[", "{"):
                i = self.match.get(i, i)
            i += 1
        return i

    def type(self, i: int) -> int:
        """After the type that starts at i."""
        while True:
            while self.at(i, *_TYPE_PREFIX) and not (self.at(i, "asserts", "infer", "readonly", "unique", "keyof", "abstract") and self.at(i + 1, ",", ")", ";", "=", "{", "}", "=>", "|", "&")):
                i += 1
            if self.at(i, "<"):
                i = self.angles(i)
            if self.at(i, "("):
                i = self.past(i)
                if self.at(i, "=>"):
                    return self.type(i + 1)
            elif self.at(i, "[", "{"):
                i = self.past(i)
            elif self.at(i, "-") or self.kind(i) in ("name", "string", "number", "template", "regex"):
                i += 2 if self.at(i, "-") else 1
            elif i < len(self.t) and self.t[i].kind == "punct":
                return i
            while i < len(self.t):
                if self.at(i, ".") or (self.at(i, "is") and not self.new_line(i)):
                    i += 2 if self.at(i, ".") else 0
                    if self.at(i, "is"):
                        return self.type(i + 1)
                elif self.at(i, "<"):
                    i = self.angles(i)
                elif self.at(i, "[") and not self.new_line(i):
                    i = self.past(i)
                elif self.at(i, "(") and self.at(i - 1, "import"):
                    i = self.past(i)
                else:
                    break
            if self.at(i, "extends"):
                i = self.type(i + 1)
                if self.at(i, "?"):
                    i = self.type(i + 1)
                    if self.at(i, ":"):
                        i = self.type(i + 1)
            if not self.at(i, "|", "&"):
                return i

    def expression(self, i: int, stop: tuple[str, ...] = (";",)) -> int:
        """The token that ends the expression which starts at i: a stop, a closing bracket, or the first on a new line."""
        first = i
        while i < len(self.t):
            if self.at(i, *stop) or self.at(i, ")", "]", "}"):
                return i
            if i > first and self.new_line(i) and not self.at(i, *_GOES_ON) and self.kind(i) != "template" and not self.at(i - 1, *_WANTS_MORE):
                return i
            i = self.past(i) if self.at(i, "(", "[", "{") else i + 1
        return i

    def callable(self, i: int) -> tuple[int, int] | None:
        """Of an arrow function or function expression at i: the token before its body, and the token after it."""
        if self.at(i, "async") and not self.new_line(i + 1):
            i += 1
        if self.at(i, "function"):
            while i < len(self.t) and not self.at(i, "(", "<"):
                i += 1
            head, body = self.signature(i)
            if body is None:
                return None
            after = self.past(body)
            goes_on = self.at(after, "(", ".", "?.", "[", "as", "satisfies", "||", "&&", "??", "?") or self.kind(after) == "template"
            return None if goes_on else (head, after)
        if self.at(i, "<"):
            i = self.angles(i)
        if self.at(i, "("):
            i = self.past(i)
            if self.at(i, ":"):
                i = self.type(i + 1)
        elif self.is_name(i):
            i += 1
        else:
            return None
        if not self.at(i, "=>"):
            return None
        return i, self.past(i + 1) if self.at(i + 1, "{") else self.expression(i + 1, (";", ","))

    def signature(self, i: int) -> tuple[int, int | None]:
        """From type parameters or ( on: the last token before the body, and the body's brace if there is one."""
        if self.at(i, "<"):
            i = self.angles(i)
        if self.at(i, "("):
            i = self.past(i)
        if self.at(i, ":"):
            i = self.type(i + 1)
        return i - 1, i if self.at(i, "{") else None

    # --- what a symbol carries

    def doc(self, first: int) -> str | None:
        start = self.t[first].start
        before = self.t[first - 1].end if first else 0
        i = bisect_left(self.comment_ends, before)
        mine = [(a, b) for a, b in self.comments[i:] if a >= before and b <= start] if i < len(self.comments) and self.comments[i][0] < start else []
        if first:  # comments on the line of the token before belong to that
            mine = [c for c in mine if re.search("[\n\r]", self.text[before : c[0]])]
        for a, b in reversed(mine):
            raw = self.text[a:b]
            if raw.startswith("/**"):
                for entry in re.sub(r"\*+/$", "", re.sub(r"^/\*\*+", "", raw)).split("\n"):
                    said = re.sub(r"^\s*\*?\s?", "", entry).strip()
                    if said and said[0] != "@":
                        return one_line(said, 160)
        return None

    def strings(self, first: int, stop: int) -> list[str] | None:
        found: dict[str, None] = {}
        for tok in self.t[first:stop]:
            if tok.kind in ("string", "template", "jsx_text"):
                value = " ".join(tok.value.split()) if tok.kind == "jsx_text" else tok.value
                if useful(value):
                    found[value] = None
            if len(found) == 10:
                break
        return list(found) or None

    def callable_kind(self, name: str, first: int, stop: int) -> str:
        if name in VERBS and ROUTE_FILE.search(self.path):
            return "route"
        if re.match("use[A-Z]", name):
            return "hook"
        if re.match("[A-Z]", name) and any(tok.kind == "jsx" for tok in self.t[first:stop]):
            return "component"
        return "function"

    def add(self, name: str, kind: str, first: int, stop: int, exported: bool, head: int | None = None, parent: str | None = None) -> None:
        """A symbol of the tokens first..stop; its signature ends with token `head`, or with its first line."""
        start, end = self.t[first].start, self.t[stop - 1].end
        said = self.text[start : self.t[head].end] if head is not None else self.text[start:end].split("\n")[0]
        self.out.symbols.append(Symbol(name, kind, self.line(start), self.line(end), exported, one_line(said), self.doc(first), parent, self.strings(first, stop)))

    # --- statements

    def run(self) -> Parsed:
        i = 0
        while i < len(self.t):
            i = max(i + 1, self.statement(i))
        for s in self.out.symbols:
            s.exported = s.exported or s.name in self.later
        return self.out

    def decorators(self, i: int) -> int:
        while self.at(i, "@"):
            i += 1
            if self.at(i, "("):
                i = self.past(i)
            else:
                i += 1
                while self.at(i, "."):
                    i += 2
            if self.at(i, "("):
                i = self.past(i)
        return i

    def closing(self, i: int) -> int:
        return i + 1 if self.at(i, ";") else i

    def statement(self, first: int) -> int:
        i, seen = self.decorators(first), set()
        while self.at(i, *_MODIFIERS) and not (self.at(i, "declare", "async", "abstract") and (self.new_line(i + 1) or self.kind(i + 1) != "name")):
            seen.add(self.t[i].text)
            i = self.decorators(i + 1)
            if "default" in seen and self.at(i - 1, "default") and not self.at(i, "function", "class", "abstract", "interface", "async"):
                break
        exported = "export" in seen
        if exported and i == first + 1 or self.at(first, "import"):
            if (end := self.module_clause(first, i)) is not None:
                return end
        if self.at(i, "function"):
            return self.function(first, i, exported, "default" in seen)
        if self.at(i, "class"):
            return self.class_(first, i, exported)
        if "default" in seen:
            return self.export_value(first, i)
        if self.at(i, "interface") and self.is_name(i + 1) and not self.new_line(i + 1):
            brace = i + 2
            while brace < len(self.t) and not self.at(brace, "{"):
                brace = self.angles(brace) if self.at(brace, "<") else brace + 1
            self.add(self.t[i + 1].text, "interface", first, self.past(brace), exported, brace - 1)
            return self.past(brace)
        if self.at(i, "type") and self.is_name(i + 1) and self.at(i + 2, "=", "<"):
            j = self.angles(i + 2) if self.at(i + 2, "<") else i + 2
            end = self.closing(self.type(j + 1))
            self.add(self.t[i + 1].text, "type", first, end, exported)
            return end
        if self.at(i, "enum") or (self.at(i, "const") and self.at(i + 1, "enum")):
            name = i + 1 if self.at(i, "enum") else i + 2
            if self.is_name(name) and self.at(name + 1, "{"):
                self.add(self.t[name].text, "enum", first, self.past(name + 1), exported, name)
                return self.past(name + 1)
        if self.at(i, "const", "let", "var"):
            return self.variables(first, i + 1, exported)
        return self.other(i)

    def other(self, i: int) -> int:
        """Past a statement that declares nothing."""
        if self.at(i, *_BLOCKS):
            while i < len(self.t):
                if self.at(i, ";"):
                    return i + 1
                if self.at(i, "{"):
                    i = self.past(i)
                    if not self.at(i, "else", "catch", "finally", "while"):
                        return i
                else:
                    i = self.past(i) if self.at(i, "(", "[") else i + 1
            return i
        return self.closing(self.expression(i))

    def module_clause(self, first: int, i: int) -> int | None:
        """import ... 'x' and export ... 'x'; None if the statement is something else."""
        if self.at(first, "import"):
            if self.at(first + 1, "(", "."):
                return None
            j = first + 1
            while j < len(self.t) and self.kind(j) != "string":
                if self.at(j, "=", ";"):
                    return self.closing(self.expression(j))
                j = self.past(j) if self.at(j, "{") else j + 1
            return self.specifier(j)
        if self.at(i, "type") and self.at(i + 1, "{", "*"):
            i += 1
        if self.at(i, "*"):
            while i < len(self.t) and self.kind(i) != "string":
                i += 1
            return self.specifier(i)
        if self.at(i, "{"):
            end = self.past(i)
            start = i + 1
            for j in range(i + 1, end):
                if self.at(j, ",") or j == end - 1:
                    part = [tok for tok in self.t[start:j]]
                    if len(part) > 1 and part[0].text == "type" and part[1].text != "as":
                        part = part[1:]
                    if part:
                        self.later.add(part[0].value or part[0].text)
                    start = j + 1
            return self.specifier(end + 1) if self.at(end, "from") else self.closing(end)
        if self.at(i, "="):
            return self.export_value(first, i + 1)
        if self.at(i, "import", "as"):
            return self.closing(self.expression(i))
        return None

    def specifier(self, i: int) -> int:
        if self.kind(i) == "string":
            self.out.specifiers.append(self.t[i].value)
            i += 1
            if self.at(i, "with", "assert") and self.at(i + 1, "{"):
                i = self.past(i + 1)
        return self.closing(i)

    def export_value(self, first: int, i: int) -> int:
        end = self.expression(i)
        single = end == i + 1 and self.is_name(i)
        name = self.t[i].text if single else "default"
        self.add(name, self.callable_kind(name, i, end), first, self.closing(end), True)
        return self.closing(end)

    def function(self, first: int, i: int, exported: bool, default: bool) -> int:
        name = i + 2 if self.at(i + 1, "*") else i + 1
        named = self.is_name(name)
        head, body = self.signature(name + 1 if named else name)
        end = self.past(body) if body is not None else self.closing(head + 1)
        if named:
            said = self.t[name].text
            self.add(said, self.callable_kind(said, first, end), first, end, exported, head if body is not None else None)
        return end

    def class_(self, first: int, i: int, exported: bool) -> int:
        named = self.is_name(i + 1) and not self.at(i + 1, "extends", "implements")
        brace = i + 1
        while brace < len(self.t) and not self.at(brace, "{"):
            brace = self.angles(brace) if self.at(brace, "<") else self.past(brace) if self.at(brace, "(", "[") else brace + 1
        end = self.past(brace)
        if named:
            name = self.t[i + 1].text
            self.add(name, "class", first, end, exported, brace - 1)
            j = brace + 1
            while j < end - 1:
                j = max(j + 1, self.member(j, end - 1, name, exported))
        return end

    def member(self, first: int, stop: int, owner: str, exported: bool) -> int:
        i = self.decorators(first)
        if self.at(i, ";"):
            return i + 1
        generator = accessor = False
        while self.at(i, "*", *_MEMBER_MODIFIERS) and not (self.t[i].text != "*" and self.at(i + 1, "(", "<", "=", ":", ";", "}", "?", "!", ",")):
            if self.at(i, "static") and self.at(i + 1, "{"):
                return self.past(i + 1)
            generator, accessor = generator or self.at(i, "*"), accessor or self.at(i, "get", "set")
            i = self.decorators(i + 1)
        named = self.is_name(i) and not (self.at(i, "constructor") and not accessor)
        name = self.t[i].text if i < len(self.t) else ""
        i = self.past(i) if self.at(i, "[") else i + 1
        if self.at(i, "?", "!"):
            i += 1
        if self.at(i, "(", "<"):
            head, body = self.signature(i)
            end = min(self.past(body) if body is not None else self.closing(head + 1), stop)
            if named:
                self.add(name, "method", first, end, exported, head if body is not None else None, owner)
            return end
        if self.at(i, ":"):
            i = self.type(i + 1)
        function = None
        if self.at(i, "="):
            function = self.callable(i + 1)
            i = function[1] if function else self.expression(i + 1)
        elif not self.at(i, ";") and i < stop and not self.new_line(i):
            i += 1
        end = min(self.closing(i), stop)
        if function and named:
            self.add(name, "method", first, end, exported, None, owner)
        return end

    def variables(self, first: int, i: int, exported: bool) -> int:
        found: list[tuple[str, int, tuple[int, int] | None]] = []
        while i < len(self.t):
            named, name, place = self.is_name(i), self.t[i].text, i
            i = self.past(i) if self.at(i, "{", "[") else i + 1
            if self.at(i, "!"):
                i += 1
            if self.at(i, ":"):
                i = self.type(i + 1)
            function, value = None, i
            if self.at(i, "="):
                value = i + 1
                function = self.callable(value)
                i = function[1] if function else self.expression(value, (";", ","))
            if named:
                found.append((name, value if function else place, function))
            if not self.at(i, ","):
                break
            i += 1
        end = self.closing(i)
        for name, value, function in found:
            if function:
                self.add(name, self.callable_kind(name, value, function[1]), first, end, exported, function[0])
            elif exported:
                self.add(name, "const", first, end, exported)
        return end


def parse(path: str, text: str) -> Parsed:
    return _Reader(path, text).run()


__all__ = ["Token", "parse"]
