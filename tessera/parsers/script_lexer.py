"""Tokens of TypeScript, JavaScript and JSX text, with the comments between them.

Good enough to find declarations: regular expressions are told from division and JSX from comparison by the token
before; template substitutions and JSX containers are tokenised like any other code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS_BEFORE_EXPRESSION = {"return", "typeof", "case", "do", "else", "in", "instanceof", "new", "void", "delete", "throw", "yield", "await", "of", "default", "extends"}

_SPACE = re.compile("[\\s\ufeff]+")
_LINE_COMMENT = re.compile(r"//[^\n\r\u2028\u2029]*")
_BLOCK_COMMENT = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)")
_NAME = re.compile(r"#?[A-Za-z_$\u0080-\U0010FFFF\\][\w$\u0080-\U0010FFFF\\]*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'?|\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\"?")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_PUNCT = re.compile(r"\.\.\.|=>|===|!==|==|!=|<=|&&=|\|\|=|\?\?=|\*\*=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|\+\+|--|[-+*/%&|^]=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_TEMPLATE_PART = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template (without substitution), regex, punct, jsx (an element begins), jsx_text
    text: str
    start: int
    end: int
    value: str = ""


def cooked(raw: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"
        return _SIMPLE.get(m[4], m[4])

    return _ESCAPE.sub(one, raw)


class Lexer:
    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.jsx = text, jsx
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        self.code(0, top=True)

    def add(self, kind: str, start: int, end: int, value: str = "") -> int:
        self.tokens.append(Token(kind, self.text[start:end], start, end, value))
        return end

    def trivia(self, i: int) -> int:
        """Past white space and comments; a first line that starts with #! is one."""
        while True:
            m = _SPACE.match(self.text, i)
            if m:
                i = m.end()
                continue
            m = _BLOCK_COMMENT.match(self.text, i) or _LINE_COMMENT.match(self.text, i) or (i == 0 and re.compile(r"#![^\n]*").match(self.text))
            if not m:
                return i
            self.comments.append((i, m.end()))
            i = m.end()

    def expression_here(self) -> bool:
        """Whether the next token starts an operand (else it follows one)."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "name":
            return t.text in KEYWORDS_BEFORE_EXPRESSION
        return t.kind == "punct" and t.text not in (")", "]", "}", "++", "--")

    def code(self, i: int, top: bool = False) -> int:
        """Tokens from i up to the brace that closes this level; returns the place after it."""
        text, n, depth = self.text, len(self.text), 0
        while True:
            i = self.trivia(i)
            if i >= n:
                return n
            c = text[i]
            if c in "'\"":
                m = _STRING.match(text, i)
                body = m[0][1:-1] if len(m[0]) > 1 and m[0][-1] == c else m[0][1:]
                i = self.add("string", i, m.end(), cooked(body))
            elif c == "`":
                i = self.template(i)
            elif m := _NAME.match(text, i):
                i = self.add("name", i, m.end())
            elif c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit()):
                i = self.add("number", i, _NUMBER.match(text, i).end())
            elif c == "/" and self.expression_here() and (m := _REGEX.match(text, i)):
                i = self.add("regex", i, m.end())
            elif c == "<" and self.jsx and self.expression_here() and (end := self.element(i)):
                i = end
            elif m := _PUNCT.match(text, i):
                if m[0] == "{":
                    depth += 1
                elif m[0] == "}":
                    if depth == 0 and not top:
                        return m.end()
                    depth -= 1
                i = self.add("punct", i, m.end())
            else:
                i += 1

    def template(self, i: int) -> int:
        start, parts = i, 0
        i += 1
        while True:
            m = _TEMPLATE_PART.match(self.text, i)
            if m.end() >= len(self.text) or self.text[m.end()] == "`":
                end = min(m.end() + 1, len(self.text))
                if not parts:
                    return self.add("template", start, end, cooked(m[0]).replace("\r\n", "\n"))
                return self.add("regex", m.end(), end)  # an operand ends here
            self.add("punct", m.end(), m.end() + 2)
            self.tokens[-1].text = "("
            i = self.code(m.end() + 2)
            self.add("punct", i - 1, i)
            self.tokens[-1].text = ")"
            parts += 1

    def element(self, i: int) -> int | None:
        """An element or fragment from its < on; None (and nothing added) if it isn't one."""
        kept = len(self.tokens), len(self.comments)
        end = self._element(i)
        if end is None:
            del self.tokens[kept[0] :], self.comments[kept[1] :]
        return end

    def _element(self, i: int) -> int | None:
        text, start = self.text, i
        i = self.trivia(i + 1)
        name = _JSX_NAME.match(text, i)
        if name:
            i = self.trivia(name.end())
            if text[i : i + 1] == "," or re.match(r"extends\b", text[i:i + 8]) or (len(name[0]) == 1 and name[0].isupper() and re.match(r"\s*>\s*\(", text[i : i + 40])):
                return None  # type parameters
            if text[i : i + 1] == "<":  # type arguments of a component
                i = self.angle(i)
        elif text[i : i + 1] != ">":
            return None
        self.add("jsx", start, start + 1)
        while True:
            i = self.trivia(i)
            if text.startswith("/>", i):
                return self.closed(i, 2)
            if text.startswith(">", i):
                i += 1
                break
            if text.startswith("{", i):
                i = self.contained(i)
            elif attribute := _JSX_NAME.match(text, i):
                i = self.trivia(attribute.end())
                if text.startswith("=", i):
                    i = self.trivia(i + 1)
                    if text[i : i + 1] in ("'", '"') and text[i : i + 1]:
                        stop = text.find(text[i], i + 1)
                        if stop < 0:
                            return None
                        i = self.add("string", i, stop + 1, text[i + 1 : stop])
                    elif text.startswith("{", i):
                        i = self.contained(i)
                    elif text.startswith("<", i):
                        i = self._element(i)
                        if i is None:
                            return None
                    else:
                        return None
            else:
                return None
        while True:
            stop = re.compile(r"[<{]").search(text, i)
            if not stop:
                return None
            if stop.start() > i:
                self.add("jsx_text", i, stop.start(), text[i : stop.start()])
            i = stop.start()
            if text[i] == "{":
                i = self.contained(i)
            elif closing := re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, i):
                if closing[1] != (name[0] if name else ""):
                    return None
                return self.closed(closing.start(), len(closing[0]))
            else:
                i = self._element(i)
                if i is None:
                    return None

    def closed(self, i: int, size: int) -> int:
        return self.add("regex", i, i + size)  # an operand ends here

    def contained(self, i: int) -> int:
        self.add("punct", i, i + 1)
        i = self.code(i + 1)
        return self.add("punct", i - 1, i)

    def angle(self, i: int) -> int:
        depth = 0
        while i < len(self.text):
            depth += {"<": 1, ">": -1}.get(self.text[i], 0) if self.text[i - 1 : i + 1] != "=>" else 0
            i += 1
            if not depth:
                break
        return i
