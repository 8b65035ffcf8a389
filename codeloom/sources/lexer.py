"""One tolerant lexer for the languages with braces, and brackets matched over its tokens."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_STRING = r'"(?:\\.|[^"\\\n])*"?'
_COMMON = r"(?P<doc>/\*.*?(?:\*/|\Z)|//[^\n]*)"
_WORD = r"(?P<word>[^\W\d]\w*|\$\w*)"
_REST = r"|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|\.\.\.|&&|\|\||[^\s\w])"
_PATTERNS = {
    "rust": _COMMON + r"|(?P<str>b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])')|(?P<life>'[^\W\d]\w*)|" + _WORD + _REST,
    "go": _COMMON + r"|(?P<str>`[^`]*`?|" + _STRING + r"|'(?:\\.|[^'\\\n])*'?)|" + _WORD + _REST,
    "c": _COMMON + r"|(?P<pre>^[ \t]*\#(?:\\\n|[^\n])*)|(?P<str>" + _STRING + r"|'(?:\\.|[^'\\\n])*'?)|" + _WORD + _REST,
    "java": _COMMON + r"|(?P<str>\"\"\".*?\"\"\"|" + _STRING + r"|'(?:\\.|[^'\\\n])*'?)|" + _WORD + _REST,
    "javascript": _COMMON + r"|(?P<str>`(?:\\.|[^`\\])*`?|" + _STRING + r"|'(?:\\.|[^'\\\n])*'?)|" + r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)" + _REST,
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_COMPILED = {k: re.compile(p, re.S | re.M) for k, p in _PATTERNS.items()}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


class Source:
    """Tokens without comments; ``match[i]`` is the partner of a bracket (the last token if it has none),
    ``depth[i]`` the number of braces around it."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens: list[Token] = []
        self.docs: list[Token] = []
        for m in _COMPILED[language].finditer(text):
            kind = m.lastgroup if m.lastgroup != "h" else "str"
            t = Token(kind, m.group(), m.start(), m.end(), self.line(m.start()))
            (self.docs if kind == "doc" else self.tokens).append(t)
        n = len(self.tokens)
        self.match = [-1] * n
        self.depth = [0] * n
        stack: list[int] = []
        braces = 0
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in _CLOSE:
                for k in range(len(stack) - 1, -1, -1):  # drop openings that were never closed
                    if self.tokens[stack[k]].text == _CLOSE[t.text]:
                        for j in stack[k + 1 :]:
                            braces -= self.tokens[j].text == "{"
                        del stack[k + 1 :]
                        o = stack.pop()
                        self.match[o], self.match[i] = i, o
                        braces -= t.text == "}"
                        break
            self.depth[i] = braces
            if t.kind == "op" and t.text in _OPEN:
                stack.append(i)
                braces += t.text == "{"
        for o in stack:
            self.match[o] = n - 1

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def span(self, i: int, j: int) -> str:
        """Source text from token i to token j, inclusive."""
        return self.text[self.tokens[i].start : self.tokens[j].end]

    def find(self, i: int, texts: tuple[str, ...], stop: int | None = None) -> int:
        """The first token from i on with one of the texts, brackets passed over; -1 if none."""
        end = len(self.tokens) if stop is None else stop
        while i < end:
            t = self.at(i)
            if t in texts and self.tokens[i].kind == "op" or t in texts and self.tokens[i].kind == "word":
                return i
            i = self.match[i] + 1 if t in _OPEN and self.tokens[i].kind == "op" and self.match[i] > i else i + 1
        return -1

    def end_line(self, i: int) -> int:
        return self.line(max(self.tokens[i].start, self.tokens[i].end - 1))

    def statement_start(self, i: int) -> int:
        """The first token of the declaration that holds token i."""
        while i > 0 and not (self.tokens[i - 1].kind == "pre" or self.tokens[i - 1].kind == "op" and self.at(i - 1) in (";", "{", "}")):
            i -= 1
        return i

    def doc_before(self, i: int, prefix: str = "") -> str | None:
        """The comment right before token i, if nothing but white space stands between."""
        at = self.tokens[i].start
        for d in reversed(self.docs):
            if d.end <= at:
                return d.text if not self.text[d.end : at].strip() and d.text.startswith(prefix) else None
        return None
