"""Shared scanner: a copy of the text in which comments and the insides of strings are blank.

Offsets agree with the text, so structure is read from the blanked copy and names, paths
and literals from the text.
"""

from __future__ import annotations

import bisect
import re
from functools import cache, cached_property

_OPEN, _CLOSE = "([{", ")]}"
_PARTNER = dict(zip(_CLOSE, _OPEN))
_BRACKET = re.compile(r"[()\[\]{}]")
_NOT_NEWLINE = re.compile(r"[^\n]")
_LITERAL = re.compile(r"\s*[@$]?([\"'`])[^\"'`]*\1")


def token_pattern(line: tuple[str, ...], block: tuple[tuple[str, str], ...], strings: tuple[str, ...]) -> re.Pattern:
    """Comments and strings of a language, whichever starts first."""
    parts = [f"(?P<c{i}>{re.escape(a)}[\\s\\S]*?(?:{re.escape(b)}|\\Z))" for i, (a, b) in enumerate(block)]
    parts += [f"(?P<l{i}>{x}[^\\n]*)" for i, x in enumerate(line)]
    parts += [f"(?P<s{i}>{x})" for i, x in enumerate(strings)]
    return re.compile("|".join(parts))


def leading(first: str, *parts: str) -> re.Pattern:
    """Tokens by their first characters: it is matched at once and looked back at, so that other characters are passed quickly."""
    return re.compile(f"[{first}](?:{'|'.join(parts)})")


DOUBLE = r'"(?:[^"\\\n]|\\.)*"'
SINGLE = r"'(?:[^'\\\n]|\\.)*'"
TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*`"
C_BLOCK = (("/*", "*/"),)
#: A regular expression of JavaScript after its first slash.
_REGEX = r"(?![/*\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

LANGUAGES = {
    "js": leading("\"'`/ \\t", r"(?P<c0>(?<=/)\*[\s\S]*?(?:\*/|\Z))", r"(?P<l0>(?<=/)/[^\n]*)", r'(?P<s0>(?<=")[^"\\\n]*(?:\\.[^"\\\n]*)*")', r"(?P<s1>(?<=')[^'\\\n]*(?:\\.[^'\\\n]*)*')", r"(?P<s2>(?<=`)[^`\\]*(?:\\[\s\S][^`\\]*)*`)",
                  rf"(?P<s3>(?:(?<=[=(,:;!&|?{{}}\n][ \t])[ \t]*/|(?<=[=(,:;!&|?{{}}\n]/)){_REGEX})"),
    "php": token_pattern(("//", r"\#(?!\[)"), C_BLOCK, (r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'")),
    "cs": token_pattern(("//",), C_BLOCK, (r'@"(?:[^"]|"")*"', r'"""[\s\S]*?"""', r'\$?"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)+'")),
    "java": token_pattern(("//",), C_BLOCK, (r'"""[\s\S]*?"""', DOUBLE, r"'(?:[^'\\\n]|\\.)+'")),
    "go": token_pattern(("//",), C_BLOCK, (DOUBLE, r"`[^`]*`", r"'(?:[^'\\\n]|\\.)+'")),
    "rust": token_pattern(("//",), C_BLOCK, (r'r(?P<h>#*)"[\s\S]*?"(?P=h)', r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[^\n]{1,8})'")),
    "c": token_pattern(("//",), C_BLOCK, (r'R"(?P<d>[^(]*)\([\s\S]*?\)(?P=d)"', DOUBLE, SINGLE)),
    "ruby": token_pattern(("#",), (("\n=begin", "\n=end"),), (DOUBLE, SINGLE)),
    "ps1": token_pattern(("#",), (("<#", "#>"),), (r'"(?:[^"`]|`[\s\S])*"', r"'[^']*'")),
    "sql": leading("-/'\"", r"(?P<c0>(?<=/)\*[\s\S]*?(?:\*/|\Z))", r"(?P<l0>(?<=-)-[^\n]*)", r"(?P<s0>(?<=')[^']*(?:''[^']*)*')", r'(?P<s1>(?<=")[^"]*(?:""[^"]*)*")'),
}


@cache
def _seek(mark: str):
    return re.compile(f"[(\\[{{<>{re.escape(mark)}]").search


def _blanks(token: str) -> str:
    return _NOT_NEWLINE.sub(" ", token) if "\n" in token else " " * len(token)


class Source:
    def __init__(self, text: str, language: str):
        self.text = text
        out, at = [], 0
        for m in LANGUAGES[language].finditer(text):
            kind = m.lastgroup[0] if m.lastgroup[0] in "cls" else "s"
            out.append(text[at : m.start()])
            out.append(self._blank(m[0], kind == "s"))
            at = m.end()
        self.code = "".join(out) + text[at:]

    @staticmethod
    def _blank(token: str, is_string: bool) -> str:
        if is_string and len(token) >= 2:
            lead = len(token) - len(token.lstrip("@$rR \t#"))
            first, last = (lead, len(token) - 1) if token[lead : lead + 1] in ("'", '"', "`") else (-1, -1)
            blank = _blanks(token)
            return blank if first < 0 else blank[:first] + token[first] + blank[first + 1 : last] + token[last] * (last > first)
        return _blanks(token)

    @cached_property
    def _lines(self) -> list[int]:
        return [m.end() for m in re.finditer("\n", self.text)]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._lines, at) + 1

    @cached_property
    def _pairs(self) -> dict[int, int]:
        stack, pairs, count = [], {}, 0
        for m in _BRACKET.finditer(self.code):
            c, count = m[0], count + 1
            if c in _OPEN:
                stack.append((c, m.start()))
            else:
                want = _PARTNER[c]
                while stack and stack[-1][0] != want:
                    stack.pop()
                if stack:
                    pairs[stack.pop()[1]] = m.start()
        self.balanced = len(pairs) * 2 == count
        return pairs

    @cached_property
    def balanced(self) -> bool:
        """Every bracket has its partner."""
        _ = self._pairs
        return self.balanced

    def close(self, opened: int) -> int:
        """Offset of the bracket that closes the one at `opened` (the end of the text if none does)."""
        return self._pairs.get(opened, len(self.code))

    @cached_property
    def blocks(self) -> list[tuple[int, int]]:
        """Pairs of curly braces in order of opening."""
        return sorted((a, b) for a, b in self._pairs.items() if self.code[a] == "{")

    def depth(self, at: int) -> int:
        return sum(a < at <= b for a, b in self.blocks)

    def find(self, pattern: str, flags: int = 0, start: int = 0, end: int | None = None):
        return re.compile(pattern, flags).finditer(self.code, start, len(self.code) if end is None else end)

    def raw(self, m: re.Match, group: int = 0) -> str | None:
        return self.text[m.start(group) : m.end(group)] if m.start(group) >= 0 else None

    def literal(self, at: int, end: int | None = None) -> str | None:
        """The string literal that starts at `at` after blanks, without its quotes."""
        m = _LITERAL.match(self.code, at, len(self.code) if end is None else end)
        return self.text[m.start(1) + 1 : m.end() - 1] if m else None

    def split(self, start: int, end: int, mark: str = ",") -> list[tuple[int, int]]:
        """Pieces between marks that stand outside inner brackets (and angle brackets of types)."""
        out, at, i, angle, code, pairs, text = [], start, start, 0, self.code, self._pairs, self.text
        seek = _seek(mark)
        while found := seek(code, i, end):
            i, c = found.start(), found[0]
            if c == mark:
                if not angle:
                    out.append((at, i))
                    at = i + 1
            elif c == "<":
                angle += 1
            elif c == ">":
                angle -= bool(code[i - 1] not in "=-" and angle)
            elif pairs.get(i, end) < end:
                i = pairs[i]
            i += 1
        out.append((at, end))
        return [(a, b) for a, b in out if text[a:b].strip()]
