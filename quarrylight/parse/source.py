"""The text of one file: lines, blocks, and scans shared by all grammars."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import cached_property

#: Comments, and string literals by quote character (groups 1 to 3); possessive, so that a
#: literal of any length is one step.
_NOISE = re.compile(
    r"""//[^\n]*|\#[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"""
    r"""|(")(?:""[\s\S]*?(?:\"{3}|\Z)|(?:[^"\\]++|\\[\s\S]|\\\Z)*+(?:"|\Z))"""
    r"""|(')(?:''[\s\S]*?(?:'{3}|\Z)|(?:[^'\\]++|\\[\s\S]|\\\Z)*+(?:'|\Z))"""
    r"""|(`)(?:[^`\\]++|\\[\s\S]|\\\Z)*+(?:`|\Z)"""
)
_BRANCH_WORDS = "and case catch do elif elsif except for foreach if or rescue select switch unless until while"
_BRANCH = re.compile(rf"\b(?:{'|'.join(_BRANCH_WORDS.split())})\b|&&|\|\||=>|\?(?!\?)", re.A)
_ELSE_IF = re.compile(r"\belse\s+if\b", re.A)


def without_noise(code: str) -> str:
    """Code without comments, with every literal emptied, in one scan from the left."""
    return _NOISE.sub(lambda m: 2 * (m[1] or m[2] or m[3] or ""), code)


def complexity(code: str) -> int:
    """One, and one more for every branching word or sign; ``else if`` counts twice."""
    bare = without_noise(code)
    return 1 + sum(1 for _ in _BRANCH.finditer(bare)) + sum(1 for _ in _ELSE_IF.finditer(bare))


class Source:
    """Lines are counted from 0 here; results count from 1."""

    def __init__(self, text: str, path: str = "") -> None:
        self.text, self.path = text, path
        self.lines = text.split("\n")
        self._balance: dict[str, tuple[list[int], dict[int, list[int]], list[int]]] = {}

    @cached_property
    def _breaks(self) -> list[int]:
        out, at = [], -1
        for line in self.lines[:-1]:
            at += len(line) + 1
            out.append(at)
        return out

    def line_at(self, offset: int) -> int:
        return bisect_left(self._breaks, offset)

    def body(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first : last + 1])

    def _sums(self, pair: str) -> tuple[list[int], dict[int, list[int]], list[int]]:
        """(depth before each line, lines after which a depth is reached, lines that open)."""
        if pair not in self._balance:
            depth, reached, opens = [0], defaultdict(list), []
            for i, line in enumerate(self.lines):
                up = line.count(pair[0])
                if up:
                    opens.append(i)
                depth.append(depth[-1] + up - line.count(pair[1]))
                reached[depth[-1]].append(i)
            self._balance[pair] = depth, reached, opens
        return self._balance[pair]

    def balanced(self, first: int, pair: str = "{}") -> int:
        """Last line of the block that opens on or after ``first``: the first line at whose end
        all of it is closed again; ``first`` itself if there is none."""
        depth, reached, opens = self._sums(pair)
        o = bisect_left(opens, first)
        if o == len(opens):
            return first
        ends = reached.get(depth[first], [])
        e = bisect_left(ends, opens[o])
        return ends[e] if e < len(ends) else first

    def parens(self, first: int) -> int:
        return self.balanced(first, "()")

    def indented(self, first: int) -> int:
        """Last line of the lines below that are blank or further in than ``first``."""
        head = self.lines[first]
        base, last = len(head) - len(head.lstrip()), first
        for i in range(first + 1, len(self.lines)):
            line = self.lines[i]
            inner = line.lstrip()
            if inner and len(line) - len(inner) <= base:
                break
            last = i
        return last

    def until(self, first: int, closing: re.Pattern) -> int:
        """The next line that ``closing`` matches, or the last one."""
        for i in range(first + 1, len(self.lines)):
            if closing.match(self.lines[i]):
                return i
        return len(self.lines) - 1
