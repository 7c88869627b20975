"""Regular expressions of programs, as Java takes them."""

from __future__ import annotations

import re

try:
    import regex as _engine  # knows Unicode and bracket classes
except ImportError:
    _engine = re

from loglathe.errors import ProgramError

_POSIX = {"alpha": r"\p{Alpha}", "digit": "0-9", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "word": r"\w", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}"}
#: Newline alone ends a line, and classes are Unicode's.
FLAGS = "(?dU)"


def to_java(pattern: str) -> str:
    """Translate bracket classes; refuse what a linear-time matcher lacks."""
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!]|<[=!]|>)", pattern):
        raise ProgramError(f"look-around and atomic groups are not supported: {pattern}")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        raise ProgramError(f"backreferences are not supported: {pattern}")
    out = re.sub(r"\[:(\^?)(\w+):\]", lambda m: _POSIX.get(m[2], m[0]) if not m[1] else m[0], pattern)
    return out.replace("(?P<", "(?<")


def search(pattern: str) -> str:
    return FLAGS + to_java(pattern)


def whole(pattern: str) -> str:
    """Anchored at both ends of the text, as label matchers are."""
    return rf"{FLAGS}\A(?:{to_java(pattern)})\z"


def around(pattern: str) -> str:
    """The first match with all that stands before and after it, group 1 the match itself if the pattern has no group."""
    own = to_java(pattern)
    own = f"(?:{own})" if groups(pattern) else f"({own})"
    # Nothing can stand before a match that begins where the text does.
    before = "" if pattern.startswith("^") and "|" not in pattern else r"\A(?s:.*?)"
    return rf"{FLAGS}{before}{own}(?s:.*)\z"


def groups(pattern: str) -> int:
    """The number of capture groups."""
    n = i = 0
    inside = False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                i += 1
        elif c == "(":
            n += pattern[i + 1 : i + 2] != "?" or bool(re.match(r"\?P?<[A-Za-z_]", pattern[i + 1 :]))
        i += 1
    return n


def matches_name(pattern: str, name: str) -> bool:
    """For metric names, which are known when planning."""
    return _engine.fullmatch(pattern, name) is not None


def check(pattern: str) -> None:
    """Raises ProgramError where a pattern is malformed, before any task sees it."""
    to_java(pattern)
    try:
        _engine.compile(pattern)
    except _engine.error as e:
        raise ProgramError(f"malformed pattern: {e}") from None
