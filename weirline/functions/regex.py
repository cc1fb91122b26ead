"""Regular expressions of the RE2 dialect as Java patterns."""

from __future__ import annotations

import re

#: POSIX classes and their Java names.
POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}
_NOT_RE2 = re.compile(r"\(\?<?[=!]|\(\?>|\\[1-9]|(?<!\\)[*+?}]\+")
_META = re.compile(r"[\\.+*?()|\[\]{}^$]")


def to_java(pattern: str) -> str:
    """The Java pattern that matches what RE2 matches; ValueError for what RE2 refuses."""
    if _NOT_RE2.search(pattern):
        raise ValueError(f"RE2 has no lookaround, backreference, atomic group or possessive quantifier: {pattern}")
    bare = re.sub(r"\\\\", "", pattern)
    if m := re.search(r"\\([ceghijklmoqruyEFGHIJKLMNOTUVXYZ])", bare):
        raise ValueError(f"invalid escape \\{m[1]}: {pattern}")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
            name = POSIX[m[2]]
            out.append(re.sub(r"^\\([a-z])", lambda x: "\\" + x[1].upper(), name, count=1) if m[1] else name)
            i += len(m[0])
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "[" and in_class:
            c = "\\["
        elif c == "]" and in_class:
            in_class = False
        elif c == "&" and in_class:
            c = "\\&"
        elif c == "$" and not in_class and "(?m" not in pattern:
            c = r"\z"  # Java's $ also matches before a last line break
        elif pattern.startswith("(?P<", i):
            c, i = "(?<", i + 3
        out.append(c)
        i += 1
    return "".join(out)


def plain_affix(pattern: str) -> tuple[str, str] | None:
    """('startswith' or 'endswith', text) for ^text and text$ without any other operator."""
    if len(pattern) > 1 and pattern[0] == "^" and not _META.search(pattern[1:]):
        return "startswith", pattern[1:]
    if len(pattern) > 1 and pattern[-1] == "$" and not _META.search(pattern[:-1]):
        return "endswith", pattern[:-1]
    return None
