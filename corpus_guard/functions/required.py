"""Strings that every match of a pattern must hold, told from the pattern's own parts.

Python's ``re`` reads the pattern; its list of parts is walked once. The result is a list of groups:
a text without all strings of any one group has no match. Strings are lower-case ASCII of the
folded text (``operators.matching``), so case and the letters that fold to s, i and k do not matter.
"""

from __future__ import annotations

import re
from re import _parser as parser  # the parts of a pattern have no public reader

_FOLDED = {"ſ": "s", "ı": "i", "İ": "i", "K": "k"}
_SIGNS = "(=:+"

Group = tuple[str, ...]


def _char(code: int) -> str | None:
    c = chr(code)
    c = _FOLDED.get(c, c.lower())
    return c if c.isascii() else None


def _one_char(parts) -> str | None:
    """The character that a class of one letter in both cases stands for."""
    chars = {_char(arg) if op is parser.LITERAL else None for op, arg in parts}
    return chars.pop() if len(chars) == 1 else None


def _is_space(parts) -> bool:
    spaces = (parser.CATEGORY, parser.CATEGORY_SPACE)
    return all(
        (op is parser.IN and all(x == spaces for x in arg)) or (op is parser.LITERAL and chr(arg) in " \t") for op, arg in parts
    )


def _flat(parts):
    """Parts in a row, those of plain groups among them."""
    for op, arg in parts:
        if op is parser.SUBPATTERN:
            yield from _flat(arg[3])
        elif op is parser.ATOMIC_GROUP:
            yield from _flat(arg)
        else:
            yield op, arg


def _groups(parts, spaced: bool) -> list[Group]:
    found: list[Group] = []
    run = ""

    def ended() -> None:
        nonlocal run
        if run:
            found.append((run,))
        run = ""

    for op, arg in _flat(parts):
        char = None
        if op is parser.LITERAL:
            char = _char(arg)
        elif op is parser.IN:
            char = _one_char(arg)
        elif op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
            continue  # of no width
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
            least, _, inner = arg
            if spaced and _is_space(inner):
                continue
            ended()
            if least:
                found.extend(_groups(inner, spaced))
            continue
        elif op is parser.BRANCH:
            ended()
            choices = [best(_groups(branch, spaced)) for branch in arg[1]]
            if all(choices):
                found.append(tuple(dict.fromkeys(w for group in choices for w in group)))
            continue
        if char is None:
            ended()
        else:
            run += char
    ended()
    return found


def best(groups: list[Group]) -> Group:
    """The group whose shortest string is longest, of fewest strings; empty if there is none."""
    return max(groups, key=lambda g: (min(map(len, g)), -len(g)), default=())


def required(pattern: str, spaced: bool = False) -> list[Group]:
    """The groups of a pattern that compiles. ``spaced`` leaves white space between characters out."""
    return _groups(parser.parse(pattern, re.IGNORECASE | re.MULTILINE), spaced)


def is_required(strings: Group, pattern: str) -> bool:
    """Whether every match holds one of the strings, as far as the pattern's parts tell.

    A string that ends in a sign stands for its word, white space and that sign.
    """
    wanted = [w.lower() for w in strings]

    def holds(groups: list[Group], words: list[str]) -> bool:
        return any(group and all(any(w in text for w in words) for text in group) for group in groups)

    signed = [w for w in wanted if len(w) > 1 and w[-1] in _SIGNS]
    return holds(required(pattern), wanted) or (
        len(signed) == len(wanted) and holds(required(pattern, spaced=True), signed)
    )
