"""Python regular expressions for Spark's (Java) regex functions.

Rule patterns are written in Python syntax. The two dialects differ in what ``.``, ``\\s``,
``\\w``, ``\\d``, ``\\b`` and ignore-case cover outside ASCII; the translation spells the Python
meaning out, so that both engines find the same matches in any text.
"""

from __future__ import annotations

import re

# What Python's str.isspace() accepts, and its word characters, as Java class members.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PYTHON_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WORD = r"\p{L}\p{N}_"

_IN_CLASS = {
    r"\s": SPACE,
    r"\S": f"[^{SPACE}]",
    r"\w": WORD,
    r"\W": f"[^{WORD}]",
    r"\d": r"\p{Nd}",
    r"\D": r"\P{Nd}",
}
_OUTSIDE = {
    r"\s": f"[{SPACE}]",
    r"\S": f"[^{SPACE}]",
    r"\w": f"[{WORD}]",
    r"\W": f"[^{WORD}]",
    r"\d": r"\p{Nd}",
    r"\D": r"\P{Nd}",
    r"\b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    r"\B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
    r"\Z": r"\z",
}
_TOKEN = re.compile(r"\\.|\(\?P<|\(\?P=\w+\)|\[\^?\]?|\]|&&|.", re.DOTALL)


def to_java(pattern: str, dotall: bool = False) -> str:
    """The Java pattern that matches what Python's ``re`` matches with IGNORECASE | MULTILINE."""
    out = []
    in_class = False
    for token in _TOKEN.findall(pattern):
        if token.startswith("\\"):
            token = (_IN_CLASS if in_class else _OUTSIDE).get(token, token)
        elif in_class:
            if token == "]":
                in_class = False
            elif token[0] == "[":
                # a literal bracket here; a "]" read along with it closes the class
                in_class = not token.endswith("]")
                token = "\\" + token
            elif token == "&&":
                token = r"&\&"
        elif token[0] == "[":
            in_class = True
            if token.endswith("]"):
                token = token[:-1] + r"\]"
        elif token == "(?P<":
            token = "(?<"
        elif token.startswith("(?P="):
            token = f"\\k<{token[4:-1]}>"
        out.append(token)
    flags = "dium" + ("s" if dotall else "")
    return f"(?{flags})" + "".join(out)


def compiles(pattern: str) -> bool:
    """Whether the pattern is valid; a rule with an invalid pattern yields no findings."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
