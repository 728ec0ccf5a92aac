"""Masking and sanitising of text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_guard.functions.dialect import SPACE, to_java

# Patterns (Python syntax) and their replacements, applied in this order.
MASKS = (
    (r"\b\d{3}[.\-]?\d{3}[.\-]?\d{3}[.\-]?\d{2}\b", "[CPF MASKED]"),
    (r"\b\d{2}[.\-]?\d{3}[.\-]?\d{3}[/]?\d{4}[.\-]?\d{2}\b", "[CNPJ MASKED]"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL MASKED]"),
    (r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", "[CARD MASKED]"),
)
MAX_PROMPT_LENGTH = 2000
INJECTION_MARKERS = r"(ignore|forget|disregard).*(instructions|above|previous)"


def _case_sensitive(pattern: str) -> str:
    body = pattern
    if pattern.startswith(r"\b"):
        # the check only runs next to a digit
        body = r"(?=\d)(?<!\w)" + pattern[2:-2] + r"(?!\w)"
    return to_java(body).replace("(?dium)", "(?d)", 1)


def mask_pii(text: Column) -> Column:
    """Replace CPF, CNPJ, e-mail and card numbers. Texts without digits or ``@`` are left as is."""
    masked = text
    for pattern, replacement in MASKS:
        masked = F.regexp_replace(masked, _case_sensitive(pattern), replacement)
    return F.when(text.rlike(r"\p{Nd}{3}|@"), masked).otherwise(text)


def mask_cpf(value: Column) -> Column:
    """Keep the last two digits; a value with fewer than two digits is masked whole."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(
        F.length(digits) >= 2, F.concat(F.lit("***.***.***-"), F.right(digits, F.lit(2)))
    ).otherwise(F.lit("***"))


def sanitize_prompt(text: Column, max_length: int = MAX_PROMPT_LENGTH) -> Column:
    """Cut to a length, drop instruction overrides and trim, as a prompt guard.

    The cut is what the function is for: it bounds what reaches a model.
    """
    cut = F.substring(text, 1, max_length)
    kept = F.regexp_replace(cut, "(?diu)" + INJECTION_MARKERS, "")
    return F.regexp_replace(kept, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def sanitize_markup(text: Column, max_length: int = MAX_PROMPT_LENGTH) -> Column:
    """Cut to a length and drop angle brackets."""
    return F.translate(F.substring(text, 1, max_length), "<>", "")
