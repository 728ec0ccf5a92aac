"""The Rule record shared by every rule set."""

from __future__ import annotations

from dataclasses import dataclass

# Code points reserved for internal use that a rewriting of a text puts for others (``Rule.prepare``).
LIVE_BRACE, DEAD_F, DEAD_QUOTE = "\ufdd4", "\ufdd5\ufdd7", "\ufdd6"  # DEAD_F: f and F


@dataclass(frozen=True)
class Rule:
    """One pattern with the metadata its findings carry.

    Rules are listed in discovery order, and the position in the list is the ``rule_no`` that
    orders findings inside a unit. Several patterns may share a ``rule_id``.

    ``needs`` drives the cheap prefilter: it lists groups of lower-case strings, and a unit that
    lacks all strings of any one group cannot match. A string that ends in one of ``(=:+`` stands
    for its word followed by white space and that sign. ``engine_pattern`` and ``probe`` replace the
    pattern by a linear-time form with the same match start where the plain one backtracks over
    the whole unit (see ``operators.matching``). With ``check`` the engine pattern also takes what
    the pattern does not match, and every hit is checked against the pattern. ``not_after`` are words
    none of which may follow a hit anywhere in the unit: one number tells that for all hits.
    ``prepare`` names a rewriting of the text, of the same length, that the engine pattern is for
    (``functions.text.PREPARED``).
    """

    rule_id: str
    title: str
    severity: str
    category: str
    pattern: str
    description: str
    confidence: float
    description_pt: str = ""
    recommendation: str = ""
    recommendation_pt: str = ""
    fix_example: str = ""
    owasp_id: str | None = None
    owasp_name: str | None = None
    owasp_url: str | None = None
    references: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    detected_by: str = "regex"
    # where the rule applies
    languages: tuple[str, ...] = ()
    # how it is matched
    kind: str = "regex"  # regex, tool (severity depends on the hit) or concat (see operators.concat)
    dotall: bool = False
    needs: tuple[tuple[str, ...], ...] = ()
    engine_pattern: str | None = None
    probe: str | None = None
    check: bool = False
    not_after: str | None = None
    prepare: str | None = None
    # what happens to a match
    context: str = "none"  # see functions.text.CONTEXT_FILTERS
    value_filter: str = "none"  # none, pii or secret
    before: int = 2
    after: int = 2
    column: bool = False
