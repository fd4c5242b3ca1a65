"""Tag expressions over the combined text of an event, as SQL texts.

Each rule set gives a few dozen expressions; as texts they are built in one step.
"""

from __future__ import annotations

from causeway.plans.once import literal
from causeway.rules import RECOVERY_PATTERN, RuleSet


def combine_text(columns: list[str]) -> str:
    """All texts joined by a blank; a null counts as the empty string and keeps its separator."""
    return "concat_ws(' ', " + ", ".join(f"coalesce(`{c}`, '')" for c in columns) + ")"


def matches(text: str, lowered: str, pattern: str, literals: tuple[str, ...] = ()) -> str:
    """Case-insensitive search; rows without any necessary literal skip the regular expression."""
    hit = f"{text} RLIKE {literal('(?i)' + pattern)}"
    if not literals:
        return hit
    possible = " OR ".join(f"contains({lowered}, {literal(word)})" for word in literals)
    return f"({possible}) AND {hit}"


def tag_flags(text: str, lowered: str, rules: RuleSet) -> dict[str, str]:
    return {t: matches(text, lowered, p, rules.literals.get(t, ())) for t, p in rules.patterns.items()}


def recovery_flag(text: str, lowered: str, rules: RuleSet) -> str:
    return matches(text, lowered, RECOVERY_PATTERN, rules.literals.get("recovery", ()))


def assemble_tags(flags: dict[str, str]) -> str:
    """The names of the true flags, in rule order."""
    names = ", ".join(f"IF(`{column}`, {literal(tag)}, NULL)" for tag, column in flags.items())
    return f"array_compact(array({names}))"
