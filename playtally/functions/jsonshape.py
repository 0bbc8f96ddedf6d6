"""Breadth and depth of a JSON text, measured without parsing it (SQL text)."""

from __future__ import annotations

# A string literal, or an unterminated one up to the end of the text. Only
# possessive quantifiers: nothing to backtrack into, no stack growth.
_STRING_LITERAL = r"""r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)'"""
_NOT_STRUCTURE = r"""r'[^{}\[\],]++'"""


def skeleton(body: str) -> str:
    """The structural characters ``{ } [ ] ,`` that lie outside strings."""
    return f"regexp_replace(regexp_replace({body}, {_STRING_LITERAL}, ''), {_NOT_STRUCTURE}, '')"


def token_count(skel: str) -> str:
    return f"length({skel})"


def nesting(skel: str) -> str:
    """Deepest bracket nesting; a closer without opener does not count."""
    now = (
        "CASE WHEN ch IN ('{', '[') THEN a.now + 1"
        " WHEN ch IN ('}', ']') THEN greatest(a.now - 1, 0) ELSE a.now END"
    )
    return (
        f"aggregate(split(replace({skel}, ',', ''), ''),"
        " named_struct('now', 0, 'deepest', 0),"
        f" (a, ch) -> named_struct('now', {now}, 'deepest', greatest(a.deepest, {now})),"
        " a -> a.deepest)"
    )


def nesting_bound(skel: str) -> str:
    """A cheap upper bound of :func:`nesting`.

    Taking away every innermost pair lowers the nesting by at most one, and
    what is left cannot nest deeper than it has openers. For a flat list of
    events this is already tight.
    """
    rest = rf"""regexp_replace(replace({skel}, ',', ''), r'[{{\[][}}\]]', '')"""
    return rf"""(length(regexp_replace({rest}, r'[}}\]]', '')) + 1)"""
