"""Strictly typed access to members of JSON values held as VARIANT.

A plain cast would turn ``"5"`` into 5 and ``1.9`` into 1. Every accessor first
looks at the JSON type of the member and yields a fallback when it differs.
The builders return SQL text: they are mostly used inside lambdas over lists
of members, and one parsed text is far cheaper to plan than a Column tree.
"""

from __future__ import annotations


def let(var: str, value: str, result: str) -> str:
    """``result`` with ``var`` bound to ``value``, which is computed once."""
    return f"get(transform(array({value}), {var} -> {result}), 0)"


def member(value: str, name: str) -> str:
    """A member of an object, still as VARIANT; NULL when absent."""
    return f"try_variant_get({value}, '$.{name}', 'variant')"


def has_type(value: str, json_type: str) -> str:
    """TRUE or FALSE; absent members have no type, JSON null has type VOID."""
    return f"coalesce(schema_of_variant({value}) = '{json_type}', false)"


def is_integer(value: str) -> str:
    return has_type(value, "BIGINT")


def is_text(value: str) -> str:
    return has_type(value, "STRING")


def is_object(value: str) -> str:
    return f"coalesce(startswith(schema_of_variant({value}), 'OBJECT'), false)"


def integer(value: str, wrong: str = "NULL") -> str:
    """64-bit integer; NULL when absent, ``wrong`` when of another type."""
    return (
        f"CASE WHEN {value} IS NULL THEN CAST(NULL AS BIGINT)"
        f" WHEN schema_of_variant({value}) = 'BIGINT'"
        f" THEN try_variant_get({value}, '$', 'bigint')"
        f" ELSE CAST({wrong} AS BIGINT) END"
    )


def text(value: str, absent: str = "''", wrong: str = "''") -> str:
    """JSON string; fallbacks for an absent member and for another type."""
    return (
        f"CASE WHEN {value} IS NULL THEN CAST({absent} AS STRING)"
        f" WHEN schema_of_variant({value}) = 'STRING'"
        f" THEN try_variant_get({value}, '$', 'string')"
        f" ELSE CAST({wrong} AS STRING) END"
    )
