"""The workflow expression language's semantics as Column expressions.

They differ from SQL: concatenation skips nulls, division is always true
division, modulo takes the sign of the divisor, equality is two-valued,
truthiness follows emptiness, and lists are indexed from 0 or from the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(c: Column, kind: str) -> Column:
    """A value as the language prints it; null prints as nothing."""
    if kind == "boolean":
        return F.when(c.isNull(), "").otherwise(F.when(c, "True").otherwise("False"))
    if kind in ("double", "float"):
        plain = c.cast("double")
        whole = (plain == F.floor(plain)) & (F.abs(plain) < 1e15)
        return F.when(c.isNull(), "").when(whole, F.concat(plain.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(plain.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def join_text(*parts: tuple[Column, str]) -> Column:
    """The ++ operator over (column, type name) pairs."""
    return F.concat(*[text_of(c, kind) for c, kind in parts])


def divide(a: Column, b: Column) -> Column:
    """True division; a zero divisor raises (also without ANSI mode)."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(a.cast("double") / F.when(b != 0, b.cast("double")))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def same(a: Column, b: Column) -> Column:
    """Equality that is never null: null equals null and nothing else."""
    return a.eqNullSafe(b)


def ordered(a: Column, b: Column, op: str) -> Column:
    """A comparison (<, <=, >, >=) that raises on a null operand."""
    result = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("comparison with null"))).otherwise(result)


def truthy(c: Column, kind: str) -> Column:
    """False for null, zero, false and anything empty."""
    if kind == "boolean":
        full = c
    elif kind == "string":
        full = F.length(c) > 0
    elif kind in ("array", "map"):
        full = F.size(c) > 0
    else:
        full = c != 0
    return F.coalesce(full, F.lit(False))


def both(a: Column, b: Column) -> Column:
    """&& on truth values; the right side counts only where the left holds."""
    return F.when(a, b).otherwise(False)


def either(a: Column, b: Column) -> Column:
    return F.when(a, True).otherwise(b)


def item(values: Column, index: Column) -> Column:
    """values[index], from 0 or, negative, from the end; a miss raises."""
    at = F.when(index >= 0, index + 1).otherwise(index)
    inside = (index < F.size(values)) & (index >= -F.size(values))
    return F.when(inside, F.try_element_at(values, at.cast("int"))).otherwise(F.raise_error(F.lit("index out of range")))


def entry(values: Column, key: Column) -> Column:
    """values[key] of a map; a missing key raises, a null value does not."""
    return F.when(F.map_contains_key(values, key), F.try_element_at(values, key)).otherwise(F.raise_error(F.lit("no such key")))


def input_value(inputs: Column, field: str, *path: str, loop: tuple[str, Column] | None = None) -> Column:
    """$.field.a.b over a map of inputs: the variable of a foreach (name,
    value) hides an input of its name; an input that is missing raises, and so
    does a property of null or one that is not there. The values of a longer
    path are JSON texts of objects."""
    found = loop[1] if loop and loop[0] == field else entry_or(inputs, field, f"input parameter '{field}' not found")
    return _walk(found, f"$.{field}", path)


def step_value(outputs: Column, step: str, attribute: str, *path: str) -> Column:
    """step.attribute.a.b over a map of a step's outputs: an attribute that is
    missing or null raises."""
    name = f"{step}.{attribute}"
    found = entry_or(outputs, attribute, f"{name} not found")
    return _walk(F.when(found.isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(found), name, path)


def entry_or(values: Column, key: str, message: str) -> Column:
    return F.when(F.map_contains_key(values, key), F.try_element_at(values, F.lit(key))).otherwise(F.raise_error(F.lit(message)))


def _walk(value: Column, name: str, path: tuple[str, ...]) -> Column:
    for part in path:
        fields = F.from_json(value, "map<string,string>")
        inner = entry_or(fields, part, f"{name} has no property '{part}'")
        value = F.when(value.isNull(), F.raise_error(F.lit(f"property '{part}' of null {name}"))).otherwise(inner)
        name = f"{name}.{part}"
    return value


def list_literal(*items: Column) -> Column:
    return F.array(*items)


def map_literal(pairs: list[tuple[str, Column]]) -> Column:
    """A map; of a key given twice the last value counts."""
    return F.create_map(*[x for k, v in dict(pairs).items() for x in (F.lit(k), v)])


def with_defaults(given: Column, defaults: dict[str, Column]) -> Column:
    """Fill parameters by presence, not nullness: a map of given arguments over
    a map of defaults. A given null stays null."""
    base = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v)])
    missing = F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(missing, given)
