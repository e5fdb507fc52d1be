"""Reading and rewriting values inside JSON text.

A path's names go down objects, numbers go to an array's element, and a name that meets an array goes to each of its
elements, through arrays of arrays too. Paths are dynamic (the documents, not the schema, decide where arrays are), which
no built-in expression covers; so these are Arrow functions over batches. Objects are written back with sorted keys and
without blanks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Path = tuple[str, ...]


class Number(str):
    """A number as it is written."""


def parse(text: str) -> Any:
    """Values of a JSON text; numbers stay as written. ValueError if it isn't JSON."""

    def no_constant(name: str) -> Any:
        raise ValueError(name)

    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=no_constant)


def dump(value: Any) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in sorted(value.items())) + "}"


def leaf_text(value: Any) -> str | None:
    """NULL for null, a string's or scalar's text, JSON for what holds others."""
    return None if value is None else str(value) if isinstance(value, str) else dump(value)


def places(value: Any, path: Path) -> Iterator[tuple[Any, Any]]:
    """(container, key) of every value a path leads to."""
    name, rest = path[0], path[1:]
    if isinstance(value, dict):
        keys = [name] if name in value else []
    elif isinstance(value, list):
        if name.isascii() and name.isdigit():
            keys = [int(name)] if int(name) < len(value) else []
        else:
            for item in value:
                if isinstance(item, (dict, list)):
                    yield from places(item, path)
            return
    else:
        return
    for key in keys:
        if rest:
            yield from places(value[key], rest)
        else:
            yield value, key


def targets(text: str | None, path: Path) -> list[str | None]:
    """Texts at a path; one NULL if there are none, the text is NULL or isn't JSON."""
    if text is None:
        return [None]
    try:
        value = parse(text)
    except (ValueError, RecursionError):
        return [None]
    return [leaf_text(box[key]) for box, key in places(value, path)] or [None]


def read(cell: Column, path: Path) -> Column:
    """``targets`` as an array of strings."""

    @F.pandas_udf("array<string>")
    def at(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: targets(t, path))

    return at(cell)


def written(old: Any, new: str | None, quoted: bool) -> Any:
    """The JSON value for a masked text where ``old`` was: of the old kind if the text can be, unless it is quoted."""
    if new is None:
        return None
    if not quoted:
        if isinstance(old, Number):
            try:
                return parse(new) if isinstance(parse(new), Number) else new
            except ValueError:
                return new
        if isinstance(old, bool) and new.lower() in ("true", "false", "1", "0"):
            return new.lower() in ("true", "1")
        if new in ("[]", "{}"):
            return [] if new == "[]" else {}
        if isinstance(old, (list, dict)):
            try:
                return parse(new)
            except ValueError:
                return new
    return new


def rewrite(text: str | None, rules: list[tuple[Path, Callable[[str | None], str | None], bool]]) -> tuple[str | None, int]:
    """The text with what the rules' functions give at their paths, and how many values were given one. A text that isn't
    JSON stays as it is."""
    if text is None:
        return None, 0
    try:
        value = parse(text)
    except (ValueError, RecursionError):
        return text, 0
    n = 0
    for path, mask, quoted in rules:
        for box, key in list(places(value, path)):
            old = box[key]
            box[key] = written(old, mask(leaf_text(old)), quoted)
            n += 1
    return (dump(value), n) if n else (text, 0)
