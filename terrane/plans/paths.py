"""Field paths: ``.`` steps into a struct, ``!`` into the elements of an array.

``s1!.b!.c`` is field c of the elements of b in the elements of s1. The granularity of a path is all up to its last
``!``: fields of one granularity have a value for each row of the same exploded table.
"""

from __future__ import annotations

import difflib

STRUCT, ARRAY = ".", "!"
STRUCT_NAME, ARRAY_NAME = "__STRUCT__", "__ARRAY__"


def steps(path: str) -> list[str]:
    """Names and markers in order: s1!.b -> s1 ! b. Raises on a ``!`` that is followed by a name."""
    out: list[str] = []
    for part in path.split(STRUCT):
        name = part.rstrip(ARRAY)
        if ARRAY in name:
            raise ValueError(f"Invalid field name '{path}': '{ARRAY}' not followed by a '{STRUCT}'")
        out += [name] if name else []
        out += [ARRAY] * (len(part) - len(name))
    return out


def granularity(path: str) -> str:
    return path[: path.rfind(ARRAY) + 1]


def same_granularity(a: str, b: str) -> bool:
    return granularity(a) == granularity(b)


def same_granularity_as_any(path: str, others: list[str]) -> bool:
    return any(same_granularity(path, x) for x in others)


def is_sub_field(path: str, of: str) -> bool:
    """Whether ``path`` is inside ``of``."""
    return path != of and path.startswith(of) and (of.endswith(ARRAY) or path[len(of)] in (STRUCT, ARRAY))


def is_sub_field_or_equal(path: str, of: str) -> bool:
    return path == of or is_sub_field(path, of)


def is_sub_field_of_any(path: str, others: list[str]) -> bool:
    return any(is_sub_field(path, x) for x in others)


def is_sub_field_or_equal_to_any(path: str, others: list[str]) -> bool:
    return any(is_sub_field_or_equal(path, x) for x in others)


def is_parent_field(path: str, of: str) -> bool:
    return is_sub_field(of, path)


def is_parent_field_of_any(path: str, others: list[str]) -> bool:
    return any(is_parent_field(path, x) for x in others)


def before_last(text: str, mark: str) -> str:
    """All before the last mark; empty if there is none."""
    return text.rpartition(mark)[0]


def after_last(text: str, mark: str) -> str:
    """All after the last mark; the whole text if there is none."""
    return text.rpartition(mark)[2]


def array_prefixes(path: str) -> list[str]:
    """The arrays on the way, outermost first: s1!.b!.c -> s1!, s1!.b!."""
    return [path[: i + 1] for i, c in enumerate(path) if c == ARRAY]


def mangle(path: str) -> str:
    """The path as a plain column name."""
    return path.replace(ARRAY, ARRAY_NAME).replace(STRUCT, STRUCT_NAME)


def unmangle(name: str) -> str:
    return name.replace(ARRAY_NAME, ARRAY).replace(STRUCT_NAME, STRUCT)


def closest(name: str, known: list[str], most: int = 5) -> list[str]:
    """The known names most like ``name``."""
    return sorted(known, key=lambda k: -difflib.SequenceMatcher(None, name, k).ratio())[:most]
