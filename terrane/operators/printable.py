"""Functions that print as what they do, and their composition."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class PrintableFunction:
    """A function with a text that shows it; the text may be a function of the argument's text."""

    def __init__(self, func: Callable, text: str | Callable[[str], str]):
        self.func, self.text = func, text

    def __call__(self, *args):
        return self.func(*args)

    def show(self, argument: str = "x") -> str:
        return self.text(argument) if callable(self.text) else self.text

    def __repr__(self) -> str:
        return f"lambda x: {self.show('x')}" if callable(self.text) else self.text

    def boxed(self) -> PrintableFunction:
        return PrintableFunction(box(self.func), self.text)


def arity(func: Callable) -> int:
    """Number of positional arguments."""
    target = func.func if isinstance(func, PrintableFunction) else func
    return len([p for p in inspect.signature(target).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)])


def box(func: Callable) -> Callable[[Sequence], Any]:
    """Call with a scope: the function gets as many of its right-most values as it has arguments."""
    n = arity(func)
    return lambda scope: func(*(list(scope)[-n:] if n else []))


def compose(*functions: PrintableFunction) -> PrintableFunction:
    """compose(f, g)(x) = f(g(x)), also in print."""

    def run(x):
        for f in reversed(functions):
            x = f(x)
        return x

    def text(x: str) -> str:
        for f in reversed(functions):
            x = f.show(x)
        return x

    return PrintableFunction(run, text)


def alias(name: str) -> PrintableFunction:
    return PrintableFunction(lambda c: c.alias(name), lambda x: f"{x}.alias('{name}')")


def struct_get(key: str) -> PrintableFunction:
    """Field of a struct, or column of a DataFrame."""
    return PrintableFunction(lambda s: s[key] if isinstance(s, Column) else F.col(f"`{key}`"), lambda x: f"{x}['{key}']")


def recursive_struct_get(keys: Sequence[str]) -> PrintableFunction:
    return compose(*[struct_get(k) for k in reversed(list(keys))]) if keys else PrintableFunction(lambda x: x, lambda x: x)


def transform(func: PrintableFunction) -> PrintableFunction:
    """Each element of an array."""
    return PrintableFunction(lambda a: F.transform(a, lambda x: func(x)), lambda x: f"f.transform({x}, {func!r})")


def boxed_transform(func: Callable[[Sequence], Column]) -> Callable[[Sequence], Column]:
    """Each element of the scope's last value, with the element added to the scope."""
    return lambda scope: F.transform(scope[-1], lambda x: func([*scope, x]))
