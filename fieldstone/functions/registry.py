"""Named functions that hooks and access predicates refer to.

A hook maps a DataFrame of records to a DataFrame of records (use column
expressions, a pandas UDF or ``mapInPandas`` inside it) and keeps columns it
does not know.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FUNCTIONS: dict[str, Callable] = {}


class HookError(ValueError):
    """A hook that did not return records."""


def register(name: str, fn: Callable) -> Callable:
    """Make ``fn`` known under ``name``; a later registration replaces an earlier one."""
    if not callable(fn):
        raise TypeError(f"`{name}` is not callable")
    _FUNCTIONS[name] = fn
    return fn


def resolve(hook: str | Callable) -> Callable:
    if callable(hook):
        return hook
    if hook not in _FUNCTIONS:
        raise KeyError(f"function `{hook}` is not registered")
    return _FUNCTIONS[hook]


def apply_hooks(hooks: Iterable[str | Callable], records: DataFrame) -> DataFrame:
    """Run the hooks in order, each on the result of the one before."""
    for hook in hooks:
        records = resolve(hook)(records)
        if not isinstance(records, DataFrame):
            raise HookError(f"the result of hook `{hook}` must be records, got {type(records).__name__}")
    return records


def apply_read_hooks(hooks: Iterable[str | Callable], records: DataFrame, absent: dict) -> DataFrame:
    """Run read hooks on selected fields only; an unselected field reads as null."""
    hooks = tuple(hooks)
    if not hooks:
        return records
    keep = records.columns
    padded = records.withColumns({n: F.lit(None).cast(t) for n, t in absent.items() if n not in keep})
    return apply_hooks(hooks, padded).select(*keep)
