"""SQL text for expressions over arrays of nodes.

An expression that is built from Python columns asks the JVM for each of its
parts; where there are thousands of them, text is parsed in a fraction of the time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from folio.functions.text import JAVA_WHITE

_RUNS = f"[{JAVA_WHITE.replace(' ', '', 1)}][{JAVA_WHITE}]*| [{JAVA_WHITE}]+"
_names = count()


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fresh() -> str:
    """A name for a lambda's variable that no other has."""
    return f"v{next(_names)}"


def let(x: str, body: Callable[[str], str]) -> str:
    """``body`` of ``x``, which is worked out once however often it is named."""
    v = fresh()
    return f"transform(array({x}), {v} -> {body(v)})[0]"


def transform(items: str, body: Callable[..., str], index: bool = False) -> str:
    v, i = fresh(), fresh()
    return f"transform({items}, ({v}, {i}) -> {body(v, i)})" if index else f"transform({items}, {v} -> {body(v)})"


def where(items: str, test: Callable[..., str], index: bool = False) -> str:
    v, i = fresh(), fresh()
    return f"filter({items}, ({v}, {i}) -> {test(v, i)})" if index else f"filter({items}, {v} -> {test(v)})"


def rank(places: str, place: str) -> str:
    """How many of the ascending ``places`` come before ``place``, by halving."""
    s, i = fresh(), fresh()
    middle = f"shiftright({s}.lo + {s}.hi, 1)"
    return (
        f"aggregate(sequence(1, 31), named_struct('lo', 0, 'hi', size({places})), ({s}, {i}) -> CASE WHEN {s}.lo >= {s}.hi THEN {s} "
        f"WHEN get({places}, {middle}) < {place} THEN named_struct('lo', {middle} + 1, 'hi', {s}.hi) ELSE named_struct('lo', {s}.lo, 'hi', {middle}) END).lo"
    )


def first(items: str) -> str:
    return f"get({items}, 0)"


def one_of(x: str, values: Iterable[str]) -> str:
    """Null where ``x`` is null, which every test here takes for false."""
    return f"({x} IN ({', '.join(quoted(v) for v in sorted(values))}))"


def full(x: str) -> str:
    """Null for an empty string."""
    return f"nullif({x}, '')"


def normal(x: str) -> str:
    """White space normalised, as :func:`folio.functions.text.normalize_text` does it."""
    return f"trim(regexp_replace(coalesce({x}, ''), r'{_RUNS}', ' '))"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields.items()) + ")"


def with_fields(x: str, fields: dict[str, str], names: Iterable[str]) -> str:
    """A struct of ``x``'s fields ``names`` and more."""
    return "named_struct(" + ", ".join([f"'{n}', {x}.`{n}`" for n in names] + [f"'{n}', {v}" for n, v in fields.items()]) + ")"
