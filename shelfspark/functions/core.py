"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as Python's ``\s`` sees it.
WS = r"(?U)\s"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda that closes over an expression evaluates it per element; binding it
    as a lambda variable keeps array functions linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_ws(c: Column | str) -> Column:
    """White-space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), WS + "+", " "))


def strip_ws(c: Column) -> Column:
    """Unicode trim of both ends."""
    return F.regexp_replace(c, rf"^{WS}+|(?U)\s+$", "")


def trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def rtrim_chars(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def coalesce_fields(*cols: Column | str) -> Column:
    """First alias that is not blank, trimmed; ``''`` when all are blank."""
    return F.coalesce(*[blank_to_null(col(c).cast("string")) for c in cols], F.lit(""))


def to_float(c: Column | str) -> Column:
    """Tolerant number: null when the value does not read as one."""
    return F.trim(col(c).cast("string")).try_cast("double")


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return any_of([text.contains(p) for p in phrases])


def first_match(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """Group of the first pattern that matches, null when none does."""
    return F.coalesce(
        *[F.when(text.rlike(p), F.regexp_extract(text, p, group)) for p in patterns],
        F.lit(None).cast("string"),
    )


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def split_nonblank(text: Column, pattern: str) -> Column:
    return F.filter(
        F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != ""
    )


def compose(c: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    return reduce(lambda acc, step: step(acc), steps, c)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; wall-clock value for zone-less timestamps."""
    return F.unix_micros(col(ts).cast("timestamp"))
