"""Two-valued predicates over partition keys.

Every function returns a Boolean ``Column`` that is never null, so ``&``, ``|``
and ``~`` combine exactly as plain logic:

* a null key makes ``eq``, ``like`` and ``matches`` false, ``ne`` true and the
  orderings false; the negated forms of ``between``, ``in_list`` and ``like``
  are therefore true on it;
* the literal picks the comparison: text compares as text (``'12' < '2'``), a
  number compares as a number, exactly and at any length (``12 < 2`` is false).
  With ``permissive=True`` a key that is no number counts as null instead of failing.

``&`` and ``|`` need parentheses in Python: write ``(a) & ((b) | (c))``.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import Decimal

import pyspark.sql.functions as F
from pyspark.sql import Column

# For numbers with an exponent only: plain ones are compared digit by digit.
EXPONENTIAL = "decimal(38,18)"

Operand = Column | str | int | float | Decimal | None
NumberTest = Callable[[Column, Callable[[Operand], Column]], Column]

_ORDER = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _is_number(x: Operand) -> bool:
    return isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)


def _column(x: Operand) -> Column:
    if isinstance(x, Column):
        return x
    if x is None:
        return F.lit(None).cast("string")
    return F.lit(str(x))


def _ordered(plain: Column) -> Column:
    """A text that sorts as the plain decimal number does: sign, number of whole digits, digits; below zero
    every digit is turned round."""
    whole = F.regexp_extract(plain, r"^[+-]?0*(\d*)", 1)
    part = F.regexp_extract(plain, r"\.(\d*?)0*$", 1)
    size = F.concat(F.lpad(F.length(whole).cast("string"), 10, "0"), whole, F.lit("."), part)
    below = plain.startswith("-") & ((whole != "") | (part != ""))
    turned = F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit(":"))
    return F.when(below, turned).otherwise(F.concat(F.lit("1"), size))


def _ordered_literal(n: int | float | Decimal) -> str:
    """The same text for a literal."""
    sign, whole, _, part = re.fullmatch(r"(-?)0*(\d*)(\.(\d*?)0*)?", format(Decimal(str(n)), "f")).groups()
    size = f"{len(whole):010d}{whole}.{part or ''}"
    if sign and (whole or part):
        return "0" + size.translate(str.maketrans("0123456789", "9876543210")) + ":"
    return "1" + size


def _as_number(x: Operand, permissive: bool) -> Column:
    """The operand as an ordered text; null, or an error, for what is no number."""
    text = F.trim(_column(x))
    other = (text.try_cast(EXPONENTIAL) if permissive else text.cast(EXPONENTIAL)).cast("string")
    return F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), _ordered(text)).when(other.isNotNull(), _ordered(other))


def _is_long(x: Operand) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and -(1 << 63) <= x < 1 << 63


def _numeric(left: Operand, test: NumberTest, whole: bool, permissive: bool) -> Column:
    """A test of the left side as a number, false on null.

    With whole literals nearly every key is a whole number too, and those are
    compared as longs.
    """
    exact = test(_as_number(left, permissive), lambda n: F.lit(_ordered_literal(n)))
    if not whole:
        return F.coalesce(exact, F.lit(False))
    as_long = test(_column(left).try_cast("bigint"), lambda n: F.lit(n).cast("bigint"))
    return F.coalesce(as_long, exact, F.lit(False))


def _sure(condition: Column) -> Column:
    """Null to false, for tests no scan can answer; the key is computed once."""
    return F.coalesce(condition, F.lit(False))


def _known(condition: Column, *operands: Operand) -> Column:
    """Null to false as a conjunction, which scans over real key columns can take over."""
    for x in operands:
        if isinstance(x, Column):
            condition = x.isNotNull() & condition
    return condition


def eq(left: Operand, right: Operand, permissive: bool = False) -> Column:
    """Equal; two nulls are equal."""
    if _is_number(right):
        return _numeric(left, lambda a, lit: a == lit(right), _is_long(right), permissive)
    return _column(left).eqNullSafe(_column(right))


def ne(left: Operand, right: Operand, permissive: bool = False) -> Column:
    """Not equal; a null differs from every value."""
    return ~eq(left, right, permissive)


def compare(left: Operand, op: str, right: Operand, permissive: bool = False) -> Column:
    """``= == != <> < <= > >=`` by name."""
    if op in ("=", "=="):
        return eq(left, right, permissive)
    if op in ("!=", "<>"):
        return ne(left, right, permissive)
    order = _ORDER[op]
    if _is_number(right):
        return _numeric(left, lambda a, lit: order(a, lit(right)), _is_long(right), permissive)
    return _known(order(_column(left), _column(right)), left, right)


def between(
    left: Operand, low: Operand, high: Operand, negate: bool = False, permissive: bool = False
) -> Column:
    """Both bounds included."""
    if _is_number(low) and _is_number(high):
        whole = _is_long(low) and _is_long(high)
        inside = _numeric(left, lambda a, lit: (a >= lit(low)) & (a <= lit(high)), whole, permissive)
    else:
        inside = compare(left, ">=", low, permissive) & compare(left, "<=", high, permissive)
    return ~inside if negate else inside


def in_list(
    left: Operand, values: list[Operand], negate: bool = False, permissive: bool = False
) -> Column:
    """Member of the list; numbers compare by value, so ``1`` matches ``1.0``."""
    texts = [v for v in values if not _is_number(v)]
    numbers = [v for v in values if _is_number(v)]
    found = F.lit(False)
    if texts:
        known = [t for t in texts if t is not None]
        found = _known(_column(left).isin(known), left) if known else found
        if len(known) < len(texts):
            found = found | _column(left).isNull()
    if numbers:
        whole = all(_is_long(n) for n in numbers)
        found = found | _numeric(left, lambda a, lit: a.isin([lit(n) for n in numbers]), whole, permissive)
    return ~found if negate else found


# LIKE tokens and the regular expressions they stand for.
LIKE_TOKENS = {"[%]": "%", "[_]": "_", "[[]": "[", "%": ".*", "_": "."}


def like_regex(pattern: str) -> str:
    """Regular expression of a LIKE pattern; other metacharacters keep their regex meaning."""
    token = "|".join(re.escape(t) for t in LIKE_TOKENS)
    return re.sub(token, lambda m: LIKE_TOKENS[m.group()], pattern)


def matches(left: Operand, pattern: str, negate: bool = False) -> Column:
    """The whole text matches a regular expression."""
    found = _sure(_column(left).rlike(rf"\A(?:{pattern})\z"))
    return ~found if negate else found


def like(left: Operand, pattern: str, negate: bool = False) -> Column:
    """The whole text matches a LIKE pattern; a plain leading text also narrows the scan."""
    found = matches(left, like_regex(pattern))
    prefix = re.match(r"[A-Za-z0-9=/ -]*(?=%)", pattern)
    if prefix and prefix.group() and isinstance(left, Column):
        found = _known(left.startswith(prefix.group()), left) & found
    return ~found if negate else found


def is_null(left: Operand, negate: bool = False) -> Column:
    """The key has no value (or the default partition)."""
    column = _column(left)
    return column.isNotNull() if negate else column.isNull()


def truth(left: Operand | bool) -> Column:
    """A lone term: true only for the text ``true`` in any case."""
    if isinstance(left, bool):
        return F.lit(left)
    return _sure(F.lower(_column(left)) == "true")


# How a typed key reads its text, and which literals it takes.
_KEY_CASTS = {"string": "string", "integral": "bigint", "date": "date", "timestamp": "timestamp_ntz"}


def typed(left: Column, key_type: str, op: str, literal: object) -> Column:
    """Compare a key in its declared type; a literal of the wrong kind is refused at once."""
    fits = {
        "string": lambda v: isinstance(v, str),
        "integral": lambda v: isinstance(v, int) and not isinstance(v, bool),
        "date": lambda v: isinstance(v, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v),
        "timestamp": lambda v: isinstance(v, str)
        and re.fullmatch(r"\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d+)?)?", v),
    }
    if not fits[key_type](literal):
        raise ValueError(f"literal {literal!r} does not fit a key of type {key_type}")
    kind = _KEY_CASTS[key_type]
    a, b = left.cast(kind), F.lit(literal).cast(kind)
    if op in ("=", "=="):
        return a.eqNullSafe(b)
    if op in ("!=", "<>"):
        return ~a.eqNullSafe(b)
    return _known(_ORDER[op](a, b), a)


# How declared key types are read; any other type is text.
_DECLARED = {
    "integral": ("bigint", "int", "integer", "smallint", "tinyint"), "date": ("date",), "timestamp": ("timestamp",),
}


def typed_as(left: Column, declared: Column, op: str, literal: object, strict: bool = True) -> Column:
    """:func:`typed` with the key's declared type in a column, so that it may differ from row to row.

    False where nothing is declared.  A literal that is none of a row's type is an error, or with ``strict=False``
    false; one that fits no type at all is refused at once.
    """
    kind = F.lower(F.regexp_extract(declared, r"^\s*(\w+)", 1))
    branches, fitting = [], 0
    for key_type in (*_DECLARED, "string"):
        try:
            branches.append((key_type, typed(left, key_type, op, literal)))
            fitting += 1
        except ValueError:
            wrong = F.concat(F.lit(f"literal {literal!r} does not fit a key of type "), declared)
            branches.append((key_type, F.raise_error(wrong).cast("boolean") if strict else F.lit(False)))
    if not fitting:
        raise ValueError(f"literal {literal!r} fits no key type")
    out = F.when(declared.isNull(), False)
    for key_type, found in branches[:-1]:
        out = out.when(kind.isin(*_DECLARED[key_type]), found)
    return out.otherwise(branches[-1][1])


# Names that stand for a file's or partition's own times rather than for columns.
TIME_NAMES = ("dateCreated", "lastUpdated")

# How wide a number each integral column type holds.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def instant(number: int | Decimal) -> datetime:
    """An epoch number as a UTC time: seconds, milliseconds or microseconds, told apart by its size."""
    n = int(number)
    micros = n * 1_000_000 if abs(n) < 10**10 else n * 1000 if abs(n) < 10**13 else n
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def column_literal(kind: str, literal: object) -> Column:
    """A literal as a column of type ``kind`` takes it.

    Numbers lose their fraction for integral columns; a number too large for one, a number for a column that is none,
    and text for a number are refused.  Dates and times are written as text.
    """
    number = isinstance(literal, (int, float, Decimal)) and not isinstance(literal, bool)
    base = kind.partition("(")[0]
    if number and base in _BITS:
        whole = int(Decimal(str(literal)))
        if not -(1 << (_BITS[base] - 1)) <= whole < 1 << (_BITS[base] - 1):
            raise ValueError(f"{literal!r} is out of the range of {kind}")
        return F.lit(whole).cast(kind)
    if number and base in ("float", "double"):
        return F.lit(float(literal)).cast(kind)
    if number and base == "decimal":
        return F.lit(Decimal(str(literal)))
    if isinstance(literal, str) and base in ("string", "char", "varchar"):
        return F.lit(literal)
    if isinstance(literal, str) and base in ("date", "timestamp", "timestamp_ntz"):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d+)?)?", literal):
            raise ValueError(f"{literal!r} is no {kind}")
        return F.lit(literal).cast(kind)
    if isinstance(literal, bool) and base == "boolean":
        return F.lit(literal)
    raise ValueError(f"literal {literal!r} does not fit a column of type {kind}")


def column(df: DataFrame, name: str, op: str, literal: object, times: dict[str, str] | None = None) -> Column:
    """Compare a column of ``df``, found by its name in any case, with a literal in the column's own type.

    So the comparison reaches the scan, and statistics of files and row groups can answer it.  ``dateCreated`` and
    ``lastUpdated`` mean the time columns that ``times`` gives for them, compared with epoch numbers of any unit.
    Two-valued like all predicates here: a null is unequal to everything, and neither below nor above.  A name that
    is neither is refused.
    """
    if name in TIME_NAMES and times and name in times:
        found = times[name]
        if not isinstance(literal, (int, Decimal)) or isinstance(literal, bool):
            raise ValueError(f"{name} compares with an epoch number, not with {literal!r}")
        value = F.lit(instant(literal).isoformat(sep=" ")).cast(df.schema[found].dataType.simpleString())
    else:
        found = next((f.name for f in df.schema if f.name.lower() == name.lower()), None)
        if found is None:
            raise ValueError(f"{name} is neither a column nor one of {', '.join(TIME_NAMES)}")
        value = column_literal(df.schema[found].dataType.simpleString(), literal)
    c = F.col(f"`{found}`")
    if op in ("=", "=="):
        return c.isNotNull() & (c == value)
    if op in ("!=", "<>"):
        return c.isNull() | (c != value)
    return c.isNotNull() & _ORDER[op](c, value)


def column_between(df: DataFrame, name: str, low: object, high: object, times: dict[str, str] | None = None, negate: bool = False) -> Column:
    """Inclusive range of a column, see :func:`column`; negated, what lies below or above it."""
    if negate:
        return column(df, name, "<", low, times) | column(df, name, ">", high, times)
    return column(df, name, ">=", low, times) & column(df, name, "<=", high, times)
