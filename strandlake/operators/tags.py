"""Optional fields of SAM records as typed values: found by tag, looked up, made rows, pushed and printed.

A field is ``TAG:TYPE:VALUE``: A one ASCII character, i a number of 64 bits, f one of 32 bits, Z text, H an even count of
hexadecimal digits (in upper case once parsed), B an array of one of the subtypes c C s S i I f. Everything is native.

Cases: a null array of fields is null, an empty one has no tags. Of fields with the same tag the first is found. A lookup
raises where the field found is malformed, or where one before it has no colon, so that its tag is not known; fields after
it are not looked at. A null among the fields counts as one without a colon.

Expressions inside a lambda are interpreted, others are compiled. So lambdas only find the tags of a row, and hold the items
of array fields; a field's value is read where it is looked up, or in a row of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.sources.modes import judged, known

#: The least and greatest number of each integer subtype.
RANGES = {"c": (-(1 << 7), (1 << 7) - 1), "C": (0, (1 << 8) - 1), "s": (-(1 << 15), (1 << 15) - 1), "S": (0, (1 << 16) - 1), "i": (-(1 << 31), (1 << 31) - 1), "I": (0, (1 << 32) - 1)}

TYPES = "AifZHB"
_TAG, _REST = r"^[A-Za-z][A-Za-z0-9]\z", 1 << 30
_NO_COLON, _NO_VALUE, _UNSUPPORTED, _MALFORMED = "no colon", "no type and value", "unsupported type", "malformed value of type "
_SIGNED, _UNSIGNED = r"^[+-]?[0-9]+\z", r"^\+?[0-9]+\z"
_FLOAT = r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"
_NAN = r"(?i)^[+-]?nan\z"


def _tag(tag: str) -> str:
    if not re.fullmatch("[A-Za-z][A-Za-z0-9]", tag):
        raise ValueError(f"{tag!r} is no tag of a SAM field")
    return tag


def _float(text: Column) -> Column:
    return F.when(text.rlike(_NAN), F.lit(float("nan")).cast("float")).when(text.rlike(_FLOAT), text.try_cast("float"))


def _whole(subtype: str) -> Callable[[Column], Column]:
    form = _UNSIGNED if RANGES[subtype][0] == 0 else _SIGNED
    return lambda x: F.when(x.rlike(form) & x.try_cast("bigint").between(*RANGES[subtype]), x.try_cast("bigint"))


def _integer(text: Column) -> Column:
    return F.when(text.rlike(_SIGNED), text.try_cast("bigint"))


def _char(text: Column) -> Column:
    return F.when((F.octet_length(text) == 1) & (F.ascii(text) < 128), text)


def _hexadecimal(text: Column) -> Column:
    return F.when((F.length(text) % 2 == 0) & text.rlike(r"^[0-9A-Fa-f]*\z"), F.upper(text))


def _subtype(text: Column) -> Column:
    return F.substring_index(text, ",", 1)


def _numbers(text: Column, made: Callable[[Column, Column], Column]) -> Column:
    """What ``made`` makes of the subtype and the items of an array field; null where an item is null. The text is cut once."""

    def of(cut: Column) -> Column:
        return made(F.get(cut, F.lit(0)), F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))))

    return F.get(F.filter(F.transform(F.array(F.split(text, ",", -1)), of), lambda x: ~F.exists(x, lambda y: y.isNull())), F.lit(0))


def _whole_items(text: Column) -> Column:
    """The numbers of an array field of an integer subtype as bigint; null where one is malformed, and for other subtypes."""

    def made(subtype: Column, items: Column) -> Column:
        whole = F.lit(None).cast("array<bigint>")
        for name in RANGES:
            whole = F.when(subtype == name, F.transform(items, _whole(name))).otherwise(whole)
        return whole

    return _numbers(text, made)


def _float_items(text: Column) -> Column:
    return _numbers(text, lambda subtype, items: F.when(subtype == "f", F.transform(items, _float)))


def _is_sound(kind: Column, text: Column) -> Column:
    """Whether the text is a value of its type; null for unknown types."""
    return (
        F.when(kind == "Z", text.isNotNull())
        .when(kind == "i", _integer(text).isNotNull())
        .when(kind == "f", _float(text).isNotNull())
        .when(kind == "A", _char(text).isNotNull())
        .when(kind == "H", _hexadecimal(text).isNotNull())
        .when(kind == "B", F.when(F.startswith(text, F.lit("f")), _float_items(text).isNotNull()).otherwise(_whole_items(text).isNotNull()))
    )


def _value(kind: Column, text: Column) -> Column:
    """The value as a VARIANT, that of an array field as (subtype, items); null where it is malformed."""
    shown = lambda x: F.to_variant_object(F.struct(_subtype(text).alias("subtype"), x.alias("items")))
    array = lambda x: F.when(x.isNotNull(), shown(x))
    return (
        F.when(kind == "i", _integer(text).cast("variant"))
        .when(kind == "f", _float(text).cast("variant"))
        .when(kind == "A", _char(text).cast("variant"))
        .when(kind == "Z", text.cast("variant"))
        .when(kind == "H", _hexadecimal(text).cast("variant"))
        .when((kind == "B") & (_subtype(text) == "f"), array(_float_items(text)))
        .when(kind == "B", array(_whole_items(text)))
    )


def _member(p: Column) -> list[Column]:
    """The parts of a field, cut at its first two colons, as tag, type, value and fault."""
    tag, kind, text = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
    fault = (
        F.when(F.coalesce(F.size(p), F.lit(0)) < 2, _NO_COLON)
        .when(F.size(p) < 3, _NO_VALUE)
        .when(~tag.rlike(_TAG), "invalid tag")
        .when(~kind.isin(*TYPES), _UNSUPPORTED)
        .when(~_is_sound(kind, text), F.concat(F.lit(_MALFORMED), kind))
    )
    return [tag.alias("tag"), kind.alias("type"), _value(kind, text).alias("value"), fault.alias("fault")]


def members(fields: Column) -> Column:
    """All fields in their order as an array of (tag, type, value, fault); value is a VARIANT, and null where it is malformed.

    It is interpreted: for whole tables use ``rows``.
    """
    return F.transform(F.transform(fields, lambda x: F.split(x, ":", 3)), lambda p: F.struct(*_member(p)))


def parsed(fields: Column) -> Column:
    """(fields, tags): the fields, and the tag of each; ``:`` stands for that of a field without a colon.

    Select it as a column of its own and look tags up in that: the tags are found once a row.
    """
    tags = F.transform(fields, lambda x: F.when(F.contains(x, F.lit(":")), F.substring_index(x, ":", 1)).otherwise(F.lit(":")))
    return F.when(fields.isNotNull(), F.struct(fields.alias("fields"), tags.alias("tags")))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(field: Column, tag: str) -> tuple[Column, Column, Column]:
    """The first field with this tag, null if there is none; its value's text; whether one without a colon comes before."""
    at, broken = F.array_position(field["tags"], _tag(tag)), F.array_position(field["tags"], ":")
    found = F.get(field["fields"], F.nullif(at, F.lit(0)).cast("int") - 1)
    return found, F.substring(found, len(tag) + 4, _REST), (broken > 0) & ((at == 0) | (broken < at))


def fault(field: Column, tag: str) -> Column:
    """Why a lookup of this tag in a parsed column raises; null if it does not."""
    found, text, broken = _at(field, tag)
    kind = F.substring(found, len(tag) + 2, 1)
    typed = F.substring(found, len(tag) + 3, 1) == ":"
    return (
        F.when(broken, F.lit("a field without a colon comes before"))
        .when(found.isNull(), F.lit(None).cast("string"))
        .when(typed & kind.isin(*TYPES), F.when(~_is_sound(kind, text), F.concat(F.lit(_MALFORMED), kind)))
        .when(F.contains(F.substring(found, len(tag) + 2, _REST), F.lit(":")), _UNSUPPORTED)
        .otherwise(_NO_VALUE)
    )


def _lookup(field: Column, tag: str, kind: str, read: Callable[[Column], Column], strict: bool) -> Column:
    """What ``read`` makes of the text of a field of this type."""
    found, text, broken = _at(field, tag)
    value = F.when(F.startswith(found, F.lit(f"{tag}:{kind}:")) & ~broken, read(text))
    return _checked(value, field, tag, strict)


def _checked(value: Column, field: Column, tag: str, strict: bool) -> Column:
    """The value, null where there is a fault; with strict the fault of a null one raises."""
    if not strict:
        return value
    wrong = fault(field, tag)
    return F.coalesce(value, F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit(f"SAM field {tag}: "), wrong))))


def type_of(field: Column, tag: str, strict: bool = True) -> Column:
    """The type letter of a tag, null if there is none. This and the next ones look a tag up in a ``parsed`` column.

    They are null where the tag has another type. With strict a malformed field raises as the module says, else it is null.
    """
    return _checked(F.when(fault(field, tag).isNull(), F.substring(_at(field, tag)[0], len(tag) + 2, 1)), field, tag, strict)


def char(field: Column, tag: str, strict: bool = True) -> Column:
    return _lookup(field, tag, "A", _char, strict)


def integer(field: Column, tag: str, strict: bool = True) -> Column:
    return _lookup(field, tag, "i", _integer, strict)


def real(field: Column, tag: str, strict: bool = True) -> Column:
    return _lookup(field, tag, "f", _float, strict)


def string(field: Column, tag: str, strict: bool = True) -> Column:
    return _lookup(field, tag, "Z", lambda text: text, strict)


def hexadecimal(field: Column, tag: str, strict: bool = True) -> Column:
    return _lookup(field, tag, "H", _hexadecimal, strict)


def subtype(field: Column, tag: str, strict: bool = True) -> Column:
    return _lookup(field, tag, "B", lambda text: F.when(_is_sound(F.lit("B"), text), _subtype(text)), strict)


def items(field: Column, tag: str, kind: str = "bigint", strict: bool = True) -> Column:
    """The numbers of an array field: kind is ``bigint`` for the integer subtypes, ``float`` for f; null for the other one."""
    return _lookup(field, tag, "B", {"bigint": _whole_items, "float": _float_items}[kind], strict)


def rows(df: DataFrame, fields: str, keep: tuple[str, ...] = (), mode: str = "FAILFAST") -> DataFrame:
    """A row for each field: the kept columns, its place, tag, type and value (a VARIANT); malformed ones by the mode."""
    known(mode)
    taken = {c.lower() for c in keep} | {"at"}
    m = next(n for n in ("_member" + "_" * i for i in range(len(taken) + 1)) if n not in taken)
    each = df.select(*keep, F.posexplode(F.col(fields)).alias("at", m)).select(*keep, "at", F.split(m, ":", 3).alias(m))
    *columns, wrong = _member(F.col(m))
    return judged(each, wrong, [*map(F.col, keep), F.col("at"), *columns], mode, "SAM field")


def push(fields: Column, tag: str, shown: Column) -> Column:
    """The fields with one more at the end, printed by one of the functions below. A null value adds none; null fields are none yet."""
    more = F.concat(F.lit(_tag(tag) + ":"), shown)
    # both uses of the new field are always worked out, so that compiled code works it out once
    added = F.slice(F.array(more), F.lit(1), F.when(more.isNull(), 0).otherwise(1))
    return F.concat(F.coalesce(fields, F.array().cast("array<string>")), added)


def show_char(value: Column) -> Column:
    return F.when(_char(value).isNotNull(), F.concat(F.lit("A:"), value)).when(value.isNotNull(), F.raise_error("a field of type A is one ASCII character").cast("string"))


def show_integer(value: Column) -> Column:
    return F.concat(F.lit("i:"), value.cast("bigint").cast("string"))


def show_real(value: Column) -> Column:
    return F.concat(F.lit("f:"), shown_float(value))


def show_string(value: Column) -> Column:
    return F.concat(F.lit("Z:"), value)


def show_hexadecimal(value: Column) -> Column:
    return F.when(_hexadecimal(value).isNotNull(), F.concat(F.lit("H:"), F.upper(value))).when(value.isNotNull(), F.raise_error("a field of type H is an even count of hexadecimal digits").cast("string"))


def show_items(values: Column, subtype: str) -> Column:
    """An array field of this subtype; numbers outside the subtype's range, and nulls, raise."""
    bad = F.raise_error(f"an item is no number of subtype {subtype}").cast("string")
    if subtype == "f":
        shown = lambda x: F.coalesce(shown_float(x), bad)
    elif subtype in RANGES:
        shown = lambda x: F.when(x.cast("bigint").between(*RANGES[subtype]), x.cast("bigint").cast("string")).otherwise(bad)
    else:
        raise ValueError(f"{subtype!r} is no subtype; there are {', '.join([*RANGES, 'f'])}")
    return F.concat(F.lit("B:"), F.array_join(F.concat(F.array(F.lit(subtype)), F.transform(values, shown)), ","))


def shown_float(value: Column) -> Column:
    """The digits of a 32-bit number without an exponent, as the JVM prints them: 1.5, 1, 0.00001, inf, NaN."""

    def expanded(parts: Column) -> Column:  # of a mantissa's two sides and an exponent
        whole, power = F.ltrim(F.get(parts, F.lit(0)), F.lit("-")), F.get(parts, F.lit(2)).cast("int")
        digits = F.concat(whole, F.regexp_replace(F.get(parts, F.lit(1)), r"^0\z", ""))
        large = F.concat(F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, "0"), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substr(digits, power + 2, F.length(digits)))).otherwise(""))
        return F.concat(F.when(F.startswith(F.get(parts, F.lit(0)), F.lit("-")), "-").otherwise(""), F.when(power >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)))

    text = value.cast("float").cast("string")
    plain = F.regexp_replace(text, r"\.0\z", "")
    return F.when(F.contains(text, F.lit("E")), _bound(F.split(text, "[.E]"), expanded)).when(text == "Infinity", "inf").when(text == "-Infinity", "-inf").otherwise(plain)
