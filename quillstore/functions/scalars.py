"""Grammars of records, lists and numbers, Column to Column.

Everything here stays inside Catalyst.  Text is parsed with ``try_cast`` behind a regular expression that states the
grammar, because the casts of SQL engines accept more than is wanted.  Patterns end with ``\\z``: ``$`` would also
match before a final newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FLOAT_SEPARATOR, LIST_FLAG, LIST_SEPARATOR

BLANKS = " \t\f\x0b\n\r"
DECIMAL = r"([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
HEX = r"0[xX]([0-9a-fA-F]+[.]?[0-9a-fA-F]*|[.][0-9a-fA-F]+)"
HEX_FLOAT = HEX + r"[pP][+-]?[0-9]+"
FLOAT_MAX = 3.4028234663852886e38


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


# --- records -----------------------------------------------------------------------------------------------------


def has_equals(record) -> Column:
    return F.instr(col(record), "=") > 0


def record_key(record) -> Column:
    """What stands before the first ``=``; empty for a record without one.  A list flag is taken off."""
    key = F.when(has_equals(record), F.substring_index(col(record), "=", 1)).otherwise("")
    return F.when(is_list_key(key), F.substr(key, F.lit(2))).otherwise(key)


def record_value(record) -> Column:
    """What stands after the first ``=``; it may hold further ones."""
    r = col(record)
    return F.when(has_equals(r), F.substr(r, F.instr(r, "=") + 1)).otherwise("")


def is_list_key(key, flag: str = LIST_FLAG) -> Column:
    return F.startswith(col(key), F.lit(flag))


def query_id(key) -> Column:
    """The integer before the first dot, after an optional list flag; 0 if there is none."""
    return F.coalesce(F.regexp_extract(col(key), r"^\x01?([+-]?[0-9]+)[.]", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def query_id_literal(key: bytes | str) -> int:
    """The same for a literal key, so that a point lookup can prune partitions."""
    import re

    text = key.decode("utf-8", "replace") if isinstance(key, bytes) else key
    m = re.match(r"\x01?([+-]?[0-9]+)[.]", text)
    return int(m[1]) if m and -(2**63) <= int(m[1]) < 2**63 else 0


# --- lists -------------------------------------------------------------------------------------------------------


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def split_all(value, separator: str = LIST_SEPARATOR) -> Column:
    """Split, keeping every empty part; an empty text is one empty part."""
    return F.split(col(value), _quoted(separator), -1) if separator else F.array(col(value))


def split_any(value, separators: str) -> Column:
    """Split at any of several characters, keeping every empty part."""
    return F.split(col(value), "[" + "".join("\\" + c if not c.isalnum() else c for c in separators) + "]", -1)


def split_parts(value, separator: str) -> Column:
    """Split; an empty text has no part and one empty part at the end is dropped."""
    parts = split_all(value, separator)
    return F.when(col(value) == "", _empty_strings()).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def split_first(value, separator: str) -> Column:
    """One or two parts: before and after the first separator."""
    return F.split(col(value), _quoted(separator), 2)


def file_list(value) -> Column:
    """A list value of a record file: all parts are kept, sorted by bytes; an empty text is an empty list."""
    return F.when(col(value) == "", _empty_strings()).otherwise(F.array_sort(split_all(value)))


def inserted_list(value, truncate: bool = False) -> Column:
    """A list value given to insert: one empty part at the end is dropped, then sorted by bytes, then each element is
    cut at its first NUL if asked for."""
    parts = F.array_sort(split_parts(value, LIST_SEPARATOR))
    return F.transform(parts, until_nul) if truncate else parts


def text_list(value) -> Column:
    """A list value of a typed text file: one empty part at the end is dropped, the order is kept."""
    return split_parts(value, LIST_SEPARATOR)


def join_list(values, separator: str = LIST_SEPARATOR) -> Column:
    return F.array_join(col(values), separator)


def until_nul(value) -> Column:
    return F.substring_index(col(value), "\x00", 1)


def trim(value, characters: str = BLANKS) -> Column:
    return F.btrim(col(value), F.lit(characters))


def lowercase(value) -> Column:
    """ASCII letters only, as in the C locale."""
    return F.translate(col(value), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- numbers -----------------------------------------------------------------------------------------------------


def to_bool(value) -> Column:
    """``true`` in any case, or exactly ``1``."""
    return (lowercase(value) == "true") | (col(value) == "1")


def to_long(value) -> Column:
    """A leading integer with an optional minus; 0 if there is none or it does not fit."""
    return F.coalesce(F.regexp_extract(col(value), "^-?[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_integer(value) -> Column:
    return F.coalesce(F.regexp_extract(col(value), "^-?[0-9]+", 0).try_cast("int"), F.lit(0))


def _words(value, signs: str) -> Column:
    low = lowercase(value)
    infinite, none = F.lit(float("inf")), F.lit(float("nan"))
    return (
        F.when(low.rlike(rf"^[{signs}]?inf(inity)?\z") & ~F.startswith(low, F.lit("-")), infinite)
        .when(low.rlike(r"^-inf(inity)?\z"), -infinite)
        .when(low.rlike(rf"^[{signs}]?nan\z"), none)
    )


def try_double(value) -> Column:
    """The strict grammar: the whole text, no blanks, plus or hexadecimals; null if it is not a number or too large."""
    v = col(value)
    number = F.when(v.rlike(rf"^-?{DECIMAL}\z"), v.try_cast("double"))
    finite = F.when(F.abs(number) < float("inf"), number)
    return F.coalesce(_words(v, "-"), finite)


def to_double(value) -> Column:
    return F.coalesce(try_double(value), F.lit(0.0))


def to_double_lenient(value) -> Column:
    """As ``to_double``; then also leading blanks, a plus, hexadecimal numbers, and overflow to infinity."""
    v = col(value)
    bare = F.ltrim(v, F.lit(BLANKS))
    whole = F.when(bare.rlike(rf"^[+-]?{HEX}\z"), F.concat(bare, F.lit("p0"))).otherwise(bare)  # an exponent that Java asks for
    number = F.when(v.rlike(rf"^[ \t\n\x0B\f\r]*[+-]?({DECIMAL}|{HEX_FLOAT}|{HEX})\z"), whole.try_cast("double"))
    return F.coalesce(_words(v, "-"), _words(bare, "+-"), number, F.lit(0.0))


def to_number(value, default=None, normal: bool = False) -> Column:
    """A leading number; with ``normal`` infinities, NaN and subnormals do not count.  Without a default: null."""
    v = col(value)
    head = F.regexp_extract(v, rf"^-?{DECIMAL}", 0)
    number = F.when(head != "", head.try_cast("double"))
    number = F.when(F.abs(number) < float("inf"), number)
    word = F.regexp_extract(lowercase(v), "^-?(infinity|inf|nan)", 0)
    number = F.coalesce(number, F.when(word != "", _words(word, "-")))
    if normal:
        number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")) & ((number == 0) | (F.abs(number) >= 2.2250738585072014e-308)), number)
    return number if default is None else F.coalesce(number, F.lit(default).cast("double"))


def to_int32(value, default: int | None = None) -> Column:
    number = F.regexp_extract(col(value), "^-?[0-9]+", 0).try_cast("int")
    return number if default is None else F.coalesce(number, F.lit(default))


def to_int64(value, default: int | None = None) -> Column:
    number = F.regexp_extract(col(value), "^-?[0-9]+", 0).try_cast("bigint")
    return number if default is None else F.coalesce(number, F.lit(default).cast("bigint"))


def number_vector(value, separator: str = FLOAT_SEPARATOR, default: float | None = None, strict: bool = False, function=None) -> Column:
    """Numbers of a separated text, trimmed.  A bad token is null, the default, or an error.  With a function of one
    token instead, an empty tail is left out."""
    parts = F.when(col(value) == "", _empty_strings()).otherwise(split_all(value, separator))
    if function is not None:
        return F.transform(split_parts(value, separator), function)

    def parse(token):
        number = to_number(trim(token), default, normal=True)
        if strict and default is None:
            return F.coalesce(number, F.raise_error(F.concat(F.lit("not a number: "), token)).cast("double"))
        return number

    return F.transform(parts, parse)


def float_vector(value, strict: bool = False) -> Column:
    """What a float-list getter makes of a String: its numbers as floats; an empty text is an empty list."""
    return number_vector(value, strict=strict).cast("array<float>")


def dictionary_floats(value) -> Column:
    """Floats of a dictionary entry: bad tokens are 0, those beyond a float are left out."""
    numbers = F.transform(split_parts(value, FLOAT_SEPARATOR), lambda t: to_double(trim(t)))
    return F.filter(numbers, lambda x: (x >= -FLOAT_MAX) & (x <= FLOAT_MAX)).cast("array<float>")


def wrap32(value) -> Column:
    """A 64-bit integer cut to its low 32 bits, signed; a cast would raise."""
    return F.shiftright(F.shiftleft(col(value).cast("bigint"), 32), 32).cast("int")


def power_of_two_at_least(value) -> Column:
    v = col(value).cast("bigint")
    return F.when(v <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(v - 1))))
