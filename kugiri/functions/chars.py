"""Character types, full-width normalisation and character arrays, as columns and for plain strings."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT, ROMAN, HIRAGANA, KATAKANA, KANJI, OTHER = range(1, 7)
CODES = {"D": DIGIT, "R": ROMAN, "H": HIRAGANA, "T": KATAKANA, "K": KANJI, "O": OTHER}
#: Ranges of code points, both ends included; everything else is OTHER.
RANGES = {
    DIGIT: [(0x30, 0x39), (0xFF10, 0xFF19)],
    ROMAN: [(0x41, 0x5A), (0x61, 0x7A), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    HIRAGANA: [(0x3040, 0x3096)],
    KATAKANA: [(0x30A0, 0x30FA), (0x30FC, 0x30FF), (0xFF66, 0xFF9F)],
    KANJI: [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F)],
}
_same = "".join(chr(x) for x in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))) + "(){}<>[]/_,%?+:!&*@="
_odd = {"-": "−", ".": "。", "~": "~", "～": "〜", "－": "ー", "―": "ー", "─": "ー", "–": "ー", '"': "”", "'": "’", "｢": "「", "｣": "」", "､": "、", "･": "・", "｡": "。"}
del _odd["~"]
FULLWIDTH = {c: chr(ord(c) + 65248) for c in _same} | _odd
WIDE_FROM, WIDE_TO = "".join(FULLWIDTH), "".join(FULLWIDTH.values())
_table = np.full(0x110000, OTHER, dtype=np.uint8)
for _type, _ranges in RANGES.items():
    for _a, _b in _ranges:
        _table[_a : _b + 1] = _type
_wide_table = _table.copy()
for _from, _to in FULLWIDTH.items():
    _wide_table[ord(_from)] = _table[ord(_to)]


def chars(text: Column) -> Column:
    """The characters as an array; of an empty text an empty one."""
    return F.when(F.length(text) > 0, F.split(text, "")).when(text.isNotNull(), F.array().cast("array<string>"))


def ngrams(units: Column, n: int) -> Column:
    """The n-grams of an array of strings, in order; none where it is shorter. Arrays are zipped, so it is linear in their length."""
    out = units
    for k in range(1, n):
        out = F.zip_with(F.slice(out, 1, F.greatest(F.size(units) - k, F.lit(0))), F.slice(units, k + 1, F.greatest(F.size(units) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    return out


def char_type(c: Column) -> Column:
    """The type, 1 to 6, of the first character."""
    code = F.ascii(c)
    out = reduce(lambda acc, tr: acc.when(reduce(lambda x, y: x | y, (code.between(a, b) for a, b in tr[1])), F.lit(tr[0])), RANGES.items(), F.when(c.isNull(), F.lit(None).cast("int")))
    return out.otherwise(F.lit(OTHER))


def char_types(text: Column) -> Column:
    return F.transform(chars(text), char_type)


def type_string(text: Column) -> Column:
    """The types as a string of digits, by one translation of classes: cheaper than an array where only patterns are wanted."""
    out = text
    for kind, ranges in RANGES.items():
        if kind != DIGIT:
            out = F.regexp_replace(out, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]", chr(0xE000 + kind))
    digits = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in RANGES[DIGIT])
    out = F.regexp_replace(out, f"[{digits}]", chr(0xE001))
    out = F.regexp_replace(out, "(?s)[^\\x{E001}-\\x{E005}]", chr(0xE006))
    return F.translate(out, "".join(chr(0xE000 + k) for k in range(1, 7)), "123456")


def fullwidth(text: Column) -> Column:
    """Half-width characters by their full-width ones, one for one, so that boundaries and tags carry over by position."""
    return F.translate(text, WIDE_FROM, WIDE_TO)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def types_of(points: np.ndarray) -> np.ndarray:
    return _table[points]


def types_of_wide(points: np.ndarray) -> np.ndarray:
    """types_of() of the full-width characters."""
    return _wide_table[points]


def widened(text: str, _map=str.maketrans(FULLWIDTH)) -> str:
    return text.translate(_map)


def sql_type(c: str) -> str:
    """char_type() in SQL with ord()."""
    return "CASE " + " ".join("WHEN " + " OR ".join(f"ord({c}) BETWEEN {a} AND {b}" for a, b in r) + f" THEN {t}" for t, r in RANGES.items()) + f" ELSE {OTHER} END"


def sql_fullwidth(c: str) -> str:
    q = lambda s: s.replace("'", "''")
    return f"translate({c}, '{q(WIDE_FROM)}', '{q(WIDE_TO)}')"
