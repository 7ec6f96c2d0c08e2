"""Chat formatting: schema fingerprints select declarative mappings from many layouts to canonical turns.

A layout's field paths (lower case, [] for the elements of an array) that some mapping knows are hashed, in order; the hash is
the fingerprint. One that is a mapping's own selects it. Of a layout with further known paths, the fingerprints of its subsets
are looked up: the mapping with the most paths counts, of equal ones the first in ALL. A mapping says where the turns are and
whose they are, and nothing else; the same mapping is run as Spark expressions over a table's columns and, for rows of JSON of
whatever layout each, in Arrow batches.

Canonical turns have a role of system, user, assistant or tool and a content that isn't empty; content in parts is their texts,
a blank line between. Fields that the mapping doesn't name are ignored, so tables may have further columns of any name. A table
without a mapping is an error, a JSON row without one has null layout and null turns, as has a null or malformed one; a layout
whose fields are all null or empty has no turns. Roles that aren't known are kept in lower case, a null role is user; where a
layout has no roles, user and assistant take turns. Rows of one turn each are brought together by conv_id, in the order of turn
(null first), role and text; rows that repeat wholly count once, a conversation without any content has no turns, and rows with
a null conv_id are left out. An empty table gives no rows. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

ROLES = {"human": "user", "prompter": "user", "instruction": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "ai": "assistant", "developer": "system", "function": "tool", "observation": "tool"}
OPEN, CLOSE = "<|", "|>"
ALTERNATE, PARTS = "~", "[].text"


@dataclass(frozen=True)
class Mapping:
    """turns: (role, fields of one turn) in order; a role that begins with @ is the field that holds it, ALTERNATE stands for none. each: the array whose elements have the turns; a field that ends in PARTS is an array of structs of text. rows: the table has a row a turn. before: turns ahead of those of each."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    each: str = ""
    rows: bool = False
    before: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def paths(self) -> list[str]:
        own = [f for role, fields in self.turns for f in (*fields, *((role[1:],) if role[0] == "@" else ()))]
        out = [f"{self.each}[].{f}" for f in own] if self.each else own
        return sorted({*out, *(f for _, fields in self.before for f in fields), *(("conv_id", "turn") if self.rows else ())})


SYSTEM = (("system", ("system",)),)
_plain = [
    ("instruction and input", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    ("instruction", (("user", ("instruction",)), ("assistant", ("output",)))),
    ("instruction and context", (("user", ("instruction", "context")), ("assistant", ("response",)))),
    ("instruction and response", (("user", ("instruction",)), ("assistant", ("response",)))),
    ("prompt and completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    ("prompt and response", (("user", ("prompt",)), ("assistant", ("response",)))),
    ("prompt and chosen", (("user", ("prompt",)), ("assistant", ("chosen",)))),
    ("question and answer", (("user", ("question",)), ("assistant", ("answer",)))),
    ("question and response", (("user", ("question",)), ("assistant", ("response",)))),
]
_each = [("messages", "messages", "role", "content"), ("conversations", "conversations", "from", "value"), ("conversation", "conversation", "role", "content"), ("dialogue", "dialogue", "speaker", "text"), ("turns", "turns", "role", "text")]
_arrays = [
    *((n, e, f"@{r}", c) for n, e, r, c in _each),
    *((n + ", parts", e, f"@{r}", c + PARTS) for n, e, r, c in _each),
    *((n + ", no roles", e, ALTERNATE, c) for n, e, _, c in _each),
    *((n + ", no roles, parts", e, ALTERNATE, c + PARTS) for n, e, _, c in _each),
]
#: In the order of precedence among mappings of as many paths.
ALL = [
    Mapping("turn rows", (("@role", ("text",)),), rows=True),
    Mapping("turn rows, content", (("@role", ("content",)),), rows=True),
    *(Mapping(n + ", system", ((r, (c,)),), each=e, before=SYSTEM) for n, e, r, c in _arrays),
    *(Mapping(n, ((r, (c,)),), each=e) for n, e, r, c in _arrays),
    *(Mapping(n + ", system", (*SYSTEM, *t)) for n, t in _plain),
    *(Mapping(n, t) for n, t in _plain),
]
KNOWN = frozenset(p for m in ALL for p in m.paths())


def hashed(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()


MAPPINGS = {hashed(m.paths()): m for m in ALL}


@lru_cache(maxsize=10_000)
def selected(paths: frozenset[str], rows: bool = True) -> Mapping | None:
    """The mapping of a layout of these paths; rows: also those of a row a turn."""
    exact = MAPPINGS.get(hashed(paths))
    if exact and (rows or not exact.rows):
        return exact
    held = [m for f, m in MAPPINGS.items() if hashed(paths.intersection(m.paths())) == f and (rows or not m.rows)]
    if held:
        return max(held, key=lambda m: (len(m.paths()), -ALL.index(m)))
    return next((m for m in ALL if m.each and not m.before and m.each + "[]" in paths), None)  # an array without elements


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def value_paths(value: Any, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k.lower()}" if at else k.lower())}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(schema: T.StructType) -> str:
    return hashed(schema_paths(schema))


def role_column(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("user"))))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[low], low)


def canonical(df: DataFrame) -> DataFrame:
    """The table with a column layout and a column turns, array of (role, content), in place of the layout's own; of rows of one turn each, (conv_id, layout, turns)."""
    mapping = selected(frozenset(schema_paths(df.schema)))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {sorted(set(schema_paths(df.schema)) & KNOWN)}")
    real = {c.lower(): c for c in df.columns}

    def turn(role: str, fields: tuple[str, ...], get, at: Column | None = None) -> Column:
        who = F.when(at % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")) if role == ALTERNATE else role_column(get(role[1:])) if role[0] == "@" else F.lit(role)
        texts = [get(f) for f in fields]
        some = [F.when(F.length(t) > 0, t) for t in texts]
        return F.struct(who.alias("role"), F.concat_ws("\n\n", *some).alias("content"))

    if mapping.rows:
        (role, (field,)), = mapping.turns
        rows = df.select(F.col(real["conv_id"]).alias("conv_id"), F.col(real["turn"]).alias("turn"), turn(role, (field,), lambda f: F.col(real[f]).cast("string")).alias("t")).where("conv_id is not null").distinct()
        got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("t.role").alias("role"), F.col("t.content").alias("content")))).alias("turns"))
        filled = F.filter("turns", lambda x: F.length(x.content) > 0)
        return got.select("conv_id", F.lit(mapping.name).alias("layout"), F.transform(filled, lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("turns"))
    top = lambda f: F.col(f"`{real[f]}`").cast("string")
    turns = F.array(*(turn(r, f, top) for r, f in (mapping.before if mapping.each else mapping.turns)))
    if mapping.each:
        (role, fields), = mapping.turns
        inner = {f.name.lower(): f for f in df.schema[real[mapping.each]].dataType.elementType.fields}

        def of(x: Column, f: str) -> Column:
            name = f.removesuffix(PARTS)
            if f == name:
                return x[inner[f].name].cast("string")
            own = next(p.name for p in inner[name].dataType.elementType.fields if p.name.lower() == "text")
            return F.array_join(F.filter(F.transform(x[inner[name].name], lambda p: p[own].cast("string")), lambda t: F.length(t) > 0), "\n\n")

        parts = F.transform(F.col(f"`{real[mapping.each]}`"), lambda x, i: turn(role, fields, lambda f: of(x, f), i))
        turns = F.concat(turns, F.coalesce(parts, F.array())) if mapping.before else F.coalesce(parts, F.array().cast("array<struct<role string, content string>>"))
    used = {p.split("[")[0].split(".")[0] for p in mapping.paths()}
    rest = [f"`{c}`" for c in df.columns if c.lower() not in used | {"layout", "turns"}]
    return df.select(*rest, F.lit(mapping.name).alias("layout"), F.filter(turns, lambda x: F.length(x.content) > 0).alias("turns"))


def text_of(value: Any) -> str:
    """The text of a field, or those of its parts."""
    if isinstance(value, list):
        return "\n\n".join(filter(None, map(text_of, value)))
    if isinstance(value, dict):
        return text_of(next((v for k, v in value.items() if k.lower() == "text"), None))
    return "" if value is None else str(value)


def json_turns(record: Any) -> tuple[str | None, list[dict] | None]:
    """The layout and the turns of one JSON value."""
    if not isinstance(record, dict) or (mapping := selected(frozenset(value_paths(record)), False)) is None:
        return None, None

    def read(mapped, source: dict, at: int = 0) -> list[dict]:
        low, out = {k.lower(): v for k, v in source.items()}, []
        for role, fields in mapped:
            text = "\n\n".join(filter(None, (text_of(low.get(f.removesuffix(PARTS))) for f in fields)))
            who = ("user", "assistant")[at % 2] if role == ALTERNATE else str(low.get(role[1:]) or "user").strip().lower() if role[0] == "@" else role
            if text:
                out.append({"role": ROLES.get(who, who), "content": text})
        return out

    if not mapping.each:
        return mapping.name, read(mapping.turns, record)
    parts = next((v for k, v in record.items() if k.lower() == mapping.each), None) or []
    return mapping.name, read(mapping.before, record) + [t for i, x in enumerate(parts) if isinstance(x, dict) for t in read(mapping.turns, x, i)]


def canonical_json(column: Column) -> Column:
    """A struct of layout and turns of a column of JSON records, each of its own layout."""

    def run(rows: pa.Array) -> pa.Array:
        layouts, turns = [], []
        for r in rows.to_pylist():
            try:
                got = json_turns(json.loads(r)) if r else (None, None)
            except (ValueError, RecursionError):
                got = None, None
            layouts.append(got[0])
            turns.append(got[1])
        return pa.StructArray.from_arrays([pa.array(layouts, pa.string()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())])))], ["layout", "turns"])

    return F.arrow_udf(run, "struct<layout string, turns array<struct<role string, content string>>>")(column)


def rendered(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(CLOSE + "\n"), t.content, F.lit("\n"))), "")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    got = canonical(core.table(spark, sf_dir, "conversations"))
    return got.select("conv_id", "layout", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t.role), ",").alias("roles"), rendered(F.col("turns")).alias("chat"))


_cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items())
SQL = f"""
WITH r AS (SELECT conv_id, turn, lower(trim(coalesce(role, 'user'))) AS low, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT DISTINCT conv_id, turn, CASE low {_cases} ELSE low END AS role, text FROM r)
SELECT conv_id, 'turn rows' AS layout, count(*) FILTER (text <> '') AS n_turns, coalesce(string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (text <> ''), '') AS roles,
       coalesce(string_agg('{OPEN}' || role || '{CLOSE}' || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) FILTER (text <> ''), '') AS chat
FROM t GROUP BY conv_id
"""
