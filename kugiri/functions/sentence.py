"""Annotated sentences: the three text formats, their errors, and the sentence column.

A sentence is a struct of text, boundaries (n - 1 marks: 0 none, 1 word boundary, 2 unknown) and tags (for each character an
array of tags, null where it ends no tagged word), all tags padded to n_tags. What can't be parsed is a null sentence; the
error column has the message. A null line is a null sentence without an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import chars

NONE, WORD, UNKNOWN = 0, 1, 2
SENTENCE = "struct<text string, boundaries array<int>, tags array<array<string>>, n_tags int, error string>"
_arrow = pa.struct([("text", pa.string()), ("boundaries", pa.list_(pa.int32())), ("tags", pa.list_(pa.list_(pa.string()))), ("n_tags", pa.int32()), ("error", pa.string())])


class InvalidArgument(ValueError):
    def __init__(self, argument: str, message: str):
        super().__init__(f"InvalidArgumentError: {argument}: {message}")


@dataclass
class Sentence:
    text: str
    boundaries: list[int]
    tags: list[list[str | None] | None] = field(default_factory=list)
    n_tags: int = 0

    def tokens(self) -> list[tuple[int, int]]:
        """Spans between word boundaries, those with an unknown mark inside left out."""
        out, start, whole = [], 0, True
        for i, b in enumerate([*self.boundaries, WORD]):
            if b == WORD:
                if whole:
                    out.append((start, i + 1))
                start, whole = i + 1, True
            elif b == UNKNOWN:
                whole = False
        return out

    def tags_at(self, i: int) -> list[str | None]:
        return (self.tags[i] if self.tags else None) or [None] * self.n_tags

    def padded(self) -> Sentence:
        self.n_tags = max([0, *(len(t) for t in self.tags if t)])
        self.tags = [None if t is None else t + [None] * (self.n_tags - len(t)) for t in self.tags]
        return self


def _checked(argument: str, text: str) -> None:
    if not text:
        raise InvalidArgument(argument, "must contain at least one character")
    if "\0" in text:
        raise InvalidArgument(argument, "must not contain NULL")


def parse_raw(text: str) -> Sentence:
    _checked("text", text)
    return Sentence(text, [UNKNOWN] * (len(text) - 1), [None] * len(text))


def parse_tokenized(line: str) -> Sentence:
    """Words apart by blanks, tags behind slashes, a backslash before a character that is meant as such."""
    arg = "tokenized_text"
    _checked(arg, line)
    text: list[str] = []
    marks: list[int] = []
    tags: list[list[str | None] | None] = []
    tag: list[str] | None = None
    word = escaped = False
    for c in line:
        if not escaped and c == "\\":
            escaped = True
        elif not escaped and c == " ":
            if not text:
                raise InvalidArgument(arg, "must not start with a whitespace")
            if not word:
                raise InvalidArgument(arg, "must not contain consecutive whitespaces")
            word, tag = False, None
        elif not escaped and c == "/":
            if not word:
                raise InvalidArgument(arg, "a slash must follow a character")
            tag = []
            tags[-1] = [*(tags[-1] or []), None]
        else:
            escaped = False
            if tag is not None:
                tag.append(c)
                tags[-1][-1] = "".join(tag)
            else:
                if text:
                    marks.append(NONE if word else WORD)
                text.append(c)
                tags.append(None)
                word = True
    if not text:
        raise InvalidArgument(arg, "must contain at least one character")
    if not word:
        raise InvalidArgument(arg, "must not end with a whitespace")
    return Sentence("".join(text), marks, tags).padded()


def parse_partial(line: str) -> Sentence:
    """Characters and marks by turns: - none, | boundary, blank unknown; tags behind slashes after a character."""
    arg = "partial_annotation_text"
    _checked(arg, line)
    text: list[str] = []
    marks: list[int] = []
    tags: list[list[str | None] | None] = []
    i, n = 0, len(line)
    while i < n:
        text.append(line[i])
        tags.append(None)
        i += 1
        while i < n and line[i] == "/":
            i += 1
            tag = []
            while i < n and line[i] not in " -|/":
                i += line[i] == "\\" and i + 1 < n
                tag.append(line[i])
                i += 1
            tags[-1] = [*(tags[-1] or []), "".join(tag) or None]
        if i < n:
            if line[i] not in "-| ":
                raise InvalidArgument(arg, f"contains an invalid boundary character: '{line[i]}'")
            marks.append({"-": NONE, "|": WORD, " ": UNKNOWN}[line[i]])
            i += 1
            if i == n:
                raise InvalidArgument(arg, "invalid annotation")
    return Sentence("".join(text), marks, tags).padded()


def _trimmed(tags: list[str | None] | None) -> list[str]:
    out = list(tags or [])
    while out and out[-1] is None:
        out.pop()
    return [t or "" for t in out]


def _escaped(text: str, signs: str) -> str:
    return "".join("\\" + c if c in signs else c for c in text)


def write_tokenized(s: Sentence) -> str:
    return " ".join("".join([_escaped(s.text[a:b], " \\/"), *("/" + _escaped(t, " \\/") for t in _trimmed(s.tags_at(b - 1)))]) for a, b in s.tokens())


def write_partial(s: Sentence, escape: bool = True) -> str:
    out = []
    for i, c in enumerate(s.text):
        out.append(c)
        out += ["/" + (_escaped(t, "\\ -|/") if escape else t) for t in _trimmed(s.tags_at(i))]
        if i < len(s.boundaries):
            out.append("-| "[s.boundaries[i]])
    return "".join(out)


def _row(parse, line: str | None) -> dict | None:
    if line is None:
        return None
    try:
        s = parse(line)
    except InvalidArgument as e:
        return {"error": str(e)}
    return {"text": s.text, "boundaries": s.boundaries, "tags": s.tags, "n_tags": s.n_tags, "error": None}


def _parser(parse):
    def column(line: Column) -> Column:
        def run(lines: pa.Array) -> pa.Array:
            return pa.array([_row(parse, x) for x in lines.to_pylist()], _arrow)

        return F.arrow_udf(run, SENTENCE)(line)

    return column


from_tokenized, from_partial = _parser(parse_tokenized), _parser(parse_partial)


def from_raw(text: Column) -> Column:
    """A sentence with all boundaries unknown; on the JVM alone."""
    n = F.length(text)
    bad = F.when(n == 0, F.lit("InvalidArgumentError: text: must contain at least one character")).when(F.instr(text, "\0") > 0, F.lit("InvalidArgumentError: text: must not contain NULL"))
    ok = bad.isNull()
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(ok, text).alias("text"), F.when(ok, F.array_repeat(F.lit(UNKNOWN), n - 1)).alias("boundaries"),
            F.when(ok, F.array_repeat(F.lit(None).cast("array<string>"), n)).alias("tags"), F.when(ok, F.lit(0)).alias("n_tags"), bad.alias("error"),
        ),
    )


def _writer(write):
    def column(sentence: Column) -> Column:
        def run(rows: pa.Array) -> pa.Array:
            return pa.array([None if r is None or r["text"] is None else write(Sentence(r["text"], r["boundaries"], r["tags"] or [], r["n_tags"] or 0)) for r in rows.to_pylist()], pa.string())

        return F.arrow_udf(run, "string")(sentence)

    return column


to_tokenized, to_partial = _writer(write_tokenized), _writer(write_partial)


def substring(text: Column, start: int | Column, end: int | Column) -> Column:
    """Characters start to end, the end excluded."""
    return F.substr(text, F.lit(start) + 1, F.lit(end) - F.lit(start))


def reset_tags(sentence: Column, n: int) -> Column:
    return sentence.withField("tags", F.transform(chars(sentence["text"]), lambda _: F.array_repeat(F.lit(None).cast("string"), n))).withField("n_tags", F.lit(n))


def transfer(sentence: Column, text: Column) -> Column:
    """The boundaries and tags of a sentence on another text of as many characters, such as the one before normalisation."""
    return F.when(F.length(text) == F.length(sentence["text"]), sentence.withField("text", text))
