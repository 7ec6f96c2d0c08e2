"""Models as small tables: weights of character n-grams, type n-grams and dictionary words, and tag models."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A model is compiled on the driver and broadcast; beyond this number of weights the exploded form, which joins, is the one to use.
MAX_WEIGHTS = 20_000_000
SCHEMAS = {
    "meta": "bias int, char_window int, type_window int",
    "char_ngram": "ngram string, weights array<int>",
    "type_ngram": "ngram string, weights array<int>",
    "dict": "word string, weights array<int>, comment string",
    "tag_token": "token_id int, token string, tags array<array<string>>, bias array<int>",
    "tag_char_ngram": "token_id int, ngram string, rel int, weights array<int>",
    "tag_type_ngram": "token_id int, ngram string, rel int, weights array<int>",
}


@dataclass(frozen=True)
class TagModel:
    token: str
    tags: list[list[str]]
    bias: list[int]
    char_ngrams: list[tuple[str, int, list[int]]] = field(default_factory=list)
    type_ngrams: list[tuple[str, int, list[int]]] = field(default_factory=list)


@dataclass(frozen=True)
class Model:
    bias: int = 0
    char_window: int = 3
    type_window: int = 3
    char_ngrams: list[tuple[str, list[int]]] = field(default_factory=list)
    type_ngrams: list[tuple[str, list[int]]] = field(default_factory=list)
    dictionary: list[tuple[str, list[int], str]] = field(default_factory=list)
    tag_models: list[TagModel] = field(default_factory=list)

    def checked(self) -> Model:
        """The model, if it is small enough to be broadcast."""
        n = sum(len(w) for _, w in self.char_ngrams) + sum(len(w) for _, w in self.type_ngrams) + sum(len(w) for _, w, _ in self.dictionary) + sum(len(w) for t in self.tag_models for g in (t.char_ngrams, t.type_ngrams) for _, _, w in g)
        if n > MAX_WEIGHTS:
            raise ValueError(f"a model of {n} weights isn't broadcast; use the exploded form")
        for word, weights, _ in self.dictionary:
            if len(weights) != len(word) + 1:
                raise ValueError(f"InvalidArgumentError: weights: the word {word} needs {len(word) + 1} weights")
        return self

    def with_dictionary(self, words: list[tuple[str, list[int], str]], strict: bool = False) -> Model:
        """The model with another dictionary. Words that recur are summed in scoring; strict refuses them."""
        if strict and len({w for w, _, _ in words}) < len(words):
            raise ValueError("a word occurs twice")
        return replace(self, dictionary=list(words)).checked()

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        ids = list(enumerate(self.tag_models))
        rows = {
            "meta": [(self.bias, self.char_window, self.type_window)],
            "char_ngram": self.char_ngrams,
            "type_ngram": self.type_ngrams,
            "dict": self.dictionary,
            "tag_token": [(i, t.token, t.tags, t.bias) for i, t in ids],
            "tag_char_ngram": [(i, *g) for i, t in ids for g in t.char_ngrams],
            "tag_type_ngram": [(i, *g) for i, t in ids for g in t.type_ngrams],
        }
        return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}

    def write(self, spark: SparkSession, path: str) -> None:
        for name, df in self.tables(spark).items():
            df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Model:
        """The tables come to the driver: they are what is broadcast."""
        t = {name: spark.read.schema(s).parquet(f"{path}/{name}").collect() for name, s in SCHEMAS.items()}
        grams = {k: {} for k in ("tag_char_ngram", "tag_type_ngram")}
        for k, by in grams.items():
            for r in t[k]:
                by.setdefault(r.token_id, []).append((r.ngram, r.rel, list(r.weights)))
        meta = t["meta"][0]
        return Model(
            meta.bias, meta.char_window, meta.type_window,
            [(r.ngram, list(r.weights)) for r in t["char_ngram"]], [(r.ngram, list(r.weights)) for r in t["type_ngram"]], [(r.word, list(r.weights), r.comment) for r in t["dict"]],
            [TagModel(r.token, [list(x) for x in r.tags], list(r.bias), grams["tag_char_ngram"].get(r.token_id, []), grams["tag_type_ngram"].get(r.token_id, [])) for r in sorted(t["tag_token"], key=lambda r: r.token_id)],
        )


def dump_dictionary(model: Model, spark: SparkSession, path: str) -> None:
    """word,weights,comment as CSV, weights apart by blanks."""
    df = model.tables(spark)["dict"]
    df.select("word", F.array_join(F.transform("weights", lambda w: w.cast("string")), " ").alias("weights"), "comment").coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def load_dictionary(spark: SparkSession, path: str) -> list[tuple[str, list[int], str]]:
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema="word string, weights string, comment string")
    return [(r.word, [int(x) for x in r.weights.split()], r.comment or "") for r in df.collect()]
