"""Text features, prompts and answers, as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.expressions import float_divide, returning

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PROMPT = "Answer the question with yes or no, using these passages:\n"


@returning("string")
def finalize_question(question: Column, passages: Column) -> Column:
    """A prompt: passages, a line each, an empty line, and the question."""
    return F.concat(F.lit(PROMPT), F.concat_ws("\n", passages), F.lit("\n\n"), question)


@returning("boolean")
def is_yes(text: Column) -> Column:
    """Whether the answer begins with yes, in any case."""
    return F.lower(F.substring(text, 1, 3)) == "yes"


@returning("int")
def punctuation_count(text: Column) -> Column:
    """How many of the 32 ASCII punctuation characters."""
    return F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))


@returning("int")
def sentence_count(text: Column) -> Column:
    """Full stops and one."""
    return F.size(F.split(text, "\\.", -1))


@returning("int")
def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def first_and_mean_distance(distances: Column) -> Column:
    """The first, and the sum of all over one less than their number (which for one is infinite)."""
    total = F.aggregate(distances, F.lit(0.0), lambda a, d: a + d)
    mean = float_divide(total, (F.size(distances) - 1).cast("double"))
    return F.struct(F.get(distances, F.lit(0)).alias("first"), mean.alias("mean"))


@returning("double")
def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Dollars for a million tokens, in and out, by model (fixed values).
TOKEN_RATES = {"4o": (2.50, 10.0), "1.5-8b": (0.0375, 0.15), "2.0-flash": (0.10, 0.40)}


def token_cost(tokens_in: Column, tokens_out: Column, model: str | Column) -> Column:
    if isinstance(model, str):
        a, b = TOKEN_RATES[model]
        return tokens_in * (a / 1e6) + tokens_out * (b / 1e6)
    out = F.when(F.lit(False), F.lit(0.0))
    for name, (a, b) in TOKEN_RATES.items():
        out = out.when(model == name, tokens_in * (a / 1e6) + tokens_out * (b / 1e6))
    return out


@returning("string")
def first_id(ids: Column) -> Column:
    """The first of a list; null if there is none."""
    return F.get(ids, F.lit(0))


def preclassifier_features(text: Column, distances: Column) -> Column:
    """Bytes, sentences, first and mean distance."""
    d = first_and_mean_distance(distances)
    return F.array(F.octet_length(text).cast("double"), sentence_count(text).cast("double"), d["first"], d["mean"])


def split_prefix(row: Column, prefix: str) -> Column:
    """Entries of a map whose keys begin with a prefix, without it."""
    kept = F.map_filter(row, lambda k, _: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(kept, lambda k, _: F.substr(k, F.lit(len(prefix) + 1)))
