"""Tokens, words, terms and k-grams as Spark expressions, with the meaning that Python's str.split and \\W have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and ends of words as Python sees them; Java's \s and \W know ASCII only.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
GRAM = 3


def clean(raw: Column) -> Column:
    """A token without what is no letter, number or underscore at its ends, without apostrophes, in lower case."""
    return F.lower(F.replace(F.regexp_replace(raw, EDGE, ""), F.lit("'"), F.lit("")))


def hyphen_parts(word: Column) -> Column:
    """The word and what stands between its hyphens, each once; may hold the empty string."""
    return F.array_distinct(F.array_append(F.split(word, "-"), word))


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, raw): every white-space token with its position from 0. Null and blank texts have none."""
    body = F.regexp_replace(F.col(text), f"^{SPACE}|{SPACE}$", "")
    return docs.select("doc_id", F.posexplode(F.split(body, SPACE)).alias("pos", "raw")).where("raw <> ''")


def kgrams(word: Column, k: int = GRAM) -> Column:
    """The distinct runs of 1 to k characters of $word$."""
    padded = F.concat(F.lit("$"), word, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*(of(n) for n in range(1, k + 1)))))


def grams_of(word: str, k: int = GRAM) -> set[str]:
    """As kgrams, for one word on the driver or in numpy."""
    padded = f"${word}$"
    return {padded[i : i + n] for n in range(1, k + 1) for i in range(len(padded) - n + 1)}
