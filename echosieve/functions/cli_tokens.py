"""The cli dialect's tokenizer: Penn Treebank word splitting, then normalised tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from echosieve.config import CLI_STOPWORDS

# The published Treebank rules, in their order. Quotes that open, then
# punctuation, brackets and dashes; after blanks are put around the text, quotes that
# close with the clitics, and the contractions.
_OPENING = ((r'^"', "`` "), (r'([ (\[{<])("|\'{2})', r"\1 `` "))
_MARKS = (
    (r"([:,])([^\d])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"\.\.\.", " ... "),
    (r"[;@#$%&]", r" \g<0> "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", r"\1 \2\3 "),
    (r"[?!]", r" \g<0> "),
    (r"([^'])' ", r"\1 ' "),
    (r"[\]\[(){}<>]", r" \g<0> "),
    (r"--", " -- "),
)
_CLOSING = (
    (r"''", " '' "),
    (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r"(?i)\b(can)(not)\b", r" \1 \2 "),
    (r"(?i)\b(d)('ye)\b", r" \1 \2 "),
    (r"(?i)\b(gim|lem)(me)\b", r" \1 \2 "),
    (r"(?i)\b(gon)(na)\b", r" \1 \2 "),
    (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(more)('n)\b", r" \1 \2 "),
    (r"(?i)\b(wan)(na)\s", r" \1 \2 "),
    (r"(?i) ('t)(is|was)\b", r" \1 \2 "),
)


def treebank_words(text: str) -> list[str]:
    for pattern, to in _OPENING + _MARKS:
        text = re.sub(pattern, to, text)
    text = " " + text + " "
    for pattern, to in _CLOSING:
        text = re.sub(pattern, to, text)
    return text.split()


def cli_words(text: str, excluded=()) -> list[str]:
    out = []
    for raw in treebank_words(text or ""):
        tok = re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", raw.lower())
        if tok and tok not in excluded:
            out.append(tok)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _cli_tokens(text: pd.Series, excluded: pd.Series) -> pd.Series:
    return pd.Series([cli_words(t, set(x) if x is not None else ()) for t, x in zip(text, excluded)])


def cli_tokenizer(text: Column, excluded: Column) -> Column:
    return _cli_tokens(text, excluded)


@F.pandas_udf(LongType())
def _cli_count(text: pd.Series) -> pd.Series:
    return pd.Series([len(cli_words(t)) for t in text], dtype="int64")


def cli_word_count(text: Column) -> Column:
    """The number of cli_tokenizer's tokens; only one text's tokens are held at a time."""
    return _cli_count(text)


@F.pandas_udf(ArrayType(StringType()))
def _cli_names(phrases: pd.Series) -> pd.Series:
    return pd.Series([list(dict.fromkeys(w for p in (x if x is not None else ()) for w in cli_words(p, CLI_STOPWORDS))) for x in phrases])


def cli_names(phrases: Column) -> Column:
    """Distinct words of an array of phrases, without stopwords."""
    return _cli_names(phrases)
