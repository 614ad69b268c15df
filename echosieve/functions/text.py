"""Text functions as Spark columns. Offsets count characters from 0, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echosieve.config import WEB_STOPWORDS

# The classes and patterns that the results depend on.
WS = r"[ \t\n\r\f\x0B]"
EDGE = r"[ \t\n\r\f\x0B\"'“”‘’*_(){}\[\]<>-]"
LABEL = r"[A-Za-z][A-Za-z0-9 _.'’-]{0,48}"
SEPARATORS = ",.;:!?—–"
TOKEN = r"([A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*)"
QUOTES = "\"'“”‘’"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), rf"\A{WS}+", ""), rf"{WS}+\z", "")


def clean_fragment(x) -> Column:
    """Without white space, quotes and markup at the ends, inner white space collapsed."""
    inner = F.regexp_replace(F.regexp_replace(col(x), rf"\A{EDGE}+", ""), rf"{EDGE}+\z", "")
    return F.trim(F.regexp_replace(inner, rf"{WS}+", " "))


def normalize_token(x) -> Column:
    """Lower case without other than [a-z0-9] at the ends; null if nothing is left."""
    t = F.regexp_replace(F.lower(col(x)), r"\A[^a-z0-9]+|[^a-z0-9]+\z", "")
    return F.when(t != "", t)


def tokens(x, excluded=None) -> Column:
    """Words in order, without the excluded ones."""
    out = F.transform(F.regexp_extract_all(col(x), F.lit(TOKEN), 1), F.lower)
    return out if excluded is None else F.filter(out, lambda t: ~F.array_contains(col(excluded), t))


def frontmatter(x) -> Column:
    """The leading block between --- lines with its line ends, or empty."""
    end = F.locate("\n---\n", col(x), 5)
    return F.when(col(x).startswith("---\n") & (end > 0), F.substring(col(x), F.lit(1), end + 4)).otherwise("")


def names_in(x, stopwords) -> Column:
    """Distinct words of an array of phrases, quotes dropped, without stopwords."""
    every = F.flatten(F.transform(col(x), lambda p: tokens(F.regexp_replace(p, "[\"']", ""))))
    return F.array_except(F.array_distinct(every), F.array(*[F.lit(w) for w in stopwords]))


def speaker_tokens(x) -> Column:
    """Words of the labels that begin lines and are followed by text."""
    return names_in(speaker_phrases(x), WEB_STOPWORDS)


def character_tokens(x) -> Column:
    """Words of the inline value of characters: in the frontmatter."""
    found = F.regexp_extract_all(frontmatter(x), F.lit(rf"(?:\A|\n)[ \t\r\f\x0B]*characters:([^\n]*)"), 1)
    return names_in(found, WEB_STOPWORDS)


def character_phrases(x) -> Column:
    """The phrases of characters: in the frontmatter, an inline value or list, or the lines
    that follow up to a blank one or the next key; what stands in brackets is left out."""
    parts = lambda v: F.transform(F.split(v, ","), lambda p: F.regexp_replace(strip(p), r"^[\"']+|[\"']+$", ""))
    none = F.array().cast("array<string>")
    state = lambda inside, done, out: F.struct(inside.alias("inside"), done.alias("done"), out.alias("out"))
    yes, no = F.lit(True), F.lit(False)

    def step(s, raw):
        line = strip(raw)
        value = strip(F.substring(line, F.lit(len("characters:") + 1), F.length(line)))
        listed = value.startswith("[") & value.endswith("]")
        bare = F.when(line.startswith("-"), strip(F.substring(line, F.lit(2), F.length(line)))).otherwise(line)
        item = F.regexp_replace(strip(F.substring_index(bare, "(", 1)), ",+$", "")
        key = line.rlike(rf"^[A-Za-z0-9_-]+:{WS}*") & ~line.startswith("-")
        return (
            F.when(s["done"], s)
            .when(line == "", state(s["inside"], s["inside"], s["out"]))
            .when(line.startswith("characters:"), F.when(listed, state(yes, yes, F.concat(s["out"], parts(F.substring(value, F.lit(2), F.length(value) - 2))))).when(value != "", state(yes, no, F.concat(s["out"], parts(value)))).otherwise(state(yes, no, s["out"])))
            .when(s["inside"] & key, state(s["inside"], yes, s["out"]))
            .when(s["inside"], state(s["inside"], no, F.concat(s["out"], F.array(item))))
            .otherwise(s)
        )

    return F.aggregate(F.split(frontmatter(x), r"\r\n|[\r\n]"), state(no, no, none), step, lambda s: s["out"])


def speaker_phrases(x, dialect: str = "web") -> Column:
    """The labels that begin lines and are followed by text. In the web dialect the text
    must be on the label's line; in the other a blank is enough."""
    after = r"[ \t\f\x0B]+[^ \t\n\r\f\x0B]" if dialect == "web" else r"[ \t\f\x0B]"
    return F.regexp_extract_all(col(x), F.lit(rf"(?:\A|\n)[ \t\r\f\x0B]*({LABEL}):{after}"), 1)


def starts_capitalized(x) -> Column:
    return F.regexp_extract(col(x), "[A-Za-z]", 0).rlike("^[A-Z]$")


def word_count(x, dialect: str = "web") -> Column:
    """Runs of word characters, hyphens and apostrophes that hold a word character."""
    w = r"\w" if dialect == "web" else r"\p{L}\p{N}_"
    return F.regexp_count(F.coalesce(col(x), F.lit("")), F.lit(rf"[{w}'-]*[{w}][{w}'-]*")).cast("long")


def snippet(x, limit: int = 80) -> Column:
    """One line of at most `limit` characters, with ... where it was cut."""
    flat = strip(F.regexp_replace(col(x), rf"{WS}+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(limit - 1)), rf"{WS}+\z", ""), F.lit("...")))


def cleanup(x) -> Column:
    """Blank runs, line indents and the blank lines about headings in order."""
    t = F.regexp_replace(col(x), r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    t = F.regexp_replace(t, rf"\n{{3,}}(#{{1,6}}{WS}+)", "\n\n$1")
    t = F.regexp_replace(t, rf"([^\n])\n(#{{1,6}}{WS}+)", "$1\n\n$2")
    return F.regexp_replace(t, r"(#{1,6}[^\n]+)\n([^\n])", "$1\n\n$2")


MARKER_CLUSTER = r"@(?:[ \t,.;!?—–\"'“”‘’]*@)+"
_PUNCTUATION = r"[,.;!?—–\"'“”‘’]+"


def edit_markers(x) -> Column:
    """Neighbouring @ become one, and punctuation about an @ goes."""
    t = F.regexp_replace(col(x), MARKER_CLUSTER, "@")
    t = F.regexp_replace(t, rf"[ \t]*{_PUNCTUATION}[ \t]*@[ \t]*", " @ ")
    t = F.regexp_replace(t, rf"[ \t]*@[ \t]*{_PUNCTUATION}[ \t]*", " @ ")
    return F.regexp_replace(t, MARKER_CLUSTER, "@")


def is_speaker_colon(text, colon) -> Column:
    """Whether the line before the colon at 0-based `colon` is a label."""
    line = F.regexp_extract(F.left(col(text), col(colon)), r"[^\n]*\z", 0)
    return strip(line).rlike(rf"\A{LABEL}\z")


def ngrams(x, n: int, sep: str = " ") -> Column:
    """All runs of n tokens, joined."""
    t = col(x)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), sep))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def jaccard(a, b) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    return F.when((F.size(col(a)) == 0) | (F.size(col(b)) == 0), F.lit(0.0)).otherwise(both / (F.size(col(a)) + F.size(col(b)) - both))
