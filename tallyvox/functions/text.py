"""Text columns: trimming, cleaning, case and tokens.

Java's `\\s` and `\\w` are ASCII only, so patterns either set (?U) or spell out Unicode classes.
Outer runs are trimmed by character list, not by pattern: a pattern would scan the whole text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# Character classes (white space needs the flag U), and ASCII punctuation.
SPACE = r"\s\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
PUNCTUATION = string.punctuation

# What cleaning removes.
URL_PATTERN = rf"(?U)http[^{SPACE}]+|www[^{SPACE}]+"
TAG_PATTERN = rf"[@#][{WORD}]+"


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(strip(text), F.lit("")) == ""


def clean_text(text: Column) -> Column:
    """Drop links, then mentions and hash tags, then outer white space.

    The patterns run only on texts that contain their fixed parts.
    """
    linked = text.contains("http") | text.contains("www")
    no_links = F.when(linked, F.regexp_replace(text, URL_PATTERN, "")).otherwise(text)
    tagged = text.contains("@") | text.contains("#")
    return strip(F.when(tagged, F.regexp_replace(no_links, TAG_PATTERN, "")).otherwise(no_links))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[{CASED}]+|[^{CASED}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(run.substr(1, 1)), run.substr(2, 1 << 30))),
        "",
    )


def body_or_title(body: Column, title: Column) -> Column:
    """The body unless it is null or empty; a body of white space counts as a body. A null title
    stays null."""
    return F.when(F.length(body) > 0, body).otherwise(title)


def opinion_tokens(cleaned: Column) -> Column:
    """White-space tokens in their own case without edge punctuation, two letters or more."""
    parts = F.split(cleaned, rf"(?U)[{SPACE}]+")
    bare = F.transform(parts, lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    return F.filter(bare, lambda t: F.length(t) > 1)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters, in order."""
    return F.array_remove(F.split(F.lower(text), rf"[^{WORD}]+"), "")


def letter_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def letter_trigrams(text: Column) -> Column:
    """Groups of three letters of each word, the word set between blanks: one around each letter."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))
    return F.regexp_extract_all(spaced, F.lit(r"(?=(.\p{L}.))."), F.lit(1))
