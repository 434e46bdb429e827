"""Column functions for profile text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns below must equal the published cleaning rules.
NON_ALNUM = r"[^A-Za-z0-9]"
ALNUM = r"[A-Za-z0-9]"
NON_ALNUM_SPACE = r"[^A-Za-z0-9 ]"
CONTROL_OR_SPACE = r"\p{C}|\s+|\r$|\\t|\\n|\\r"

MIN_WORD_LENGTH = 3


def word_tokens(text: Column, longer_than: int = MIN_WORD_LENGTH) -> Column:
    """Lower-cased alphanumeric tokens longer than ``longer_than``; a missing text has none.

    The runs of characters that ``NON_ALNUM`` leaves are found in one pass: no cleaned text and no short token is built.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(" "))), F.lit(f"{ALNUM}{{{max(longer_than, 0) + 1},}}"), F.lit(0))


def clean_text(text: Column, stop_words: Sequence[str] = (), longer_than: int = MIN_WORD_LENGTH) -> Column:
    """The kept tokens joined by single blanks, stop words removed; a missing text becomes one blank.

    ``stop_words`` is a fixed list given by the caller and compiles to one hash set; use
    ``operators.profiles.drop_stop_words`` when the words are a table.
    """
    tokens = word_tokens(text, longer_than)
    if stop_words:
        listed = list(stop_words)
        tokens = F.filter(tokens, lambda t: ~t.isin(listed))
    return F.when(text.isNull(), F.lit(" ")).otherwise(F.array_join(tokens, " "))


def profile_tokens(text: Column, longer_than: int = 1) -> Column:
    """Tokens for keyword counting: punctuation to blanks, lower case, single characters dropped."""
    cleaned = F.lower(F.regexp_replace(text, NON_ALNUM_SPACE, " "))
    return F.filter(F.split(cleaned, " "), lambda t: F.length(t) > longer_than)


def scrub_text(text: Column) -> Column:
    """Control characters, blank runs and literal backslash escapes become one blank each."""
    return F.regexp_replace(text, CONTROL_OR_SPACE, " ")


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "")
