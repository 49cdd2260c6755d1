"""Column functions over strings."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.binding import once

# White space as Python's str.strip and \s see it; ``trim`` alone only knows U+0020.
BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))
SPACE = r"[\s\x1c-\x1f]"
# The characters a clean name keeps, the characters cut from a lyrics tail.
# The kept characters are listed one by one: Java turns a list into a bit set, but a union of ranges
# into a chain of predicates that is many times slower and slows down further with every core.
KEPT = string.ascii_letters + string.digits + " '\".,!?()"
NOT_KEPT = f"[^{KEPT}\\-]+"
TAIL = "0123456789Embed"

# Words that trigger query expansion and the two prefixes.
MOOD_WORDS = ("triste", "alegre", "melancólico", "energético", "relajado", "romántico")
GENRE_WORDS = ("pop", "rock", "jazz", "country", "hip hop", "electronic")
MOOD_PREFIX = "canciones con mood "
GENRE_PREFIX = "música de género "


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_text(text: Column, min_length: int = 1, max_length: int = 500) -> Column:
    """Strip, collapse white space, delete special characters; NULL when the length is off."""
    collapsed = F.regexp_replace(strip(text), f"(?U){SPACE}+", " ")
    kept = F.regexp_replace(collapsed, NOT_KEPT, "")
    return once(kept, lambda k: F.when(F.length(k).between(min_length, max_length), k))


def trim_lyrics_tail(lyrics: Column) -> Column:
    """Cut the counter suffix of a lyrics page: only if the last character is a digit."""

    def cut(text: Column) -> Column:
        rest = F.rtrim(text, F.lit(TAIL))
        return F.when(F.right(text, F.lit(1)).between("0", "9") & (rest != ""), rest).otherwise(text)

    return F.coalesce(strip(once(strip(lyrics), cut)), F.lit(""))


def describe(description: Column) -> Column:
    """``plain`` member of a JSON description, or the plain string itself."""
    is_object = F.coalesce(F.ltrim(description).startswith("{"), F.lit(False))
    plain = F.get_json_object(description, "$.plain")
    parsed = F.try_parse_json(description).isNotNull()
    return F.when(is_object & parsed, F.coalesce(plain, F.lit(""))).otherwise(description)


def build_document(fields: Sequence[Column], tags: Sequence[Column] = ()) -> Column:
    """``a | b | Tags: x, y`` over the non-null fields and tags; empty strings stay."""
    parts = [column.cast("string") for column in fields]
    if tags:
        some_tag = F.coalesce(*[tag.cast("string") for tag in tags]).isNotNull()
        listed = F.concat_ws(", ", *[tag.cast("string") for tag in tags])
        parts.append(F.when(some_tag, F.concat(F.lit("Tags: "), listed)))
    return F.concat_ws(" | ", *parts) if parts else F.lit("")


def expand_query(query: Column) -> Column:
    """Add context to queries of at most two words that hold a mood or a genre word."""

    def holds(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.lower(query).contains(word)
        return found

    short = F.size(F.split(strip(query), f"(?U){SPACE}+")) <= 2
    return (
        F.when(short & holds(MOOD_WORDS), F.concat(F.lit(MOOD_PREFIX), query))
        .when(short & holds(GENRE_WORDS), F.concat(F.lit(GENRE_PREFIX), query))
        .otherwise(query)
    )


def text_shape(text: Column) -> dict[str, Column]:
    """Word count, character count and mean word length of a text."""
    words = F.filter(F.split(text, f"(?U){SPACE}+"), lambda word: word != "")
    letters = F.aggregate(words, F.lit(0), lambda total, word: total + F.length(word))
    return {
        "word_count": F.size(words),
        "char_count": F.length(text),
        "avg_word_length": F.try_divide(letters.cast("double"), F.size(words).cast("double")),
    }
