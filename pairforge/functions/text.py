"""Text column expressions. Whitespace follows Unicode, as in Python's ``\\s``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.isspace() accepts.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760]
                         + [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
# A run worth rewriting: anything but one plain blank. Most blanks never match.
_RUN = r"(?U) [\s\x1c-\x1f]+|[^\S ][\s\x1c-\x1f]*|[\x1c-\x1f][\s\x1c-\x1f]*"
MARKER = "ASSISTANT:"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Strip and turn every whitespace run into one blank."""
    return F.regexp_replace(strip(text), _RUN, " ")


def text_key(text: Column) -> Column:
    """Case- and whitespace-insensitive identity of a text."""
    return collapse(F.lower(text))


def after_first_marker(text: Column, marker: str = MARKER) -> Column:
    value = strip(text)
    start = F.instr(value, marker)
    tail = F.substr(value, start + F.lit(len(marker)))
    return F.when(start > 0, strip(tail)).otherwise(value)


def after_last_marker(text: Column, marker: str = MARKER) -> Column:
    return strip(F.substring_index(text, marker, -1))


# The role prefixes that a completion may begin with.
ROLE_PREFIXES = (
    r"(?U)^\s*(?:ASSISTANT|assistant)\s*:\s*",
    r"(?U)^\s*(?:USER|user)\s*:\s*",
)


def clean_completion(text: Column) -> tuple[Column, Column]:
    """Completion without one leading role prefix, and its status.

    The status is ``ok``, ``empty`` or ``marker`` (a role marker is left inside).
    """
    value = strip(text)
    for prefix in ROLE_PREFIXES:
        value = F.regexp_replace(value, prefix, "")
    status = (
        F.when(value == "", "empty")
        .when(value.contains("USER:") | value.contains(MARKER), "marker")
        .otherwise("ok")
    )
    return value, status


def letters_only(text: Column) -> Column:
    """Lower-case a-z words separated by single blanks; apostrophes vanish."""
    bare = F.translate(text, "'’", "")
    spaced = F.regexp_replace(F.lower(bare), "[^a-z]", " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def clean_sentence(text: Column, letters: bool = True) -> Column:
    return letters_only(text) if letters else collapse(text)


def route_name(prompt_type: Column, prompt_route: Column) -> Column:
    """Canonical route; NULL marks an unknown one."""
    value = F.coalesce(prompt_type, prompt_route, F.lit(""))
    return F.when(value.isin("chosen", "chosen_prompt"), "chosen_prompt").when(
        value.isin("rejected", "rejected_prompt"), "rejected_prompt"
    )


def role_name(role: Column) -> Column:
    return F.translate(F.lower(strip(role)), "- ", "__")


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(strip(text), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def word_count(token_array: Column) -> Column:
    return F.size(F.filter(token_array, lambda t: t.rlike(r"(?U)^\w+$")))


def words(text: Column) -> Column:
    """Whitespace-separated words without empty ones."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")
