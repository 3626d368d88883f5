"""Texts as columns: the token sets that diffs, dictionaries and file names are compared by."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = "[^A-Za-z0-9@._+-]+"
NAME_BREAK = "[^A-Za-z0-9]+"
#: One character of a token, all of them named: Java looks such a class up in one table, and texts are read several times
#: faster than by splitting them at TOKEN_BREAK, which says the same.
TOKEN_CHAR = f"[{string.ascii_letters}{string.digits}@._+-]"


def _runs(text: Column, least: int) -> Column:
    """The runs of characters of tokens in a text, of `least` characters or more."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_CHAR * least + "+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """The distinct tokens of a text of 3 characters or more, their case kept."""
    return F.array_distinct(_runs(text, 3))


def vocabulary_tokens(text: Column) -> Column:
    """The distinct tokens of a text in lower case, of any length."""
    return F.array_distinct(_runs(F.lower(text), 1))


def first_token(value: Column) -> Column:
    return F.try_element_at(F.filter(F.split(F.lower(value), TOKEN_BREAK), lambda x: x != ""), F.lit(1))


def name_tokens(name: Column) -> Column:
    """The distinct tokens of a file's name of more than one character, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(name), NAME_BREAK), lambda x: F.length(x) > 1))


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 text; what is malformed becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def whole_value_spans(text: str, marks: dict[str, list[str]]) -> list[tuple[int, int, str]]:
    """Where values stand in a text as whole values: (start, end, kind), kinds in the order given.

    Longer values win over shorter ones of their kind, earlier kinds over later ones; a value that begins or ends with a
    letter or digit must not go on with one.
    """
    taken: list[tuple[int, int, str]] = []
    for kind, values in marks.items():
        ordered = sorted({v for v in values if v}, key=lambda v: (-len(v), v))
        if not ordered:
            continue
        edge = lambda v: (r"(?<!\w)" if v[0].isalnum() else "") + re.escape(v) + (r"(?!\w)" if v[-1].isalnum() else "")
        pattern = re.compile("|".join(map(edge, ordered)), re.IGNORECASE)
        taken.sort()
        free = zip([0, *[end for _, end, _ in taken]], [*[start for start, _, _ in taken], len(text)], strict=True)
        taken += [(m.start(), m.end(), kind) for start, end in list(free) for m in pattern.finditer(text, start, end)]
    return sorted(taken)
