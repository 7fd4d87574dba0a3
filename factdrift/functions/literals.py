"""N-Triples literal escapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The escapes of the N-Triples grammar and what they stand for.
CHARACTER_ESCAPES = {
    "\\\\": "\\",
    '\\"': '"',
    "\\'": "'",
    "\\n": "\n",
    "\\r": "\r",
    "\\t": "\t",
    "\\b": "\b",
    "\\f": "\f",
}

_HEX = "[0-9A-Fa-f]"
_NOT_SURROGATE = "(?![Dd][89A-Fa-f])"
# A run of \uXXXX is decoded together, so that surrogate pairs stay whole. Half
# of a pair on its own is no character and falls through to "\\.", as text.
_SHORT_RUN = (
    rf"(?:\\u{_NOT_SURROGATE}{_HEX}{{4}}"
    rf"|\\u[Dd][89ABab]{_HEX}{{2}}\\u[Dd][C-Fc-f]{_HEX}{{2}})++"
)
_LONG = rf"\\U(?:0000{_NOT_SURROGATE}{_HEX}{{4}}|000[1-9A-Fa-f]{_HEX}{{4}}|0010{_HEX}{{4}})"
_TOKEN = rf"(?s)[^\\]++|{_SHORT_RUN}|{_LONG}|\\.|\\"


def unescape_literal(text: Column) -> Column:
    """Resolve the escapes in a literal; unknown ones keep their backslash.

    Text without a backslash, the common case, is passed through untouched.
    """

    def decode(token: Column) -> Column:
        kind = F.substring(token, 1, 2)
        resolved = F.when(~token.startswith("\\"), token)
        for escape, character in CHARACTER_ESCAPES.items():
            resolved = resolved.when(token == F.lit(escape), F.lit(character))
        return (
            resolved.when(
                (kind == F.lit("\\u")) & (F.length(token) > 2),
                F.decode(F.unhex(F.replace(token, F.lit("\\u"), F.lit(""))), "UTF-16BE"),
            )
            .when(
                (kind == F.lit("\\U")) & (F.length(token) > 2),
                F.decode(F.unhex(F.substring(token, 3, 8)), "UTF-32"),
            )
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    unescaped = F.array_join(F.transform(tokens, decode), "")
    return F.when(F.contains(text, F.lit("\\")), unescaped).otherwise(text)


def escape_literal(text: Column) -> Column:
    """Write a string the way it has to stand between quotes on a line."""
    for character, escape in (
        ("\\", "\\\\"),
        ('"', '\\"'),
        ("\n", "\\n"),
        ("\r", "\\r"),
        ("\t", "\\t"),
    ):
        text = F.replace(text, F.lit(character), F.lit(escape))
    return text
