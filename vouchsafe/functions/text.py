"""Text functions: normalisation, search text, tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields that hold text, in the order they are joined.
TEXT_FIELDS = ("title", "description", "content", "text")
SEARCH_TEXT_SEPARATOR = " | "

# Whitespace as Unicode defines it, in a form every regex engine reads alike.
WHITESPACE = r"[\s\x0B\p{Z}\x{0085}\x{001C}-\x{001F}]+"
BLANK = r"\A[\s\x0B\p{Z}\x{0085}\x{001C}-\x{001F}]*\z"
TOKEN = "[a-z0-9]+"

# Characters below U+0300 neither combine nor have another composed form, so a
# text made of them alone is in NFC already.
_MAY_CHANGE_UNDER_NFC = r"[^\x{0000}-\x{02FF}]"


@F.arrow_udf(T.StringType())
def _compose(text: pa.Array) -> pa.Array:
    composed = [None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()]
    return pa.array(composed, pa.string())


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts that could change cross into Python."""
    return F.coalesce(_compose(F.when(text.rlike(_MAY_CHANGE_UNDER_NFC), text)), text)


def squeeze_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def normalize(text: Column) -> Column:
    return squeeze_whitespace(nfc(text))


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(text, rf"\A{WHITESPACE}|{WHITESPACE}\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def search_text(parts: Sequence[Column], max_chars: int | None = None) -> Column:
    """Join the non-empty parts; with ``max_chars``, keep so many characters of the front."""
    joined = F.concat_ws(SEARCH_TEXT_SEPARATOR, *(F.nullif(part, F.lit("")) for part in parts))
    return joined if max_chars is None else F.substring(joined, 1, max_chars)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
