"""Column functions over claim text and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as whitespace in record text (Unicode
# spaces, line terminators and the byte-order mark), as a regex class body.
WHITESPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_CHARACTERS = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{WHITESPACE}]", c))

# Fixed value: the longest claim that is kept, counted in UTF-16 units.
MAX_CLAIM = 280


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_CHARACTERS))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"[{WHITESPACE}]+", " "))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def clip(text: Column, limit: int = MAX_CLAIM) -> Column:
    """Trim, then shorten to ``limit`` UTF-16 units with a closing ellipsis.

    The cut is made on UTF-16 bytes so that characters outside the basic plane
    count twice; a surrogate pair is never halved.
    """
    trimmed = strip(text)
    utf16 = F.encode(trimmed, "UTF-16BE")
    keep = 2 * (limit - 1)
    splits_pair = F.hex(F.substring(utf16, keep - 1, 1)).between("D8", "DB")
    head = F.when(splits_pair, F.substring(utf16, 1, keep - 2)).otherwise(F.substring(utf16, 1, keep))
    shortened = F.concat(F.rtrim(F.decode(head, "UTF-16BE"), F.lit(_CHARACTERS)), F.lit("…"))
    return F.when(F.octet_length(utf16) > 2 * limit, shortened).otherwise(trimmed)


def dedup_key(kind: Column, claim: Column) -> Column:
    """Two records of one kind whose claims differ only in case or spacing are the same."""
    return F.concat(kind, F.lit("\0"), collapse(F.lower(claim)))


def identifier_words(fqn: Column) -> Column:
    """Words of an identifier: split on dots, underscores and before capitals."""
    return F.filter(F.split(fqn, r"\.|_+|(?=[A-Z])"), lambda word: word != "")


def is_local_ref(ref: Column) -> Column:
    """True for a path that can be checked; false for ``scheme://`` references."""
    return ~ref.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://")


def is_constant_name(name: Column) -> Column:
    return name.rlike(r"\A[A-Z_][A-Z0-9_]*\z") & name.rlike("[A-Z]")


def sql_object_name(raw: Column) -> Column:
    """The last part of a dotted name without the quoting character that may stand at each end."""
    quotes = ("`", '"', "[", "]")
    part = F.substring_index(raw, ".", -1)
    opened = F.when(F.left(part, F.lit(1)).isin(*quotes), F.substring(part, 2, 1 << 30)).otherwise(part)
    closed = F.when(F.right(opened, F.lit(1)).isin(*quotes), F.left(opened, F.length(opened) - 1)).otherwise(opened)
    return F.trim(closed)
