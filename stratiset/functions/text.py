"""Scalar functions over text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word borders are Unicode-aware on every Java version.
_TOKEN = r"(?<![\p{L}\p{M}\p{N}_])[a-z0-9]+(?![\p{L}\p{M}\p{N}_])"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers that stand between borders; repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 0)


def long_words(text: Column, least: int = 4) -> Column:
    """Distinct words between white space (Unicode) of at least so many code points, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.length(w) >= least))


def byte_prefix(text: Column, n: int = 2000) -> Column:
    """The first ``n`` bytes of the UTF-8 text, without what is cut in the middle of a character."""
    data = F.encode(text, "UTF-8")
    head = F.make_valid_utf8(F.substring(data, 1, n).cast("string"))
    # a byte that goes on with a character follows: the mark at the end stands for that character's beginning
    goes_on = F.hex(F.substring(data, n + 1, 1)).between("80", "BF")
    return F.when(F.octet_length(text) <= n, text).when(goes_on, F.regexp_replace(head, "\uFFFD$", "")).otherwise(head)


def preview(text: Column, n: int = 4) -> Column:
    """The first ``n`` words between white space."""
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, n), " ")


def last_number(log: Column, unit: str) -> Column:
    """The last number that a log gives ``unit`` (``unit = 1.5`` or ``unit: 1.5``, in either case), as a double; null without one."""
    found = F.regexp_extract_all(log, F.lit("(?i)" + re.escape(unit) + r"\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("double")


def whole_number(word: Column) -> Column:
    """The number that a word of digits alone stands for, else null."""
    return F.when(word.rlike("^[0-9]+$"), word.try_cast("bigint"))
