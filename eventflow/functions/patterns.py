"""Regular expressions that never fail a job."""

from __future__ import annotations

from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=4096)
def is_valid_pattern(pattern: str) -> bool:
    """Ask Spark itself; the query folds to a constant, so no job is started."""
    spark = SparkSession.active()
    try:
        spark.sql("SELECT '' RLIKE :p", args={"p": pattern}).head()
    except PySparkException:
        return False
    return True


def search(text: Column, pattern: str) -> Column:
    """Unanchored search; NULL text or an invalid pattern is simply no match."""
    if not is_valid_pattern(pattern):
        return F.lit(False)
    return F.coalesce(text.rlike(pattern), F.lit(False))


def valid_patterns(spark: SparkSession, patterns: list[str | None]) -> list[bool]:
    """The same for many patterns: each is compiled once by the driver's JVM, without a query."""
    compile_ = spark._jvm.java.util.regex.Pattern.compile

    def fits(pattern: str | None) -> bool:
        if pattern is None:
            return False
        try:
            compile_(pattern)
        except PySparkException:
            return False
        return True

    return [fits(p) for p in patterns]


def needed_texts(pattern: str, least: int = 2) -> list[str] | None:
    """Texts one of which stands in every text the pattern is found in; None if none of ``least`` characters is sure.

    From each top-level alternative the longest run of plain characters is taken. Whatever may change the
    meaning of plain characters (flags, quotations, look-around, numeric escapes) gives None.
    """
    texts, best, run, i = [], "", "", 0
    while i <= len(pattern):
        c = pattern[i : i + 1]
        if c and c not in "|([\\?*+{.^$)":
            run, i = run + c, i + 1
            continue
        if c == "\\":
            escaped = pattern[i + 1 : i + 2]
            if escaped and not escaped.isalnum():
                run, i = run + escaped, i + 2
                continue
            if not escaped or escaped not in "dDwWsSbB":
                return None
        if c in ("?", "*", "{"):  # the character before may be absent
            run = run[:-1]
        best, run = max(best, run, key=len), ""
        if c in ("", "|"):
            if len(best) < least:
                return None
            texts.append(best)
            best = ""
        after = _after_atom(pattern, i)
        if after is None:
            return None
        i = after
    return texts


def _after_atom(pattern: str, i: int) -> int | None:
    """The place behind the group, class, count, escape or sign at ``i``; None where that is not sure."""
    c = pattern[i : i + 1]
    if c == ")":
        return None
    if c == "\\":
        return i + 2
    if c == "{":
        end = pattern.find("}", i)
        return end + 1 if end > 0 else None
    if c == "[":
        i += 2 if pattern[i + 1 : i + 2] == "^" else 1
        if pattern[i : i + 1] == "]":
            return None
        while pattern[i : i + 1] not in ("]", "[", ""):
            if pattern[i] == "\\" and pattern[i + 1 : i + 2] in ("Q", ""):
                return None
            i += 2 if pattern[i] == "\\" else 1
        return i + 1 if pattern[i : i + 1] == "]" else None
    if c == "(":
        if pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] != ":":
            return None
        i += 3 if pattern[i + 1 : i + 2] == "?" else 1
        while pattern[i : i + 1] != ")":
            inner = pattern[i : i + 1]
            if not inner or (inner == "\\" and pattern[i + 1 : i + 2] in ("Q", "")):
                return None
            after = _after_atom(pattern, i) if inner in "\\([" else i + 1
            if after is None:
                return None
            i = after
        return i + 1
    return i + 1
