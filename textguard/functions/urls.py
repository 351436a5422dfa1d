"""The normal form of a URL's path, as a browser keeps it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a path percent-encodes besides control characters and all beyond ASCII.
_ENCODED = r"""[^\x21\x24-;=\x40-\x5D\x5F\x61-z|~]"""
_ONE_DOT, _TWO_DOTS = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"


def percent_encoded(text: Column) -> Column:
    """The text with each character that a path can't hold as the bytes of its UTF-8."""
    byte = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    made = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(_ENCODED), byte(c)).otherwise(c)), "")
    return F.when(text.rlike(_ENCODED), made).otherwise(text)


def normal_path(path: Column) -> Column:
    """A path (empty or from its first slash on) without dot segments, percent-encoded.

    Segments are a stack: one dot adds nothing, two take the last away, and either of
    them at the end leaves an empty segment. An empty path stays empty, null null.
    """
    segments = F.split(F.substring(path, 2, F.length(path)), "/", -1)
    known = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == F.size(segments) - 1).alias("last")))

    def step(stack: Column, x: Column) -> Column:
        one, two = x["s"].rlike(_ONE_DOT), x["s"].rlike(_TWO_DOTS)
        rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        stay = F.when(two, rest).otherwise(stack)
        return F.when((one | two) & x["last"], F.array_append(stay, F.lit(""))).when(one | two, stay).otherwise(F.array_append(stack, percent_encoded(x["s"])))

    stack = F.aggregate(known, F.array().cast("array<string>"), step)
    return F.when(path == "", path).otherwise(F.concat(F.lit("/"), F.array_join(stack, "/")))
