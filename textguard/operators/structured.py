"""Candidates that have an inner structure: damaged PEM blocks, JWTs, database URLs, JSON.

Everything but JSON is JVM expressions on the spans of a pattern. JSON text needs
a parser that keeps the order of members, so its string leaves come from an Arrow
function that gets the texts which may hold JSON and null for all others.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import scalars as S
from textguard.functions.scalars import B

#: Fixed value: how far a PEM footer is looked for.
PEM_REACH = 16_384
_LABEL = r"((?:RSA[ \t]+|EC[ \t]+)?PRIVATE KEY)"
PEM_BEGIN = rf"(?:\A|\r?\n)-{{4,5}}BEGIN[ \t]+{_LABEL}-{{4,5}}[ \t]*(?:\r?\n|\z)"
_BEGIN_PARTS = rf"^(-{{4,5}})BEGIN[ \t]+{_LABEL}(-{{4,5}})"
#: body, the footer with its line feed, hyphens, label, hyphens
PEM_END = rf"^([\s\S]*?)((?:\A|\r?\n)(-{{4,5}})END[ \t]+{_LABEL}(-{{4,5}})[ \t]*)(?:\r?\n|\z)"
PEM_LINES = r"^[A-Za-z0-9+/=]{16,}(?:\r?\n[A-Za-z0-9+/=]{16,})*"
#: Fault of the block, confidence.
PEM_FAULTS = (("malformed-boundary", 0.93), ("mismatched-labels", 0.88), ("missing-footer", 0.74))

JWT = rf"{B}[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}{B}"

SCHEMES = r"postgresql|postgres|mysql|mongodb(?:\+srv)?|redis|rediss"
DB_URL = rf"(?i){B}(?:{SCHEMES})://[^\s'\"<>]*[^\s'\"<>),.;]"
#: scheme, user, password, host, port, path
DB_PARTS = r"(?i)^([a-z+]+)://([^:/?#]+):([^/?#]+)@([^/?#@:\[\]\\^|]+|\[[0-9a-f:.]+\])(?::(\d{0,5}))?((?:/[^?#]*)?)(?:[?#].*)?\z"
#: scheme, user, password, what follows
DB_DAMAGED = r"(?i)^([a-z+]+)://([^:@/?#]+):([^@/?#]{4,})@(.*)\z"


def pem_faults(text: Column, spans: Column) -> Column:
    """array<struct<start, value, key>> of the private-key blocks at the BEGIN lines
    in ``spans`` that aren't whole; key names the fault.

    With a footer in reach, the body must look encoded; without one, its leading
    lines must be long and varied enough.
    """

    def block(s: Column) -> Column:
        line = F.regexp_replace(s["value"], r"^\r?\n", "")
        start = s["start"] + F.length(s["value"]) - F.length(line)
        after = s["start"] + F.length(s["value"])
        rest = F.substring(text, after + 1, F.lit(PEM_REACH))
        return F.struct(line.alias("line"), start.alias("start"), rest.alias("rest"))

    def judged(b: Column) -> Column:
        part = lambda i: F.regexp_extract(b["rest"], PEM_END, i)
        label = lambda c: F.regexp_replace(c, r"\s+", " ")
        closed, same = part(2) != "", label(F.regexp_extract(b["line"], _BEGIN_PARTS, 2)) == label(part(4))
        exact = F.length(F.concat(F.regexp_extract(b["line"], _BEGIN_PARTS, 1), F.regexp_extract(b["line"], _BEGIN_PARTS, 3), part(3), part(5))) == 20
        compact, inner = F.regexp_replace(part(1), r"\s", ""), F.regexp_replace(part(1), r"^\s+|\s+\z", "")
        encoded = compact.rlike(r"^[A-Za-z0-9+/=_-]{8,}\z") & ~inner.rlike(r"[^\S\r\n]|\r(?!\n)")
        lines = F.regexp_extract(b["rest"], PEM_LINES, 0)
        letters = F.regexp_replace(lines, r"\s", "")
        varied = (F.length(letters) >= 64) & (F.size(F.array_distinct(F.split(letters, ""))) >= 8) & (F.contains(lines, F.lit("\n")) | (F.length(letters) >= 96))
        key = F.when(closed, F.when(~(exact & same) & encoded, F.when(same, PEM_FAULTS[0][0]).otherwise(PEM_FAULTS[1][0]))).otherwise(F.when(varied, PEM_FAULTS[2][0]))
        value = F.concat(b["line"], F.when(closed, F.concat(part(1), part(2))).otherwise(lines))
        return F.struct(b["start"].alias("start"), value.alias("value"), key.alias("key"))

    return F.filter(F.transform(F.transform(spans, block), judged), lambda x: x["key"].isNotNull())


def is_json_object(part: Column) -> Column:
    """Whether a base64url part of a token holds a JSON object."""
    padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), "=")
    decoded = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    return is_whole_object(decoded)


def is_whole_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else; false for null.

    The parser takes the first value of a text and leaves the rest. Between brackets and as
    a member's value, a rest would have to close both before it comes, which it can't.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    kind = F.schema_of_variant(F.try_variant_get(member, "$.v", "variant"))
    return F.coalesce(alone.isNotNull() & kind.startswith("OBJECT"), F.lit(False))


def jwt_parts(value: Column) -> Column:
    """11, 10, 01 or 00: whether the header and the payload decode."""
    part = lambda i: F.when(is_json_object(F.split_part(value, F.lit("."), F.lit(i))), "1").otherwise("0")
    return F.concat(part(1), part(2))


def db_part(value: Column, i: int) -> Column:
    return F.regexp_extract(value, DB_PARTS, i)


def is_db_url(value: Column) -> Column:
    """A URL with a user, a password and a host, its port in range."""
    port = F.coalesce(db_part(value, 5).try_cast("int"), F.lit(0))
    return value.rlike(DB_PARTS) & (port <= 65_535)


def db_port(value: Column) -> Column:
    """The port with its colon; empty without one."""
    port = db_part(value, 5).try_cast("int")
    return F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit(""))


def db_password(value: Column) -> Column:
    """The password of a whole URL, percent-decoded where it can be; else that of a damaged one."""
    password = db_part(value, 3)
    plain = F.coalesce(F.try_url_decode(F.replace(password, F.lit("+"), F.lit("%2B"))), password)
    return F.when(is_db_url(value), plain).otherwise(F.regexp_extract(value, DB_DAMAGED, 3))


_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.I)
_LEAVES = "array<struct<start:int, key:string, parsed:string, value:string>>"


def _members(node: dict) -> list[tuple[str, object]]:
    """Members in the order in which a browser lists them: array indices first."""
    index = lambda k: k.isdecimal() and k.isascii() and str(int(k)) == k and int(k) < 2**32 - 1 if len(k) < 11 else False
    numbers = sorted((k for k in node if index(k)), key=int)
    return [(k, node[k]) for k in numbers] + [(k, v) for k, v in node.items() if not index(k)]


def _refuse(name: str) -> None:
    raise ValueError(name)


def _leaves_of(text: str, region: str, at: int) -> list[tuple[int, str, str, str]]:
    """The string leaves of one JSON region, found again in the text from left to right."""
    try:
        tree = json.loads(region, parse_int=lambda s: 0, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return []
    out, cursor, stack = [], at, [("", tree)]
    while stack:
        key, node = stack.pop()
        if isinstance(node, list):
            stack.extend((key, x) for x in reversed(node))
        elif isinstance(node, dict):
            stack.extend(reversed(_members(node)))
        elif isinstance(node, str) and key:
            literal = json.dumps(node, ensure_ascii=False)
            found = text.find(literal, cursor, at + len(region))
            if found >= 0:
                cursor = found + len(literal)
                out.append((found + 1, key, node, literal[1:-1]))
    return out


def _json_leaves(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[tuple[int, str, str, str]]:
        if text is None:
            return []
        out, whole = [], text.strip()
        if whole[:1] + whole[-1:] in ("{}", "[]"):
            out += _leaves_of(text, whole, text.index(whole))
        for m in _FENCE.finditer(text):
            region = m[1].strip()
            if region:
                out += _leaves_of(text, region, m.start() + m[0].index(region))
        # half of a surrogate pair can't leave Python
        return [x for x in out if all(s.encode("utf-8", "ignore").decode() == s for s in x[1:])]

    return texts.map(one)


def json_leaves(text: Column) -> Column:
    """array<struct<start, key, parsed, value>>: the string leaves of a text that is
    JSON and of its fenced JSON regions; empty for null."""
    return F.pandas_udf(_json_leaves, _LEAVES)(text)


def may_hold_json(text: Column) -> Column:
    return text.rlike(r"^\s*[{\[]") | F.contains(text, F.lit("```"))
