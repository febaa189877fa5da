"""Three kinds of glob, compiled to Column predicates: whole-URL, per-level and right-anchored path patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("*[]?")


def glob_body(pattern: str, star: str = ".*", one: str = ".") -> str:
    """Regular expression of a shell pattern, valid in Java and RE2."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(star)
        elif c == "?":
            out.append(one)
        elif c == "[":
            j = i + 1 if i < len(pattern) and pattern[i] in "!]" else i
            if j < len(pattern) and pattern[i : i + 2] == "!]":
                j += 1
            end = pattern.find("]", j)
            if end < 0:
                out.append(r"\[")
            else:
                inner = pattern[i:end].replace("\\", r"\\").replace("[", r"\[")
                out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
                i = end + 1
        else:
            out.append("\\" + c if c in r"\.^$+{}()|&~#" else c)
    return "".join(out)


def url_regex(pattern: str) -> str:
    """Matches a whole URL; ``*`` crosses slashes."""
    return rf"^(?s:{glob_body(pattern)})\z"


def level_regex(pattern: str) -> str:
    """Matches one path segment."""
    return rf"^(?s:{glob_body(pattern)})\z"


def path_regex(pattern: str) -> str:
    """Right-anchored, segment by segment; a leading slash anchors the left, too."""
    parts = [p for p in pattern.split("/") if p]
    body = "/".join(glob_body(p, "[^/]*", "[^/]") for p in parts)
    return (r"^/" if pattern.startswith("/") else r"(^|/)") + body + r"\z"


@dataclass(frozen=True)
class Query:
    """A URL query: static prefix, depth (None: no glob, -1: any), literal file name, glob of the last segment."""

    base: str
    depth: int | None
    file: str | None
    glob: str | None
    levels: tuple[str, ...] = ()


_GLOB = r"[^/]*[*\[\]?][^/]*"
#: A URL query: what holds no glob sign up to a slash, the segments after that, the last segment (which may be empty).
_QUERY = re.compile(rf"(?P<base>(?:[^/*\[\]?]*/)*?)(?:(?P<levels>{_GLOB}(?:/[^/]*)*)/)?(?P<last>[^/]*)", re.S)


def parse_query(url: str) -> Query:
    """Split a URL query into static prefix, levels and last segment.

    A query without glob signs names a folder; ``**`` stands for any depth and must be the only level.
    """
    m = _QUERY.fullmatch(url)
    levels, last = tuple(m["levels"].split("/")) if m["levels"] else (), m["last"]
    if not levels and not _SPECIAL.intersection(last):
        return Query(f"{url.rstrip('/')}/", None, None, None)
    deep = levels == ("**",)
    if not deep and "**" in levels:
        raise ValueError(f"'**' must be the only level of a query: {url}")
    named = {"glob": last} if _SPECIAL.intersection(last) else {"file": last or None}
    return Query(m["base"].rstrip("/") + "/", -1 if deep else len(levels), named.get("file"), named.get("glob"), () if deep else levels)


def predicate(url: Column, query: Query) -> Column:
    """Objects that a query finds. The prefix is a conjunct of its own, as it alone can be pushed to the scan."""
    p = url.startswith(query.base)
    if query.depth is None:
        return p
    if query.depth < 0:
        if query.glob is not None:
            return p & url.rlike(url_regex(query.glob))
        return p & url.endswith("/" + query.file) if query.file is not None else p
    rel = F.split(F.substr(url, F.lit(len(query.base) + 1)), "/")
    p = p & (F.size(rel) == query.depth + 1)
    for i, level in enumerate(query.levels):
        p = p & F.get(rel, F.lit(i)).rlike(level_regex(level))
    if query.glob is not None:
        return p & url.rlike(url_regex(query.glob))
    return p & (F.get(rel, F.lit(query.depth)) == query.file) if query.file is not None else p


def is_query(uris: Column | str) -> Column:
    """Whether given addresses are to be searched: a single one with a ``*``; anything else is a list of objects."""
    u = F.col(uris) if isinstance(uris, str) else uris
    return (F.size(u) == 1) & F.coalesce(F.get(u, F.lit(0)).contains("*"), F.lit(False))
