"""Running English sentences in source files: comments, docstrings and text bodies, not code, string literals or data."""

from __future__ import annotations

import re
import unicodedata

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_MARK = re.compile(r"(?:///?!?|#+!?|--+|;;*|%+|/\*+!?|\*+(?!/)|<!--|\.\.(?= ))(?:\s+|$)")
_END = re.compile(r"\s*(?:\*+/|-->)\s*$")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ASSIGNED = re.compile(r"""[=(,:\[{+]\s*[rbfuRBFU]{0,2}(?:\"{3}|'{3})""")
_WORD = re.compile(r"[^\W\d_]+")
# A line of prose: words with sentence punctuation and inline markup, nothing that code or data has.
_PROSE = re.compile(r"^[^\W\d_(*_`'’-][^=;{}\[\]<>|\\@$%^&+~\"]*$")
_SPLIT = re.compile(r"(?<=[.!?])[\"')*_`]*\s+")


def _flush(lines: list[str], out: list[str]) -> None:
    if lines:
        out.append(" ".join(lines))
        lines.clear()


def paragraphs(text: str) -> list[str]:
    """Blocks of prose lines, without their comment signs and markup."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    out: list[str] = []
    block: list[str] = []
    kind = ""  # how the lines of the open block are marked
    fence = quote = ""
    literal = False
    for line in text.splitlines():
        s = line.strip()
        if quote:
            end = s.find(quote)
            body = s if end < 0 else s[:end]
            if end >= 0:
                quote = ""
            if literal:
                literal = bool(quote)
                continue
            if body and _is_prose(body):
                block.append(body)
            else:
                _flush(block, out)
            if not quote:
                _flush(block, out)
            continue
        if not s:
            _flush(block, out)
            continue
        if s.startswith(("```", "~~~")):
            _flush(block, out)
            fence = "" if fence else s[:3]
            continue
        if fence:
            continue
        opened = '"""' if '"""' in s else "'''" if "'''" in s else ""
        if opened and s.count(opened) % 2 == 1:
            _flush(block, out)
            quote, literal = opened, not s.lstrip("rbfuRBFU").startswith(opened) or bool(_ASSIGNED.search(s))
            body = s.lstrip("rbfuRBFU")[3:].strip()
            if not literal and body and _is_prose(body):
                block.append(body)
            continue
        m = _MARK.match(s)
        if m:
            mark, body = m.group().strip()[:1], s[m.end() :]
        elif opened and s.lstrip("rbfuRBFU").startswith(opened):
            mark, body = opened, s.lstrip("rbfuRBFU")[3:-3]
        else:
            mark, body = "", s
        body = _END.sub("", body)
        if "<" in body:
            body = _TAG.sub("", body).strip()
        if mark != kind:
            _flush(block, out)
            kind = mark
        if body and _is_prose(body) and (mark or " " in body):
            block.append(body)
        else:
            _flush(block, out)
    _flush(block, out)
    return out


def _is_prose(s: str) -> bool:
    return bool(_PROSE.match(s.lstrip("*_`'(’-")))


def sentences(text: str | None) -> list[list[str]]:
    """The words (lower case) of each complete sentence of at least three words."""
    if not text:
        return []
    out = []
    for p in paragraphs(text):
        parts = _SPLIT.split(p)
        for s in parts:
            bare = s.rstrip("\"')*_` ")
            if bare.endswith((".", "!", "?")):
                w = _WORD.findall(bare.lower())
                if len(w) >= 3 and len(bare) <= 12 * len(w) + 40:
                    out.append(w)
    return out
