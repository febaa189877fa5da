"""Evaluation texts leaking into training text.

The test items' word n-grams form a hash set that every task gets, in blocks of at most ``BLOCK_CHARS`` characters of items: a
size that is known before anything is sent. There is one pass over the corpus whatever the number of blocks; a task holds one
block at a time. It brings each document to plain lower-case words (invisible characters, escapes, entities, markup,
comment signs and joins of string pieces fall away), looks up all windows of ``SEED`` words at once, and verifies hits in
two exact steps.

A leak is a span of ``SPAN`` or more successive words of an item with at most one in ten changed, dropped or added. It is
enough to try the lengths of ``SPANS``: a span of 30 to 39 words has at most three edits and its first 30 words no more, and so
for 40 and 50; one of 60 or more can be cut in two parts of at least 30 words of which one has at most one edit in ten. At
least 27 unchanged words lie in at most four runs, 36 in five or 45 in six, so one run has seven words or more: windows of seven
words miss no leak. Verification first counts, around each seed, the item's words that occur in the document within the
possible shift (all but the edits in some span), then computes the edit distance of each such span bit-parallel. No
shuffle; no pair is capped.

``leaked`` lists documents and items, ``clean`` leaves such documents out, ``redacted`` cuts the leaking passages out of them.

Defined results: null and empty texts and items of fewer than ``SPAN`` words give no rows; each (document row, item) is
reported once; repeated document rows give repeated rows; an empty item table gives no rows. Where a passage's place in the
text as written can't be told, ``redacted`` cuts the whole text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED, SPAN, EDITS = 7, 30, 3
#: Lengths of spans with the edits they may have; any longer leak holds one of these.
SPANS = [(SPAN + 10 * k, EDITS + k) for k in range(3)]
BLOCK_CHARS = 32_000_000
SLICE_CHARS = 4_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[uU]\{([0-9a-fA-F]{1,6})\}|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|[abfnrtv0])")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>|<!--|-->")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:(?://+[/!]?|#+|\*+|--+|;+|%+|>+)[ \t]*)?(?=[^\W\d_])")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
# Tags that stand within words.
_INLINE = frozenset("a abbr b big code del em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())


def _unescape(m: re.Match) -> str:
    digits = m.group(1) or m.group(2) or m.group(3) or m.group(4)
    if digits:
        code = int(digits, 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "
    return " "


def plain(text: str) -> str:
    """The text in lower case without invisible characters, escapes, entities and markup."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group(1) and m.group(1).lower() in _INLINE else " ", text)
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """Runs of letters of the plain text."""
    if not text:
        return []
    text = plain(text)
    return re.findall("[a-z]+", text) if text.isascii() else re.findall(r"[^\W\d_]+", text)


def seed_codes(ids: np.ndarray) -> np.ndarray:
    """A hash of each window of ``SEED`` word ids (uint64 arithmetic modulo 2**64)."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    u = ids.astype(np.uint64)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        code = (code ^ u[k : k + n]) * _MULTIPLIER
        code ^= code >> np.uint64(29)
    return code


def _substitute(pattern: re.Pattern, replace, text: str, at: list[int]) -> tuple[str, list[int]]:  # noqa: ANN001
    """``pattern.sub`` that keeps, for each character of the result, its place in the text as written."""
    out, places, last = [], [], 0
    for m in pattern.finditer(text):
        new = replace(m)
        out += [text[last : m.start()], new]
        places += at[last : m.start()] + [at[m.start()] if m.start() < len(at) else 0] * len(new)
        last = m.end()
    out.append(text[last:])
    return "".join(out), places + at[last:]


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_CLUSTER = re.compile(r"[^\x00-\x7f][\u0300-\u036f]*|[\x00-\x7f][\u0300-\u036f]+")


def placed_words(text: str) -> tuple[list[str], list[tuple[int, int]]] | None:
    """The words of ``words`` with the part of the text each comes from; null if they can't be told apart."""
    plain_, at = text, list(range(len(text)))
    if "\\" in plain_:
        plain_, at = _substitute(_ESCAPE, _unescape, plain_, at)
    if "&" in plain_ and ";" in plain_:
        plain_, at = _substitute(_ENTITY, lambda m: html.unescape(m.group()), plain_, at)
    if not plain_.isascii():
        plain_, at = _substitute(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m.group()), plain_, at)
        plain_, at = _substitute(_INVISIBLE, lambda _: "", plain_, at)
    if "<" in plain_:
        plain_, at = _substitute(_TAG, lambda m: "" if m.group(1) and m.group(1).lower() in _INLINE else " ", plain_, at)
    if "-\n" in plain_ or "-\r" in plain_:
        plain_, at = _substitute(_BROKEN, lambda _: "", plain_, at)
    found = list(re.finditer(r"[^\W\d_]+", plain_))
    made = [m.group().lower() for m in found]
    if made != words(text):
        return None
    return made, [(at[m.start()], at[m.end() - 1] + 1) for m in found]


class Items:
    """The hash set of a block of test items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        split = [(k, w) for k, w in ((k, words(t)) for k, t in items) if len(w) >= SPAN]
        self.item_ids = np.array([k for k, _ in split], dtype=np.int64)
        self.vocabulary: dict[str, int] = {}
        for _, w in split:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        lists = [np.array([self.vocabulary[x] for x in w], dtype=np.int32) for _, w in split]
        # Items end to end, with gaps of id -1 that match nothing (0 is any word outside the vocabulary).
        gap = np.full(2 * SPAN, -1, dtype=np.int32)
        self.stream = np.concatenate([gap, *[x for a in lists for x in (a, gap)]]) if lists else gap
        self.owner = np.concatenate([np.full(len(gap), -1, dtype=np.int32), *[np.concatenate([np.full(len(a), i, dtype=np.int32), np.full(len(gap), -1, dtype=np.int32)]) for i, a in enumerate(lists)]]) if lists else np.full(len(gap), -1, dtype=np.int32)
        codes = seed_codes(self.stream)
        inside = np.array([i for i in range(len(codes)) if self.owner[i] >= 0 and self.owner[i] == self.owner[i + SEED - 1]], dtype=np.int64)
        codes = codes[inside]
        order = np.argsort(codes, kind="stable")
        self.codes, self.positions = codes[order], inside[order]


def within(pattern: list[int], text: list[int], most: int) -> bool:
    """Whether ``pattern`` occurs in ``text`` with at most ``most`` edits (bit-parallel edit distance, free ends in the text)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, x in enumerate(pattern):
        if x > 0:
            masks[x] = masks.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for x in text:
        eq = masks.get(x, 0) if x > 0 else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most:
            return True
    return False


def _passages(items: Items, doc: np.ndarray, p: np.ndarray, j: np.ndarray, found: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Positions (start, stop) of what documents share with items they leak: runs of seeds at most ten words apart, short ones only if there is no other."""
    seeds = sorted((int(items.owner[b]), int(a), int(b)) for a, b in zip(p, j) if (int(doc[a]), int(items.owner[b])) in found)
    runs: list[list[int]] = []  # item, start, stop, diagonal
    for item, a, b in seeds:
        if runs and runs[-1][0] == item and a <= runs[-1][2] + 10 and abs(a - b - runs[-1][3]) <= 10:
            runs[-1][2:] = [max(runs[-1][2], a + SEED), a - b]
        else:
            runs.append([item, a, a + SEED, a - b])
    long = [r for r in runs if r[2] - r[1] >= SPAN - 2 * EDITS]
    return [(r[1], r[2]) for r in (long or runs)]


def _verify(items: Items, ids: np.ndarray, doc: np.ndarray, p: np.ndarray, j: np.ndarray, span: int, edits: int, found: set[tuple[int, int]]) -> None:
    """Add to ``found`` the pairs with ``span`` words of the item within ``edits`` edits around a seed at ``p`` and ``j``."""
    reach = np.arange(-(span - SEED), span + edits)
    for at in range(0, len(p), 20_000):
        ps, js = p[at : at + 20_000], j[at : at + 20_000]
        item = items.stream[js[:, None] + reach]
        item = np.where(items.owner[js[:, None] + reach] == items.owner[js][:, None], item, -1)
        near = np.zeros(item.shape, dtype=bool)
        for s in range(-edits, edits + 1):
            near |= (ids[np.clip(ps[:, None] + reach + s, 0, len(ids) - 1)] == item) & (item > 0)
        covered = np.concatenate([np.zeros((len(ps), 1), dtype=np.int32), np.cumsum(near, axis=1, dtype=np.int32)], axis=1)
        spans = covered[:, span:] - covered[:, :-span]
        whole = (item[:, : item.shape[1] - span + 1] >= 0) & (item[:, span - 1 :] >= 0)
        for k in np.flatnonzero(((spans >= span - edits) & whole).any(axis=1)):
            pair = (int(doc[ps[k]]), int(items.owner[js[k]]))
            if pair in found:
                continue
            text_lo, text_hi = max(0, ps[k] + reach[0] - 2 * edits), ps[k] + reach[-1] + 2 * edits + 1
            text = np.where(doc[text_lo:text_hi] == doc[ps[k]], ids[text_lo:text_hi], -1).tolist()
            for a in np.flatnonzero((spans[k] >= span - edits) & whole[k]):
                if within(item[k, a : a + span].tolist(), text, edits):
                    found.add(pair)
                    break


def leaks(items: Items, ids: np.ndarray, doc: np.ndarray, places: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """(document index, item index) of all leaks; ``ids`` are word ids with gaps between documents, ``doc`` their owners.

    ``places`` takes the positions of the passages they share.
    """
    if not len(items.codes):
        return []
    codes = seed_codes(ids)
    known = ids > 0
    run = np.concatenate([[0], np.cumsum(known)])
    full = np.flatnonzero(run[SEED:] - run[:-SEED] == SEED) if len(codes) else np.zeros(0, dtype=np.int64)
    lo = np.searchsorted(items.codes, codes[full], side="left")
    n = np.searchsorted(items.codes, codes[full], side="right") - lo
    full, lo, n = full[n > 0], lo[n > 0], n[n > 0]
    p = np.repeat(full, n)
    j = items.positions[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    # Of successive seeds on one diagonal only the first is needed.
    first = (ids[np.maximum(p - 1, 0)] != items.stream[j - 1]) | (ids[np.maximum(p - 1, 0)] <= 0)
    found: set[tuple[int, int]] = set()
    for span, edits in SPANS:
        _verify(items, ids, doc, p[first], j[first], span, edits, found)
    if places is not None:
        places += _passages(items, doc, p, j, found)
    return sorted(found)


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[Items]:
    """The items block by block; the driver holds one block."""
    block: list[tuple[int, str | None]] = []
    size = 0
    for key, text in items.select(F.col(item_id).cast("long"), item_text).filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield Items(block)
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield Items(block)


def _values(shared: list) -> Iterator[Items]:
    """The blocks one at a time; several are read from the broadcast's file as they are needed and not kept."""
    if len(shared) == 1:
        yield shared[0].value
        return
    for b in shared:
        path = getattr(b, "_path", None)
        yield b.load_from_path(path) if path else b.value


def _word_ids(it: Items, split: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of documents end to end with gaps, and the owner of each position."""
    gap = np.full(2 * SPAN, -1, dtype=np.int32)
    get = it.vocabulary.get
    parts, owners = [gap], [gap]
    for k, w in split:
        parts += [np.array([get(x, 0) for x in w], dtype=np.int32), gap]
        owners += [np.full(len(w), k, dtype=np.int32), gap]
    return np.concatenate(parts), np.concatenate(owners)


def _share(docs: DataFrame, items: DataFrame, item_id: str, item_text: str) -> list:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(items, item_id, item_text)]


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id): each document that holds a passage of a test item."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", T.LongType())])
    shared = _share(docs, items, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size, split = start, 0, []
                while stop < len(texts) and (stop == start or size < SLICE_CHARS):
                    w = words(texts[stop])
                    if len(w) >= SPAN - EDITS:
                        split.append((stop, w))
                    size += len(texts[stop] or "")
                    stop += 1
                for it in _values(shared):
                    got = leaks(it, *_word_ids(it, split))
                    if got:
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array([d for d, _ in got])), pa.array(it.item_ids[[i for _, i in got]])], names=["doc_id", "item_id"])
                start = stop

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of any test item."""
    return docs.join(leaked(docs, items).select("doc_id").distinct(), "doc_id", "left_anti")


def cut(text: str | None, blocks: list[Items]) -> tuple[str | None, int]:
    """The text without its leaking passages, and how many there were; repeated until nothing leaks."""
    total = 0
    while text:
        spans: list[tuple[int, int]] = []
        for it in blocks:
            placed = placed_words(text)
            w = placed[0] if placed else words(text)
            places: list[tuple[int, int]] = []
            if not leaks(it, *_word_ids(it, [(0, w)]), places):
                continue
            if placed is None:
                return "", total + 1
            spans += [(placed[1][a - 2 * SPAN][0], placed[1][min(b, len(w) + 2 * SPAN) - 1 - 2 * SPAN][1]) for a, b in places]
        if not spans:
            break
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        total += len(merged)
        edges = [0, *[x for m in merged for x in m], len(text)]
        # A sign of the cut stays, so that what is left on both sides makes no new passage.
        text = "\n".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
    return text, total


def redacted(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, n_cut): all documents, with the leaking passages cut out of those that have any."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_cut", T.IntegerType())])
    shared = _share(docs, items, "item_id", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            split = [(k, w) for k, x in enumerate(texts) if len(w := words(x)) >= SPAN - EDITS]
            hit = {d for it in _values(shared) for d, _ in leaks(it, *_word_ids(it, split))} if split else set()
            made = [cut(x, list(_values(shared))) if k in hit else (x, 0) for k, x in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], names=["doc_id", "text", "n_cut"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
