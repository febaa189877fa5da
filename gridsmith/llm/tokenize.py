"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are cut into pieces at white space (an optional leading space stays with its piece) and pieces into words by the
tokenizer's own pattern. The merges are done in DuckDB, inside each task: token-position rows of all words that the
worker has not met yet join the merge table in one recursive query, which contracts pairs of least rank until none is
left; an ordered aggregation gives the words' ids. The recursion is keyed by position (USING KEY): it holds the current
tokens only, and a step writes only the positions it changes.

Contracting the leftmost pair of least rank of a word, one at a time, would take as many steps as a word has merges. So
words are laid out in cells of at least twice the length of the longest token they can form, and a step contracts, in
each cell, the pairs of the least rank of the cell and its two neighbours on either side (of overlapping ones, which are
equal tokens, every second from the left). The result is the same: another merge could only come before such a pair by
making a token that holds one of its halves; that token would hold a pair of lower rank that is there already, not
farther away than a token is long. A word of up to a cell's length thereby contracts its pair of least rank a step, and
the number of steps does not grow with the length of the longest word.

A worker keeps the ids of pieces it has met, at most ``MEMO_BYTES`` of them, so repeated words cost one look-up. Words go
to the query in batches of like length and at most ``BATCH_BYTES`` (one longer word is a batch of its own). A batch takes
about ``LETTER_BYTES`` of memory a letter; nothing is spilled. No shuffle.

Defined results: an empty list for empty and for null texts; texts that look like special tokens are plain text; characters
that cannot be encoded (lone surrogates) become the replacement character; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO_BYTES = 96 << 20
BATCH_BYTES = 1 << 20
LETTER_BYTES = 400
SLICE_CHARS = 4_000_000
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Unicode white space, as the tokenizer's pattern means it.
WS = r"\t-\r \x85\xa0  -     　"
PIECES = rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

# Cells of a word of letters and of any other word: twice the bytes of the longest token of that kind.
_LETTERS = re.compile(rb" ?[A-Za-z]+")

_MERGE = """
WITH RECURSIVE t(g, word, cell, tok) USING KEY (g) AS (
    SELECT g, word, cell, tok FROM words
    UNION
    (WITH pairs AS MATERIALIZED (
        SELECT q.*, m.new, m.rank
        FROM (
            SELECT g, word, cell, tok, lead(tok) OVER w AS nxt, lead(g) OVER w AS ng, lag(tok) OVER w IS DISTINCT FROM tok AS fresh
            FROM recurring.t WHERE tok >= 0 AND word IN (SELECT word FROM t) WINDOW w AS (PARTITION BY word ORDER BY g)
        ) q JOIN merges m ON q.tok = m.l AND q.nxt = m.r
    ),
    least AS (
        SELECT cell, rank, min(rank) OVER (ORDER BY cell RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around
        FROM (SELECT cell, min(rank) AS rank FROM pairs GROUP BY cell)
    ),
    best AS (
        SELECT p.g, p.ng, p.word, p.cell, p.new FROM pairs p JOIN least l ON l.cell = p.cell AND l.rank = p.rank AND l.rank = l.around
        WHERE p.tok <> p.nxt
        UNION ALL
        SELECT p.g, p.ng, p.word, p.cell, p.new
        FROM (SELECT *, max(CASE WHEN fresh THEN g END) OVER (PARTITION BY word ORDER BY g) AS since FROM pairs WHERE tok = nxt) p
        JOIN least l ON l.cell = p.cell AND l.rank = p.rank AND l.rank = l.around
        WHERE (p.g - p.since) // (p.ng - p.g) % 2 = 0 AND p.g - p.since <= $width
    )
    SELECT g, word, cell, new FROM best UNION ALL SELECT ng, word, cell, -1 FROM best)
)
SELECT word, list(tok ORDER BY g) AS ids FROM t WHERE tok >= 0 GROUP BY word ORDER BY word
"""


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The per-worker state: merge table in DuckDB and the ids of the pieces met so far."""

    def __init__(self, vocabulary: str):
        import duckdb
        import regex

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        table = pa.table({
            "l": pa.array([vocab[a] for a, _ in merges], pa.int32()), "r": pa.array([vocab[b] for _, b in merges], pa.int32()),
            "rank": pa.array(range(len(merges)), pa.int32()), "new": pa.array([vocab[a + b] for a, b in merges], pa.int32()),
        })
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")
        letters = byte_alphabet()
        inverse = {c: b for b, c in letters.items()}
        # The bytes of all tokens end to end, by id, for the way back.
        table_ = {i: x for x, i in vocab.items()}
        raw = [bytes(inverse[c] for c in table_[i]) if i in table_ and all(c in inverse for c in table_[i]) else b"" for i in range(max(vocab.values()) + 1)]
        self.token_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.token_length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        tokens = [bytes(inverse[c] for c in x) for x in vocab if all(c in inverse for c in x)]
        self.width = 2 * max(map(len, tokens))
        self.letter_width = 2 * max(len(x) for x in tokens if _LETTERS.fullmatch(x))
        self.words, self.ascii_words = regex.compile(WORDS), re.compile(ASCII_WORDS)
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.values = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int64)
        self.used = self.size = 0

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, in batches of like length and bounded size."""
        raw = [w.encode("utf-8", "replace") for w in words]
        # Letters and other words have cells of other widths, so they don't share a batch.
        kind = [_LETTERS.fullmatch(r) is not None for r in raw]
        out: list = [None] * len(raw)
        batch: list[int] = []
        size = 0
        for i in [*sorted(range(len(raw)), key=lambda k: (kind[k], len(raw[k]))), -1]:
            if batch and (i < 0 or kind[i] != kind[batch[0]] or size + len(raw[i]) > BATCH_BYTES or len(raw[i]) > 8 * max(len(raw[batch[0]]), 8)):
                for k, ids in zip(batch, self._merge([raw[k] for k in batch], self.letter_width if kind[batch[0]] else self.width)):
                    out[k] = ids
                batch, size = [], 0
            if i >= 0:
                batch.append(i)
                size += len(raw[i])
        return out

    def _merge(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        starts, at = np.cumsum(sizes) - sizes, np.arange(int(sizes.sum()))
        # Between the cells of two words lie two that are empty, so that no word sees another.
        cells = sizes // width + 3
        first = np.cumsum(cells) - cells
        rows = pa.table({
            "g": pa.array(at), "word": pa.array(np.repeat(np.arange(len(raw), dtype=np.int32), sizes)),
            "cell": pa.array((np.repeat(first, sizes) + (at - np.repeat(starts, sizes)) // width).astype(np.int32)),
            "tok": pa.array(self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]),
        })
        self.db.execute(f"SET memory_limit = '{max(400, 100 + len(at) * LETTER_BYTES // 1_000_000)}MB'")
        self.db.register("words", rows)
        out = self.db.sql(_MERGE.replace("$width", str(width))).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("words")
        ids, offsets = out.values.to_numpy(), out.offsets.to_numpy()
        return [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    def _store(self, piece: str, ids: np.ndarray) -> None:
        k = len(self.memo)
        if k == len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.used : self.used + len(ids)] = ids
        self.starts[k], self.lengths[k] = self.used, len(ids)
        self.used += len(ids)
        self.size += 2 * len(piece) + 8 * len(ids) + 150
        self.memo[piece] = k

    def learn(self, pieces: set[str]) -> None:
        split = {p: (self.ascii_words if p.isascii() else self.words).findall(p) for p in sorted(pieces)}
        words = sorted({w for ws in split.values() for w in ws})
        ids = dict(zip(words, self.merge(words)))
        for p, ws in split.items():
            self._store(p, ids[ws[0]] if len(ws) == 1 else np.concatenate([ids[w] for w in ws]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts)."""
        found = [re.findall(PIECES, t) if t else [] for t in texts]
        new = set()
        for ps in found:
            new.update(ps)
        new = {p for p in new if p not in self.memo}
        if new and self.size > MEMO_BYTES:
            self.clear()
            new = {p for ps in found for p in ps}
        if new:
            self.learn(new)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        get = self.memo.__getitem__
        index = np.fromiter((k for ps in found for k in map(get, ps)), dtype=np.int64, count=int(counts.sum()))
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        ids = self.values[np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts end to end, offsets of the texts)."""
        lengths = self.token_length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.token_start[ids] - ends[:-1], lengths) + np.arange(int(ends[-1]))
        return self.token_bytes[at], ends[offsets]


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, made once."""
    return _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, Encoder(vocabulary))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridsmith.llm import tokenize

        encoder = tokenize.worker_encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < SLICE_CHARS):
                    size += len(texts[stop] or "")
                    stop += 1
                ids, offsets = encoder.encode(texts[start:stop])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), lists], names=["doc_id", "ids"])
                start = stop

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, data): the UTF-8 bytes that each list of token ids stands for; empty for an empty or null list."""
    schema = T.StructType([T.StructField("doc_id", encoded.schema[doc_id].dataType), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridsmith.llm import tokenize

        encoder = tokenize.worker_encoder(vocabulary)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            data, ends = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
            # Slices: the bytes of a batch may exceed what 32-bit offsets can address.
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 30), side="right")) - 1)
                part = (ends[start : stop + 1] - ends[start]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), stop - start, [None, pa.py_buffer(part), pa.py_buffer(data[ends[start] : ends[stop]].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), made], names=["doc_id", "data"])
                start = stop

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, schema)
