"""Byte-level BPE of place names: class arrays, scans of transition functions, cached merging.

The pre-tokeniser's rules (fixed by the vocabulary's pattern): contractions
('s 't 're 've 'm 'll 'd), runs of letters, of digits, of other signs, each
with one space before them, and white space, of which a run leaves its last
character to what follows. They are a small automaton over classes of code
points. The function from state to state of a block of characters is the
composition of its characters' functions; composition is associative, so all
blocks are composed at once and scanned by doubling, without a regex.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, kept, lists, per_batch, runs, steps, utf8
from .merging import Merger, PairTable

LETTER, DIGIT, SIGN, SHORT, LONG, LEAD, TAIL, SPACE, START = range(9)  # classes
#: White space of the pattern's \s: the Unicode property, which has no U+001C to U+001F.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLOCK = 64
CACHE_PIECES = 100_000  # of a worker; the cache starts anew beyond it
ENCODE_BYTES = 1_000_000  # of text that are encoded at once


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and whether a piece begins there. States: in letters, digits,
    signs, after a leading space, in white space, closed, one or two characters of a contraction to go."""
    letters, digits, signs, lead, space, closed, one, two = range(8)
    to, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for cls, run in ((LETTER, letters), (DIGIT, digits), (SIGN, signs), (SHORT, one), (LONG, two), (LEAD, lead), (TAIL, closed), (SPACE, space), (START, closed)):
        to[cls] = run
        if cls in (SHORT, LONG):  # an apostrophe within a run of signs, or after a space, is a sign
            to[cls, [signs, lead]] = signs
            cut[cls, [signs, lead]] = False
        if cls in (LETTER, DIGIT, SIGN):
            cut[cls, [run, lead]] = False
    cut[SPACE, space] = False
    for cls in range(START):
        to[cls, [one, two]] = closed, one
        cut[cls, [one, two]] = False
    return to, cut


def code_classes() -> np.ndarray:
    kind = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = SPACE
    return table


def classes(code: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each code point; first marks the first ones of texts, which no look ahead crosses."""
    n = len(code)
    cls = table[code]
    last = np.append(first[1:], True)
    white = cls == SPACE
    ahead = np.append(~white[1:], False) & ~last  # something else follows in this text
    cls[white & ahead] = TAIL
    cls[(code == 32) & ahead] = LEAD
    quote = np.flatnonzero((code == 39) & ~last)
    if len(quote):
        b = code[quote + 1]
        short = np.isin(b, [ord(c) for c in "sdmt"])
        cls[quote[short]] = SHORT
        two = (quote + 2 < n) & ~last[quote + 1]
        c = code[np.minimum(quote + 2, n - 1)]
        pair = ((b == ord("r")) | (b == ord("v"))) & (c == ord("e")) | (b == ord("l")) & (c == ord("l"))
        cls[quote[pair & two]] = LONG
    return cls


def cuts(cls: np.ndarray, to: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character."""
    n = len(cls)
    if not n:
        return np.zeros(0, bool)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, START, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat, size = to.ravel(), to.shape[1]
    whole = np.tile(np.arange(size, dtype=np.uint8), (blocks, 1))
    for row in grid:  # the function of a whole block
        whole = flat[(row * np.uint8(size))[:, None] + whole]
    k = 1
    while k < blocks:  # of all blocks up to this one
        whole[k:] = np.take_along_axis(whole[k:], whole[:-k].copy(), 1)
        k *= 2
    state = np.full(blocks, 5, np.uint8)
    state[1:] = whole[:-1, 5]
    out = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(grid):
        at = row * np.uint8(size) + state
        out[j] = cut.ravel()[at]
        state = flat[at]
    return out.T.ravel()[:n]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks of a vocabulary file, the pairs that make its tokens, and pieces met before."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        self.to, self.cut, self.table = *automaton(), code_classes()
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.merger = Merger(PairTable(*np.array(pairs, np.int64).T), np.arange(max(ranks.values()) + 1))
        self.clear()

    def clear(self) -> None:
        self.seen = Codes()
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def codes(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.seen) > CACHE_PIECES:
            self.clear()
        codes = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        if self.seen.new:
            ids, counts = self.merger.merged(self.byte[np.frombuffer(b"".join(self.seen.new), np.uint8)], np.fromiter(map(len, self.seen.new), np.int64, len(self.seen.new)))
            self.seen.new = []
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
            self.counts = np.append(self.counts, counts)
            self.ids = np.append(self.ids, ids.astype(np.int32))
        return codes

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts data[at[i]:at[i+1]]: all ids, ids of each, all pieces' starts within their text, pieces of each."""
        texts = len(at) - 1
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, np.zeros(texts, np.int64), none, np.zeros(texts, np.int64)
        text = data.tobytes()
        place = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
        code = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(code), bool)
        first[np.searchsorted(place, at[:-1][np.diff(at) > 0])] = True
        cls = classes(code, first, self.table)
        heads = np.flatnonzero(first)
        marked = np.insert(cls, heads, START)  # forgets the text before
        begins = np.delete(cuts(marked, self.to, self.cut), heads + np.arange(len(heads)))
        start = place[begins]
        end = np.append(start[1:], len(data))
        codes = self.codes([text[a:b] for a, b in zip(start.tolist(), end.tolist())])
        counts = self.counts[codes]
        ids = self.ids[runs(self.starts[codes], counts)]
        bound = np.searchsorted(start, at)
        total = np.append(0, np.cumsum(counts))
        return ids, np.diff(total[bound]), start - np.repeat(at[:-1], np.diff(bound)), np.diff(bound)


def vocabulary(path: str) -> Vocabulary:
    return kept("bpe:" + path, lambda: Vocabulary(path))


def encode(places: DataFrame, path: str) -> DataFrame:
    """Adds `token_ids` (array of int) and `piece_starts` (byte offset of each pre-token) of every place's `name`.

    places: place_id, name and any other columns but those two, which are kept.
    path: a file of byte-level ranks (base64 and rank on each line) that the
    workers can read. Ids are those of merging each match of the pattern by
    itself, special tokens being ordinary text. A null or empty name has no ids
    and no pieces. Equal names and rows are encoded alike; no rows in, none out.
    Work is per row: no shuffle, so no key can crowd a task, and a lost task is
    run again from its input. A worker keeps pieces met before, to a fixed number.
    """
    others = [f for f in places.schema.fields if f.name not in ("token_ids", "piece_starts")]
    schema = T.StructType([*others, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_starts", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in others]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in steps(batch, "name", ENCODE_BYTES):
            ids, n, starts, pieces = vocab.encode(*utf8(part.column("name")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists(ids, n), lists(starts, pieces)], [*names, "token_ids", "piece_starts"])

    return per_batch(places.select(*(F.col(f"`{c}`") for c in names)), run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` (binary): the bytes of `token_ids`, whose other columns are kept. Null or no ids: no bytes."""
    others = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*others, T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in others]

    def table():
        held = sorted(read_ranks(path).items(), key=lambda x: x[1])  # no vocabulary: a worker that only decodes has no use for its pairs and pieces
        tokens, ranks = [t for t, _ in held], np.array([r for _, r in held], np.int64)
        size = np.zeros(int(ranks[-1]) + 1, np.int64)
        size[ranks] = list(map(len, tokens))
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, starts, size = kept("bpe-bytes:" + path, table)
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            column = part.column("token_ids")
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            total = np.append(0, np.cumsum(size[ids]))
            at = total[np.append(0, np.cumsum(rows))]
            out = data[runs(starts[ids], size[ids])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out.tobytes())])], [*names, "decoded"])

    return per_batch(encoded, run, schema)
