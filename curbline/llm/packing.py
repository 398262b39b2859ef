"""Packing of route directions into training sequences by dynamic programming over cuts."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import kept, named, numbered, runs, shares, steps, utf8
from .merging import Merger, PairTable

WINDOW = 2048
END = 1  # id after each text
CHUNK = 1 << 20  # ids that one programme spans at least, if the partition has them
SENTENCE, FORCED = 8, 64  # penalties, in ids of padding: a text cut after a sentence, elsewhere
OPENED = 512  # and of every sequence, or many would be made as short as a power of two
REACH = WINDOW // 8  # a stretch without a sentence's end gets a cut so often
CACHE_WORDS = 600_000
LETTER, LATIN, SIGN, STOP, CLOSE = (np.isin(np.arange(256), list(x)) for x in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", {*range(0x80, 0xC0)} - {0x97, 0xB7}, b".,;:!?", b".!?", b'")'))  # LATIN after a byte C3
RANGE_ROWS = 5_000
READ_BYTES = 4_000_000  # of text whose words are told apart at once


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it shows, else the next from 256 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if shown[b] else chr(256 + b - sum(shown[:b])) for b in range(256)]


def kinds(words: list[bytes], size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word (none empty) is of Latin-1 letters, with a sign after them or not, and whether a sentence ends with it. size: their bytes, if known."""
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) if size is None else size
    last = np.cumsum(size) - 1
    first = np.append(0, last[:-1] + 1)
    pair = np.append((data[:-1] == 0xC3) & LATIN[data[1:]], False)
    letter = LETTER[data] | pair
    letter[1:] |= pair[:-1]
    before = np.maximum(last - 1, first)
    strange = ~letter
    strange[last[SIGN[data[last]] & (last > first)]] = False
    plain = ~np.logical_or.reduceat(strange, first)
    return plain, STOP[data[last]] | CLOSE[data[last]] & STOP[data[before]]


class Words:
    """Ids of words met before. No id spans white space, so a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: told apart in the raw text, before it is split
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.merger = Merger(PairTable(left, right, np.arange(len(pairs))), made)
        self.inner, self.final = (np.array([vocab[c + end] for c in byte_signs()], np.int64) for end in ("", "</w>"))
        self.clear()

    def clear(self) -> None:
        self.seen = defaultdict(count().__next__)  # numbers words as they are first asked for
        self.starts, self.counts, self.stops = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Words of Latin-1 letters, with a sign after them or not, are merged together; the others go to the library."""
        n, raw = len(words), b"".join(words)
        size = np.fromiter(map(len, words), np.int64, n)
        plain, stop = kinds(words, size)
        other = np.flatnonzero(~plain)
        rest = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch([words[i].decode() for i in other.tolist()], add_special_tokens=False)]
        own = raw if not len(other) else np.frombuffer(raw, np.uint8)[np.repeat(plain, size)].tobytes()
        data = np.frombuffer(own.decode().lower().encode(), np.uint8)  # as long as before
        size = size[plain]
        letter = data >= ord("a")
        ends = np.cumsum(size)
        last = np.zeros(len(data), bool)  # of a piece: the letters, the sign
        last[ends - 1] = True
        last[:-1] |= letter[:-1] & ~letter[1:]
        cuts = np.flatnonzero(last) + 1
        ids, counts = self.merger.merged(np.where(last, self.final[data], self.inner[data]), np.diff(cuts, prepend=0))
        total = np.append(0, np.cumsum(counts))
        mine = total[np.searchsorted(cuts, ends) + 1]
        size, out = np.zeros(n, np.int64), np.concatenate([ids, *rest]).astype(np.uint32)
        start = np.zeros(n, np.int64)
        size[plain], start[plain] = np.diff(mine, prepend=0), np.append(0, mine[:-1])[: len(mine)]
        size[other] = list(map(len, rest))
        start[other] = len(ids) + np.cumsum(size[other]) - size[other]
        self.starts, self.counts = np.append(self.starts, len(self.ids) + start), np.append(self.counts, size)
        self.ids = np.append(self.ids, out)
        self.stops = np.append(self.stops, stop)

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > CACHE_WORDS:
            self.clear()
        known = len(self.seen)
        codes = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        if len(self.seen) > known:
            self.learn(list(islice(self.seen, known, None)))
        return codes


def tokenised(words: Words, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids with END after each text, the ids of each text, and where sentences end among all ids."""
    raw = data.tobytes()
    texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw))
    for token in words.special:
        if token in raw:
            texts = pc.replace_substring(texts, token.decode(), f" {token.decode()} ")
    # of a step, each word is looked up once
    split = pc.ascii_split_whitespace(texts)
    met = split.flatten().dictionary_encode()
    name, begin = utf8(met.dictionary)
    name, begin = name.tobytes(), begin.tolist()
    each, of = [name[a:b] for a, b in zip(begin, begin[1:])], met.indices.to_numpy()
    text_of = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    if b"" in each:  # before and after white space at a text's ends
        none = each.index(b"")
        text_of, of = text_of[of != none], of[of != none]
        of = of - (of > none)
        del each[none]
    codes = words.codes(each)[of]
    counts = words.counts[codes]
    n = np.bincount(text_of, weights=counts, minlength=len(split)).astype(np.int64) + 1
    ids = np.full(int(n.sum()), END, np.uint32)
    place = runs(np.cumsum(counts) - counts + text_of, counts)
    ids[place] = words.ids[runs(words.starts[codes], counts)]
    stop = (np.cumsum(counts) + text_of)[words.stops[codes] & (counts > 0)]
    return ids, n, stop


def candidates(ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, from 0 on, and their penalties."""
    known = np.unique(np.concatenate([[0], ends, stops]))
    gap = np.diff(known)
    extra = np.maximum(0, -(-gap // REACH) - 1)
    forced = np.repeat(known[:-1], extra) + REACH * (runs(np.zeros(len(extra), np.int64), extra) + 1)
    cut = np.union1d(known, forced)
    cost = np.full(len(cut), FORCED)
    cost[np.searchsorted(cut, stops)] = SENTENCE
    cost[np.searchsorted(cut, ends)] = 0
    return cut, cost


def chosen(cut: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The ends of sequences with the least padding and penalties.

    least[j] = cost[j] + OPENED + min over i of least[i] + padding(cut[j] - cut[i]), where
    a length that is a power of two has no padding and any other up to WINDOW is
    filled. Filling is least[i] + cut[i] + WINDOW - cut[j]: the minimum of
    least + cut over a sliding window, which a queue with rising values holds at
    its front. The powers of two are looked up.
    """
    to, frm = [], []
    for k in range(WINDOW.bit_length()):
        i = np.searchsorted(cut, cut - (1 << k))
        j = np.flatnonzero(cut[np.minimum(i, len(cut) - 1)] == cut - (1 << k))
        to.append(j)
        frm.append(i[j])
    to, frm = np.concatenate(to), np.concatenate(frm)
    order = np.argsort(to, kind="stable")
    to, frm = [*to[order].tolist(), -1], [*frm[order].tolist(), -1]
    at, fee = cut.tolist(), (cost + OPENED).tolist()
    n = len(at)
    least, back = [0] * n, [0] * n
    value, queue, head, p = [0] * n, [0], 0, 0
    for j in range(1, n):
        here = at[j]
        low = here - WINDOW
        while at[queue[head]] < low:
            head += 1
        i = queue[head]
        best = value[i] + WINDOW - here
        while to[p] == j:
            if least[frm[p]] < best:
                i = frm[p]
                best = least[i]
            p += 1
        best += fee[j]
        least[j], back[j] = best, i
        best += here
        value[j] = best
        while len(queue) > head and value[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(at[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def laid_out(ids: np.ndarray, n: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces as (text, start, length, sequence, offset), in order."""
    ends = np.cumsum(n)
    borders = chosen(*candidates(ends, stops))
    cuts = np.union1d(ends, borders)
    first = np.append(0, cuts[:-1])
    text, seq = np.searchsorted(ends, first, side="right"), np.searchsorted(borders, first, side="right")
    return text, first - (ends - n)[text], cuts - first, seq, first - np.append(0, borders)[seq]


PIECES = "route_id long, start long, length long, token_bytes binary, route_tokens long, sequence_id long, offset long"


def pack(routes: DataFrame, path: str) -> DataFrame:
    """Packs the ids of every route's `directions` into sequences of at most 2048 ids.

    routes: route_id (of any type with an order), directions; other columns are left out. path: a
    tokenizers file that the workers can read, whose special tokens count as such. One row for each piece: route_id,
    start (its text's ids before it), length, token_bytes (ids, little-endian
    unsigned 32-bit), route_tokens (the text's ids, id 1 at the end included),
    sequence_id, offset in the sequence. Sequences have no gaps; they are filled
    up to 2048 unless their length is a power of two. Texts keep the order of
    route_id; cuts are chosen as `chosen` says. A null or empty text is the end
    id alone. Equal ids or rows are packed one after the other, in the order of
    their text; null ids come first. No rows in, none out.

    Rows are dealt by ranges of route_id, a few thousand each, and one range is
    read as a stream; a programme spans about a million ids of it.
    """
    ship()
    routes, names = numbered(routes.select("route_id", "directions"), "route_id")
    ranges = shares(routes, RANGE_ROWS)
    # Equal ids are dealt on by their text, so that one id with many rows is no one task's.
    keyed = routes.select(F.col("route_id").cast("long").alias("route_id"), "directions", F.xxhash64("directions").alias("mark"))
    ordered = keyed.repartitionByRange(ranges, "route_id", "mark").sortWithinPartitions("route_id", "mark", "directions").drop("mark")

    def solved(held: list[tuple], base: int) -> pa.RecordBatch:
        ids = np.concatenate([h[1] for h in held])
        n = np.concatenate([h[2] for h in held])
        shift = np.cumsum([0, *(len(h[1]) for h in held[:-1])])
        stops = np.concatenate([h[3] + s for h, s in zip(held, shift)])
        text, start, length, seq, offset = laid_out(ids, n, stops)
        route = pa.chunked_array([h[0] for h in held]).take(pa.array(text)).combine_chunks()
        route = route if isinstance(route, pa.Array) else route.chunk(0)
        at = np.append(0, np.cumsum(length)) * 4
        blob = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
        return pa.RecordBatch.from_arrays([route, *(pa.array(x.astype(np.int64)) for x in (start, length)), blob, *(pa.array(x.astype(np.int64)) for x in (n[text], base + seq, offset))], ["route_id", "start", "length", "token_bytes", "route_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("words:" + path, lambda: Words(path))
        base, held, size = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for part in steps(batch, "directions", READ_BYTES):
                ids, n, stops = tokenised(words, *utf8(part.column("directions")))
                held.append((part.column("route_id"), ids, n, stops))
                size += len(ids)
                if size >= CHUNK:
                    out = solved(held, base)
                    yield out
                    base, held, size = out.column("sequence_id")[-1].as_py() + 1, [], 0
        if held:
            yield solved(held, base)

    return named(ordered.mapInArrow(run, PIECES), names, "route_id")
