"""SentencePiece ids of place names by a table of each prefix's last token.

A vocabulary of merges gives every prefix of a string one last token. Token t
is the last one of a prefix if it ends there (an automaton over the vocabulary
finds all that do), and if it stands next to the last token of the prefix
before it without a merge across their border (`compatible`). One pass forward
fills the table, one pass backward reads the ids off.

Strings that no token can hold together are worked on by themselves: a name is
cut wherever two neighbouring characters stand in no token side by side, which
for this kind of vocabulary is above all before a space. All new strings of a
step advance together, one character a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, kept, lists, per_batch, runs, steps, utf8
from .merging import NONE, PairTable

SPACE, MARK = " ", "▁"  # a space stands as MARK in the vocabulary
CACHE_PIECES = 200_000  # of a worker; the cache starts anew beyond it
CELLS = 1_000_000  # of the table at once
LONG = 256  # characters, from which a string fills its table by itself
MEMO = 100_000
SIDE_BITS = 22


def side(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Slot of two neighbouring characters. Pairs may share one: then a string is not cut, which costs time only."""
    h = (left.astype(np.uint64) << np.uint64(21) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - SIDE_BITS)).astype(np.int64)


class Pieces:
    """Tokens of a model file with their merges, the automaton over them, and strings met before."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.unknown = size  # a character without a token; it becomes bytes in the end
        self.bytes = np.zeros(256, np.int64)
        tokens: dict[str, int] = {}
        for i in range(size):
            if library.is_byte(i):
                self.bytes[int(library.id_to_piece(i)[1:-1], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                tokens[library.id_to_piece(i)] = i
        score = {t: library.get_score(i) for t, i in tokens.items()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(size + 1, -1, np.int64)  # merges of lower rank come first; characters are there from the start
        self.length = np.ones(size + 1, np.int64)
        self.left, self.right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        pairs, words = [], {}
        for t, i in tokens.items():
            parts = self.last_merge(t, score)
            if parts is None:
                continue  # no text comes to this token
            words[t] = i
            self.length[i] = len(t)
            if len(t) > 1:
                self.rank[i], self.left[i], self.right[i] = order[score[t]], tokens[parts[0]], tokens[parts[1]]
        for t, i in tokens.items():
            pairs += [(tokens[t[:k]], tokens[t[k:]], i) for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
        self.join = PairTable(*np.array(pairs, np.int64).T)  # "rank" is the joined token's id here
        self.automaton(words)
        self.slow: tuple[dict, dict, dict] | None = None
        self.clear()

    @staticmethod
    def last_merge(token: str, score: dict[str, float]) -> tuple[str, ...] | None:
        """The two parts that were joined last when a token is merged by itself; (itself,) of a character."""
        parts, last = list(token), (token,)
        while len(parts) > 1:
            open_ = [(-score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
            if not open_:
                return None
            k = min(open_)[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = ["".join(last)]
        return last

    def automaton(self, words: dict[str, int]) -> None:
        """States are the beginnings of tokens. `go` leads on, `fail` to the longest end that is a state,
        `token` is the state's own token, `shorter` the next state on the way of fails that has one."""
        self.kind = np.zeros(0x110000, np.uint16)  # 0: in no token
        letters = sorted(set("".join(words)))
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.kind[ord(SPACE)] = self.kind[ord(MARK)]
        self.beside = np.zeros(1 << SIDE_BITS, bool)
        both = {a + b for t in words for a, b in zip(t, t[1:])}
        both |= {p.replace(MARK, SPACE) for p in both} | {p[0] + SPACE for p in both if p[1] == MARK} | {SPACE + p[1] for p in both if p[0] == MARK}
        if both:
            ends = np.array([[ord(p[0]), ord(p[1])] for p in both], np.uint32)
            self.beside[side(ends[:, 0], ends[:, 1])] = True
        states, arcs = {"": 0}, []
        for t in sorted(words, key=len):
            for k in range(1, len(t) + 1):
                if t[:k] not in states:
                    states[t[:k]] = len(states)
        self.fail, self.token, self.shorter = (np.zeros(len(states), np.int64) for _ in range(3))
        self.token[:] = -1
        for s in sorted(states, key=len):
            i = states[s]
            if not s:
                continue
            arcs.append((states[s[:-1]], int(self.kind[ord(s[-1])]), i))
            self.fail[i] = next(states[s[k:]] for k in range(1, len(s) + 1) if s[k:] in states)
            self.token[i] = words.get(s, -1)
            f = int(self.fail[i])
            self.shorter[i] = f if self.token[f] >= 0 else self.shorter[f]
        self.go = PairTable(*np.array(arcs, np.int64).T)

    def clear(self) -> None:
        self.seen = Codes()
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens stay apart when merged side by side.

        Their merges are taken back, the latest first (of equal ranks the right one, since the left one was
        made before). Whenever the two symbols at the border could join, that must not have come first.
        """
        a, b = left.copy(), right.copy()
        ok = self.join.ranked(a, b) == NONE
        live = np.flatnonzero(ok & ((self.rank[a] >= 0) | (self.rank[b] >= 0)))
        while len(live):
            x, y = a[live], b[live]
            from_left = self.rank[x] > self.rank[y]
            limit = np.where(from_left, self.rank[x], self.rank[y])
            x, y = np.where(from_left, self.right[x], x), np.where(from_left, y, self.left[y])
            joined = self.join.ranked(x, y)
            first = np.where(joined == NONE, NONE, self.rank[np.where(joined == NONE, 0, joined)])
            bad = np.where(from_left, first < limit, first <= limit)
            ok[live[bad]] = False
            a[live], b[live] = x, y
            live = live[~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))]
        return ok

    def table(self, kind: np.ndarray) -> np.ndarray:
        """The last token of every prefix. kind[:, i] are the characters of string i, the longest string first, -1 beyond its end."""
        rows, many = kind.shape
        last = np.full((rows + 1, many), -1, np.int64)
        state = np.zeros(many, np.int64)
        for j in range(1, rows + 1):
            c = kind[j - 1]
            m = int(np.searchsorted(c < 0, True)) if c[-1] < 0 else many
            c, s = c[:m].astype(np.int64), state[:m]
            to = self.go.ranked(s, c)
            stuck = np.flatnonzero((to == NONE) & (s > 0))
            while len(stuck):
                s[stuck] = self.fail[s[stuck]]
                to[stuck] = self.go.ranked(s[stuck], c[stuck])
                stuck = stuck[(to[stuck] == NONE) & (s[stuck] > 0)]
            s[:] = np.where(to == NONE, 0, to)
            last[j, :m][c == 0] = self.unknown
            at = np.flatnonzero(s > 0)
            end = s[at]
            end = np.where(self.token[end] >= 0, end, self.shorter[end])
            while len(at):
                token = self.token[end]
                start = j - self.length[token]
                fits = start == 0
                inner = np.flatnonzero(~fits)
                before = last[start[inner], at[inner]]
                fits[inner] = (before >= 0) & self.compatible(np.maximum(before, 0), token[inner])
                last[j, at[fits]] = token[fits]
                at, end = at[~fits], self.shorter[end[~fits]]
                at, end = at[end > 0], end[end > 0]
        return last

    def slowly(self, kind: list[int]) -> list[int]:
        """One long string: the same table, filled with plain numbers."""
        if self.slow is None:
            self.slow = (self.go.items(), self.join.items(), {})
        go, join, memo = self.slow
        fail, token_of, shorter, length = self.fail.tolist(), self.token.tolist(), self.shorter.tolist(), self.length.tolist()
        rank, left, right = self.rank.tolist(), self.left.tolist(), self.right.tolist()

        def compatible(a: int, b: int) -> bool:
            key = a << 20 | b
            if key in memo:
                return memo[key]
            ok = key not in join
            while ok and (rank[a] >= 0 or rank[b] >= 0):
                limit, from_left = max(rank[a], rank[b]), rank[a] > rank[b]
                a, b = (right[a], b) if from_left else (a, left[b])
                made = join.get(a << 20 | b)
                ok = made is None or (rank[made] >= limit if from_left else rank[made] > limit)
            if len(memo) > MEMO:
                memo.clear()
            memo[key] = ok
            return ok

        last, state = [-1] * (len(kind) + 1), 0
        for j, c in enumerate(kind, 1):
            while state and state << 20 | c not in go:
                state = fail[state]
            state = go.get(state << 20 | c, 0)
            if not c:
                last[j] = self.unknown
            end = state if token_of[state] >= 0 else shorter[state]
            while end:
                token = token_of[end]
                before = last[j - length[token]]
                if j == length[token] or before >= 0 and compatible(before, token):
                    last[j] = token
                    break
                end = shorter[end]
        out, j = [], len(kind)
        while j:
            out.append(last[j])
            j -= length[last[j]]
        return out[::-1]

    def read_back(self, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all strings in order, and how many each has."""
        at, own, found = size.copy(), np.arange(len(size)), []
        while len(own):
            token = last[at[own], own]
            found.append((own, token))
            at[own] -= self.length[token]
            own = own[at[own] > 0]
        own, token = (np.concatenate(x)[::-1] for x in zip(*found))
        return token[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(size))

    def learn(self, strings: list[bytes]) -> None:
        code = np.frombuffer(b"".join(strings).decode().encode("utf-32-le"), np.uint32)
        size = np.fromiter((len(s.decode()) for s in strings), np.int64, len(strings))
        first, kind = np.cumsum(size) - size, self.kind[code].astype(np.int32)
        tokens: list[np.ndarray] = []
        whose: list[np.ndarray] = []
        for i in np.flatnonzero(size > LONG).tolist():
            tokens.append(np.array(self.slowly(kind[first[i] : first[i] + size[i]].tolist()), np.int64))
            whose.append(np.full(len(tokens[-1]), i))
        rest = np.flatnonzero(size <= LONG)
        rest = rest[np.argsort(-size[rest], kind="stable")]
        while len(rest):
            rows = int(size[rest[0]])
            part, rest = rest[: max(1, CELLS // rows)], rest[max(1, CELLS // rows) :]
            grid = np.full((rows, len(part)), -1, np.int32)
            of = np.repeat(np.arange(len(part)), size[part])
            grid[runs(np.zeros(len(part), np.int64), size[part]), of] = kind[runs(first[part], size[part])]
            found, many = self.read_back(self.table(grid), size[part])
            tokens.append(found)
            whose.append(np.repeat(part, many))
        token, own = np.concatenate(tokens), np.concatenate(whose)
        order = np.argsort(own, kind="stable")
        token, own = token[order], own[order]
        # a character without a token is its bytes
        begin = np.cumsum(self.length[token]) - self.length[token]
        lone = np.flatnonzero(token == self.unknown)
        width = np.ones(len(token), np.int64)
        c = code[begin[lone]]
        width[lone] = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        ids = np.repeat(token, width)
        ids[runs((np.cumsum(width) - width)[lone], width[lone])] = self.bytes[np.frombuffer("".join(map(chr, c.tolist())).encode(), np.uint8)]
        counts = np.bincount(np.repeat(own, width), minlength=len(strings))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.ids = np.append(self.ids, ids.astype(np.int32))

    def codes(self, strings: list[bytes]) -> np.ndarray:
        if len(self.seen) > CACHE_PIECES:
            self.clear()
        codes = np.fromiter(map(self.seen.__getitem__, strings), np.int64, len(strings))
        if self.seen.new:
            self.learn(self.seen.new)
            self.seen.new = []
        return codes

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts data[at[i]:at[i+1]]: all ids, and how many each has. A text that is not empty has a space before it."""
        full = np.flatnonzero(np.diff(at) > 0)
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
        data = np.insert(data, at[full], 32)
        at = at + np.searchsorted(full, np.arange(len(at)))
        text = data.tobytes()
        place = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        begins = np.append(True, ~self.beside[side(code[:-1], code[1:])])
        begins[np.searchsorted(place, at[full])] = True
        start = place[begins]
        end = np.append(start[1:], len(data))
        codes = self.codes([text[a:b] for a, b in zip(start.tolist(), end.tolist())])
        counts = self.counts[codes]
        total = np.append(0, np.cumsum(counts))
        return self.ids[runs(self.starts[codes], counts)], np.diff(total[np.searchsorted(start, at)])


def model(path: str) -> Pieces:
    return kept("pieces:" + path, lambda: Pieces(path))


def encode(places: DataFrame, path: str) -> DataFrame:
    """Adds `piece_ids` (array of int) to every place: the ids of its `name`.

    places: rows with `name` and any other columns but `piece_ids`, which are kept as
    they are. path: a SentencePiece model of merges with byte fallback, that the
    workers can read and whose text rules are the plain ones (no normalising, a
    space put first, spaces kept). Ids are the library's, without begin or end
    ids. A null or empty name has none. Equal names and rows are encoded alike;
    no rows in, none out. Row by row: no shuffle, so no key can crowd a task and
    a lost task is run again from its input. A worker keeps strings met before,
    to a fixed number; a name is never cut but where no token can reach across.
    """
    others = [f for f in places.schema.fields if f.name != "piece_ids"]
    names = [f.name for f in others]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in steps(batch, "name", 1_000_000):
            ids, n = model(path).encode(*utf8(part.column("name")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists(ids, n)], [*names, "piece_ids"])

    return per_batch(places.select(*(F.col(f"`{c}`") for c in names)), run, T.StructType([*others, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` (string): the text of `piece_ids`; other columns are kept.

    The space that encoding puts first is taken away. Null or no ids: an empty
    text. Ids whose bytes are no UTF-8 are decoded by the library, which puts a
    replacement character for each such byte. Ids that the model lacks are an error.
    """
    others = [f for f in encoded.schema.fields if f.name != "decoded"]
    names = [f.name for f in others]

    def table():
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        text = lambda i: library.id_to_piece(i).replace(MARK, SPACE).encode()
        forms = [bytes([int(library.id_to_piece(i)[1:-1], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else b" \xe2\x81\x87 " if library.is_unknown(i) else text(i)
                 for i in range(library.get_piece_size())]
        size = np.array(list(map(len, forms)), np.int64)
        return library, np.frombuffer(b"".join(forms), np.uint8), np.cumsum(size) - size, size

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        library, data, starts, size = kept("pieces-text:" + path, table)
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            column = part.column("piece_ids")
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            total = np.append(0, np.cumsum(size[ids]))
            cut = np.append(0, np.cumsum(rows))
            at, out = total[cut], data[runs(starts[ids], size[ids])].tobytes()
            texts = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                try:
                    texts.append(out[a + (out[a : a + 1] == b" " and size[ids[cut[i]]] > 0) : b].decode())
                except UnicodeDecodeError:
                    texts.append(library.decode(ids[cut[i] : cut[i + 1]].tolist()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return per_batch(encoded, run, T.StructType([*others, T.StructField("decoded", T.StringType())]))
