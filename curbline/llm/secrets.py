"""Secrets in fetched pages: fixed forms, and strings that a tokeniser's vocabulary does not know."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, per_batch, steps, utf8

# Fixed forms. Letters of an assignment count in either case, so it is sought in
# the lower-cased bytes, which keep their places. None of the forms holds a line
# feed: texts joined by one are searched at once.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")  # the order of spans that begin alike
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Efficiency test: runs of key characters, at least so long, with fewer
# characters a token than this. Prose, compound words and identifiers made of
# words have over 2; random letters and digits about 1.5. A run may glue names
# and paths to a value, so its parts between signs are tested too.
RUN = 20
RATIO = 2.0
PART = re.compile(r"[0-9A-Za-z]+")
STRONG = 6  # letters and digits of a part, from which its ratio alone says whether it is readable
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[-_T]?[0-9-]*Z?"
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
KNOWN = (  # digests, and identifiers that are not secret
    re.compile(r"[0-9a-f]+|[0-9A-F]+|[0-9+/_=-]+"),
    re.compile(UUID),
    re.compile(r"(?:md5|sha1|sha256|sha384|sha512)[-_=][0-9A-Za-z+/=]+"),
    re.compile(DATE),
)
# The same within a run; a digest is no longer there than its hex digits are.
DIGEST = "|".join(f"{name}[-_=][0-9A-Za-z+/=]{{1,{n}}}" for name, n in (("md5", 32), ("sha1", 40), ("sha256", 64), ("sha384", 96), ("sha512", 128)))
INNER = re.compile(f"(?<![0-9A-Za-z])(?:{DIGEST}|(?:{UUID}|{DATE})(?![0-9A-Za-z]))")

SECRET = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def members(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


LOWER, UPPER, NUMBER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX, KEY = members(NUMBER + "abcdef"), members(LOWER + UPPER + NUMBER + "+/_=-")
ONE = members("\1")


def stretches(data: np.ndarray, table: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the longest runs of the table's bytes that are long enough."""
    inside = np.concatenate([[False], table[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    long = last - first >= least
    return first[long].tolist(), last[long].tolist()


def tokens(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def dense(text: str, encoding) -> bool:
    return len(text) < RATIO * len(encoding.encode_ordinary(text))


def known(text: str) -> bool:
    return any(p.fullmatch(text) for p in KNOWN)


def random_parts(text: str, encoding) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run of key characters: the run, or else groups of its parts.

    The parts lie between signs. A readable part of STRONG characters or more and an
    identifier end a group; shorter parts say nothing by themselves, as the signs
    also stand within a value. A group begins and ends with an unreadable part, and parts of
    STRONG characters or more are half of it at least.
    """
    if known(text):
        return []
    if dense(text, encoding) and not INNER.search(text):
        return [(0, len(text))]
    held = np.zeros(len(text), bool)
    for m in INNER.finditer(text):
        held[m.start() : m.end()] = True
    groups: list[list[tuple[int, int, bool]]] = [[]]
    for m in PART.finditer(text):
        a, b = m.span()
        odd, long = dense(m[0], encoding), b - a >= STRONG
        if held[a] or long and (not odd or known(m[0])):
            groups.append([])
        elif odd or groups[-1]:
            groups[-1].append((a, b, odd))
    out = []
    for group in groups:
        while group and not group[-1][2]:
            group.pop()
        if not group:
            continue
        a, b = group[0][0], group[-1][1]
        strong = sum(y - x for x, y, _ in group if y - x >= STRONG)
        if b - a >= RUN and 2 * strong >= b - a and not known(text[a:b]) and dense(text[a:b], encoding):
            out.append((a, len(text) if not text[b:].strip("=") else b))
    return out


def spans(data: bytes, encoding) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted; data may be texts joined by line feeds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST["access"]]
    view = np.frombuffer(data, np.uint8)
    out += [(a, 2, b) for a, b in zip(*stretches(view, HEX, LEAST["hex"]))]
    open_ = KEY[view]  # key characters that no fixed form has
    for a, _, b in out:
        open_[a:b] = False
    more = []
    for a, b in zip(*stretches(open_.view(np.uint8), ONE, RUN)):
        more += [(a + x, 3, a + y) for x, y in random_parts(data[a:b].decode(), encoding)]
    return sorted(out + more)


def find(pages: DataFrame, path: str) -> DataFrame:
    """Adds `secrets` to every fetched page: array of (kind, start, end), in code points of `html`, end exclusive.

    pages: page_id, html and any other columns but `secrets`, which are kept.
    Fixed kinds, leftmost and not overlapping within a kind: `assign` (a name
    such as password or api_key, a sign, a value of 8 characters), `access` (a
    cloud access key), `hex` (32 digits or more). The method adds `random`: a run
    of key characters outside the fixed forms, or parts of it between signs, that the
    vocabulary at `path` splits
    into many tokens, unless it is a digest, a UUID, a number or a date. Spans are
    sorted by start, then kind. A null or empty page has none; equal pages have
    the same. Whole texts are searched, row by row: no shuffle, no hot key.
    """
    others = [f for f in pages.schema.fields if f.name != "secrets"]
    names = [f.name for f in others]
    schema = T.StructType([*others, T.StructField("secrets", SECRET)])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoding = kept("tiktoken:" + path, lambda: tokens(path))
        for part in steps(batch, "html"):
            data, at = utf8(part.column("html"))
            joined = np.full(len(data) + len(at) - 1, 10, np.uint8)
            joined[np.arange(len(data)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = data
            found = spans(joined.tobytes(), encoding)
            start, kind, end = (np.array([x[i] for x in found], np.int64) for i in range(3))
            heads = at[:-1] + np.arange(len(at) - 1)  # of the rows, in joined
            row = np.searchsorted(heads, start, side="right") - 1
            code = np.append(0, np.cumsum((joined & 0xC0) != 0x80)) if len(found) else np.zeros(1, np.int64)
            zero = code[heads[row]] if len(found) else start
            values = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kind.tolist()], pa.string()), pa.array(code[start] - zero), pa.array(code[end] - zero)], ["kind", "start", "end"])
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], [*names, "secrets"])

    return per_batch(pages.select(*(F.col(f"`{c}`") for c in names)), run, schema)


def listed(secrets: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(html: Column, secrets: Column) -> Column:
    """The text with each stretch that spans cover replaced by [SECRET]."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def take(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(html, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("[SECRET]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

    def finish(acc):
        return F.concat(F.array_join(acc["parts"], ""), F.substring(html, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    return F.when(F.size(secrets) > 0, F.aggregate(secrets, begin, take, finish)).otherwise(html)
