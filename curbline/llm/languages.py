"""Language of place names by error-correcting output codes.

Every language has a codeword of bits. For each bit a naive Bayes classifier over
hashed letter n-grams says how far a name leans to 1. The decoder takes the
codeword with the least loss, weighing each bit of each language by how often
the classifier got it right in training, and flags names whose two best
codewords lie close together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, per_batch, steps, utf8

FEATURES = 1 << 13  # hashed n-grams
GRAMS = (1, 2, 3)
SMOOTH = 1e-5  # added to a feature's share; one that no language has says nothing
SCALE = 4.0  # margins, in nats an n-gram, are multiplied by this before tanh
SURE = 0.03  # least lead of the best codeword's loss over the next one's
WEIGH_ROWS = 4_000  # training names, at most about so many, that weigh the bits
SPACE = 0
STEP = 500_000  # bytes of text at once


def codewords(k: int) -> np.ndarray:
    """k rows of +-1. Up to 7 languages: all ways to split them in two (2^(k-1) - 1 bits).
    More: 10 log2 k bits, of a fixed random source, drawn until no two languages
    are alike and no bit is constant."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        bits = (1 << (k - 1)) - 1
        return np.array([[1.0] * bits] + [[1.0 if ((b + 1) >> i) & 1 else -1.0 for b in range(bits)] for i in range(k - 1)]) * np.array([[-1.0]] + [[1.0]] * (k - 1))
    random, bits = np.random.default_rng(k), math.ceil(10 * math.log2(k))
    while True:
        code = random.choice([-1.0, 1.0], (k, bits))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


def letters() -> np.ndarray:
    """Code point -> lower-cased letter, or SPACE for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low[0])
    return table


def lowered(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and sign of the texts' letters, with spaces for all else: one at both ends of every text, and no two in turn."""
    rows = len(at) - 1
    place = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    row = (np.searchsorted(at, place, side="right") - 1).astype(np.int32)
    sign = table[code]
    heads = np.searchsorted(row, np.arange(rows + 1))
    ends = np.concatenate([heads[:-1], heads[1:]])
    whose = np.tile(np.arange(rows, dtype=np.int32), 2)
    order = np.lexsort((np.repeat([1, 0], rows), whose, ends))  # a text's opening space comes after the closing one of the text before
    if (heads[1:] == heads[:-1]).any():  # texts without a sign have none of either
        order = order[np.diff(heads)[whose[order]] > 0]
    sign, row = np.insert(sign, ends[order], SPACE), np.insert(row, ends[order], whose[order])
    keep = np.append(True, (sign[1:] != SPACE) | (sign[:-1] != SPACE) | (row[1:] != row[:-1])) if len(sign) else np.zeros(0, bool)
    return row[keep], sign[keep]


def grams(row: np.ndarray, sign: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every n-gram that ends after the first `known` signs."""
    sign = sign.astype(np.uint64)
    out_row, out = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for n in GRAMS:
        skip = max(0, known - n + 1)
        s, r = sign[skip:], row[skip:]
        if len(s) < n:
            continue
        h = np.full(len(s) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ s[i : len(s) - n + 1 + i]
        h *= np.uint64(0x9E3779B97F4A7C15)
        ok = s[: len(h)] != SPACE if n == 1 else r[: len(h)] == r[n - 1 :]
        if n == 2:
            ok &= (s[:-1] != SPACE) | (s[1:] != SPACE)
        out.append((h[ok] >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32))
        out_row.append(r[: len(h)][ok])
    return np.concatenate(out_row), np.concatenate(out)


def features(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every n-gram of the texts' words; a word has one space before and after it."""
    return grams(*lowered(data, at, table))


def counted(part: pa.RecordBatch, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and feature of every n-gram of a slice. A long text comes in several parts, the last two signs of one standing before the next."""
    data, at = utf8(part.column("name"))
    if part.num_rows > 1 or len(data) <= 2 * STEP:
        yield features(data, at, table)
        return
    held, first = np.zeros(0, np.uint32), 0
    while first < len(data):
        last = min(len(data), first + STEP)
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        _, sign = lowered(data[first:last], np.array([0, last - first]), table)
        # the spaces at the borders of a part are no borders of the text
        begin, end = first > 0 and table[ord(data[first : first + 4].tobytes().decode(errors="ignore")[0])] != SPACE, last < len(data) and not self_ends(data, last, table)
        sign = sign[int(begin) : len(sign) - int(end)]
        if len(held) and len(sign) and held[-1] == SPACE == sign[0]:
            sign = sign[1:]
        sign = np.concatenate([held, sign])
        yield grams(np.zeros(len(sign), np.int32), sign, len(held))
        held, first = sign[-2:], last


def self_ends(data: np.ndarray, last: int, table: np.ndarray) -> bool:
    """Whether the character before `last` is no letter."""
    lead = last - 1
    while data[lead] & 0xC0 == 0x80:
        lead -= 1
    return table[ord(data[lead:last].tobytes().decode())] == SPACE


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from steps(batch, "name", STEP)


@dataclass
class Model:
    """languages[i] has codeword code[i]; weights[:, b] are log odds of bit b; trust[i, b] weighs it; bias[b] is what a name without evidence has."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, part: pa.RecordBatch, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number from -1 to 1 for each name and bit, and the n-grams of each name."""
        rows, bits = part.num_rows, self.weights.shape[1]
        lean, total = np.zeros((rows, bits)), np.zeros(rows, np.int64)
        for row, feature in counted(part, table):
            total += np.bincount(row, minlength=rows)
            for b in range(bits):
                lean[:, b] += np.bincount(row, weights=self.weights[feature, b], minlength=rows)
        return np.tanh(SCALE * lean / np.maximum(1, total)[:, None]), total

    def decoded(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its score from 0 to 1, and the lead over the next one. Loss of a bit is (1 - codeword * margin) / 2."""
        loss = np.stack([((1 - margins * word) / 2 * trust).sum(1) for word, trust in zip(self.code, self.trust)], 1)
        best = loss.argmin(1)
        rest = loss.copy()
        rest[np.arange(len(best)), best] = np.inf
        lead = np.minimum(1.0, rest.min(1) - loss[np.arange(len(best)), best]) if loss.shape[1] > 1 else np.ones(len(best))
        return best, np.clip(1 - loss[np.arange(len(best)), best], 0, 1), lead


def train(names: DataFrame) -> Model | None:
    """A model from names with a non-null `lang`; None if there are none.

    names: name, lang and any other columns, which play no part. n-gram counts
    of all names are summed by language in each task before they are shuffled;
    the driver gets a number for each language and feature. The weights of bits
    come from about WEIGH_ROWS names, taken by a hash of the text.
    """
    known = names.where("lang is not null").select(F.coalesce("name", F.lit("")).alias("name"), "lang")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = kept("letters", letters), {}
        for batch in batches:
            for part in small(batch):
                known, lang = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                for row, feature in counted(part, table):
                    added = np.bincount(lang[row] * FEATURES + feature, minlength=len(known) * FEATURES).reshape(-1, FEATURES)
                    for x, n in zip(known.tolist(), added):
                        sums[x] = sums.get(x, 0) + n
        for x, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "feature", "n"])

    from ..session import ship

    ship()
    sums = known.mapInArrow(add, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    if not len(sums):
        return None
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), FEATURES))
    counts[np.searchsorted(languages, sums["lang"]), sums["feature"]] = sums["n"]
    # each language weighs the same in a bit, whatever its share of the names
    share = counts / np.maximum(1, counts.sum(1, keepdims=True)) + SMOOTH
    code = codewords(len(languages))
    weights = np.zeros((FEATURES, code.shape[1]))
    for b in range(code.shape[1]):
        one, two = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(one) and len(two):
            weights[:, b] = np.log(one.mean(0)) - np.log(two.mean(0))
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))
    total = known.count()
    sample = known.where(F.pmod(F.xxhash64("name", F.lit(7)), F.lit(max(1, total // WEIGH_ROWS))) == 0)

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = kept("letters", letters)
        for part in small(batch):
            lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()])
            right = (model.margins(part, table)[0] * code[lang] > 0).astype(np.int64)
            b = code.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lang, b)), pa.array(np.tile(np.arange(b), len(lang))), pa.array(right.ravel())], ["i", "b", "ok"])

    got = per_batch(sample, judge, "i long, b long, ok long").groupBy("i", "b").agg(F.avg("ok").alias("ok")).toPandas()
    trust = np.full(code.shape, 0.5)
    trust[got["i"], got["b"]] = np.maximum(got["ok"], 0.05)
    model.trust = trust / trust.sum(1, keepdims=True)
    return model


def predict(places: DataFrame, model: Model | None) -> DataFrame:
    """Adds `lang_pred`, `score` (0 to 1) and `ambiguous` to every place.

    places: place_id, name and any other columns but those three, which are kept;
    only the name counts. A name that is null or has no letter, or any without a
    model, gets `und`, score 0 and is ambiguous. A name is ambiguous too if the
    loss of the next codeword is less than SURE above the best one's; equal
    losses go to the language that comes first in the alphabet. Row by row, no
    shuffle. No rows in, none out.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    others = [f for f in places.schema.fields if f.name not in ("lang_pred", "score", "ambiguous")]
    names = [f.name for f in others]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = kept("letters", letters)
        for part in small(batch):
            if model is None:
                void = np.ones(part.num_rows, bool)
                lang, score, lead = ["und"] * len(void), np.zeros(len(void)), np.zeros(len(void))
            else:
                margins, total = model.margins(part, table)
                void = total == 0
                best, score, lead = model.decoded(margins)
                lang = ["und" if v else model.languages[i] for v, i in zip(void, best)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(np.where(void, 0.0, score)), pa.array(void | (lead < SURE))], [*names, "lang_pred", "score", "ambiguous"])

    return per_batch(places.select(*(F.col(f"`{c}`") for c in names)), run, T.StructType([*others, *added]))
