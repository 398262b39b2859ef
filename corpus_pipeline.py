"""The corpus pipeline: language ID, near-copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents; other columns that docs may have go with their rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import languages, packing, repeats, secrets, simhash
from curbline.session import Workspace, table


def with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """docs with `text` from changed (doc_id, was, text), and n_chars after it. Rows meet by doc_id and the
    text that they had, so that repeated ids and rows keep their own. The row goes along as one column, so that no name in it can clash."""
    key = lambda c: F.coalesce(F.col(c), F.lit(-(2**63)).cast("long"))
    mark = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    # one exchange serves the duplicates and the join: the keys are the same, and not null
    new = changed.select(key("doc_id").alias("new_id"), mark("was").alias("new_mark"), F.col("text").alias("new_text")).dropDuplicates(["new_id", "new_mark"])
    met = docs.select(whole(docs), key("doc_id").alias("id"), mark("text").alias("mark")).join(new, (F.col("id") == F.col("new_id")) & (F.col("mark") == F.col("new_mark")))
    return opened(met, docs, F.col("new_text"))


def whole(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def opened(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs from `row`, with another text, if one is given, and its n_chars."""
    out = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(out[c].alias(c) if c in out else F.col("row").getField(c).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language. Those without a letter go; ambiguous ones stay, as clean short texts
    are among them, and without any label all that have a letter."""
    model = languages.train(docs.select(F.col("text").alias("name"), "lang"))
    told = languages.predict(docs.select(whole(docs), F.col("text").alias("name")), model)
    has = F.col("lang_pred") != "und" if model else F.coalesce(F.col("name").rlike(r"\p{L}"), F.lit(False))
    return opened(told.where(has), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component."""
    found = simhash.near_copies(docs.select(F.col("doc_id").alias("place_id"), F.col("text").alias("name")))
    first = found.where("place_id <=> component_id").select(F.col("place_id").alias("kept_id")).distinct()
    return opened(docs.select(whole(docs), F.col("doc_id").alias("own_id")).join(first, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi"), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a smaller doc_id has. A document of which nothing is left goes;
    a character of which a part is left goes too."""
    cut = repeats.drop_repeats(docs.select(F.col("doc_id").alias("route_id"), F.col("text").alias("directions")), whole_characters=True)
    kept = cut.where((F.octet_length("kept") > 0) | (F.size("spans") == 0)).select(F.col("route_id").alias("doc_id"), F.col("directions").alias("was"), F.col("kept").cast("string").alias("text"))
    return with_text(docs, kept)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] in the place of every span that is found."""
    found = secrets.find(docs.select(whole(docs), F.col("text").alias("html")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return opened(found, docs, secrets.masked(F.col("html"), F.col("secrets")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 2048 ids."""
    p = packing.pack(docs.select(F.col("doc_id").alias("route_id"), F.col("text").alias("directions")), public_tokenizers.path("word_bpe_49k.json"))
    return p.select(F.col("route_id").alias("doc_id"), "start", "length", F.crc32("token_bytes").alias("ids_crc32"), F.col("route_tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("passages", passages), ("secret_scan", secret_scan), ("packed", packed)]

#: SQL can express none of the classifier, the tokeniser and the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
