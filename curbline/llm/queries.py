"""The numbered queries: each maps a given table to its operator's records and the results back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace, table
from . import bpe, centroids, chat, embeddings, fingerprints, languages, packing, pieces, repair, repeats, secrets, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def places(spark: SparkSession, sf: str) -> DataFrame:
    """documents as places: the text is the name."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("place_id"), F.col("text").alias("name"))


def hex_of(text: str | Column) -> Column:
    return F.sha2(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"), 256)


def op1_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    folder = Workspace(spark, "warc").path("archives")
    warc.write(table(spark, sf, "pages"), folder)
    found = warc.resolved(warc.read(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_codes(spark: SparkSession, sf: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("place_id"), F.col("text").alias("name"), "lang", held.alias("held_out"))
    model = languages.train(d.where("not held_out").select("name", "lang"))
    return languages.predict(d.drop("lang"), model).select(F.col("place_id").alias("doc_id"), "held_out", "lang_pred", "score", "ambiguous")


def op3_multiset_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    c = fingerprints.compare(d.select(F.col("doc_id").alias("route_id"), F.col("text").alias("directions")))
    return c.select(F.col("route_id").alias("doc_id"), F.length("directions").cast("long").alias("n_chars"), hex_of("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = bpe.encode(places(spark, sf), path)
    e = e.select(F.col("place_id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), hex_of(F.array_join(F.col("token_ids").cast("array<string>"), " ")).alias("ids_sha256"), "token_ids")
    return bpe.decode(e, path).select("doc_id", "n_tokens", "ids_sha256", hex_of("decoded").alias("decoded_sha256"))


def op5_embedding_copies(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    n = simhash.near_copies(places(spark, sf))
    return n.select(F.col("place_id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    d = d.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    c = chat.format_turns(d).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hex_of(told).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        hex_of("loss").alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op8_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    r = repeats.drop_repeats(d.select(F.col("doc_id").alias("route_id"), F.col("text").alias("directions")))
    n = F.octet_length("directions").cast("long")
    return r.select(F.col("route_id").alias("doc_id"), n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), hex_of("kept").alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    p = packing.pack(d.select(F.col("doc_id").alias("route_id"), F.col("text").alias("directions")), public_tokenizers.path("word_bpe_49k.json"))
    return p.select(F.col("route_id").alias("doc_id"), "start", "length", F.crc32("token_bytes").alias("ids_crc32"), F.col("route_tokens").alias("doc_tokens"), "sequence_id", "offset")


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    found = secrets.find(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        F.col("page_id").alias("doc_id"), *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        hex_of(secrets.listed(of("assign", "access", "hex"))).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with faults put in, by a checksum of conv_id and turn."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.where("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("_")).drop("_")


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    bad = damaged(turns)
    found = Workspace(spark, "repair-found").write(repair.audits(bad), "audits")
    texts = repair.digests(repair.repaired(bad, found)).withColumnRenamed("conv_id", "_text_id")
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = every.join(found, same("_id", "conv_id"), "left").join(texts, same("_id", "_text_id"), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = F.col("audit").isNull()  # no row is left of the conversation
    return out.select(
        F.col("_id").alias("conv_id"), *(F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", hex_of(F.lit(""))).alias("repaired_sha256"))


def op12_sentence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("name"))
    e = pieces.encode(d, path).select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), hex_of(F.array_join(F.col("piece_ids").cast("array<string>"), ",")).alias("ids_sha256"), "piece_ids")
    return pieces.decode(e, path).select("doc_id", "n_tokens", "ids_sha256", hex_of("decoded").alias("decoded_sha256"))


def op13_centroid_tables(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    start = hex_of(F.concat(F.lit("1:"), F.col("vec_id").cast("string")))
    found = centroids.cluster(e, F.col("embedding"), 64, start, clusters=16, rounds=3, scale=64.0)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", hex_of(F.array_join(F.col("centroid").cast("array<string>"), ",")).alias("centroid_sha256"))


QUERIES: dict[str, Query] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_language_codes": op2_language_codes,
    "op3_multiset_fingerprints": op3_multiset_fingerprints,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_embedding_copies": op5_embedding_copies,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_suffix_repeats": op8_suffix_repeats,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_centroid_tables": op13_centroid_tables,
}
ORACLES: dict[str, str] = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, sha256(html) AS payload_digest, CAST(strlen(html) AS BIGINT) AS payload_bytes FROM p),
        m AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN m.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.first < d.page_id THEN m.first END AS refers_to
        FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 100""",
    # The edits of a row, then turns put in after it, by the state before and behind; arg_min and min agree, as audits differ.
    "op11_conversation_repair": """
        WITH RECURSIVE told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        codes AS (SELECT * EXCLUDE (key), list_transform(range(1, length(key) + 1), lambda i: CAST(unicode(substr(key, i, 1)) AS BIGINT)) AS b FROM told),
        keyed AS (SELECT * EXCLUDE (b), xor(list_reduce(b, lambda c, x: list_reduce(range(8), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS k FROM codes),
        rows AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, k FROM keyed WHERE k <> 0),
        bad AS (SELECT conv_id, turn, role, text FROM rows UNION ALL SELECT conv_id, turn, role, text FROM rows WHERE k = 3),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM bad),
        judged AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
            left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
        follows(p, q) AS (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
        grown(p, q, w, e, said) AS (VALUES ('-', '-', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('-', 'u', 2, 'I', chr(10) || 'user:'), ('s', 'u', 2, 'I', chr(10) || 'user:'),
            ('u', 'a', 2, 'I', chr(10) || 'assistant:'), ('a', 'u', 2, 'I', chr(10) || 'user:'), ('-', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        edits AS (SELECT conv_id, i, f.p AS p, f.q AS q, CAST(fault = 'truncated' AS INTEGER) AS w, 'K' AS e, chr(10) || role || ':' || text AS said FROM judged JOIN follows f ON f.q = c WHERE fault IN ('sound', 'truncated')
            UNION ALL SELECT conv_id, i, f.p, f.q, 2 + CAST(fault = 'truncated' AS INTEGER), 'R', chr(10) || CASE f.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM judged JOIN follows f ON f.q IN ('u', 'a') WHERE fault IN ('sound', 'truncated')
            UNION ALL SELECT conv_id, i, s.p, s.p, 3, 'D', '' FROM judged CROSS JOIN (SELECT DISTINCT p FROM grown) s),
        moves AS (SELECT a.conv_id, a.i, a.p, g.q, a.w + g.w AS w, a.e || g.e AS e, a.said || g.said AS said FROM edits a JOIN grown g ON g.p = a.q),
        best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, g.q AS q, g.w AS cost, g.e AS audit, g.said AS said FROM (SELECT DISTINCT conv_id FROM judged) d CROSS JOIN grown g WHERE g.p = '-'
            UNION ALL SELECT b.conv_id, b.i + 1, m.q, min(struct_pack(c := b.cost + m.w, a := b.audit || m.e)).c, min(struct_pack(c := b.cost + m.w, a := b.audit || m.e)).a,
                arg_min(b.said || m.said, struct_pack(c := b.cost + m.w, a := b.audit || m.e)) FROM best b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 AND m.p = b.q GROUP BY b.conv_id, b.i, m.q),
        counts AS (SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
        won AS (SELECT b.conv_id, min(struct_pack(c := b.cost, a := b.audit)) AS v, arg_min(b.said, struct_pack(c := b.cost, a := b.audit)) AS said FROM best b JOIN counts k ON k.conv_id IS NOT DISTINCT FROM b.conv_id AND k.n = b.i WHERE b.q IN ('-', 'a') GROUP BY b.conv_id)
        SELECT d.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal,
               CAST(coalesce(w.v.c, 0) AS BIGINT) AS cost, coalesce(w.v.a, '') AS audit, sha256(coalesce(substr(w.said, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op13_centroid_tables": "WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),\n"
    "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM kept QUALIFY c < 16),\n"
    + ",\n".join(
        f"a{r} AS (SELECT k.vec_id, k.v, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c)) AS b FROM kept k CROSS JOIN c{r} c GROUP BY ALL)"
        + ("" if r == 3 else f""",
        u{r} AS (SELECT b.c AS c, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
        c{r + 1} AS (SELECT c, list(x ORDER BY i) AS m FROM u{r} GROUP BY c UNION ALL SELECT c, m FROM c{r} WHERE c NOT IN (SELECT c FROM u{r}))""") for r in range(4))
    + """
        SELECT a.vec_id, CAST(a.b.c AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m.m, ',')) AS centroid_sha256 FROM a3 a JOIN c3 m ON m.c = a.b.c""",
}
