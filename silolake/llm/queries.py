"""The registered query of each operator, and its SQL where DuckDB can express it.

Every query runs its operator with production parameters over the whole table
and derives digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_two_fit, chat_preference, conversation_repair, digest_dedup, jaccard_join, periodic_runs, pivot_dedup, sentencepiece_stream,
               soft_mixing, token_count, token_store, toxicity, warc)
from . import planted
from .common import stored, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_tokens(table(spark, sf_dir, "documents"))
    return token_store.read_ids(store, store.manifest.select("doc_id", "nth"), digest=True).drop("nth")


def op2_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_preference.preference_pairs(*chat_preference.swapped_replies(table(spark, sf_dir, "conversations")))
    sides = [f(s).alias(n) for s in ("chosen", "rejected") for f, n in ((chat_preference.completion, s), (chat_preference.mask, f"{s}_mask"))]
    return pairs.select("pair_id", "prompt_turns", "prompt", *sides)


def op3_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("member")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = soft_mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    mixed, domains = soft_mixing.mix(docs, labelled, soft_mixing.WEIGHTS)
    return mixed.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    # lengths and digests are taken from the payloads as they are parsed, once; their bytes need not go through the joins
    records = warc.read_records(spark, folder, manifest)
    small = F.when(F.col("type").isin("request", "metadata"), F.col("payload"))
    captures = stored(warc.assemble(stored(records.withColumn("payload", small), "records")).drop("payload"), "captures")
    return warc.page_captures(captures)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_stream.encode_documents(table(spark, sf_dir, "documents"), ids=False, digest=True)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(planted.with_periods(table(spark, sf_dir, "documents")))
    # the greatest length, then the smallest start, then the smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = rows.withColumn("_top", F.when(F.size("runs") > 0, longest)).withColumns({
        "start": -F.col("_top.col2"), "length": F.col("_top.length"), "period": -F.col("_top.col3")})
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
                       F.expr("1000 * length div period").alias("exponent_milli"),
                       F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_two_fit.pack(table(spark, sf_dir, "documents"))
    return packed.places.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", F.col("offset").cast("long"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = conversation_repair.summary(conversation_repair.edits(planted.with_faults(turns)))
    every = turns.select("conv_id").distinct()  # a conversation may lose all its rows
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (every.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_chat_preference": op2_chat_preference,
    "op3_pivot_dedup": op3_pivot_dedup,
    "op4_digest_dedup": op4_digest_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_count": op10_token_count,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_two_fit": op12_best_two_fit,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_chat_preference": """
        WITH c AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
             l AS (SELECT pair_id, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY 1),
             r AS (SELECT c.pair_id, max(c.text) AS reply FROM c JOIN l ON c.pair_id = l.pair_id AND c.turn = l.last AND role = 'assistant' GROUP BY 1),
             k AS (SELECT c.*, l.last, CASE WHEN c.role = 'assistant' AND c.turn = l.last THEN coalesce(o.reply, '') ELSE c.text END AS swap
                   FROM c LEFT JOIN l USING (pair_id) LEFT JOIN r AS o ON o.pair_id = xor(c.pair_id, 1)),
             s AS (SELECT pair_id, min(turn) FILTER (text <> swap) AS split FROM k GROUP BY 1),
             j AS (SELECT k.*, s.split IS NULL OR k.turn < s.split AS common, '<|' || role || '|>' || chr(10) AS head, '<|end|>' || chr(10) AS tail,
                          CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS loss FROM k JOIN s USING (pair_id))
        SELECT pair_id, count(DISTINCT turn) FILTER (common) AS prompt_turns,
               coalesce(string_agg(head || text || tail, '' ORDER BY turn, role, text) FILTER (common), '') AS prompt,
               coalesce(string_agg(head || text || tail, '' ORDER BY turn, role, text) FILTER (NOT common), '') AS chosen,
               coalesce(string_agg(length(head) || ':0,' || length(text || tail) || ':' || loss, ',' ORDER BY turn, role, text) FILTER (NOT common), '') AS chosen_mask,
               coalesce(string_agg(head || swap || tail, '' ORDER BY turn, role, swap) FILTER (NOT common), '') AS rejected,
               coalesce(string_agg(length(head) || ':0,' || length(swap || tail) || ':' || loss, ',' ORDER BY turn, role, swap) FILTER (NOT common), '') AS rejected_mask
        FROM j GROUP BY pair_id""",
    "op4_digest_dedup": """
        WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
             n AS (SELECT coalesce(text, '') AS t, count(*) AS group_size FROM documents GROUP BY 1),
             k AS (SELECT t, max(doc_id) AS keep_id FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN k USING (t) JOIN n USING (t)""",
    "op13_conversation_repair": planted.repair_sql(),
}
