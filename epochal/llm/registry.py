"""Queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file (the same on every machine)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import repair, storage

    path = storage.new_path(spark, "op1-shards")
    repair.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path)
    return repair.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_glob_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import urlglob

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlglob.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import topk

    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT vec_id, min(v) AS v FROM ok WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN ok c ON q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import arc, storage

    old, new = storage.new_path(spark, "op4-arc"), storage.new_path(spark, "op4-warc")
    arc.write_arc(table(spark, sf_dir, "pages"), old)
    arcs = arc.archives(spark, old)
    arc.to_warc(arcs, arc.revisits(arc.arc_payloads(arcs)), new)
    records = arc.warc_records(arc.archives(spark, new))
    return records.select(F.col("source").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f"""


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import packing

    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import linerules

    out = linerules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", (F.col("n_lines") - F.col("n_removed_lines")).alias("n_kept_lines")
    )


def op7_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import linejoin

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linejoin.decisions(docs).withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    own = docs.select("doc_id", linejoin.text_key(F.col("text")).alias("text_key"))
    zero = F.lit(0).cast("long")
    return own.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("text_key") == F.col("__key")), "left").select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_removed", zero).alias("n_removed"), "removed"
    )


def op8_cpsjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import cpsjoin

    return cpsjoin.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS v
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w)::BIGINT - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (
  WITH RECURSIVE r(x, y) AS (
    SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id, r.m = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id"""


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import bpe

    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import qda

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return qda.score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op11_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op12_conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import conversations

    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))).drop("repaired")


def op13_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochal.llm import interactions

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return interactions.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repair_ids": op1_repair_ids,
        "op2_glob_automaton": op2_glob_automaton,
        "op3_exact_topk": op3_exact_topk,
        "op4_arc_to_warc": op4_arc_to_warc,
        "op5_hierarchical_packing": op5_hierarchical_packing,
        "op6_line_rules": op6_line_rules,
        "op7_segment_edit_join": op7_segment_edit_join,
        "op8_cpsjoin": op8_cpsjoin,
        "op9_speculative_bpe": op9_speculative_bpe,
        "op10_quality_qda": op10_quality_qda,
        "op11_sainte_lague": op11_sainte_lague,
        "op12_conversation_fold": op12_conversation_fold,
        "op13_filter_replay": op13_filter_replay,
    }


def oracle_sql() -> dict[str, str]:
    from epochal.llm import conversations, interactions, linerules, mixing, urlglob

    return {"op2_glob_automaton": urlglob.sql(), "op3_exact_topk": OP3_SQL, "op4_arc_to_warc": OP4_SQL, "op6_line_rules": linerules.sql(), "op8_cpsjoin": OP8_SQL, "op11_sainte_lague": mixing.SQL, "op12_conversation_fold": conversations.SQL, "op13_filter_replay": interactions.SQL}
