"""The queries that apply the operators of this subpackage to the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearword.llm import exact_dedup, fingerprints, mixing, near_dup, packing, quality, sharding, token_store, toxicity, warc
from nearword.llm.storage import Scratch, ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary() -> str:
    """The path of the byte-level BPE vocabulary that the token queries take."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives, read back."""
    manifest = warc.write(table(spark, sf_dir, "pages"), Scratch(spark, "warc").child("archives"))
    return warc.read(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes."""
    return quality.sampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_min_max_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on shingles of two words."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.Rule(n=2)).select("doc_id", "n_shingles", "component_id", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch into a new digest index."""
    index = exact_dedup.DigestIndex(spark, Scratch(spark, "digest-index").path)
    found = exact_dedup.ingest(table(spark, sf_dir, "documents"), index, "documents").drop("new_group")
    index.close()
    return found


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), public_vocabulary())


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens as Simple-8b files, read back."""
    scratch = Scratch(spark, "token-files")
    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), scratch.child("files"), public_vocabulary()))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of all documents takes of each."""
    found = mixing.decide(table(spark, sf_dir, "documents"))
    listed = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("draws", "orders")]
    return found.select("doc_id", "size", "source_size", "target", "taken", *listed)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints against their edited texts' and the next documents'."""
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by bytes."""
    docs = table(spark, sf_dir, "documents")
    maps = sharding.build(docs, Scratch(spark, "slot-map").path, 16)
    placed = sharding.place(docs, maps.load(maps.latest()))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_min_max_near_dup": op3_min_max_near_dup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_files": op7_token_files,
    "op8_source_mix": op8_source_mix,
    "op9_fingerprints": op9_fingerprints,
    "op10_virtual_slots": op10_virtual_slots,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), g AS (
    SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY sha1(body)) AS last FROM p
), r AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM g
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
""",
    "op4_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), r AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""",
}
