"""The registered queries of this subpackage: thin digests over each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, utf8
from .infill import INFILL_SQL, fill_in_middle, restore
from .licenses import scan, scan_sql
from .media import store_and_resolve
from .mixing import MIX_SQL, in_order, mix
from .packing import Capacities, pack
from .pii import detect
from .planes import encode_and_read
from .quality import judge
from .sharding import shard_documents
from .simhash import near_duplicates
from .tries import TRIE_SQL, prefix_trie
from .urls import judge_urls
from .wordpiece import count_tokens


#: At most 32 documents and 95 % of a full sequence's attention cost, where that costs no sequence of 2048 tokens.
WISHED = Capacities(2048, 32, 2048 * 2048 * 95 // 100)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary(), Capacities(2048, 2048, 2048 * 2048), end_id=0, wished=WISHED)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(mix(read_table(spark, sf_dir, "documents"))).drop("positions")


def op3_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op5_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read_table(spark, sf_dir, "documents")).drop("found")


def op7_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(read_table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op4_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=3, n_words=1, radius=2, parts=8)
    return found.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def op10_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store_and_resolve(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2(utf8(F.col("output")), 256), "restored_sha256": F.sha2(utf8(restore(F.col("output"), F.col("form"))), 256)}
    return out.withColumns(digests).select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


def op12_license_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("found")


def op13_patricia_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op4_longest_match_counts": op4_longest_match_counts,
    "op3_url_language_ratio": op3_url_language_ratio,
    "op5_decision_lists": op5_decision_lists,
    "op6_pii_spans": op6_pii_spans,
    "op7_bit_plane_ids": op7_bit_plane_ids,
    "op8_minimax_shards": op8_minimax_shards,
    "op9_simhash_components": op9_simhash_components,
    "op10_interleaved_media": op10_interleaved_media,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_license_containment": op12_license_containment,
    "op13_patricia_prefix_trie": op13_patricia_prefix_trie,
}

#: The other queries need models, tokenizers, hashes or positions of matches that SQL lacks; the tests compare them with brute force.
ORACLE: dict[str, str] = {
    "op2_curriculum_mix": MIX_SQL,
    "op11_fill_in_middle": INFILL_SQL,
    "op12_license_containment": scan_sql(),
    "op13_patricia_prefix_trie": TRIE_SQL,
}
