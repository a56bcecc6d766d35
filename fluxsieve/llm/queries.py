"""One registered query per operator, each over its whole table with production parameters.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, DuckDB SQL or None)``.  A query derives its
digest columns from the operator's own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from . import align, bpe, chat, lm_score, mixing, ordinal, prefix_trie, quality_rules, simhash, substring, suffix, token_files, voronoi

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public byte-level BPE vocabulary installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    """The public sentencepiece model installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def graded(labels: DataFrame) -> DataFrame:
    """Labels as grades: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


@register("op1_voronoi_top_k", voronoi.TOP_K_SQL)
def op1_voronoi_top_k(spark, sf_dir):
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op2_lm_difference", lm_score.LM_SQL)
def op2_lm_difference(spark, sf_dir):
    good = graded(table(spark, sf_dir, "labels")).filter("grade = 2")
    return lm_score.score(table(spark, sf_dir, "documents"), good).withColumn("score", F.round("score", 6))


@register("op3_ordinal_quality")
def op3_ordinal_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, graded(table(spark, sf_dir, "labels")), n_grades=3)
    return ordinal.score(docs, model, tail_grade=2)


@register("op4_simhash_covering")
def op4_simhash_covering(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


@register("op5_adaptive_rules", quality_rules.RULES_SQL)
def op5_adaptive_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@register("op6_bpe_chunk_reuse")
def op6_bpe_chunk_reuse(spark, sf_dir):
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op7_curriculum_mix", mixing.MIX_SQL)
def op7_curriculum_mix(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0))
    return plan.repartitionByRange(first, "h").sortWithinPartitions(first, "h").select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        first.alias("first_position"))


@register("op8_substring_dedup", substring.SUBSTRING_SQL)
def op8_substring_dedup(spark, sf_dir):
    out = substring.remove_repeated(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op9_chat_format", chat.CHAT_SQL)
def op9_chat_format(spark, sf_dir):
    cols = ["conv_id", "turn", "role", "text"]
    text = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    out = chat.format_conversations(table(spark, sf_dir, "conversations").select(*cols).unionByName(probe))
    turns, loss = chat.read_turns(F.col("formatted")), chat.loss_text(F.col("segments"))
    back = out.select("conv_id", "valid", "formatted", turns.alias("turns"), loss.alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


@register("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    out = suffix.remove_repeated(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their hundred: as many as the CRC of the
    id says (up to five, all if there are fewer), then their own further ones."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    heads = seqs.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, 5).alias("heads"))
    both = seqs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "first_id", "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.when(F.col("heads").isNull(), own).otherwise(F.concat(F.slice("heads", F.lit(1), h), own)).alias("turns"))


@register("op11_prefix_trie", prefix_trie.TRIE_SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(rebuilt(cut_lineage(prefix_trie.sequences(table(spark, sf_dir, "conversations")))))


@register("op12_token_files")
def op12_token_files(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=0)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op13_lockstep_alignment")
def op13_lockstep_alignment(spark, sf_dir):
    aligned = align.alignments(table(spark, sf_dir, "documents"), vocabulary(), pieces())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    out = align.with_counts(aligned.withColumn("groups", digest))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.col("groups").alias("groups_sha256"))
