"""Registered queries of this subpackage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.llm import alignment, chat, hnsw, katz, linechunks, mixing, pieces, quality, secrets, simhash, subspace, substrings, trie


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_hnsw(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_substring_dedup(spark, sf_dir):
    found = substrings.dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex64(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def fold(id_col: str, folds: int = 5):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def quality_model(spark, docs, sf_dir):
    """Fitted on the labelled documents whose fold is not 0."""
    labels = _read(spark, sf_dir, "labels").where(fold("doc_id") != 0)
    return quality.train(docs, labels)


def op5_quality_crf(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality_model(spark, docs, sf_dir))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark, sf_dir):
    return linechunks.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def default_model() -> pieces.Transducer:
    """The public model file installed with the tokenizers."""
    import public_tokenizers

    return pieces.Transducer.load(public_tokenizers.path("piece_bpe_32k.model"))


def op7_sentencepiece(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode_table(docs, default_model(), verify=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.col("decoded").alias("round_trip"))


def op8_chat_format(spark, sf_dir):
    probe = spark.createDataFrame(
        [(-7, t, r, r"\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.conversation_digests(chat.format_examples(turns))


def op9_katz_score(spark, sf_dir):
    held_out = fold("doc_id") == 1
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    found = katz.score(docs, min_count=1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), *katz.RESULT)


def op10_embedding_dedup(spark, sf_dir):
    return subspace.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    a = alignment.ByteLevelBPE.load(public_tokenizers.path("byte_bpe_50k.json"))
    b = alignment.PieceBPE.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = alignment.align(_read(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", *alignment.RESULT[:-1], digest.alias("groups_sha256"))


def op12_secret_scan(spark, sf_dir):
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
                        F.sha2(secrets.written(secrets.base_only(F.col("spans"))), 256).alias("base_sha256"),
                        secrets.written(F.col("spans")).alias("spans"))


def with_shared_starts(listed: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv, entries): the first h turns come from the conversation whose id is the next lower multiple of `every`;
    h is the CRC-32 of the id modulo `most`."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int")
    bases = listed.where(F.col("conv") % every == 0).select(
        F.col("conv").alias("base"), F.slice("entries", 1, most - 1).alias("start"))
    both = listed.withColumn("base", F.col("conv") - F.col("conv") % every).join(bases, "base", "left").withColumn("h", h)
    none = F.array().cast("array<string>")
    return both.select("conv", F.concat(F.slice(F.coalesce("start", none), F.lit(1), F.col("h")),
                                        F.slice("entries", F.col("h") + 1, F.size("entries"))).alias("entries"))


def op13_prefix_trie(spark, sf_dir):
    return trie.prefix_tree(with_shared_starts(trie.conversations(_read(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_hnsw, op3_substring_dedup, op4_simhash, op5_quality_crf, op6_line_dedup, op7_sentencepiece,
    op8_chat_format, op9_katz_score, op10_embedding_dedup, op11_tokenizer_alignment, op12_secret_scan, op13_prefix_trie)}
