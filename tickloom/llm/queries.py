"""The registered query of each operator, over its whole table, and the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import hosts, lexical, mixing, negatives, neighbours, ordermin, packing, quality, simhash, telephony, tokenbin, toxicity, warc
from tickloom.llm.common import cut, scratch, table, unsigned_hex

def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(neighbours.usable(table(spark, sf_dir, "embeddings")), "vectors")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


MIX = mixing.Mix()


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), MIX)


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = telephony.store_payloads(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    stored = cut(telephony.with_pcm(media, rate=telephony.WIDE).select("doc_id", "n_bytes", "a.*"), "audio", **telephony.PAGES)
    return telephony.features(telephony.read_back(stored, rate=telephony.WIDE).select("doc_id", "n_bytes", "d.*")).drop("codec", "pcm")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    history = warc.merge_index(cut(warc.read(spark, path), "captures"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {5 * i + 1}, 5))::INTEGER >> {5 * j}) & 31) + 1, 1)" for i in range(8) for j in (3, 2, 1, 0))

WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
     k AS (SELECT x, max(page_id) AS winner FROM p GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN winner IS NULL OR page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM p JOIN k USING (x)
"""


#: Labelled documents that a classifier is fitted on at most.
LABELLED = 16_000


def _fold(of: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(4) == 2
    model = toxicity.fit(quality.sample(docs, labels.where(~held_out), "toxic", LABELLED))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(5) == 0
    weights = quality.fit(quality.sample(docs, labels.where(~held_out), "quality", LABELLED))
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=3, seed=42)
    return found.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; imported here, as only queries fix the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [
    hosts.Rule("com", "/en/", "block"),
    hosts.Rule("example.com", "/en/7", "allow"),
    hosts.Rule("net", "/de/", "allow"),
    hosts.Rule("example.net", "/de/8", "block"),
    hosts.Rule("org", "/es/", "block"),
]


def op8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), RULES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(cut_up, capacity=4096)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ids = scratch(spark, "token-files"), 50257
    tokenbin.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0, vocabulary_size=ids)
    read_back = cut(tokenbin.read(spark, path, ids), "token-rows")
    return tokenbin.placed(read_back).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = cut(negatives.usable(table(spark, sf_dir, "embeddings"), label), "vectors")
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordermin.compared(table(spark, sf_dir, "documents"))
    return found.withColumns({name: F.lower(F.hex(name)) for name in ("fingerprint", "edited_fingerprint")})


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(lexical.index(table(spark, sf_dir, "documents")), "index")
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_neighbours": op1_neighbours,
    "op2_mixing": op2_mixing,
    "op3_telephony": op3_telephony,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_hosts": op8_hosts,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_order_minhash": op12_order_minhash,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.sql(MIX),
    "op4_warc": WARC_SQL,
    "op8_hosts": hosts.sql(RULES),
    "op11_hard_negatives": negatives.sql(),
    "op13_ranked_search": lexical.SQL,
}
