"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import bpe, concat, langid, lm, packing, quality, ranking, search, secrets, simhash, toxicity, trie, urls
from papyrine.llm.common import held_out, pick, read


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_encode(pick(read(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "n_tokens", "ids")
    both = bpe.bpe_decode(encoded)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity.fit(documents, read(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.lm_scores(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", *(F.round(c, lm.DIGITS).alias(c) for c in ("logprob", "per_token")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    predicted = langid.predict(pick(documents, "doc_id", "text"), langid.fit(documents))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.quality(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return checked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"))


def op12_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_lines(read(spark, sf_dir, "sale_lines"))


def op13_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.concat_pack(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_byte_bpe, op2_bm25_search, op3_toxicity, op4_lm_scores, op5_simhash, op6_language_id, op7_quality, op8_secrets, op9_packing, op10_url_filter)
    return {f.__name__: f for f in (*first, op11_prefix_trie, op12_ranking_ties, op13_concat_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_bm25_search": search.ORACLE_SQL, "op4_lm_scores": lm.ORACLE_SQL, "op7_quality": quality.ORACLE_SQL, "op11_prefix_trie": trie.ORACLE_SQL, "op12_ranking_ties": ranking.ORACLE_SQL}
