"""The registered queries of the training-data operators, each over whole tables; their SQL is in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, jaccard, langid, licenses, mixing, placement, quality, rules, toolcalls, urlfilter, vectorcodes, vptree
from .common import cut, small
from .oracles import ORACLES

#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TOOLS = {"reply": {"prompt": {"type": "string", "required": True, "max_length": 200}}}
#: Tokenizers A (byte-level) and B (sentence pieces); every machine has these files.
TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(key: str, by: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.train(docs.where(_remainder("doc_id", 3) != 1), "text", "lang", F.col("doc_id"))
    got = langid.predict(docs.select("doc_id", "text"), "text", model)
    return got.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20, factor=1.0)


def conversation_events(turns: DataFrame) -> DataFrame:
    """Each user turn as a call of `reply` that needs the previous reply, each assistant turn as the result of the call before it; other turns are messages."""
    named = lambda back: F.concat_ws(":", "conv_id", F.col("turn") - back)
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    return turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.lit(0).alias("part"),
        F.when(user, "call").when(reply, "result").otherwise("message").alias("kind"),
        F.when(user, named(0)).when(reply, named(1)).alias("id"),
        F.when(user, F.lit("reply")).otherwise(F.col("role")).alias("name"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt")))).otherwise(F.col("text")).alias("body"),
        F.when(user & (F.col("turn") >= 2), F.array(named(2))).alias("needs"),
    )


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(conversation_events(_read(spark, sf_dir, "conversations")), TOOLS)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("host", urlfilter.host_of(F.col("url"))).withColumn("path", urlfilter.path_of(F.col("url")))
    pages = pages.withColumn("ruled", urlfilter.rule_of(F.col("host"), F.col("path"), URL_RULES))
    labelled = pages.select("page_id", "url", (F.col("ruled.verdict") == "block").alias("blocked"))
    got = urlfilter.judge(pages, "url", urlfilter.train(labelled, "url", "blocked", F.col("page_id"), ignore=urlfilter.rule_suffixes(URL_RULES)))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("judged.blocked") >= 0.5, "block").otherwise("allow"))
    return got.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), F.col("judged.blocked").alias("block_score"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.find_items(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", _read(spark, sf_dir, "benchmark"), "item_id", "text", width=10)
    hit = decontaminate.hit_words(F.col("found"))
    return got.select("doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("found")).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return placement.place(docs, "doc_id", SHARDS, fallback="text").select("doc_id", "slot", "shard", F.octet_length("text").cast("long").alias("n_bytes"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")
    return got.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_read(spark, sf_dir, "documents"), "doc_id", "text", n=4, num=85, den=100)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, "doc_id", "text", _read(spark, sf_dir, "labels"), "doc_id", "quality", _remainder("doc_id", 4) != 2)
    got = quality.score(docs, "text", model)
    return got.select("doc_id", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "quality.score", (F.col("quality.score") >= 0.7).cast("int").alias("predicted"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return got.select(
        "doc_id", "license.n_words", "license.n_base", "license.first_word", "license.last_word",
        join(F.col("license.base")).alias("base_labels"), join(F.concat("license.base", "license.method")).alias("labels"), "license.score",
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = cut(rules.measure(docs, "text").select("doc_id", "lang", "source", "counts"))
    got = rules.judge(measured, "counts", ("lang", "source"))
    return got.select("doc_id", *(f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "rules.base_failed", "rules.kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", *TOKENIZERS)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, book = vectorcodes.compress(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", parts=16, entries=64, rounds=2, scale=256)
    coded = cut(got.select("vec_id", "label", "coded.code", "coded.error"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(small(sums, sums.count()), F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(book)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_nearest_neighbours, op3_tool_calls, op4_url_filter, op5_decontaminate, op6_sharding, op7_mixing, op8_jaccard_join, op9_quality, op10_licenses, op11_quality_rules, op12_token_alignment, op13_vector_codes)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
