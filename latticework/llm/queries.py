"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import best_fit_packing, block_naming, decontaminate, embedding_whitening, language_id, licence_scan, periodic_runs, quality_rules, secret_scan, sharding, simhash_dedup, substring_dedup, tool_calls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licence_scan.scan(docs, licence_scan.train(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.classes(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(_table(spark, sf_dir, "documents"), word_tokenizer())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    named = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.report(_table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secret_scan.digest(F.col("found"), 3), 256).alias("base_sha256"), secret_scan.digest(F.col("found"), 99).alias("spans"),
    )


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked(*tool_calls.turn_calls(_table(spark, sf_dir, "conversations")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.places(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = embedding_whitening.fit(vectors)
    values = [float(e / model.trace) for e in model.values] if model else []
    explained = F.array(*map(F.lit, values)) if values else F.array().cast("array<double>")
    rows = embedding_whitening.whitened(vectors, model).select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("at", "entry"))
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("entry.whitened").alias("whitened"), F.col("entry.explained").alias("explained"), F.lit(error).alias("identity_error"))


def op12_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the documents' words, after each tenth document (by hash) is made periodic from a word of its own on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    shift = docs.withColumn("a", F.when(F.size("w") > 0, F.expr("cast(g % size(w) as int)"))).withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    words = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    texts = shift.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))
    best = periodic_runs.longest(F.col("runs"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = periodic_runs.periodic_runs(texts).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), told.alias("told"), "collapsed")
    return found.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_tool_calls": op8_tool_calls,
    "op9_language_id": op9_language_id,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_block_naming": op12_block_naming,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op12_block_naming": r"""select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, row_number() over w = 1 as kept, sha256(norm) as text_sha256
        from (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents) t
        window w as (partition by norm order by n desc, doc_id nulls last)""",
}
