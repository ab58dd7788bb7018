"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmark.llm import byte_pairs, chat_windows, decontaminate, language_id, license_scan, merkle, mixing, periodic_runs, pii, quality_rules, repeats, simhash, toxicity
from siftmark.llm.common import fold, materialise, word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
        "n_good_lines", "kept",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return chat_windows.read_back(chat_windows.format_windows(turns.unionByName(extra)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    settings = toxicity.Settings()
    rows = toxicity.training_rows(docs.where("not held_out"), _table(spark, sf_dir, "labels"), "toxic", settings)
    model = toxicity.fit(docs, materialise(rows, "toxicity-training"), settings)
    return toxicity.score(docs, model, ["doc_id", "held_out"], settings.threshold)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = language_id.fit(docs.where("not held_out").select("doc_id", "text", "lang"))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # Sizes are counted once; only three numbers of a document are needed afterwards.
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("n")), "mix-input")
    mixed = mixing.mix_sources(sizes, F.col("n"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are repositories; a folder holds a hundred documents, and every fourth document is a licence file."""
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    folders = [F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100)]
    docs = _table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", *folders, name).alias("path"))
    return license_scan.scan_licenses(files, "doc_id").select("doc_id", "path", "own", "license", "license_dir")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof; a third of them are tampered with before they are checked. A null id is not."""
    docs = _table(spark, sf_dir, "documents")
    columns = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(columns(F.translate("text", upper, lower))))
    manifest = merkle.build(docs, "lang", "doc_id", merkle.leaf(columns(F.col("text"))), [F.col("doc_id"), tampered.alias("tampered")])
    proofs = merkle.prove(manifest).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the texts, a tenth of which first get a period by the contract's rule. A null id plants none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    planted = periodic_runs.plant_period(
        F.col("text"), lambda n: g % n, lambda n, a: F.floor((n - a) / (g % 8 + 3)) + 1,
    )
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs, ["doc_id"])
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.l").alias("length"),
        (-F.col("top.p")).alias("period"), F.expr("(1000 * top.l) div (-top.p)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_byte_pairs(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Ids of every text and what they decode to. The vocabulary is a public tokenizer's file, by its path."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    shared = byte_pairs.share(spark, byte_pairs.load(vocabulary))
    done = byte_pairs.encode(_table(spark, sf_dir, "documents"), shared, ["doc_id"], decoded=True)
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash": op2_simhash,
    "op3_license_scan": op3_license_scan,
    "op4_chat_windows": op4_chat_windows,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_decontaminate": op8_decontaminate,
    "op9_repeats": op9_repeats,
    "op10_pii": op10_pii,
    "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_pairs": op13_byte_pairs,
}
