"""The numbered queries: thin digests of the operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import chat_format, decontaminate, jaccard_join, language_id, licenses, mixing, prefix_trie, quality_classifier, quality_rules, secrets_scan, sharding, spelling, suffix_dedup
from millrace.llm.joins import join_groups
from millrace.llm.storage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of the mix of all documents, in the order of mix_at."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = stored(mixing.count_tokens(docs, keep=["doc_id", "source"], name="n_tokens"))
    mix = mixing.plan_mix(counted.select(mixing.source_key("source"), F.col("n_tokens").alias("mix_tokens")))
    drawn = mixing.mix_order(counted, mix, tokens="n_tokens")
    return drawn.select(
        "doc_id",
        "source",
        "n_tokens",
        F.col("mix_epoch").alias("epoch"),
        F.col("mix_start").alias("start_token"),
        F.round("mix_at", 9).alias("mix_at"),
        F.round("mix_weight", 9).alias("weight"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their texts, into shards 0 to 15 under the law of equal row counts; digests of the texts that arrive there."""
    placed = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = quality_classifier.classify(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "p_quality", "p_toxic", "doc_p_quality", "doc_p_toxic", F.col("keep").alias("kept"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes leave of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, keep=["doc_id"], bodies=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; all pages, with their markup and addresses, are evidence beside them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("host"), F.lit(None).cast("string").alias("markup"), F.lit(True).alias("asked"))
    pages = _table(spark, sf_dir, "pages")
    shown = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    none = F.lit(None)
    pages = pages.select(none.cast("long"), shown, none.cast("string"), "url", F.regexp_extract("html", r"(?i)<html\b[^>]*>", 0), F.lit(False))
    found = language_id.identify(docs.union(pages), host="host", markup="markup", keep=["doc_id", "asked"])
    return found.where("asked").select("doc_id", "language", "language_p", "text_language", "declared_language", F.col("accepted").alias("kept"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of every document."""
    found = secrets_scan.secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    both = F.array_sort(F.concat("base_spans", "linked_spans"))
    return found.select(
        "doc_id",
        *[secrets_scan.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets_scan.span_text(base), 256).alias("base_sha256"),
        secrets_scan.span_text(both).alias("spans"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination_report(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        "longest_words",
        "longest_item",
        "longest_at",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the adaptive verdict for every document."""
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    base = quality_rules.base_failed()
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & F.col("passes")).alias("kept"),
        F.array_join("failed", ",").alias("failed"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = licenses.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "license",
        "license_use",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the words of all documents, one run in 97 of which loses a letter.

    Null texts have no words; a null doc_id is written as nothing.
    """
    docs = _table(spark, sf_dir, "documents")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(spelling.runs(F.col("text"), 5)).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    spoilt = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % 97 == 0, spoilt).otherwise(F.col("run")).alias("word"))
    return spelling.spelling_groups(spelling.count_words(words, "word"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from what was formatted; conversation -1 holds control strings."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(False).alias("added"))
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), said, F.lit(True))
    keys = ("added", "conv_id")
    return chat_format.read_back(chat_format.format_conversations(given.union(added), keys=keys), keys).drop("added")


def _branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which up to 8 first turns of each come from the first of its five; a null conversation stays as it is."""
    taken = F.pmod(F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary")), F.lit(9))
    first = F.col("conv") - F.col("conv") % 5
    convs = stored(turns.groupBy("conv").agg(F.max("place").alias("n")))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    each = convs.select("conv", first.alias("base"), taken.alias("h")).join(bases, "base", "left")
    each = stored(each.select("conv", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("kept")))
    own = join_groups(turns, each.select("conv", "kept"), ["conv"], 64).where(F.col("place") > taken)
    own = own.select("conv", (F.col("place") - taken + F.coalesce("kept", F.lit(0))).alias("place"), "d1", "d2", "size")
    # Below zero the remainder is negative: a first conversation may have followers on either side.
    near = F.array(*[F.try_add(F.col("conv"), F.lit(k)) for k in range(-4, 5)])
    shared = turns.where((F.col("place") <= 8) & (F.col("conv") == first)).select(F.col("conv").alias("base"), F.explode(near).alias("conv"), "place", "d1", "d2", "size").where(F.col("base") == first)
    shared = join_groups(shared, each.select("conv", "kept"), ["conv"], 64, "inner").where("place <= kept")
    return own.union(shared.select(own.columns)), each.select("conv")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each of which begins like the first of its five."""
    turns = stored(prefix_trie.number_turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(*_branched(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_sharding": op2_sharding,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_language_id": op6_language_id,
        "op7_secret_scan": op7_secret_scan,
        "op8_decontamination": op8_decontamination,
        "op9_quality_rules": op9_quality_rules,
        "op10_license_scan": op10_license_scan,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_chat_format": op12_chat_format,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_license_scan": licenses.license_digest_sql()}
