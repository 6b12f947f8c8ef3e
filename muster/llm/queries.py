"""Queries over the synthetic tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import alignment, bpe, exact_dedup, html_text, jaccard, minhash, mixing, oracle, quality, runs, sharding, suffixes, token_counts, warc
from muster.llm.store import shared_dir, stored, table, with_row_id


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index")
    rows = exact_dedup.decisions(table(spark, sf_dir, "documents"), index)
    index.close()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A log of captures made of ``pages``, as ``warc.read_warc`` gives it: every page is
    fetched in the order of its id, one each two seconds, and the answer is 304 when it
    is asked for up to 100 seconds before or after that, or at the same time.

    Of those answers one in seven has the tag of another page, one in eleven has
    no tag but the date, and one in thirteen no validator at all.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    modified = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss")
    i = F.col("page_id")
    date = lambda seconds: F.concat(F.date_format(F.timestamp_seconds(F.lit(1_750_000_000) + seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    first = pages.select(
        F.concat(F.lit("urn:page:"), i).alias("record_id"), F.lit("response").alias("kind"), "url", date(2 * i).alias("date"), F.sha2("html", 256).alias("digest"), F.lit("200 OK").alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("content-type"), F.lit("text/html"),
                     F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        F.col("html").cast("binary").alias("body"),
    )
    plain = F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0"), F.lit("x-cache"), F.lit("hit"))
    tagged = F.when(i % 13 == 5, F.create_map().cast("map<string,string>")).when(i % 11 == 4, F.create_map(F.lit("last-modified"), modified)).when(
        i % 7 == 3, F.create_map(F.lit("etag"), F.lit('"other"'))).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag)))
    when = F.when(i % 17 == 3, 2 * i).otherwise(2 * i + 2 * (37 * i % 101) - 99)
    again = pages.select(
        F.concat(F.lit("urn:again:"), i).alias("record_id"), F.lit("revisit").alias("kind"), "url", date(when).alias("date"), F.lit(None).cast("string").alias("digest"),
        F.lit("304 Not Modified").alias("status"), F.map_concat(plain, tagged).alias("headers"), F.lit(None).cast("binary").alias("body"),
    )
    return first.unionByName(again)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stored(warc.timed(capture_log(table(spark, sf_dir, "pages"))), "log")
    out = warc.resolve_revisits(log.drop("body"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return out.select(number("record_id").alias("page_id"), "url", number("response_id").alias("response_page_id"), "verdict", F.array_join(lines, "\n").alias("headers"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"), least=50)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_id(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    found = alignment.with_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    found = stored(found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    scores = alignment.link_scores(found.select("row", "pairs", "times"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_components(table(spark, sf_dir, "documents"), n=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs.with_runs(docs.select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text")), keep=["doc_id"]).withColumn("top", runs.longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force."""
    return {
        "op1_exact_dedup": oracle.DEDUP, "op3_warc_revisits": oracle.WARC, "op5_quality_rules": oracle.QUALITY,
        "op9_jaccard_join": oracle.JACCARD, "op10_suffix_array": oracle.SUFFIXES,
        "op12_b_bit_minhash": oracle.NEAR, "op13_periodic_runs": oracle.RUNS,
    }
