"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casespark.llm.exact_dedup import exact_duplicates
from casespark.llm.fingerprint import edited_fingerprints
from casespark.llm.hard_negatives import mine_hard_negatives
from casespark.llm.hmm_lm import score_texts
from casespark.llm.minhash_dedup import near_duplicates
from casespark.llm.packing import pack
from casespark.llm.pieces import encode_and_decode
from casespark.llm.pii import pseudonymise
from casespark.llm.quality import quality_scores
from casespark.llm.repeats import remove_repeats
from casespark.llm.secrets import find_secrets
from casespark.llm.url_filter import filter_urls
from casespark.llm.whitening import whiten


#: a run of one's own takes a secret key
PII_KEY = "published with the tests"


#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: small labelled URL table (1: block); sites invented for this purpose, none of them a site of the tables
URL_LABELS = [(f"https://{url}", 1) for url in [
    "discount-pills.example.net", "www.pharma-pills.example.com/en/order", "pillshop.example.org/fr/4", "m.diet-pills.example.net/es/90",
    "casino-bonus.example.com/en/slots", "www.best-casino.example.net/win", "poker-win.example.org/de/12", "sportsbets.example.com/en/88?page=2",
    "www.bets-online.example.net/de/7.html", "adult-videos.example.net", "www.adultcams.example.org/live/3", "xxx-cams.example.org/en/345.html",
    "free-xxx.example.com/fr/345.html", "hot-singles.example.org/meet", "link-farm.example.com/en/1/", "www.content-farm.example.net/es/5#top",
    "seo-spam.example.org", "spamblog.example.net/en/33", "spam-links.example.com/en/12", "clickbait.example.net/you-wont-believe",
    "malware-download.example.net/setup.exe", "phishing-login.example.com/verify/account", "warez-crack.example.org/keygen",
    "get-rich-quick.example.net/offer", "free-prizes.example.com/en/claim", "cheap-loans.example.org/apply", "m.cheap-watches.example.com/buy"]] + [
    (f"https://{url}", 0) for url in [
        "blog.writer.example.com/en/12", "www.news-daily.example.net/de/7.html", "library.example.org", "m.museum.example.net/es/90",
        "university.example.com/en/courses", "www.weather.example.net/today", "recipes.example.org/soup/3", "garden.example.com/en/88?page=2",
        "science-journal.example.net", "encyclopedia.example.com/en/article", "chess-club.example.org/de/12", "blog.northern.example.org/en/345.html",
        "travel.example.net/mountain-walks", "history.example.com/fr/345.html", "code-forum.example.org/en/1/", "docs.project.example.net/manual.html",
        "city-council.example.com/meetings/agenda", "theatre.example.org/programme", "blog.thing.example.net/es/5#top", "www.other.example.com/en/33",
        "music-school.example.net/lessons", "blog.notes.example.org/en/773", "station.example.com", "www.weekend-markets.example.org/fr/4",
        "m.hospital.example.com/en/claim", "mathematics.example.net/en/order", "example.org"]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; it is installed on every node."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_length")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), PII_KEY)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    labelled = spark.createDataFrame(URL_LABELS, "url string, block int")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, labelled)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    both = encode_and_decode(documents(spark, sf_dir), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), folds=10)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))

    def of(*kinds: str) -> Column:
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(of("assign", "access", "hex")), 256).alias("base_sha256"),
                        listed(F.col("findings")).alias("spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32, scale=64, shift=1_000_000)
    # null where the exact value does not fit in a long
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label,
                               positives=5, negatives=5, floor_percent=80, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_fingerprints": op3_fingerprints,
    "op4_pii": op4_pii,
    "op5_url_filter": op5_url_filter,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_hmm_lm": op7_hmm_lm,
    "op8_repeats": op8_repeats,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_secrets": op11_secrets,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) <= 5""",
}
