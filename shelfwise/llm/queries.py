"""Registered queries of the training-data operators, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import hnsw, html_extract, langid, licenses, multi_index, packing, pair_bpe, periodic_runs, piece_fst, resampling, secrets, simhash, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = simhash.simhash_classes(docs, "doc_id", "text", shingle=4, max_bits=4)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source; repository: the document. Beside the contract's columns: distinct live and copied secrets."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan_secrets(docs, "doc_id", "text", owner_col="source", repo_col="doc_id", copied_owners=3)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k, *_ in secrets.BASE],
        F.sha2(secrets.span_list(F.col("base")), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("copied").cast("long").alias("n_copied"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, "doc_id", "text", "lang", per_class=200, max_sample_chars=20000)
    return langid.predict(docs, "doc_id", "text", model)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's piece ids, and whether decoding gives its text back."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = piece_fst.encode_and_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), piece_fst.MARK, " ")
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        (F.col("decoded") == plain).alias("round_trip"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), "doc_id", "text", window=2048, end_id=1)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licences(docs, "text", "found")
    base, notices = F.col("found.base"), F.col("found.notices")
    base_labels = F.array_distinct(base["label"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, notices["label"])).alias("labels"),
        licenses.score(F.col("found")).alias("score"),
        F.size(notices).cast("long").alias("n_notices"),
        F.array_min(notices["edits"]).cast("long").alias("least_edits"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    text = html_extract.main_text_of(F.col("html"), spark).alias("text")
    return pages.select("page_id", "url", text).withColumn("n_chars", F.length("text").cast("long"))


def op6_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", k=20, ef=160)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.near_duplicates(rows, "vec_id", "embedding", threshold=0.95)


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list derived from the pages' own hosts: ``(kind, pattern, category, action, at)``.

    The host whose first page has id ``k`` is listed as a host, a domain or a path prefix by ``k`` mod 3,
    some entries are removed later and some of those added again.
    """
    at = F.to_date(F.lit("2024-01-01"))
    host = url_filter.host_of(F.col("url"))
    first = pages.filter(host != "").groupBy(host.alias("host")).agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("p"))
    first = first.select("host", F.col("p.page_id").alias("k"), F.element_at(url_filter.directories_of(F.col("p.url")), 1).alias("folder"))
    kind = F.element_at(F.array(*map(F.lit, url_filter.KINDS)), (F.col("k") % 3 + 1).cast("int"))
    names = F.array(*map(F.lit, ("spam", "malware", "adult", "piracy", "phishing")))
    listed = first.select(
        kind.alias("kind"),
        F.when(kind == "host", F.col("host")).when(kind == "domain", F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(F.concat("host", "folder")).alias("pattern"),
        F.element_at(names, (F.col("k") % 5 + 1).cast("int")).alias("category"),
        "k",
    ).filter("pattern <> ''")

    def log(kinds: tuple, action: str, days) -> DataFrame:
        return listed.filter(F.col("kind").isin(*kinds)).select("kind", "pattern", "category", F.lit(action).alias("action"), F.date_add(at, days.cast("int")).alias("at"))

    added = F.col("k") * 7 % 300
    return (
        log(url_filter.KINDS, "add", added)
        .unionByName(log(("domain", "prefix"), "remove", added + 60))
        .unionByName(log(("domain",), "add", added + 120))
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: every page, fetched on a day of 2024 that follows from its id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") * 37 % 365).cast("int"))
    judged = url_filter.filter_urls(pages.withColumn("fetched_on", day), url_list(pages), "url", "fetched_on")
    return judged.withColumn("categories", F.array_join("categories", ","))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text that decoding them gives."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pair_bpe.encode_and_decode(docs, tokenizer_path("word_bpe_49k.json"), "text", "ids", "decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to the texts of ``benchmark``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, _table(spark, sf_dir, "benchmark"), "doc_id", "text", "text", run=2, buckets=10_000, least_words=20, percent=25, seed=7)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; from a word on, the texts of a tenth of the ids repeat a few of their own words (the query's contract)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)).cast("int"))
    a, p = F.col("a"), F.col("p")
    # the original words after the first p are never read again
    made = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("w"), F.when(i < a, i).otherwise(a + (i - a) % p)))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, "text", "found", least=6, powers=4)
    runs = F.col("found.runs")
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.minus")
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_language_id": op3_language_id,
    "op4_license_scans": op4_license_scans,
    "op5_html_extraction": op5_html_extraction,
    "op6_approximate_nearest_neighbours": op6_approximate_nearest_neighbours,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_packing": op8_packing,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_bpe": op11_bpe,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
