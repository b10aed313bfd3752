"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import alignment, bpe_codec, brown, crf, fingerprints, mixing, near_duplicates, near_vectors, packing, secrets, spelling, tokens, url_reputation
from labelmill.llm.common import LOWER, UPPER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


_HOST = "(?s)^.*?://([^/?#]*)([^?#]*)"
_SUFFIXES = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)


def _sql_strength(children: str, parent: str) -> str:
    low, high = url_reputation.LEAST_RHO, url_reputation.MOST_RHO
    return f"""(SELECT CASE WHEN room > 0 THEN (1 - rho) / rho ELSE {url_reputation.DEFAULT_STRENGTH} END FROM (
      SELECT room, greatest({low}, least({high}, (spread - binomial) / nullif(room, 0))) AS rho FROM (
        SELECT sum(b2n - bad * m) AS spread, sum(m * (1 - m) * (k - 1)) AS binomial, sum(m * (1 - m) * (n - n2 / n - (k - 1))) AS room FROM (
          SELECT sum(bad) / sum(n) AS m, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS n2, sum(bad * bad / n) AS b2n, count(*) AS k
          FROM {children} GROUP BY {parent}))))"""


def _sql_rule() -> tuple[str, str]:
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for said, text in ordered:
        at = text.find("/")
        fits.append((f"(host = '{text[:at]}' OR ends_with(host, '.{text[:at]}')) AND starts_with(path, '{text[at:]}')", text, said))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    return case(1), case(2)


OP6_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{_HOST}', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '{_HOST}', 2), '') AS path FROM pages),
named AS (
  SELECT DISTINCT host, CASE WHEN two IN ({_SUFFIXES}) THEN three ELSE two END AS domain, CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE one END AS suffix
  FROM (SELECT host, string_split(host, '.')[-1] AS one, array_to_string(string_split(host, '.')[-2:], '.') AS two,
               array_to_string(string_split(host, '.')[-3:], '.') AS three FROM parts)),
counts AS (
  SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad
  FROM (SELECT host, greatest(toxic = 1, quality = 0) AS bad FROM parts JOIN labels ON page_id = doc_id) JOIN named USING (host)
  WHERE bad IS NOT NULL GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM counts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, 1 AS everything FROM domains GROUP BY ALL),
priors AS (SELECT (SELECT coalesce(sum(bad) / sum(n), 0.5) FROM suffixes) AS mean0, {_sql_strength("suffixes", "everything")} AS m_s,
           {_sql_strength("domains", "suffix")} AS m_d, {_sql_strength("counts", "suffix, domain")} AS m_h),
shrunk_s AS (
  SELECT named.*, m_d, m_h, (coalesce(s.bad, 0) + m_s * mean0) / (coalesce(s.n, 0) + m_s) AS mean_s
  FROM named, priors LEFT JOIN suffixes s ON s.suffix = named.suffix),
shrunk_d AS (
  SELECT x.*, (coalesce(d.bad, 0) + m_d * mean_s) / (coalesce(d.n, 0) + m_d) AS mean_d
  FROM shrunk_s x LEFT JOIN domains d ON d.domain = x.domain AND d.suffix = x.suffix),
shrunk_h AS (
  SELECT x.host, m_h, coalesce(c.n, 0) AS n, (coalesce(c.bad, 0) + m_h * mean_d) / (coalesce(c.n, 0) + m_h) AS mean
  FROM shrunk_d x LEFT JOIN counts c ON c.host = x.host)
SELECT page_id, host, path, {_sql_rule()[0]} AS rule,
  coalesce({_sql_rule()[1]}, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (n + m_h + 1)) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN shrunk_h USING (host)
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][number % 3 + 1] AS weight, 3 * source_size AS cap FROM sources),
filled AS (
  SELECT *, sum(cap) OVER upto - cap AS capped, sum(weight) OVER () - sum(weight) OVER upto + weight AS weights,
         (sum(source_size) OVER ())::BIGINT AS total, row_number() OVER upto AS nth
  FROM weighed WINDOW upto AS (ORDER BY cap::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
share AS (
  SELECT arg_min((total - capped)::DOUBLE / weights::DOUBLE, nth) AS share FROM filled
  WHERE weight * ((total - capped)::DOUBLE / weights::DOUBLE) < cap),
shares AS (SELECT source, source_size, least(cap::DOUBLE, weight * coalesce((SELECT share FROM share), 0.0)) AS target FROM weighed),
placed AS (
  SELECT z.*, source_size, target, round(target)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
  FROM sized z JOIN shares s ON z.source IS NOT DISTINCT FROM s.source),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM whole
"""


@query("op6_url_reputation", OP6_SQL)
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages; a labelled page is bad if it is toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = F.greatest((F.col("toxic") == 1), (F.col("quality") == 0))
    outcomes = pages.join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").select(
        url_reputation.host_of(F.col("url")).alias("host"), bad.alias("bad")
    )
    return url_reputation.judge_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op9_mix_sources", OP9_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents by the weights 5, 2, 1 of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_minhash_dedup")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op5_metric_join")
def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_brown_lm")
def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-model scores of all documents."""
    return brown.score_held_out(table(spark, sf_dir, "documents"))


@query("op2_language_crf")
def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return crf.identify_held_out(table(spark, sf_dir, "documents"))


@query("op13_bpe_codec")
def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts that they decode to, as digests."""
    coded = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"), TOKENIZER), TOKENIZER)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, aligned, with the corpus-wide counts of linked ids."""
    aligned = alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    scored = alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"), TOKENIZER, PIECES)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
