"""Queries of the training-data operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens, with_corpus_counts
from .byte_bpe import decode_ids, encode_texts
from .decontaminate import benchmark_leaks
from .fill_in_middle import CHANGED, SEED, SUFFIX_FIRST, TOKEN, fill_in_middle, restored
from .licenses import license_scan
from .line_templates import drop_recurring_lines
from .mixing import mixed, plan_mix
from .quality_model import quality_scores
from .rules import RULES, STOP_WORDS, quality_rules
from .secret_scan import fitted, secret_scan
from .simhash import simhash_groups
from .token_store import token_store
from .warc import parse_warc, resolve_revisits, warc_bytes

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
RANKS = "byte_bpe_50k.tiktoken"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_store(docs, public_tokenizers.path(TOKENIZER), END_ID)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl as WARC bytes: every page's full response, and a day later its revisit with the page's own entity tag.

    The tag is that of the page's title, so a revisit fails where another version of its canonical URL was captured
    between. A null page is an empty one; a null id or URL stays without date or URL.
    """
    html = F.coalesce("html", F.lit(""))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    tag = F.concat(F.lit('"'), F.md5(F.regexp_extract(html, "<title>(.*?)</title>", 1)), F.lit('"'))
    date = lambda days: F.coalesce(
        F.date_format(F.timestamp_seconds(F.lit(1704067200 + 86400 * days) + 60 * F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")
    )
    url = F.coalesce("url", F.lit(""))
    full = warc_bytes(
        F.lit("response"), F.concat(F.lit("<urn:page:"), number, F.lit(":response>")), url, date(0), F.lit("HTTP/1.1 200 OK"),
        F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nCache-Control: max-age=60\r\nETag: "), tag, F.lit("\r\n")), F.encode(html, "UTF-8"), F.lit(None).cast("string"),
    )
    again = warc_bytes(
        F.lit("revisit"), F.concat(F.lit("<urn:page:"), number, F.lit(":revisit>")), url, date(1), F.lit("HTTP/1.1 304 Not Modified"),
        F.concat(F.lit("Cache-Control: max-age=3600\r\nExpires: 0\r\nContent-Length: 0\r\nETag: W/"), tag, F.lit("\r\n")), F.encode(F.lit(""), "UTF-8"),
        F.lit("http://netpreserve.org/warc/1.1/revisit/server-not-modified"),
    )
    return pages.select(F.col("page_id").alias("page_id"), F.concat(full, again).alias("warc"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse_warc(crawl_of(_table(spark, sf_dir, "pages")), "page_id", "warc", with_payload=False)
    page = lambda c: F.regexp_extract(c, "page:(\\d+)", 1)
    return resolve_revisits(records).select(
        F.nullif(page("record_id"), F.lit("")).cast("long").alias("page_id"),
        "canonical",
        "outcome",
        F.nullif(page("refers_to"), F.lit("")).cast("long").alias("refers_to_page"),
        F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("headers"),
        "payload_bytes",
    )


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u,
         md5(regexp_extract(html, '<title>(.*?)</title>', 1)) AS tag FROM p
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS base,
         list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM bare
), c AS (
  SELECT page_id, tag, strlen(html) AS n, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM parts
), latest AS (
  SELECT a.page_id, max(b.page_id) AS hit FROM c a JOIN c b ON a.canonical = b.canonical AND b.page_id < a.page_id + 1440 GROUP BY a.page_id
)
SELECT c.page_id, c.canonical,
       CASE WHEN h.page_id IS NULL THEN 'no_earlier_response' WHEN h.tag = c.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
       CASE WHEN h.tag = c.tag THEN h.page_id END AS refers_to_page,
       CASE WHEN h.tag = c.tag THEN 'cache-control=max-age=3600;content-type=text/html; charset=utf-8;etag=W/"' || c.tag || '";expires=0' END AS headers,
       CASE WHEN h.tag = c.tag THEN h.n END AS payload_bytes
FROM c LEFT JOIN latest l ON c.page_id = l.page_id LEFT JOIN c h ON h.page_id = l.hit
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def _rules_sql() -> str:
    parts = []
    for _, ratio, least, most in RULES:
        over, under = (x.strip() for x in ratio.split("/"))
        value = f"coalesce({over}::DOUBLE / nullif({under}, 0), 0)"
        parts += [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
    return " AND ".join(parts)


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), grams AS (
  SELECT r, i, list_slice(words, i, i + 2) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), marked AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM marked WHERE n > 1) GROUP BY r
), c AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: list_contains(['{"','".join(STOP_WORDS)}'], lower(x)))) AS n_stop_words,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_rules_sql()} AS kept
FROM c
""".replace('","', "','")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixed(plan_mix(_table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"), fitted(spark), path_col="source")


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP10_SQL = r"""
WITH raw AS (
  SELECT doc_id, i, list_extract(l, i) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), spaced AS (
  SELECT doc_id, i, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM raw
), lines AS (
  SELECT doc_id, i, string_split(regexp_replace(s, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS m FROM spaced WHERE s <> ''
), distinct_lines AS (
  SELECT DISTINCT len(m) AS n, list_slice(m, 1, 3) AS lead, m FROM lines
), tokens AS (
  SELECT n, lead, m, p, list_extract(m, p) AS t FROM (SELECT n, lead, m, unnest(range(4, n + 1)) AS p FROM distinct_lines)
), counted AS (
  SELECT n, lead, m, p, t, count(*) OVER (PARTITION BY n, lead, p, t) AS f FROM tokens
), shared AS (
  SELECT m, greatest((n * 70 + 99) // 100 - 3, 0) AS k, list({'p': p, 't': t} ORDER BY f DESC, p) AS many, list({'p': p, 't': t} ORDER BY f, p) AS few
  FROM (SELECT * FROM counted WHERE f > 1) GROUP BY m, n
), ranked AS (
  SELECT d.n, d.lead, d.m, greatest((d.n * 70 + 99) // 100 - 3, 0) AS k, coalesce(many, []) AS many, coalesce(few, []) AS few,
         count(*) OVER (PARTITION BY d.n, d.lead) AS n_leaf FROM distinct_lines d LEFT JOIN shared s ON d.m = s.m
), skeletons AS (
  SELECT n, lead, m, k, list_sort(list_slice(many, 1, k)) AS many, list_sort(list_slice(few, 1, k)) AS few FROM ranked WHERE len(many) >= k AND n_leaf > 1
), templates AS (
  SELECT m, unnest(list_distinct([{'n': n, 'lead': lead, 'parts': many}, {'n': n, 'lead': lead, 'parts': few}])) AS template FROM skeletons WHERE k >= 3
  UNION ALL SELECT m, {'n': n, 'lead': lead, 'parts': many} FROM skeletons WHERE k < 3 QUALIFY count(*) OVER (PARTITION BY n, lead, many) >= 4
), named AS (
  SELECT doc_id, i, {'own': CASE WHEN t.m IS NULL THEN l.m END, 'of': t.template} AS template FROM lines l LEFT JOIN templates t ON l.m = t.m
), seen AS (
  SELECT template, min(doc_id) AS first_id FROM named GROUP BY template HAVING count(DISTINCT doc_id) > 1
), lost AS (
  SELECT DISTINCT doc_id, i FROM named JOIN seen USING (template) WHERE doc_id <> first_id
), kept AS (
  SELECT r.doc_id, count(*) AS n_lines, count(l.i) AS n_dropped,
         coalesce(string_agg(CASE WHEN l.i IS NULL THEN line END, chr(10) ORDER BY r.i), '') AS text
  FROM raw r LEFT JOIN lost l ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY r.doc_id
)
SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars, md5(text) AS text_md5 FROM kept
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path(RANKS)
    decoded = decode_ids(encode_texts(_table(spark, sf_dir, "documents"), file, public_tokenizers.PATTERN), file)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), t AS (
  SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS tokens,
         list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS h FROM d
), f AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {CHANGED} THEN 'plain'
              WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
         least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
         array_to_string(tokens[b + 1:], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = map(public_tokenizers.path, ALIGNED)
    aligned = align_tokens(_table(spark, sf_dir, "documents"), *files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return with_corpus_counts(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_quality_model": op2_quality_model,
        "op3_simhash": op3_simhash,
        "op4_warc_revisits": op4_warc_revisits,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_mixing": op7_mixing,
        "op8_decontaminate": op8_decontaminate,
        "op9_secret_scan": op9_secret_scan,
        "op10_line_templates": op10_line_templates,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_revisits": OP4_SQL, "op6_quality_rules": OP6_SQL, "op10_line_templates": OP10_SQL, "op12_fill_in_middle": OP12_SQL}
