"""The operators of this subpackage over the whole driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import decontamination, filter_audit, line_quality, line_windows, packing, pii, sharding, simhash, spelling, token_counts, toxicity, url_lists, warc_index

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time: each gets one by its number."""
    pages = table(spark, sf_dir, "pages").withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60))
    found = warc_index.archive_and_index(pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "range_no", "range_pos")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"), with_text=False)


def op4_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_severity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listing("base"), 256).alias("base_sha256"), pii.listing("spans").alias("spans"))


def op8_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.cut_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def url_events(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the addresses of ``pages``, so that it grows with them: list_name, kind, entry, action, listed_at.

    By their MD5s an eighth of the hosts is listed as host, as domain or with its parent domain, on one of four
    lists, added, removed and added again; a sixteenth of the addresses is listed for good.
    """
    host = url_lists.url_host(F.col("url"))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    digit = lambda name, at, n: F.conv(F.substring(name, at, n), 16, 10).cast("int")
    start = F.timestamp_seconds(F.lit(1_704_067_200))  # 2024-01-01
    named = pages.select(host.alias("host"), path.alias("path")).dropna()
    hosts = named.select("host").distinct().withColumn("h", F.md5("host")).filter(digit("h", 1, 1) < 2)
    parent = F.when(F.col("host").rlike(r"\..*\."), F.regexp_replace("host", r"^[^.]+\.", "")).otherwise(F.col("host"))
    hosts = hosts.select(
        F.concat(F.lit("list"), digit("h", 3, 1) % 4).alias("list_name"),
        F.when(digit("h", 2, 1) < 6, "host").otherwise("domain").alias("kind"),
        F.when(digit("h", 2, 1) < 12, F.col("host")).otherwise(parent).alias("entry"),
        F.explode(F.expr("array(struct('add' as action, 0 as later), struct('remove' as action, 40 as later), struct('add' as action, 80 as later))")).alias("e"),
        digit("h", 4, 2).alias("day"),
    )
    addresses = named.distinct().withColumn("h", F.md5(F.concat("host", "path"))).filter(digit("h", 1, 1) == 7)
    dated = lambda days: (start + F.make_dt_interval(days)).alias("listed_at")
    return hosts.select("list_name", "kind", "entry", "e.action", dated(F.col("day") + F.col("e.later"))).union(
        addresses.select(F.lit("urls"), F.lit("url"), F.concat("host", "path"), F.lit("add"), dated(digit("h", 2, 2)))
    )


def op10_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time: each gets a day of 2024 by its number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("cast(date_add(date'2024-01-01', cast(page_id % 366 as int)) as timestamp)").alias("fetched_at"))
    return url_lists.filter_urls(pages, url_events(table(spark, sf_dir, "pages")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


_ALL = (
    op1_warc_index, op2_best_fit_packing, op3_line_quality, op4_toxicity_ordinal, op5_benchmark_decontamination, op6_simhash_variants, op7_pii_disclosure,
    op8_bounded_ring_shards, op9_line_windows, op10_url_temporal_lists, op11_spelling_variants, op12_filter_audit, op13_token_counts,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Up to one key range of pages, as the cuts between ranges are taken from a sample.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, 1700000000 + page_id * 60 AS captured_at, split_part(split_part(lower(trim(url)), '#', 1), '://', 2) AS rest FROM pages),
h AS (SELECT *, sha1(html) AS hex, regexp_extract(rest, '^[^/?]*') AS host FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace(host, '^www[.]', ''), '.')), ',') || ')' || CASE WHEN length(rest) > length(host) THEN substr(rest, length(host) + 1) ELSE '/' END AS url_key FROM h),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM k)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < largest THEN largest END AS refers_to,
url_key, captured_at, 0 AS range_no, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS range_pos FROM g
"""

WORD = r"'[^\x20\x09-\x0D]+'"
#: Words and phrases are compared as the operator's, with word ends of ASCII letters.
_SEPARATORS = ", ".join(f"'{x.decode()}'" for x in sorted(line_quality.SEPARATORS))
_PHRASES = r"(?i)\b(?:" + "|".join(line_quality.BOILERPLATE) + r")\b|[{}©]+"
_ENDS = "".join(f"\\x{{{ord(c):X}}}" for c in line_quality.ENDS)
_SHARE = "100 * len(list_filter(ws, lambda x: {})) > {} * n".format
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, regexp_extract_all(t, {WORD}) AS ws FROM d),
l AS (SELECT row, line, ws, len(ws) AS n FROM (SELECT row, line, regexp_extract_all(line, {WORD}) AS ws FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d))),
j AS (SELECT row, line, n, CASE WHEN n = 0 THEN false WHEN {_SHARE(f"x IN ({_SEPARATORS})", line_quality.MAX_SEPARATORS)} THEN true
WHEN n <= {line_quality.NAVIGATION_WORDS} AND length(array_to_string(ws, '')) <= {line_quality.NAVIGATION_LETTERS} AND NOT regexp_matches(ws[-1], '[{_ENDS}][\\"''”’»)\\]」』]*$') THEN true
WHEN {_SHARE("suffix(x, '!!')", line_quality.MAX_BANG_WORDS)} OR {_SHARE("contains('#*$%&|<>', x[-1])", line_quality.MAX_SYMBOL_WORDS)} THEN true
WHEN n >= 5 AND {_SHARE(r"length(x) > 1 AND regexp_matches(x, '[[:upper:]]|\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}')", line_quality.MAX_UPPER_WORDS)} THEN true
ELSE 100 * coalesce(list_sum(list_transform(regexp_extract_all(line, '{_PHRASES}'), lambda m: len(string_split(m, ' ')))), 0) >= {line_quality.MIN_BOILERPLATE_WORDS} * n AND n > 0 END AS bad FROM l),
b AS (SELECT row, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, count(*) FILTER (bad) AS lines_gone, coalesce(sum(n) FILTER (bad), 0) AS words_gone FROM j GROUP BY row),
g AS (SELECT row, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS gram FROM w, unnest(range(1, len(ws) - 1)) u(k)),
c AS (SELECT row, k FROM (SELECT *, count(*) OVER (PARTITION BY row, gram) AS times FROM g) WHERE times > 1),
r AS (SELECT row, count(DISTINCT k + i) AS repeats FROM c, unnest(range(3)) u(i) GROUP BY row),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
coalesce(repeats, 0)::BIGINT AS n_repeat_words, lines_gone::BIGINT AS n_lines_removed, words_gone::BIGINT AS n_words_removed FROM d JOIN w USING (row) JOIN b USING (row) LEFT JOIN r USING (row)),
v AS (SELECT *, n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > {line_quality.MAX_REPEATED} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * n_words_removed <= {line_quality.MAX_LOST} * n_words AS kept FROM v
"""

FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS ws FROM documents), i AS (SELECT item_id, {FOLDED} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + 9], ' ') AS g FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(k) WHERE len(ws) > 0),
s AS (SELECT DISTINCT n FROM w),
f AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT * FROM d, s) x, unnest(range(1, len(ws) - n + 2)) t(k)),
h AS (SELECT DISTINCT doc_id, k, n, item_id FROM f JOIN w USING (g, n)),
a AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM h, unnest(range(n)) t(j) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, k, ls[k] AS line, trim(regexp_replace(lower(ls[k]), '\\s+', ' ', 'g')) AS n FROM d, unnest(range(1, len(ls) + 1)) t(k)),
w AS (SELECT doc_id, k, n || chr(10) || lead(n) OVER o || chr(10) || lead(n, 2) OVER o AS win FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS rn FROM w WHERE win IS NOT NULL AND win <> chr(10) || chr(10)),
c AS (SELECT DISTINCT doc_id, k + j AS k, true AS cut FROM r, (VALUES (0), (1), (2)) x(j) WHERE rn > 1)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (cut IS NULL), '') AS text, count(*)::BIGINT AS n_lines, count(cut)::BIGINT AS n_cut FROM l LEFT JOIN c USING (doc_id, k) GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""

OP10_SQL = """
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id % 366)::INT) AS f, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]$', '') AS named,
nullif(named, '') AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hs AS (SELECT host, md5(host) AS h FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL) WHERE ('0x' || substr(md5(host), 1, 1))::INT < 2),
us AS (SELECT host || path AS entry, md5(host || path) AS h FROM (SELECT DISTINCT host, path FROM p WHERE host IS NOT NULL) WHERE substr(md5(host || path), 1, 1) = '7'),
e AS (SELECT DISTINCT 'list' || (('0x' || substr(h, 3, 1))::INT % 4) AS list_name, CASE WHEN ('0x' || substr(h, 2, 1))::INT < 6 THEN 'host:' ELSE 'domain:' END
|| CASE WHEN ('0x' || substr(h, 2, 1))::INT >= 12 AND len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]+[.]', '') ELSE host END AS key,
action, TIMESTAMP '2024-01-01' + to_days((('0x' || substr(h, 4, 2))::INT + later)::INT) AS t FROM hs, (VALUES ('add', 0), ('remove', 40), ('add', 80)) x(action, later)
UNION ALL SELECT 'urls', 'url:' || entry, 'add', TIMESTAMP '2024-01-01' + to_days(('0x' || substr(h, 2, 2))::INT) FROM us),
i AS (SELECT *, lead(t) OVER (PARTITION BY list_name, key ORDER BY t, action) AS until FROM e),
v AS (SELECT * FROM i WHERE action = 'add' AND (until IS NULL OR until > t)),
k AS (SELECT page_id, f, unnest(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: 'domain:' || array_to_string(string_split(host, '.')[n:], '.')), ['host:' || host, 'url:' || host || path])) AS key FROM p),
m AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(list_name))), ',') AS names FROM k JOIN v USING (key) WHERE t <= f AND (until IS NULL OR f < until) GROUP BY page_id)
SELECT page_id, host, coalesce(n, 0)::BIGINT AS n_entries, coalesce(names, '') AS lists, n IS NOT NULL AS blocked FROM p LEFT JOIN m USING (page_id)
"""

#: Counts of each combination of failures, then each order and step over them.
OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
+ 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS fails FROM w),
b AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS goods, count(*) FILTER (toxic) AS toxics FROM f LEFT JOIN b USING (doc_id) GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit,
unnest([0, a.bit, a.bit | b.bit, a.bit | b.bit | c.bit, 31 - e.bit]) AS before FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (before | bit) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & bit > 0) AS removed, sum(n) FILTER (fails & before > 0 AND fails & bit > 0) AS redundant,
sum(n) FILTER (fails = bit) AS unique_fails, sum(goods) FILTER (fails & before = 0 AND fails & bit > 0) AS good_lost, sum(toxics) FILTER (fails & before = 0 AND fails & bit > 0) AS toxic_lost FROM c, o GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM s
"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": OP1_SQL,
    "op3_line_quality": OP3_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
    "op9_line_windows": OP9_SQL,
    "op10_url_temporal_lists": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
}
