"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bagminhash, bpe, divergence, ego, kernel_lang, line_spread, packing, pii, quality_ordinal, warc, whiten, windows
from .common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, canonical_url, response_page, status and merged headers for the revisit of every page."""
    found = warc.resolve(warc.captures(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(
        F.expr("record_id div 2").alias("page_id"), "canonical_url", F.expr("response_id div 2").alias("response_page"), "status", F.array_join(lines, ";").alias("headers")
    )


OP1_SQL = """
with parts as (
  select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^[hH][tT][tT][pP][sS]?://', '') as bare from pages
  where url is not null and page_id is not null
), split as (
  select page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '(:80|:443)$', ''), '^www[.]', '') as host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*[?](.*)$', 1), '&'),
      lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid)(=|$)'))) as kept from parts
), c as (
  select page_id, md5(html) as tag, strlen(html) as bytes,
    host || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from split
), m as (
  select r.page_id, r.url, r.tag, (select max(f.page_id) from c f where f.url = r.url and f.page_id < r.page_id + 5000) as response from c r
)
select m.page_id, m.url as canonical_url, m.response as response_page,
  case when f.page_id is null then 'no_response' when m.tag is null or f.tag is null then 'unchecked' when m.tag = f.tag then 'resolved' else 'mismatch' end as status,
  case when m.tag is null or f.tag is null or m.tag = f.tag then array_to_string(list_filter([
    'cache-control=no-cache', 'content-length=' || f.bytes, 'content-type=text/html', 'date=' || (m.page_id + 5000),
    'etag=' || coalesce('W/"' || m.tag || '"', '"' || f.tag || '"')], lambda x: x is not null), ';') end as headers
from m left join c f on f.page_id = m.response
"""


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept for every document."""
    ratings = quality_ordinal.graded(_table(spark, sf_dir, "labels"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_ordinal.classify(docs, ratings).select("doc_id", "expected_grade", "tail_probability", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: where it starts, its checksum, its sequence and its place there."""
    import public_tokenizers as tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizers.path("byte_bpe_50k.json"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the rest of the text and the number of lines removed, for every document."""
    docs = _table(spark, sf_dir, "documents")
    return line_spread.deduplicated(docs).select("doc_id", "text", "n_lines_removed")


def op5_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector; cosine 0.9 or more is a link."""
    return ego.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kernel_lang.identify(docs, kernel_lang.train(docs))


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every document."""
    return pii.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and both distances for every document."""
    rows = divergence.judged(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes for every document."""
    import public_tokenizers as tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its near-duplicates), kept for every document."""
    return bagminhash.classes(_table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its tokens, groups and links under two tokenizers, how its links stand corpus-wide, its groups' digest."""
    import public_tokenizers as tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = align.align(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: where it starts, its checksum, its window and its place there."""
    import public_tokenizers as tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return windows.pack(docs, tokenizers.path("byte_bpe_50k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component: its whitened coordinate, exact deviation, and the fit's figures."""
    return whiten.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Sites are counted exactly here; a document's lines are its rows, so removal is an aggregate of those that stay.
OP4_SQL = """
with d as (select doc_id, coalesce(source, '') as site, text, length(text) as size from documents),
l as (select doc_id, site, size, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from d where text is not null),
k as (select *, regexp_matches(line, '[^ \t\x0B\f\r]') as filled, md5(trim(line, ' ' || chr(9) || chr(13))) as key,
  len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) < 5 as short from l),
marks as (select key from k where filled group by key, short having count(distinct site) >= case when short then 10 else 5 end),
m as (select k.*, filled and key in (select key from marks) as marked from k),
pages as (select doc_id, bool_and(marked) filter (where filled) as whole, sum(length(line)) filter (where marked) > 0.5 * min(size) as copied from m group by doc_id having count(*) filter (where marked) > 0),
stands as (select distinct m.key, doc_id, whole from m join pages using (doc_id) where marked and (whole or copied)),
firsts as (select key, arg_min(doc_id, (not whole, doc_id)) as doc_id from stands group by key having not bool_or(whole)),
goes as (select m.doc_id, m.pos from m join pages p on p.doc_id = m.doc_id left join firsts f on f.key = m.key and f.doc_id = m.doc_id where m.marked and not p.whole and f.key is null),
rest as (select l.doc_id, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text, count(g.pos)::int as n from l left join goes g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id)
select d.doc_id, case when n > 0 then rest.text else d.text end as text, coalesce(n, 0)::int as n_lines_removed from d left join rest using (doc_id)
"""


#: Windows are compared by their words; distances are sums over the histograms' places, rounded as the query rounds them.
OP8_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
lists(lang, words) as (values {", ".join(f"('{k}', {list(v)})" for k, v in divergence.COMMON_WORDS.items())}),
c as (select r, doc_id, lang, text, length(text) as n_chars, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
g as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as i from c)),
twice as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n > 1),
repeated as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from twice) group by r),
m as (select c.r, doc_id, c.lang, len(w) as n_words, n_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  n_chars - len(regexp_extract_all(text, '[\\x20\\x09-\\x0D]')) as word_chars, len(regexp_extract_all(text, '\\p{{Ll}}')) as n_lower, len(regexp_extract_all(text, '\\p{{Lu}}')) as n_upper, len(regexp_extract_all(text, '[0-9]')) as n_digit,
  list_transform(words, lambda x: len(list_filter(w, lambda y: lower(y) = x))) as common from c left join repeated using (r) left join lists on lists.lang = c.lang),
places as (select r, lang, 'c' as kind, unnest(range(6)) as pos, unnest([n_chars - word_chars, n_symbols, n_lower, n_upper, n_digit, word_chars - n_symbols - n_lower - n_upper - n_digit]) as v from m
  union all select r, lang, 'w', unnest(range({divergence.N_COMMON + 1})), unnest(list_append(common, n_words - list_sum(common)::bigint)) from m where common is not null),
p as (select r, lang, kind, pos, v / nullif(sum(v) over (partition by r, kind), 0) as p from places),
q as (select lang, kind, pos, v / nullif(sum(v) over (partition by lang, kind), 0) as q from (select lang, kind, pos, sum(v) as v from places group by all)),
j as (select r, kind, sqrt(greatest(0, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2)) as js from p join q using (lang, kind, pos) where p is not null and q is not null group by all),
s as (select m.*, case when n_chars >= {divergence.MIN_CHARS} then a.js end as char_distance, case when n_words >= {divergence.MIN_COMPARED_WORDS} then b.js end as word_distance, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from m left join j a on a.r = m.r and a.kind = 'c' left join j b on b.r = m.r and b.kind = 'w')
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(char_distance > {divergence.MAX_CHAR_DISTANCE}, false) and not coalesce(word_distance > {divergence.MAX_WORD_DISTANCE}, false) as kept, round(char_distance, 9) as char_distance, round(word_distance, 9) as word_distance from s
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_spread": op4_line_spread,
    "op5_ego_join": op5_ego_join,
    "op6_kernel_language": op6_kernel_language,
    "op7_boosted_pii": op7_boosted_pii,
    "op8_divergence": op8_divergence,
    "op9_bpe": op9_bpe,
    "op10_bagminhash": op10_bagminhash,
    "op11_alignment": op11_alignment,
    "op12_window_packing": op12_window_packing,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op4_line_spread": OP4_SQL, "op8_divergence": OP8_SQL}
