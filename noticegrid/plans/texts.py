"""Text queries over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions import text
from noticegrid.operators import relevance
from noticegrid.plans.registry import query
from noticegrid.plans.views import DOCUMENT_NOTICES, with_views
from noticegrid.sources import tables as T

# A country made of frequent corpus words, so that matching has work to do.
CORPUS_COUNTRY = S.CountryTerms(
    latin=("wher", "thend", "quent", "keiten", "para ción", "example"), substrings=("ürün", "ößig"),
    tld=".com",
)
W = r"[\p{L}\p{N}_]"
_CLEAN = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"


@query("text_clean_digits", rf"""
SELECT doc_id, {_CLEAN} AS cleaned,
       translate(translate(CAST(doc_id AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩'), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS digits
FROM documents""")
def text_clean_digits(spark, sf_dir):
    docs = T.heavy(spark, sf_dir, "documents")
    arabic = F.translate(F.col("doc_id").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return docs.select(
        "doc_id", text.clean(F.col("text")).alias("cleaned"), text.ascii_digits(arabic).alias("digits")
    )


@query("text_language_share", rf"""
SELECT doc_id, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
       round(CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 THEN
         length(regexp_replace(text, '[^äöüßéèêçàñóí]', '', 'g')) * 1e0
         / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) ELSE 0e0 END, 6) AS accented_share,
       'en' AS language
FROM documents""")
def text_language_share(spark, sf_dir):
    docs = T.heavy(spark, sf_dir, "documents")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    accented = F.length(F.regexp_replace("text", "[^äöüßéèêçàñóí]", ""))
    return docs.select(
        "doc_id", letters.alias("letters"),
        F.round(F.when(letters > 0, accented / letters).otherwise(F.lit(0.0)), 6).alias("accented_share"),
        text.language(F.col("text")).alias("language"),
    )


@query("text_arabic", r"""
WITH t AS (SELECT o_orderkey, 'Clerk ' || o_orderpriority || repeat(' ماء', CAST(o_orderkey % 5 AS INTEGER)) AS body FROM orders),
n AS (SELECT *, length(regexp_replace(body, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(body, '[^ماء]', '', 'g')) AS arabic FROM t)
SELECT o_orderkey, round(arabic * 1e0 / letters, 6) AS share, CASE WHEN arabic * 1e0 / letters >= 0.2e0 THEN 'ar' ELSE 'en' END AS language FROM n""")
def text_arabic(spark, sf_dir):
    word = F.expr("repeat(' ماء', cast(o_orderkey % 5 as int))")
    body = F.concat(F.lit("Clerk "), "o_orderpriority", word)
    return T.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(text.arabic_share(body), 6).alias("share"), text.language(body).alias("language"))


@query("text_truncate", rf"""
SELECT doc_id, CASE WHEN length(c) <= 120 THEN c
  ELSE regexp_replace(substr(c, 1, 120), ' [^ ]*$', '') || ' …' END AS teaser
FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)""")
def text_truncate(spark, sf_dir):
    return T.heavy(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 120).alias("teaser"))


_UNTAGGED = (
    r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<[a-z/!?](?:\"[^\"]*\"|''[^'']*''|[^''\">])*>', ' ', 'g')"
).replace('\\"', '"')
_READABLE = (
    r"trim(regexp_replace(replace(replace(replace(replace(" + _UNTAGGED
    + ''', '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[\\s\\p{Z}]+', ' ', 'g'))'''
)


@query("html_to_text", f"""
SELECT page_id, {_READABLE} AS readable, length({_READABLE}) AS n FROM pages""")
def html_to_text(spark, sf_dir):
    pages = T.heavy(spark, sf_dir, "pages")
    shown = pages.select("page_id", text.strip_markup(F.col("html")).alias("readable"))
    return shown.withColumn("n", F.length("readable"))


_TERMS = "wher|thend|quent|keiten|para ción|example"
_DOMAIN = r"""(regexp_matches(t, '(?i)://[^/\s]*\.com(?:[/:\s]|$)')
     OR (regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])[\p{L}\p{N}_-]+\.com([^\p{L}\p{N}_]|$)')
         AND NOT contains(right(string_split(t, '.com')[1], 40), '@')))"""
_MATCH = rf"""
, blobs AS (SELECT id, portal, {_CLEAN.replace('text', "concat_ws(' ', title, description, eligibility)")} AS t0, url FROM doc_notices),
  joined AS (SELECT id, portal, t0 || ' ' || url AS t FROM blobs),
  matched AS (SELECT id, portal, {_DOMAIN}
     OR regexp_matches(lower(regexp_replace(t, '{W[:-1]}.+-]+@{W[:-1]}-]+(?:\.{W[:-1]}-]+)+', ' ', 'g')),
          '(^|[^\p{{L}}\p{{N}}_])({_TERMS})([^\p{{L}}\p{{N}}_]|$)')
     OR contains(t, 'ürün') OR contains(t, 'ößig') AS hit FROM joined)"""


@query("relevance_match", with_views(DOCUMENT_NOTICES, body=_MATCH + """
SELECT id, hit FROM matched"""))
def relevance_match(spark, sf_dir):
    notices = T.notices_from_documents(spark, sf_dir)
    return notices.select("id", relevance.text_match(CORPUS_COUNTRY).alias("hit"))


@query("relevance_scanned", with_views(DOCUMENT_NOTICES, body=_MATCH + """
SELECT portal, count(*) AS scanned, count(*) FILTER (WHERE hit) AS relevant FROM matched GROUP BY portal"""))
def relevance_scanned(spark, sf_dir):
    notices = T.notices_from_documents(spark, sf_dir)
    scanned = relevance.scanned_counts(notices)
    kept = relevance.relevant(notices, CORPUS_COUNTRY).groupBy("portal").agg(F.count("*").alias("relevant"))
    return scanned.join(kept, "portal", "left").select(
        "portal", "scanned", F.coalesce("relevant", F.lit(0)).alias("relevant")
    )


_VERDICT_TERMS = S.CountryTerms(latin=("france", "jordan", "united"), substrings=(), codes=("fra", "jo"), tld=None)


@query("relevance_verdict", r"""
WITH c AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN n_name END AS country,
         CASE WHEN c_custkey % 4 = 0 THEN substr(n_name, 1, 3) END AS code,
         CASE WHEN c_custkey % 2 = 0 THEN n_name || ' – ' || c_name ELSE c_name || ' in ' || n_name END AS title
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), v AS (
  SELECT *, coalesce(
      CASE WHEN country IS NOT NULL THEN regexp_matches(lower(country), '(^|[^a-z])(france|jordan|united)([^a-z]|$)') END,
      CASE WHEN code IS NOT NULL THEN lower(code) IN ('fra', 'jo')
           OR regexp_matches(lower(code), '(^|[^a-z])(france|jordan|united)([^a-z]|$)') END,
      CASE WHEN c_custkey % 2 = 0 AND regexp_matches(n, '^[^0-9–—|/]{3,28}$')
           AND NOT regexp_matches(lower(n), '(^|[^a-z])(france|jordan|united)([^a-z]|$)') THEN false END) AS verdict
  FROM (SELECT c.*, trim(split_part(title, ' – ', 1)) AS n FROM c)
)
SELECT c_custkey, CASE WHEN verdict IS NULL THEN 'unknown' WHEN verdict THEN 'yes' ELSE 'no' END AS verdict,
       coalesce(verdict, regexp_matches(lower(title), '(^|[^a-z])(france|jordan|united)([^a-z]|$)')) AS keep
FROM v""")
def relevance_verdict(spark, sf_dir):
    nation = T.table(spark, sf_dir, "nation")
    customer = T.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name, nation_name = F.col("c_name"), F.col("n_name")
    rows = customer.select(
        "c_custkey",
        F.when(T.every("c_custkey", 3), nation_name).alias("country"),
        F.when(T.every("c_custkey", 4), F.substring(nation_name, 1, 3)).alias("code"),
        F.when(T.every("c_custkey", 2), F.concat(nation_name, F.lit(" – "), name))
        .otherwise(F.concat(name, F.lit(" in "), nation_name)).alias("title"),
    )
    verdict = F.coalesce(
        relevance.field_verdict(_VERDICT_TERMS, F.col("country")),
        relevance.code_verdict(_VERDICT_TERMS, F.col("code")),
        relevance.title_prefix_verdict(_VERDICT_TERMS, F.col("title")),
    )
    rows = rows.withColumn("v", verdict)
    keep = F.coalesce("v", text.mentions_country(_VERDICT_TERMS, F.col("title")))
    label = F.when(F.col("v").isNull(), "unknown").when(F.col("v"), "yes").otherwise("no")
    return rows.select("c_custkey", label.alias("verdict"), keep.alias("keep"))


def _sector_sql(blob):
    arms = []
    for rank, (label, terms) in enumerate(S.SECTOR_LEXICON.items()):
        score = " + ".join(f"contains({blob}, '{t}')::INT" for t in terms)
        arms.append(f"SELECT doc_id, '{label}' AS label, {rank} AS r, {score} AS n FROM b")
    return " UNION ALL ".join(arms)


@query("sector_label", rf"""
WITH b AS (SELECT doc_id, lower({_CLEAN}) AS t FROM documents),
scores AS ({_sector_sql('t')})
SELECT doc_id, coalesce(arg_min(CASE WHEN n > 0 THEN label END, (-n, r)) FILTER (WHERE n > 0), 'Unclassified') AS sector
FROM scores GROUP BY doc_id""")
def sector_label(spark, sf_dir):
    docs = T.heavy(spark, sf_dir, "documents")
    return docs.select("doc_id", text.sector(text.clean(F.col("text"))).alias("sector"))


_MARKERS = tuple(S.RESTRICTION_MARKERS) + ("that the", "de la", "nicht ein")


@query("restriction_marker", rf"""
SELECT doc_id, {' OR '.join(f"contains(t, '{m}')" for m in _MARKERS)} AS restricted
FROM (SELECT doc_id, lower({_CLEAN}) AS t FROM documents)""")
def restriction_marker(spark, sf_dir):
    docs = T.heavy(spark, sf_dir, "documents")
    return docs.select("doc_id", text.restricted(text.clean(F.col("text")), _MARKERS).alias("restricted"))
