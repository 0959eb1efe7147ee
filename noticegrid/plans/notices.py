"""Notice queries: filters, scores, ranking, report and dedupe."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions import money
from noticegrid.operators import dedupe, filters, health, normalise, report, run, score, state
from noticegrid.plans.registry import query
from noticegrid.plans.views import ALIKE, DOCUMENT_NOTICES, MERGED, NOTICES, with_steps, with_views
from noticegrid.session import cut_lineage, scratch_folder
from noticegrid.sources import feeds, registry, sinks
from noticegrid.sources import tables as T

POLICY = S.FilterPolicy()
SCORING = S.ScorePolicy()
RUN = T.ORDERS_RUN_DATE
# Frequent words of the given documents, so that lexicon matching has work to do.
CORPUS_SCORING = S.ScorePolicy(
    ranking_terms=tuple(S.RANKING_LEXICON) + ("from", "this", "that", "with", "avec", "nicht", "para", "of the", "and the"),
    penalty_terms=tuple(S.PENALTY_LEXICON) + ("to be", "dans la"),
)
CORPUS_POLICY = S.FilterPolicy(
    keywords=("from", "avec", "nicht", "para", "of the"), notice_types=("notice", "award"),
    language_mode="english_only", eligibility_mode="exclude", lookback_days=40,
    sectors=(S.UNCLASSIFIED,),
)


def judged_orders(spark, sf_dir):
    return filters.judge(T.notices_from_orders(spark, sf_dir), POLICY, RUN)


def scored_orders(spark, sf_dir):
    kept = filters.survivors(judged_orders(spark, sf_dir))
    return score.score(kept, POLICY, SCORING, RUN)


@query("notice_filter_reasons", with_views(NOTICES, body="""
SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY 1"""))
def notice_filter_reasons(spark, sf_dir):
    return filters.reason_counts(judged_orders(spark, sf_dir))


@query("notice_drop_sentence", with_views(NOTICES, body="""
SELECT string_agg(n || ' ' || drop_reason, ', ' ORDER BY drop_reason) AS filtered_out
FROM (SELECT drop_reason, count(*) AS n FROM reasoned WHERE drop_reason IS NOT NULL GROUP BY 1)"""))
def notice_drop_sentence(spark, sf_dir):
    return report.dropped_sentence(filters.reason_counts(judged_orders(spark, sf_dir)))


_PRE, _POST = S.FLAG_IMPLAUSIBLE.replace("'", "''").split("{value}")


@query("notice_flags", with_views(NOTICES, body=f"""
SELECT id, concat_ws('; ',
    CASE WHEN raw_value IS NOT NULL AND value IS NULL
         THEN '{_PRE}USD ' || format('{{:,}}', CAST(round_even(raw_value, 0) AS BIGINT)) || '{_POST}' END,
    CASE WHEN closing_date IS NULL THEN '{S.FLAG_NO_DEADLINE}' END,
    CASE WHEN raw_value IS NULL THEN '{S.FLAG_NO_VALUE}' END,
    CASE WHEN language = 'ar' THEN '{S.FLAG_ARABIC}' END,
    eligibility) AS flags
FROM reasoned WHERE drop_reason IS NULL"""))
def notice_flags(spark, sf_dir):
    kept = filters.survivors(judged_orders(spark, sf_dir))
    return kept.select("id", F.concat_ws("; ", "flags").alias("flags"))


_WORDS = r"(^|[^\p{L}\p{N}_])(from|avec|nicht|para)([^\p{L}\p{N}_]|$)"


@query("notice_filter_optional", with_views(DOCUMENT_NOTICES, body=rf"""
SELECT coalesce(CASE
    WHEN DATE '2026-06-15' - posted_date > 90 THEN 'undated and published over 90 days ago'
    WHEN DATE '2026-06-15' - posted_date > 40 THEN 'outside lookback window'
    WHEN NOT (regexp_matches(lower(title || ' ' || description), '{_WORDS}')
              OR contains(lower(regexp_replace(title || ' ' || description, '\s+', ' ', 'g')), 'of the'))
      THEN 'no keyword match'
    WHEN NOT contains(lower(coalesce(notice_type, '')), 'notice')
         AND NOT contains(lower(coalesce(notice_type, '')), 'award') THEN 'notice type not targeted'
    WHEN language = 'ar' THEN 'language excluded'
    WHEN eligibility IS NOT NULL THEN 'eligibility restricted' END, 'kept') AS reason,
  count(*) AS n
FROM doc_notices GROUP BY 1"""))
def notice_filter_optional(spark, sf_dir):
    notices = T.notices_from_documents(spark, sf_dir)
    return filters.reason_counts(filters.judge(notices, CORPUS_POLICY, T.DOCUMENTS_RUN_DATE))


@query("notice_score", with_views(NOTICES, body="""
SELECT id, score, round(value_part, 3) AS value_part, round(runway_part, 3) AS urgency_part FROM scored"""))
def notice_score(spark, sf_dir):
    return scored_orders(spark, sf_dir).select(
        "id", "score", F.col("components")["value"].alias("value_part"),
        F.col("components")["urgency"].alias("urgency_part"),
    )


_SECTOR_POLICY = S.FilterPolicy(sectors=("BUILDING", "MACHINERY"), undated_days=None)


@query("notice_score_sectors", with_views(NOTICES, body="""
SELECT id, round(greatest(0e0, least(4e1 * 0e0
      + 3e1 * CASE WHEN sector IN ('BUILDING', 'MACHINERY') THEN 1e0 ELSE 0e0 END
      + 1.5e1 * v + 1.5e1 * r
      - CASE WHEN eligibility IS NOT NULL THEN 25e0 ELSE 0e0 END, 1e2)), 1) AS score
FROM (SELECT *, CASE WHEN value IS NULL THEN 0.55e0 WHEN value <= 1e5 THEN 0.35e0
         ELSE least(0.35e0 + 0.65e0 * ((value - 1e5) / 4.9e6), 1e0) END AS v,
    CASE WHEN closing_date IS NULL THEN 0.5e0 WHEN closing_date - run_date <= 5 THEN 0.15e0
         WHEN closing_date - run_date <= 12 THEN 0.5e0 WHEN closing_date - run_date <= 30 THEN 1e0
         WHEN closing_date - run_date <= 75 THEN 0.85e0 ELSE 0.6e0 END AS r
  FROM judged
  WHERE (closing_date IS NULL OR closing_date >= run_date) AND (value IS NULL OR value >= 1e5)
    AND sector IN ('BUILDING', 'MACHINERY'))"""))
def notice_score_sectors(spark, sf_dir):
    judged = filters.judge(T.notices_from_orders(spark, sf_dir), _SECTOR_POLICY, RUN)
    scored = score.score(filters.survivors(judged), _SECTOR_POLICY, SCORING, RUN)
    return scored.select("id", "score")


def _sql_list(terms):
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _hits_sql(text, terms):
    from noticegrid.functions.text import is_substring_term

    words = [t for t in terms if not is_substring_term(t)]
    phrases = [t for t in terms if is_substring_term(t)]
    return (
        rf"list_concat(list_filter({_sql_list(words)}, lambda t: list_contains(string_split_regex({text}, '[^\p{{L}}\p{{N}}_]+'), t)),"
        f" list_filter({_sql_list(phrases)}, lambda t: contains({text}, t)))"
    )


@query("notice_keyword_score", with_views(DOCUMENT_NOTICES, body=rf"""
, cleaned AS (
  SELECT id, lower(trim(regexp_replace(title || ' ' || description, '[\s\p{{Z}}]+', ' ', 'g'))) AS blob,
         lower(trim(regexp_replace(title, '[\s\p{{Z}}]+', ' ', 'g'))) AS head FROM doc_notices
), hits AS (
  SELECT id, {_hits_sql('blob', CORPUS_SCORING.ranking_terms)} AS h,
         {_hits_sql('head', CORPUS_SCORING.ranking_terms)} AS th,
         {_hits_sql('blob', CORPUS_SCORING.penalty_terms)} AS p FROM cleaned
)
SELECT id, len(h) AS n_hits, len(th) AS n_title_hits,
  array_to_string(list_sort(h), ',') AS keyword_hits,
  round((0.7e0 * least(len(h) / 5e0, 1e0) + 0.3e0 * least(len(th) / 2e0, 1e0))
        * CASE WHEN len(p) > 0 THEN 0.55e0 ELSE 1e0 END, 6) AS keyword_part
FROM hits"""))
def notice_keyword_score(spark, sf_dir):
    scored = score.keyword_columns(T.notices_from_documents(spark, sf_dir), CORPUS_SCORING)
    return scored.select(
        "id", "n_hits", "n_title_hits", F.array_join("keyword_hits", ",").alias("keyword_hits"),
        F.round("keyword_part", 6).alias("keyword_part"),
    )


@query("notice_rank_sections", with_views(NOTICES, body="""
SELECT id, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS band,
       CASE WHEN rn <= 50 THEN rn END AS position,
       CASE WHEN rn <= 50 THEN 'inline' ELSE 'overflow' END AS section
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, closing_date ASC NULLS LAST, id) AS rn FROM scored)"""))
def notice_rank_sections(spark, sf_dir):
    marked = report.sections(scored_orders(spark, sf_dir))
    return marked.select("id", "score", score.band(F.col("score")).alias("band"), "position", "section")


_LAYOUT = f"""
SELECT score AS "Score", title AS "Title", portal AS "Portal", notice_type AS "Notice type",
       sector AS "Sector", CAST(posted_date AS VARCHAR) AS "Published",
       CAST(closing_date AS VARCHAR) AS "Deadline", left_days AS "Days left",
       CASE WHEN value IS NULL THEN 'Not published'
            WHEN value >= 1e6 THEN 'US$ ' || format('{{:,.2f}}', value / 1e6) || 'm'
            ELSE 'US$ ' || format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) END AS "Estimated value",
       language AS "Language", eligibility AS "Eligibility", contact AS "Contact", url AS "Link" """


@query("notice_report_layout", with_views(NOTICES, body=_LAYOUT + "\nFROM scored"))
def notice_report_layout(spark, sf_dir):
    layout = report.export_layout(report.decorate(scored_orders(spark, sf_dir), RUN))
    return layout.drop("Flags").withColumns({
        "Published": F.col("Published").cast("string"), "Deadline": F.col("Deadline").cast("string"),
    })


@query("notice_filter_language", with_views(NOTICES, body="""
SELECT coalesce(drop_reason, CASE WHEN language = 'ar' THEN 'language excluded' END, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY 1"""))
def notice_filter_language(spark, sf_dir):
    policy = S.FilterPolicy(language_mode="english_only")
    return filters.reason_counts(filters.judge(T.notices_from_orders(spark, sf_dir), policy, RUN))


# ------------------------------------------------------------------------------ sinks

_SOURCES = ",".join(key for key, _, _ in S.SOURCES)


def _export(df, name):
    shown = df.drop("Flags").withColumns({c: F.col(c).cast("string") for c in ("Published", "Deadline")})
    return shown.withColumns({"Score": F.col("Score").cast("double"), "Days left": F.col("Days left").cast("int"), "format": F.lit(name)})


@query("sink_round_trip", with_views(NOTICES, body=_LAYOUT + ", format\nFROM scored, (VALUES ('csv'), ('json'), ('parquet')) f(format)"))
def sink_round_trip(spark, sf_dir):
    """The report in every format, written and read back; a name nobody knows is skipped."""
    shown = report.decorate(scored_orders(spark, sf_dir), RUN)
    folder = scratch_folder(spark, "sinks")
    written = sinks.write_outputs(shown, folder, ("csv", "json", "unknown", "parquet"))
    back = {
        "csv": spark.read.option("header", True).csv(written["csv"]),
        "json": report.export_layout(spark.read.schema(shown.schema).json(f"{written['json']}/tenders")),
        "parquet": report.export_layout(spark.read.parquet(written["parquet"])),
    }
    first, *rest = (_export(df, name) for name, df in back.items())
    for df in rest:
        first = first.unionByName(df)
    return first


@query("sink_envelope", with_views(NOTICES, body=f"""
SELECT count(*) AS tender_count, '1998-06-15' AS generated_at, '{_SOURCES}' AS portals,
       'run=19980615_' || count(*) || CASE WHEN count(*) = 1 THEN '-opportunity' ELSE '-opportunities' END AS folder FROM scored"""))
def sink_envelope(spark, sf_dir):
    """The envelope line of the JSON output, below a folder that names the state of the run."""
    shown = report.decorate(scored_orders(spark, sf_dir), RUN)
    sources = registry.source_table(spark)
    outcome = sources.select("key", "rank", F.lit(1).alias("scanned"), F.lit(1).alias("count"), F.lit(None).cast("string").alias("reason"))
    reported = shown.agg(F.count("*").alias("reported"))
    slug = health.run_status(health.source_health(outcome), reported).first()["slug"]
    folder = sinks.run_folder(scratch_folder(spark, "runs"), "19980615", slug)
    sinks.write_json(shown, folder, sources, "1998-06-15")
    return spark.read.json(f"{folder}/envelope").select(
        "tender_count", "generated_at", F.array_join("portals.key", ",").alias("portals"), F.lit(folder.rsplit("/", 1)[1]).alias("folder"))


@query("feed_entries", """
SELECT 'Notice & call ' || o_orderkey AS title, 'https://f.example/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS posted, CASE WHEN o_orderkey % 5 <> 0 THEN 'by ' || o_orderpriority END AS description
FROM orders WHERE o_orderkey % 11 <> 0""")
def feed_entries(spark, sf_dir):
    """Orders as the RSS items or Atom entries of a feed per customer; entries without a title go."""
    orders = T.table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    day = F.when(~T.every("o_orderkey", 3), F.date_format("o_orderdate", "yyyy-MM-dd"))
    by = F.when(~T.every("o_orderkey", 5), F.concat(F.lit("by "), "o_orderpriority"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))
    title = F.when(~T.every("o_orderkey", 11), F.concat(F.lit("Notice &amp; call "), "k"))
    link = F.concat(F.lit("https://f.example/"), "k")
    rss = F.concat(F.lit("<item>"), tag("title", title), F.when(T.every("o_orderkey", 4), tag("guid", link)).otherwise(tag("link", link)),
                   tag("pubDate", day), tag("description", by), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), tag("title", title), F.lit('<link href="'), link, F.lit('"/>'), tag("updated", day), tag("summary", by), F.lit("</entry>"))
    entry = F.when(T.every("o_custkey", 2), rss).otherwise(atom)
    feed = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), "").alias("body"))
    even = T.every("o_custkey", 2)
    wrapped = F.when(even, F.concat(F.lit("<rss><channel><title>All</title>"), "body", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<feed><title>All</title>"), "body", F.lit("</feed>")))
    landed = feed.select("o_custkey", wrapped.alias("payload"))
    return feeds.landed_rss(landed.where(even)).unionByName(feeds.landed_atom(landed.where(~even)))


@query("notice_ids", """
SELECT CAST(o_orderkey AS VARCHAR) AS reference,
       o_orderpriority || '-' || substr(sha256(o_orderpriority || '|' || o_orderkey), 1, 16) AS id,
       o_orderpriority || '-' || substr(sha256(o_orderpriority || '|' || o_orderstatus), 1, 16) AS title_id
FROM orders""")
def notice_ids(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    ref = F.col("o_orderkey").cast("string")
    none = F.lit(None).cast("string")
    portal, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.select(
        ref.alias("reference"),
        normalise.notice_id(portal, ref, none, status).alias("id"),
        normalise.notice_id(portal, none, none, status).alias("title_id"),
    )


# ------------------------------------------------------------------------------ state


@query("new_only", with_views(NOTICES, body="""
SELECT id, score FROM scored
WHERE id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')"""))
def new_only(spark, sf_dir):
    fresh = state.only_new(scored_orders(spark, sf_dir), T.seen_from_orders(spark, sf_dir))
    return fresh.select("id", "score")


@query("seen_upsert", with_views(NOTICES, body="""
, seen AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS at
           FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(s.id, n.id) AS id, CAST(coalesce(s.at, n.run_date) AS VARCHAR) AS first_seen,
       CAST(CASE WHEN n.id IS NULL THEN s.at ELSE greatest(s.at, n.run_date) END AS VARCHAR) AS last_seen,
       CASE WHEN s.id IS NULL THEN n.title ELSE s.id END AS title
FROM seen s FULL JOIN scored n ON s.id = n.id"""))
def seen_upsert(spark, sf_dir):
    merged = state.upsert_seen(T.seen_from_orders(spark, sf_dir), scored_orders(spark, sf_dir), RUN)
    return merged.select(
        "id", F.col("first_seen").cast("date").cast("string").alias("first_seen"),
        F.col("last_seen").cast("date").cast("string").alias("last_seen"), "title",
    )


RUN_POLICY = S.FilterPolicy(lookback_days=40, eligibility_mode="exclude")


@query("run_log", with_steps(DOCUMENT_NOTICES.replace("doc_notices AS", "all_notices AS"), """
doc_notices AS (SELECT * FROM all_notices WHERE DATE '2026-06-15' - posted_date <= 40 AND eligibility IS NULL)""", ALIKE, MERGED, body="""
, heads AS (SELECT unnest(list_transform(kept, lambda k: k.ord)) AS ord FROM (SELECT kept FROM taken ORDER BY step DESC LIMIT 1))
SELECT (SELECT count(*) FROM all_notices) AS scanned, (SELECT count(*) FROM doc_notices) AS passed,
  (SELECT count(*) FROM doc_notices) - (SELECT count(*) FROM heads) AS merged,
  (SELECT count(*) FROM heads JOIN placed USING (ord) WHERE id NOT IN (SELECT 'doc-' || doc_id FROM labels WHERE quality = 0)) AS new,
  (SELECT count(*) FROM all_notices WHERE DATE '2026-06-15' - posted_date > 40) AS outside,
  (SELECT count(*) FROM all_notices WHERE DATE '2026-06-15' - posted_date <= 40 AND eligibility IS NOT NULL) AS restricted"""))
def run_log(spark, sf_dir):
    """A run over all documents; those of low quality were reported before."""
    policy, day = RUN_POLICY, T.DOCUMENTS_RUN_DATE
    judged = filters.judge(T.notices_from_documents(spark, sf_dir), policy, day)
    low = T.table(spark, sf_dir, "labels").where(F.col("quality") == 0)
    seen = low.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"))
    done = run.run(judged, [name for _, name in filters.drop_tests(policy, day)], lambda df: df.withColumn("score", F.lit(50.0)),
                   seen, scratch_folder(spark, "run"))
    dropped = lambda name: F.coalesce(F.try_element_at("dropped", F.lit(name)), F.lit(0)).cast("long")
    return done.summary().select("scanned", "passed", "merged", "new", dropped("outside lookback window").alias("outside"),
                                 dropped("eligibility restricted").alias("restricted"))


@query("state_batches", with_views(NOTICES, body="""
SELECT id, strftime(run_date + CAST(CAST(id AS BIGINT) % 5 AS INTEGER), '%Y-%m-%d') AS first_seen,
       strftime(run_date + CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 9 ELSE CAST(CAST(id AS BIGINT) % 5 AS INTEGER) END, '%Y-%m-%d') AS last_seen,
       title, 1 AS delivered
FROM scored"""))
def state_batches(spark, sf_dir):
    """Five overlapping batches, one of them replayed after the others, then a run that sees some notices again."""
    folder = scratch_folder(spark, "state")
    tables = state.StateTables(spark, f"{folder}/state", compact_every=2, buckets=4)
    key = F.col("id").cast("bigint")
    notices_ = cut_lineage(scored_orders(spark, sf_dir).select("id", "portal", "title", "url", "posted_date", "closing_date"))
    for k in (0, 1, 2, 3, 4, 4):
        state.report_once(
            tables, notices_.where(key % 5 <= k), lambda fresh: fresh.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"),  # noqa: B023
            datetime.combine(RUN + timedelta(days=k), time()), version=k + 1).unpersist()
    tables.record(notices_.where(key % 7 == 0), datetime.combine(RUN + timedelta(days=9), time()))
    delivered = spark.read.parquet(f"{folder}/out").groupBy("id").agg(F.count("*").alias("delivered"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return tables.seen().join(delivered, "id").select("id", day("first_seen"), day("last_seen"), "title", "delivered")


# ----------------------------------------------------------------------------- dedupe


@query("dedupe_url", """
SELECT link, count(*) AS n, min(page_id) AS leader
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+'), '^https', 'http') AS link FROM pages)
GROUP BY link""")
def dedupe_url(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages")
    host = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0), "^https", "http")
    return dedupe.same_url_groups(pages.select(F.col("page_id").alias("id"), host.alias("url"))).select(
        F.col("url").alias("link"), "n", "leader"
    )


@query("dedupe_republication", with_views(DOCUMENT_NOTICES, body="""
SELECT min(id) AS leader, count(*) AS n, CAST(max(posted_date) AS VARCHAR) AS posted_date
FROM doc_notices
GROUP BY portal, title, description, eligibility, notice_type, language"""))
def dedupe_republication(spark, sf_dir):
    groups = dedupe.republication_groups(T.notices_from_documents(spark, sf_dir))
    return groups.select("leader", "n", F.col("posted_date").cast("string").alias("posted_date"))


@query("dedupe_title_pairs", with_steps(DOCUMENT_NOTICES, ALIKE, body="SELECT a, b, round(ratio, 4) AS ratio FROM alike"))
def dedupe_title_pairs(spark, sf_dir):
    notices = T.notices_from_documents(spark, sf_dir)
    return dedupe.similar_titles(notices).select("a", "b", F.round("ratio", 4).alias("ratio"))


@query("dedupe_clusters", with_steps(DOCUMENT_NOTICES, ALIKE, MERGED, body="""
SELECT p.id, k.portal, k.title, array_to_string(k.also, ', ') AS also_on, CAST(k.posted AS VARCHAR) AS posted_date, k.n AS n_members
FROM (SELECT unnest(kept) AS k FROM (SELECT kept FROM taken ORDER BY step DESC LIMIT 1)) JOIN placed p ON p.ord = k.ord"""))
def dedupe_clusters(spark, sf_dir):
    scored = T.notices_from_documents(spark, sf_dir).withColumn("score", F.lit(50.0))
    result = dedupe.deduplicate(scored)
    return result.kept.select(
        "id", "portal", "title", F.array_join("also_on", ", ").alias("also_on"),
        F.col("posted_date").cast("string").alias("posted_date"), "n_members",
    )


@query("value_display", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN 'big'
  ELSE 'US$ ' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) END AS small,
  'US$ ' || format('{:,.2f}', (o_totalprice * 1e3) / 1e6) || 'm' AS large
FROM orders""")
def value_display(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    large = F.greatest(F.col("o_totalprice") * 1000, F.lit(1_000_000.0))
    return orders.select(
        "o_orderkey", money.display_usd(F.col("o_totalprice")).alias("small"),
        money.display_usd(large).alias("large"),
    )
