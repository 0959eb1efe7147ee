"""The source registry, the reading hints of listing sources, and which source a page belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.session import evaluated


@dataclass(frozen=True)
class ListingSpec:
    """How to read one listing source."""

    key: str
    urls: tuple[str, ...]
    selectors: tuple[str, ...] = ()
    anchor_hint: str | None = None
    currency: str | None = None
    #: "text": the text must name the country; "several": a label for several countries will do; "none": no test.
    relevance: str = "text"
    field_hooks: tuple[tuple[str, str], ...] = ()


# --------------------------------------------------------------------------------------
# Addresses, selector hints and currencies of the listing sources.
# --------------------------------------------------------------------------------------
LISTING_SPECS: list[ListingSpec] = [
    ListingSpec(
        "ungm", ("https://www.ungm.org/Public/Notice",),
        ("div.dataRow.notice-table", "div.tableRow.dataRow", "div.tableRow", "tr.noticeRow"),
        "/Public/Notice/", "USD", "several",
        (("title", "span.ungm-title"),
         ("closing", "span:has(+ span.remainingDaysToDeadline)"),
         ("posted", "span.remainingDaysToDeadline ~ span")),
    ),
    ListingSpec(
        "ebrd",
        ("https://www.ebrd.com/home/work-with-us/project-procurement/procurement-notices.html",
         "https://ecepp.ebrd.com/delta/noticeSearchResults.html"),
        ("div.procurement-notice", "article.notice", "li.search-result", "table.noticeTable tbody tr"),
        "/procurement", "EUR",
    ),
    ListingSpec(
        "eib", ("https://www.eib.org/en/about/procurement/all/index.htm",),
        ("div.eib-list__item", "article.teaser", "li.list-item", "table tbody tr"),
        "/about/procurement/", "EUR",
    ),
    ListingSpec(
        "giz", ("https://ausschreibungen.giz.de/Satellite/company/welcome.do",),
        ("div.tender-item", "tr.tableRow", "table.publicationTable tbody tr", "li.result"),
        "/Satellite/notice", "EUR",
    ),
    ListingSpec(
        "kfw", ("https://www.gtai.de/en/trade/tenders",),
        ("div.gtai-teaser", "article.teaser", "li.search-result", "table tbody tr"),
        "/tenders/", "EUR",
    ),
    ListingSpec(
        "isdb", ("https://www.isdb.org/project-procurement/tenders",),
        ("div.views-row", "div.tender-card", "article.node--type-tender", "table tbody tr"),
        "/project-procurement/", "USD",
    ),
    ListingSpec(
        "sfd",
        ("https://www.sfd.gov.sa/en/tenders-view", "https://www.sfd.gov.sa/ar/tenders-view"),
        ("div.tender-item", "div.card", "table tbody tr", "li.tender"), "tender", "SAR",
    ),
    ListingSpec(
        "adfd",
        ("https://www.adfd.ae/en/what-we-do/tenders", "https://www.adfd.ae/en/media-centre/news"),
        ("div.tender-item", "div.card", "div.news-item", "table tbody tr"), None, "AED",
    ),
    ListingSpec(
        "jica",
        ("https://www.jica.go.jp/english/overseas/jordan/others/procurement.html",
         "https://www.jica.go.jp/jordan/english/office/others/procurement.html"),
        ("div.js-accordion-content li", "ul.list-normal li", "table tbody tr", "div.section li"),
        "procurement", "JPY", "none",
    ),
]


def source_table(spark: SparkSession, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Enabled sources in report order: ``key, name, tier, tier_label, rank, urls``."""
    urls = {s.key: list(s.urls) for s in LISTING_SPECS}
    rows = [
        (key, name, tier, S.TIER_LABELS[tier], rank, urls.get(key, []))
        for rank, (key, name, tier) in enumerate(S.SOURCES) if key not in disabled
    ]
    return spark.createDataFrame(
        rows, "key string, name string, tier int, tier_label string, rank int, urls array<string>"
    )


def spec_table(spark: SparkSession) -> DataFrame:
    """Listing hints as a table, one row per source."""
    rows = [
        (s.key, list(s.urls), list(s.selectors), s.anchor_hint, s.currency, s.relevance, dict(s.field_hooks))
        for s in LISTING_SPECS
    ]
    return spark.createDataFrame(
        rows, "key string, urls array<string>, selectors array<string>, anchor_hint string, "
        "currency string, relevance string, field_hooks map<string,string>",
    )


def address_prefixes(url: Column, longest: Column | None = None) -> Column:
    """Host and path prefixes of an address, longest first, of ``longest`` segments at most.

    Scheme, query and fragment do not count, nor does the case of the host.
    """
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    parts = F.transform(F.filter(F.split(bare, "/"), lambda p: p != ""), lambda p, i: F.when(i == 0, F.lower(p)).otherwise(p))
    n = F.size(parts) if longest is None else F.least(F.size(parts), longest)
    lengths = F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1)))
    return F.coalesce(F.transform(lengths, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.array().cast("array<string>"))


def spec_prefixes(specs: DataFrame) -> DataFrame:
    """``prefix, spec``: whose pages lie below which prefix.

    An address belongs to the source that lists it (the least key if several do). A shorter prefix of it belongs to the
    source too, if no other source has an address below it.
    """
    claims = specs.select("key", F.struct(*specs.columns).alias("spec"), F.explode("urls").alias("url")).select(
        "key", "spec", F.posexplode(address_prefixes(F.col("url"))).alias("shorter", "prefix"))
    return claims.groupBy("prefix").agg(
        F.min("shorter").alias("shorter"), F.count_distinct("key").alias("n"), F.min_by("spec", F.struct("shorter", "key")).alias("spec"),
    ).where((F.col("shorter") == 0) | (F.col("n") == 1)).select("prefix", "spec")


def with_specs(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """``pages`` with the columns of the spec of their ``url``: the longest known prefix decides, null where there is none.

    The prefixes of a registry are a few per source, so they travel as one map and pages are neither shuffled nor repeated.
    """
    known = spec_prefixes(specs).agg(
        F.map_from_entries(F.collect_list(F.struct("prefix", "spec"))).alias("specs"),
        F.coalesce(F.max(F.size(F.split("prefix", "/"))), F.lit(0)).alias("longest"),
    ).agg(F.first(F.struct("specs", "longest"))).scalar()
    tried = F.transform(address_prefixes(F.col("url"), F.col("_known.longest")), lambda p: F.try_element_at("_known.specs", p))
    found = pages.withColumn("_known", known).withColumn("_spec", F.get(F.filter(tried, lambda s: s.isNotNull()), F.lit(0)))
    return evaluated(found.select(*pages.columns, *[F.col(f"_spec.{c}").alias(c) for c in specs.columns]))
