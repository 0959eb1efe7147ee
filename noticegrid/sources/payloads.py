"""Landed API payloads to candidate rows.

A payload table has one row per landed response with its text in ``payload``. Responses
arrive in several shapes; an item is parsed once for all spellings of its fields, nested values as
JSON text.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions.text import filled
from noticegrid.operators.normalise import compose_title, unwrap, value_phrase
from noticegrid.operators.relevance import code_verdict, field_verdict, title_prefix_verdict
from noticegrid.session import evaluated

# Field spellings of the first source.
SPELLINGS: dict[str, tuple[str, ...]] = {
    "country": ("project_ctry_name", "countryshortname", "country_name", "countryname",
                "cty_name", "country", "project_country"),
    "link": ("url", "notice_url", "noticeurl", "notice_link", "noticelink", "bid_url",
             "pdf_url", "pdfurl", "link", "detail_url", "notice_detail_url", "web_url", "weburl"),
    "notice_id": ("id", "notice_id", "noticeid", "notice_no", "noticeno",
                  "procurement_notice_id", "op_id"),
    "title": ("notice_title", "noticetitle", "bid_description", "bid_desc", "title"),
    "project": ("project_name", "projectname"),
    "posted": ("noticedate", "notice_date", "submission_date", "publication_date", "noticedate_dt"),
    "closing": ("submission_deadline_date", "bid_closing_date", "deadline",
                "submissiondeadline", "closing_date"),
    "value": ("contract_value", "estimated_cost", "totalvalue", "amount"),
    "description": ("notice_text", "description", "bid_description", "project_ctry_name"),
    "notice_type": ("notice_type", "noticetype", "procurement_type"),
    "contact": ("contact_email", "contact_name", "agency_name"),
    "reference": ("id", "notice_no", "bid_reference_no", "project_id"),
}
# Detail pages and identifier shape.
NOTICE_PAGE = "https://projects.worldbank.org/en/projects-operations/procurement-detail/"
NOTICE_ID = r"(?i)^OP\d{6,}$"
TED_PAGE = "https://ted.europa.eu/en/notice/-/detail/"
OCDS_PAGE = "https://www.find-tender.service.gov.uk/Notice/"
ITEM_KEYS = {
    "worldbank": ("procnotices", "notices", "documents", "results"),
    "ted": ("notices", "results", "content", "items"),
    "samgov": ("opportunitiesData", "results", "data"),
    "fcdo": ("releases",),
}
# Fields of the other sources, and paths within them.
FIELDS = {
    "ted": ("publication-number", "ND", "links", "notice-title", "title", "place-of-performance-country-lot",
            "place-of-performance-country", "buyer-country", "country", "publication-date", "deadline-receipt-tender-date-lot",
            "deadline", "total-value", "description-lot", "description", "notice-type", "buyer-name"),
    "samgov": ("placeOfPerformance", "pointOfContact", "title", "uiLink", "link", "postedDate", "responseDeadLine",
               "responseDeadline", "award", "description", "type", "baseType", "noticeId", "solicitationNumber"),
    "fcdo": ("tender", "parties", "tag", "title", "ocid", "date", "buyer"),
}
TED_LINKS = ("html", "pdf", "xml", "self")
TED_PLACES = ("place-of-performance-country-lot", "place-of-performance-country", "buyer-country", "country")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON files, one whole response per row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.input_file_name().alias("file")
    )


def _texts(names) -> str:
    """A schema that reads the named fields, nested ones as JSON text."""
    return ", ".join(f"`{n}` string" for n in names)


def _as_items(json: Column) -> Column:
    """Objects of a list, or of the values of a keyed object, as JSON texts."""
    listed = F.from_json(json, "array<string>")
    keyed = F.map_values(F.from_json(json, "map<string,string>"))
    either = F.when(json.startswith("["), listed).when(json.startswith("{"), keyed)
    return F.filter(either, lambda x: x.startswith("{"))


def items(payloads: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """One row per item: ``item`` holds the fields of these ``names``, each item parsed once.

    The first of ``keys`` holding a list or an object counts; a bare list is taken as is. A field without
    content is null.
    """
    text = F.trim("payload")
    rest = [c for c in payloads.columns if c != "payload"]
    top = payloads.select(*rest, text.alias("text"), F.from_json(text, _texts(keys)).alias("top"))
    under = F.coalesce(*[F.nullif(F.col("top").getField(k), F.lit("")) for k in keys])
    listed = top.select(*rest, F.when(F.col("text").startswith("["), F.col("text")).otherwise(under).alias("list"))
    # Names that differ by case alone cannot stand in one schema.
    groups: list[dict[str, str]] = []
    for n in dict.fromkeys(names):
        group = next((g for g in groups if n.lower() not in g), None)
        if group is None:
            groups.append(group := {})
        group[n.lower()] = n
    # Parsed where the items are made: a projection's parse would be repeated by every filter on a field.
    read = lambda json: F.struct(*[F.from_json(json, _texts(g.values())).alias(f"read_{i}") for i, g in enumerate(groups)])
    parsed = listed.select(*rest, F.posexplode(F.transform(_as_items(F.col("list")), read)).alias("item_no", "parsed"))
    filled_in = [F.expr(f"if(trim(parsed.read_{i}.`{n}`) IN ('', '[]', '{{}}'), null, parsed.read_{i}.`{n}`)").alias(_slot(n))
                 for i, g in enumerate(groups) for n in g.values()]
    return parsed.select(*rest, "item_no", F.struct(*filled_in).alias("item"))


def _slot(name: str) -> str:
    """A column for a field, as names of fields may differ by case alone."""
    return "f_" + name.encode().hex()


def field(name: str, item: str = "item") -> Column:
    return F.col(item).getField(_slot(name))


def pick(names, item: str = "item") -> Column:
    """First filled field among several spellings."""
    return F.coalesce(*[field(n, item) for n in names])


def _inner(value: Column, path: str) -> Column:
    return F.get_json_object(value, path)


def worldbank(payloads: DataFrame, terms: S.CountryTerms = S.CountryTerms()) -> DataFrame:
    rows = items(payloads, ITEM_KEYS["worldbank"], tuple(chain.from_iterable(SPELLINGS.values())))
    links = [F.when(F.lower(F.trim(field(n))).startswith("http"), F.trim(field(n))) for n in SPELLINGS["link"]]
    ids = [F.when(F.trim(field(n)).rlike(NOTICE_ID), F.upper(F.trim(field(n)))) for n in SPELLINGS["notice_id"]]
    country = pick(SPELLINGS["country"])
    joined = F.when(country.startswith("["), F.concat_ws(" ", F.from_json(country, "array<string>"))).otherwise(country)
    return evaluated(rows.select(
        F.lit("worldbank").alias("portal"),
        compose_title(pick(SPELLINGS["title"]), pick(SPELLINGS["project"])).alias("title"),
        F.coalesce(*links, F.concat(F.lit(NOTICE_PAGE), F.coalesce(*ids))).alias("url"),
        pick(SPELLINGS["posted"]).alias("posted"), pick(SPELLINGS["closing"]).alias("closing"),
        pick(SPELLINGS["value"]).alias("value_text"), pick(SPELLINGS["description"]).alias("description"),
        pick(SPELLINGS["notice_type"]).alias("notice_type"), pick(SPELLINGS["contact"]).alias("contact"),
        pick(SPELLINGS["reference"]).alias("reference"), F.lit("USD").alias("currency"),
        field_verdict(terms, joined).alias("verdict"),
    )).where(F.col("title").isNotNull())


def ted(payloads: DataFrame, terms: S.CountryTerms = S.CountryTerms()) -> DataFrame:
    rows = items(payloads, ITEM_KEYS["ted"], FIELDS["ted"])
    number = F.coalesce(unwrap(field("publication-number")), unwrap(field("ND")))
    links = [unwrap(_inner(field("links"), f"$.{k}")) for k in TED_LINKS]
    title = F.coalesce(unwrap(field("notice-title")), unwrap(field("title")))
    verdict = F.coalesce(code_verdict(terms, *[unwrap(field(p)) for p in TED_PLACES]),
                         title_prefix_verdict(terms, unwrap(field("notice-title"))))
    return evaluated(rows.select(
        F.lit("ted").alias("portal"), title.alias("title"),
        F.coalesce(*links, F.concat(F.lit(TED_PAGE), number)).alias("url"),
        unwrap(field("publication-date")).alias("posted"),
        F.coalesce(unwrap(field("deadline-receipt-tender-date-lot")), unwrap(field("deadline"))).alias("closing"),
        unwrap(field("total-value")).alias("value_text"),
        F.coalesce(unwrap(field("description-lot")), unwrap(field("description"))).alias("description"),
        unwrap(field("notice-type")).alias("notice_type"), unwrap(field("buyer-name")).alias("contact"),
        number.alias("reference"), F.lit("EUR").alias("currency"), verdict.alias("verdict"),
    )).where(F.col("title").isNotNull())


def samgov(payloads: DataFrame) -> DataFrame:
    """An empty result is legal here and gives an empty table."""
    rows = items(payloads, ITEM_KEYS["samgov"], FIELDS["samgov"])
    place = field("placeOfPerformance")
    country = F.coalesce(_inner(place, "$.country.name"), _inner(place, "$.country"))
    first = "$[0]"
    contact = F.concat_ws(
        " ", filled(_inner(field("pointOfContact"), f"{first}.fullName")),
        filled(_inner(field("pointOfContact"), f"{first}.email")),
    )
    return evaluated(rows.select(
        F.lit("samgov").alias("portal"), field("title").alias("title"),
        pick(("uiLink", "link")).alias("url"), field("postedDate").alias("posted"),
        pick(("responseDeadLine", "responseDeadline")).alias("closing"),
        _inner(field("award"), "$.amount").alias("value_text"),
        F.coalesce(field("description"), filled(country)).alias("description"),
        pick(("type", "baseType")).alias("notice_type"), filled(contact).alias("contact"),
        pick(("noticeId", "solicitationNumber")).alias("reference"), F.lit("USD").alias("currency"),
    )).where(F.col("title").isNotNull())


def fcdo(payloads: DataFrame) -> DataFrame:
    """Release packages: one row per release."""
    rows = items(payloads, ITEM_KEYS["fcdo"], FIELDS["fcdo"])
    tender = field("tender")
    currency = _inner(tender, "$.value.currency")
    documents = F.from_json(_inner(tender, "$.documents"), "array<struct<url: string>>")
    parties = F.from_json(field("parties"), "array<struct<name: string, roles: array<string>>>")
    document = F.get(F.filter(documents, lambda d: F.coalesce(d["url"], F.lit("")) != ""), F.lit(0))["url"]
    buyer = F.get(F.filter(parties, lambda p: F.coalesce(F.array_contains(p["roles"], "buyer"), F.lit(False))), F.lit(0))["name"]
    tags = F.from_json(field("tag"), "array<string>")
    return evaluated(rows.select(
        F.lit("fcdo").alias("portal"),
        F.coalesce(filled(_inner(tender, "$.title")), field("title")).alias("title"),
        F.coalesce(document, F.concat(F.lit(OCDS_PAGE), field("ocid"))).alias("url"),
        field("date").alias("posted"), _inner(tender, "$.tenderPeriod.endDate").alias("closing"),
        value_phrase(_inner(tender, "$.value.amount"), currency, "GBP").alias("value_text"),
        _inner(tender, "$.description").alias("description"),
        F.coalesce(filled(_inner(tender, "$.mainProcurementCategory")), F.get(tags, F.lit(0))).alias("notice_type"),
        F.coalesce(filled(buyer), _inner(field("buyer"), "$.name")).alias("contact"),
        F.coalesce(field("ocid"), _inner(tender, "$.id")).alias("reference"),
        F.coalesce(filled(currency), F.lit("GBP")).alias("currency"),
    )).where(F.col("title").isNotNull())
