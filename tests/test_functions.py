"""Parser tables for text, dates, values and country mentions."""

from datetime import date

from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions import dates, money, text
from noticegrid.operators import normalise, relevance

RUN = date(2026, 6, 15)


def run(spark, cases, expression):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def check(spark, table, expression):
    got = run(spark, [k for k, _ in table], expression)
    assert list(zip((k for k, _ in table), got)) == table


def test_dates(spark):
    d = date
    check(spark, [
        ("2026-12-31", d(2026, 12, 31)), ("2026-06-01T09:00:00Z", d(2026, 6, 1)),
        ("2026-6-1T09:00:00Z", d(2026, 6, 1)), ("2026-09-30T17:00:00-04:00", d(2026, 9, 30)),
        ("31.12.2026", d(2026, 12, 31)), ("15. Januar 2027", d(2027, 1, 15)),
        ("28 fevrier 2027", d(2027, 2, 28)), ("١٥ تشرين الأول ٢٠٢٦", d(2026, 10, 15)),
        ("٣١ ديسمبر ٢٠٢٦", d(2026, 12, 31)), ("03/04/2026", d(2026, 4, 3)), ("12/31/2026", d(2026, 12, 31)),
        ("30-Sep-2026 19:00 (GMT +3.00)", d(2026, 9, 30)), ("October 15, 2026", d(2026, 10, 15)),
        ("Deadline: 12/10/2026", d(2026, 10, 12)), ("Tue, 15 Sep 2026 10:00:00 GMT", d(2026, 9, 15)),
        ("March 3, 2026", d(2026, 3, 3)), ("5 May 2026", d(2026, 5, 5)), ("30.02.2026", None),
        ("Mon 5 Jan 27", d(2027, 1, 5)), ("12 07 2026", d(2026, 7, 12)), ("07 23 2026", d(2026, 7, 23)), ("2nd of June, 2026", d(2026, 6, 2)),
        ("Sept 3rd '26", d(2026, 9, 3)), ("closes on Friday, Jan 5, 27 at 10:30", d(2027, 1, 5)), ("27 Jan 5", d(2005, 1, 27)), ("2026 Jan 5", d(2026, 1, 5)),
        ("31-12-26", d(2026, 12, 31)), ("1 2 27", d(2027, 2, 1)), ("12 07", None), ("Jan 2027", None), ("5 Jan", None), ("5 offices in Jan 2027", None),
        ("32 13 2026", None), ("Lot 3 of 7, ref 2026", None), ("phone 06 555 1234", None),
        ("Expires in 48 days", None), ("WFP-SDN-00220", None), ("15 May 1900", None), ("prose", None), ("", None), (None, None),
    ], lambda c: dates.parse_date(c, RUN))


def test_values(spark):
    check(spark, [
        ("Published: 01 August 2026", None), ("Deadline 31.12.2026", None), ("Lot 3 of 7, ref 12", None),
        ("Notice 2026-114", None), ("2.5 million", 2_500_000.0), ("750k USD", 750_000.0),
        ("1500000", 1_500_000.0), ("EUR 1.500.000", 1_635_000.0), ("EUR 1.500,50", 1635.55),
        ("USD 1,500.50", 1500.5), ("EUR 850.000", 926_500.0), ("US$ 3 bn", 3e9), ("0", None),
        ("EUR 50,000 per year, total EUR 1,200,000", 1_308_000.0), ("٢٥٠٠٠٠ دينار أردني", 352_500.0),
        ("100 JPY", 0.64), ("", None), (None, None),
    ], lambda c: money.parse_value_usd(c))


def test_country(spark):
    check(spark, [
        ("Amman, Jordan", True), ("Jordanstown", False), ("Ammanford", False), ("Irbid governorate", True),
        ("office@unit-jordan.org", False), ("see http://www.mit.gov.jo/x", True), ("a@mit.gov.jo", False),
        ("مشروع الأردنية", True), ("jordané", False), (None, False),
    ], lambda c: text.mentions_country(S.CountryTerms(), c))


def test_text(spark):
    check(spark, [("<p>A</p><p>B</p>&nbsp;C", "A B C"), ("x <your name> y", "x <your name> y"),
                  ("<b>see</b> &lt;p&gt;", "see <p>"), ("ﬁne  \n day", "fine day"), ("<i>é</i>‏", "é"), (None, "")],
          text.strip_markup)
    check(spark, [("مناقصة supply", "ar"), ("supply of goods مناقصة and many more words here", "en"), ("12", "en")], text.language)
    check(spark, [("one two three", "one …"), ("short", "short")], lambda c: text.truncate(c, 6))
    hits = run(spark, ["Policy-making, e-government STUDY", "studying policies"], lambda c: text.term_hits(c, S.RANKING_LEXICON))
    assert [sorted(h) for h in hits] == [["e-government", "policy", "study"], []]
    check(spark, [("road and bridge transport", "Infrastructure"), ("nothing", "Unclassified")], text.sector)
    check(spark, [("Open to national firms ONLY", True), ("all firms", False)], text.restricted)


def test_verdicts(spark):
    t = S.CountryTerms()
    check(spark, [("JOR", True), ("JOR, DEU", True), ("DEU", False), ("Jordan", True), (None, None)],
          lambda c: relevance.code_verdict(t, c))
    check(spark, [("Austria – Software", False), ("Jordan – Software", None), ("Software", None)],
          lambda c: relevance.title_prefix_verdict(t, c))
    check(spark, [("Multiple  destinations", True), ("Egypt", False)], relevance.multi_country)


def test_unwrap_and_titles(spark):
    check(spark, [('{"fra": ["b"], "eng": ["a", "c"]}', "a c"), ('{"deu": "x"}', "x"), ('["p","q"]', "p q"), ("z", "z")],
          normalise.unwrap)
    df = spark.createDataFrame([("N", "P"), ("N for p", "P"), (None, "P"), ("N", None)], "a string, b string")
    got = [r[0] for r in df.select(normalise.compose_title(F.col("a"), F.col("b"))).collect()]
    assert got == ["N (P)", "N for p", "P", "N"]


def test_identity_survives_edits(spark):
    df = spark.createDataFrame([("r1", "old text"), ("r1", "new text")], "reference string, description string")
    raw = df.withColumns({"portal": F.lit("ted"), "title": F.lit("Water audit"), "url": F.lit("u")})
    ids = {r["id"] for r in normalise.build_records(raw, RUN).collect()}
    assert len(ids) == 1
