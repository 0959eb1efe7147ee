"""The table views as SQL, written independently of the DataFrame versions."""

from noticegrid import settings as S

NOTICES = f"""
notices AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name || ' ' || n_name AS title,
         o_orderpriority AS portal,
         CASE WHEN o_orderkey % 9 <> 0 THEN 'https://notices.example/' || o_orderkey END AS url,
         CASE WHEN o_orderkey % 11 <> 0
              THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 200 AS INTEGER) END AS posted_date,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS closing_date,
         CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1e6
              WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS raw_value,
         c_mktsegment AS sector,
         CASE WHEN o_orderkey % 13 = 0 THEN '{S.FLAG_RESTRICTED}' END AS eligibility,
         c_name AS contact, o_orderstatus AS notice_type,
         CASE WHEN o_orderkey % 17 = 0 THEN 'ar' ELSE 'en' END AS language
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
judged AS (
  SELECT *, DATE '1998-06-15' AS run_date,
         CASE WHEN raw_value BETWEEN 1e3 AND 5e9 THEN raw_value END AS value
  FROM notices
),
reasoned AS (
  SELECT *, CASE
    WHEN closing_date < run_date THEN 'closed'
    WHEN value < 1e5 THEN 'below minimum value'
    WHEN closing_date IS NULL AND run_date - posted_date > 90
      THEN 'undated and published over 90 days ago' END AS drop_reason
  FROM judged
),
parts AS (
  SELECT *, closing_date - run_date AS left_days,
    CASE WHEN value IS NULL THEN 0.55e0 WHEN value <= 1e5 THEN 0.35e0
         ELSE least(0.35e0 + 0.65e0 * ((value - 1e5) / 4.9e6), 1e0) END AS value_part,
    CASE WHEN closing_date IS NULL THEN 0.5e0
         WHEN closing_date - run_date < 0 THEN 0e0
         WHEN closing_date - run_date <= 5 THEN 0.15e0
         WHEN closing_date - run_date <= 12 THEN 0.5e0
         WHEN closing_date - run_date <= 30 THEN 1e0
         WHEN closing_date - run_date <= 75 THEN 0.85e0 ELSE 0.6e0 END AS runway_part
  FROM reasoned WHERE drop_reason IS NULL
),
scored AS (
  SELECT *, round(greatest(0e0, least(
      2.1428571428571427e1 * value_part + 2.1428571428571427e1 * runway_part
      - CASE WHEN eligibility IS NOT NULL THEN 25e0 ELSE 0e0 END, 1e2)), 1) AS score
  FROM parts
)"""

DOCUMENT_NOTICES = f"""
doc_notices AS (
  SELECT 'doc-' || d.doc_id AS id, trim(regexp_extract(text, '^[^.\\n]*')) AS title,
         source AS portal, text AS description, lang AS language,
         'https://' || source || '.example/' || d.doc_id AS url,
         DATE '2026-05-01' + CAST(d.doc_id % 40 AS INTEGER) AS posted_date,
         CASE WHEN toxic = 1 THEN '{S.FLAG_RESTRICTED}' END AS eligibility,
         CASE WHEN quality = 1 THEN 'Contract Notice' WHEN quality = 0 THEN 'Contract Award' END AS notice_type
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

#: Sorted words of each title, and the ratio of every pair of them that may reach 85. The longest common subsequence is
#: computed row by row of its table; an edit distance above the allowed one (of one-byte letters) leaves a pair out.
ALIKE = r"""
worded AS MATERIALIZED (
  SELECT *, array_to_string(list_sort(string_split(lower(trim(regexp_replace(coalesce(title, ''), '[\s\p{Z}]+', ' ', 'g'))), ' ')), ' ') AS key
  FROM doc_notices
),
keys AS MATERIALIZED (
  SELECT key, regexp_replace(key, '[^\x00-\x7F]', '?', 'g') AS plain, length(key) AS n, min(portal) AS first_portal, max(portal) AS last_portal FROM worded WHERE key <> '' GROUP BY key
),
near AS MATERIALIZED (
  SELECT row_number() OVER () AS pair, a.key AS a, b.key AS b, a.n AS na, b.n AS nb
  FROM keys a JOIN keys b ON a.key < b.key AND 200 * least(a.n, b.n) >= 85 * (a.n + b.n)
   AND NOT (a.first_portal = a.last_portal AND b.first_portal = b.last_portal AND a.first_portal = b.first_portal)
   AND CASE WHEN 200 * least(a.n, b.n) >= 85 * (a.n + b.n) THEN 100 * levenshtein(a.plain, b.plain) <= 15 * (a.n + b.n) ELSE false END
),
common AS (
  SELECT pair, 0 AS i, unnest(range(1, nb + 1)) AS j, 0 AS lcs FROM near
  UNION ALL
  SELECT pair, i + 1, j, max(step) OVER (PARTITION BY pair ORDER BY j)
  FROM (SELECT c.pair, i, j, greatest(lcs, CASE WHEN a[i + 1] = b[j] THEN coalesce(lag(lcs) OVER (PARTITION BY c.pair ORDER BY j), 0) + 1 ELSE 0 END) AS step
        FROM common c JOIN near USING (pair) WHERE i < na)
),
alike AS MATERIALIZED (
  SELECT a, b, 200e0 * lcs / (na + nb) AS ratio FROM near JOIN common USING (pair)
  WHERE i = na AND j = nb AND 200 * lcs >= 85 * (na + nb)
)"""

#: The sequential loop: one notice per step, in order, against the list of those kept so far.
MERGED = """
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY coalesce(title, ''), id) AS ord FROM worded
),
matching AS MATERIALIZED (
  SELECT p.ord, list(q.ord) AS ords FROM placed p JOIN placed q ON p.portal <> q.portal AND q.ord < p.ord AND p.key <> ''
    AND (p.key = q.key OR (least(p.key, q.key), greatest(p.key, q.key)) IN (SELECT (a, b) FROM alike))
  GROUP BY p.ord
),
taken AS (
  SELECT 0::BIGINT AS step, CAST([] AS STRUCT(ord BIGINT, portal VARCHAR, title VARCHAR, url VARCHAR, language VARCHAR, description VARCHAR,
    eligibility VARCHAR, notice_type VARCHAR, posted DATE, also VARCHAR[], n BIGINT)[]) AS kept
  UNION ALL
  SELECT step + 1, CASE WHEN hit IS NULL
    THEN list_append(kept, {'ord': ord, 'portal': portal, 'title': title, 'url': url, 'language': language, 'description': md5(description),
      'eligibility': eligibility, 'notice_type': notice_type, 'posted': posted_date, 'also': CAST([] AS VARCHAR[]), 'n': 1::BIGINT})
    ELSE list_transform(kept, lambda k: CASE WHEN k.ord <> hit THEN k ELSE {'ord': k.ord, 'portal': k.portal, 'title': k.title, 'url': k.url,
      'language': k.language, 'description': coalesce(k.description, md5(description)), 'eligibility': coalesce(k.eligibility, eligibility),
      'notice_type': coalesce(k.notice_type, notice_type),
      'posted': CASE WHEN k.portal = portal THEN greatest(k.posted, posted_date) ELSE coalesce(k.posted, posted_date) END,
      'also': CASE WHEN k.portal = portal OR list_contains(k.also, portal) THEN k.also ELSE list_append(k.also, portal) END, 'n': k.n + 1} END) END
  FROM (
    SELECT step, kept, p.*, list_min(list_transform(list_filter(kept, lambda k: k.url = p.url OR coalesce(list_contains(s.ords, k.ord), false) OR (
        k.portal = p.portal AND k.title IS NOT DISTINCT FROM p.title AND k.language IS NOT DISTINCT FROM p.language
        AND k.posted IS NOT NULL AND p.posted_date IS NOT NULL AND k.description IS NOT DISTINCT FROM md5(p.description)
        AND k.eligibility IS NOT DISTINCT FROM p.eligibility AND k.notice_type IS NOT DISTINCT FROM p.notice_type)), lambda k: k.ord)) AS hit
    FROM taken JOIN placed p ON p.ord = step + 1 LEFT JOIN matching s ON s.ord = p.ord)
)"""

UNITS = """
units AS (
  SELECT p_brand || '-' || p_partkey AS id, p_brand AS project_id,
         'd' || (CAST(substr(p_brand, 7) AS INTEGER) % 4) AS district,
         CAST(p_partkey AS VARCHAR) AS code, p_size % 5 AS floor,
         list_extract(['north','east','south','west'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS orientation,
         CAST(p_size AS DOUBLE) AS area,
         CASE WHEN p_partkey % 6 = 0 THEN 12e0 ELSE 0e0 END AS outdoor,
         CAST(p_partkey % 4 + 1 AS INTEGER) AS beds, CAST(p_partkey % 3 + 1 AS INTEGER) AS baths,
         p_type AS type,
         CASE WHEN p_partkey % 10 <> 0 THEN 'plan-' || p_size END AS plan,
         CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price,
         list_extract(['available','reserved','sold'], CAST(p_partkey % 3 + 1 AS INTEGER)) AS status,
         p_partkey AS ordinal
  FROM part
),
projects AS (
  SELECT project_id AS id, min(ordinal) AS ordinal, min(district) AS district,
         list_extract(['selling','delivered','upcoming','planned'],
                      CAST(substr(project_id, 7) AS INTEGER) % 4 + 1) AS status,
         CASE WHEN CAST(substr(project_id, 7) AS INTEGER) % 7 <> 0
              THEN 'img-' || substr(project_id, 7) END AS image
  FROM units GROUP BY project_id
)"""

HEALTH = """
per_source AS (
  SELECT user_id AS rank, 's' || user_id AS key, count(*) AS scanned,
         count(*) FILTER (WHERE event_type = 'error') AS errors,
         count(*) FILTER (WHERE event_type = 'purchase') AS n
  FROM events GROUP BY user_id
),
health AS (
  SELECT rank, key, CASE WHEN rank % 29 = 0 THEN 'unconfigured'
                   WHEN rank % 31 = 0 THEN 'no listing'
                   WHEN errors / scanned > 0.25e0 THEN 'unavailable' ELSE 'ok' END AS status,
         CASE WHEN rank % 29 = 0 THEN 'not configured - no key'
              WHEN rank % 31 = 0 THEN 'no listing published - nothing to read'
              WHEN errors / scanned > 0.25e0 THEN 'transport error - no content returned'
              ELSE '' END AS reason, scanned, n
  FROM per_source
)"""


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body


def with_steps(*views: str, body: str) -> str:
    """The same where a view goes on from its own rows."""
    return "WITH RECURSIVE " + ",".join(views) + "\n" + body
