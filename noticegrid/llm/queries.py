"""The named queries of these operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.llm import audit, bpe, chat, chunks, exact, lines, minhash, mixing, periodic, quality, suffix, topk, warc
from noticegrid.llm.common import WORD, materialised, read, whole
from noticegrid.session import scratch_folder, ship_package

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of ``docs``, learnt from the labels outside the held-out fold."""
    stats = materialised(quality.measure(docs))
    known = labels.filter(quality.fold_of(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality.apply(quality.fit(stats, known), stats)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", F.coalesce(quality.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(spark, vocabulary_path())
    both = bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source."""
    done = lines.without_boilerplate(read(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("bp_all").alias("n_lines"), F.col("bp_dropped").alias("n_dropped"),
                       F.sha2(whole(F.col("text")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
p AS (SELECT r, doc_id, source, i, parts[i] AS line, trim(parts[i], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS key
      FROM (SELECT r, doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT r, doc_id, source, string_split(text, chr(10)) AS parts FROM d WHERE text IS NOT NULL))),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
c AS (SELECT source, key, count(DISTINCT r) AS pages FROM p WHERE key <> '' GROUP BY source, key),
b AS (SELECT c.source, c.key FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE c.pages >= {lines.LEAST} AND c.pages > {lines.RATIO}::DOUBLE * t.total),
m AS (SELECT p.*, b.key IS NOT NULL AS gone FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source AND p.key = b.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chunks.deduplicate(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return done.select("doc_id", "n_bytes", "n_chunks", "n_repeated", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _control_turns(spark: SparkSession) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(_control_turns(spark))
    back = chat.read_back(chat.format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_sep\|>|\|im_end\|>)', '\1\\\2\3', 'g') AS er,
                regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_sep\|>|\|im_end\|>)', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || er || '<|im_sep|>' || et || '<|im_end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact.deduplicate_table(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256 FROM t JOIN g ON t.text_sha256 = g.text_sha256
"""


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = minhash.near_duplicates(read(spark, sf_dir, "documents"), n=2)
    return done.select("doc_id", "n_shingles", "component_id", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                          F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_takes")).alias("taken"))


_DRAWS = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT::DOUBLE / 4294967296.0" for k in range(mixing.DRAWS))
_OVER = ", ".join(f"abs(floor(rate) * source_size + sum(CASE WHEN u[{k + 1}] < rate - floor(rate) THEN size ELSE 0 END) - target)" for k in range(mixing.DRAWS))
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  sha256(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, {mixing.MOST} * source_size AS cap,
             sum({mixing.MOST} * source_size) OVER o - {mixing.MOST} * source_size AS full_before, sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left,
             sum(source_size) OVER () AS total, row_number() OVER o AS place
      FROM w WINDOW o AS (ORDER BY {mixing.MOST} * source_size::DOUBLE / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((total - full_before)::DOUBLE / weight_left, place) FILTER (WHERE cap > (total - full_before)::DOUBLE / weight_left * weight) AS level FROM f),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level, 0) * weight) AS target FROM f, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
j AS (SELECT d.doc_id, d.size, r.*, [{_DRAWS}] AS u FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
m AS (SELECT source, [{_OVER}] AS misses FROM j GROUP BY source, rate, source_size, target),
k AS (SELECT source, list_position(misses, list_min(misses)) AS draw FROM m)
SELECT j.doc_id, j.size, j.source_size, j.target,
       (j.size * (floor(j.rate)::BIGINT + CASE WHEN j.u[k.draw] < j.rate - floor(j.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j JOIN k ON j.source IS NOT DISTINCT FROM k.source
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written to a new folder below the shared checkpoint folder, then read back."""
    folder = scratch_folder(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
             first_value(page_id) OVER g AS best, row_number() OVER g AS place
      FROM p WINDOW g AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {warc.LEAST} OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < {warc.LEAST} OR place = 1 THEN NULL ELSE best END AS refers_to
FROM q
"""


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by a hash of the id, goes on in repetitions from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hashed = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(whole(F.col("text")), F.lit(f"({WORD})")))
    cut = hashed.withColumn("words", words).withColumn("n", F.size("words")).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(words) < {audit.SHORT}, 100 * len(list_distinct(words)) < {audit.VARIED} * len(words),
              100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.CAPITALS} * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, FALSE)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT c.*, o.o, list_position(list_transform(o.o, lambda x: fails[x]), TRUE) AS gone FROM c, o),
g AS (SELECT s.part, s.o, f.f AS step, o[f.f] AS filter,
             sum(CASE WHEN gone <= f.f THEN 0 ELSE n END) FILTER (WHERE gone IS NOT NULL AND gone > 0) AS later,
             sum(n) FILTER (WHERE coalesce(gone, 0) = 0) AS never,
             sum(n) FILTER (WHERE gone = f.f) AS removed, sum(n) FILTER (WHERE fails[o[f.f]] AND gone < f.f AND gone > 0) AS redundant,
             sum(n) FILTER (WHERE fails[o[f.f]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
             sum(good) FILTER (WHERE gone = f.f) AS good_lost, sum(toxic) FILTER (WHERE gone = f.f) AS toxic_lost
      FROM s, f GROUP BY s.part, s.o, f.f)
SELECT part, array_to_string(list_transform(o, lambda x: chr(64 + x::INT)), '') AS filter_order, step::INT AS step,
       (coalesce(later, 0) + coalesce(never, 0))::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM g
"""


def _shipped(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    builds = (op1_quality_classifier, op2_bpe, op3_line_dedup, op4_substring_dedup, op5_chat_format, op6_exact_dedup,
              op7_minhash_dedup, op8_mixing, op9_suffix_dedup, op10_top_k, op11_warc, op12_periodic_runs, op13_filter_audit)
    return {b.__name__: _shipped(b) for b in builds}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op10_top_k": OP10_SQL,
            "op11_warc": OP11_SQL, "op13_filter_audit": OP13_SQL}
