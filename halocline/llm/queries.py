"""The registered queries opN_<name>, each over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD
from .decontam import decontaminate
from .filter_audit import audit_filters
from .language_model import score_documents
from .licenses import TEMPLATES, normalised_words, scan_licenses, template_bigrams
from .line_dedup import dedup_lines
from .mixing import mix_to_weights
from .periodic_runs import find_runs, strongest_run
from .sharding import SHARDS, reshard_documents
from .simhash import near_duplicates
from .substring import remove_repeats
from .topk import exact_top_k
from .toxicity import score_toxicity
from .warc import archive_pages, read_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, path = archive_pages(table(spark, sf_dir, "pages"))
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    found = read_records(index, path)
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a tenth of the ids, chosen by CRC-32, go on periodically from a word on, as the query is stated."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # of the other rows no words are extracted
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    sized = words.select("doc_id", "text", "w", n.alias("n"), g.alias("g")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    sized = sized.withColumn("p", p)
    of = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("w", of), " ")).otherwise(F.col("text")).alias("text"))


def op11_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents stand by source at first, so that one shard holds a third of them."""
    by_source = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(SHARDS))
    found = reshard_documents(table(spark, sf_dir, "documents"), by_source)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.select("doc_id", "runs", strongest_run(F.col("runs")).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_exact_top_k, op4_decontaminate, op5_warc, op6_mix_sources, op7_toxicity, op8_language_model, op9_simhash, op10_line_dedup, op11_reshard, op12_periodic_runs, op13_filter_audit)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op1_sql() -> str:
    rows = ", ".join(f"({_quoted(k)}, [{', '.join(map(_quoted, v))}], {len(v)}, {len(normalised_words(TEMPLATES[k]))})" for k, v in template_bigrams().items() if v)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: rf"regexp_extract_all({lower.format(c)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH t(id, grams, n, words) AS (VALUES {rows}),
d AS (SELECT doc_id, {words("text")} AS w, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, w, n_lines, t.* FROM (SELECT doc_id, w, n_lines, {grams("w")} AS all_grams FROM d WHERE len(w) > 1) CROSS JOIN t WHERE len(list_intersect(all_grams, grams)) >= n * 0.8 / 1.2 - 1e-6),
e AS (SELECT doc_id, i, len({words("line")}) AS c FROM (SELECT doc_id, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM k)))),
o AS (SELECT doc_id, i, c, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY i) - c AS BIGINT) AS s FROM e),
u AS (SELECT doc_id, 0 AS line, FALSE AS wrapped, 0 AS s, len(w) AS e, w, id, grams, n FROM k WHERE n_lines > 1
      UNION ALL SELECT doc_id, i, FALSE, s, s + c, w, id, grams, n FROM o JOIN k USING (doc_id) WHERE c > 1
      UNION ALL SELECT doc_id, i, TRUE, s, least(s + words, len(w)), w, id, grams, n FROM o JOIN k USING (doc_id) WHERE c > 0 AND c < words AND s + c < len(w)),
a AS (SELECT doc_id, line, wrapped, s, e, id, grams, n, {grams("u")} AS a FROM (SELECT *, list_slice(w, s + 1, e) AS u FROM u)),
f AS (SELECT * FROM (SELECT doc_id, line, wrapped, s, e, id, 2.0 * len(list_intersect(a, grams))::DOUBLE / (len(a) + n)::DOUBLE AS dice FROM a) WHERE dice >= 0.8),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, wrapped ORDER BY dice DESC, id) AS r FROM f),
g AS (SELECT doc_id, list([{{'line': line, 'wrapped': wrapped, 's': s, 'e': e, 'id': id, 'dice': dice}}] ORDER BY dice DESC, wrapped, line, id) AS l FROM b WHERE line > 0 AND (wrapped OR r = 1) GROUP BY doc_id),
q AS (SELECT doc_id, unnest(list_reduce(l, lambda k, x: CASE WHEN NOT x[1].wrapped OR len(list_filter(k, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(k, x) ELSE k END), recursive := true) FROM g),
r AS (SELECT doc_id, line, wrapped, s, e, id, dice FROM b WHERE line = 0 AND r = 1 UNION ALL SELECT doc_id, line, wrapped, s, e, id, dice FROM q)
SELECT doc_id, CAST(line AS INTEGER) AS line, id AS license_id, dice,
       CAST(CASE WHEN line = 0 THEN (SELECT count(*) FROM o WHERE o.doc_id = r.doc_id) WHEN wrapped THEN (SELECT count(*) FROM o WHERE o.doc_id = r.doc_id AND o.s < r.e) ELSE line END AS INTEGER) AS last_line FROM r"""


_OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
f AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER w, 0.0) AS before_cap, coalesce(sum(weight) OVER w, 0.0) AS before_weight FROM c
      WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - before_cap) / ((SELECT sum(weight) FROM c) - before_weight) AS level FROM f),
o AS (SELECT min({'ratio': ratio, 'rank': rank, 'level': level}) AS o FROM l WHERE level * weight < cap),
g AS (SELECT source, source_size, CASE WHEN o.o IS NULL OR l.ratio < o.o.ratio OR (l.ratio = o.o.ratio AND l.rank < o.o.rank) THEN cap ELSE o.o.level * weight END AS target FROM l, o),
p AS (SELECT d.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(budget // source_size * size + least(size, greatest(0, budget - budget // source_size * source_size - before)) AS BIGINT) END AS taken FROM p"""

_OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last_id IS NOT NULL AND doc_id < last_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (last_id IS NOT NULL AND doc_id < last_id)), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id"""

_OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS s FROM d)),
f AS (SELECT h, min(doc_id) AS first_id FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, s + k AS p FROM (SELECT s.doc_id, s.s, unnest(range(0, 50)) AS k FROM s JOIN f USING (h) WHERE s.doc_id > f.first_id)),
x AS (SELECT DISTINCT doc_id, p FROM g),
e AS (SELECT doc_id, p, w[p] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT e.doc_id, count(x.p) AS n_removed, string_agg(e.word, ' ' ORDER BY e.p) FILTER (x.p IS NULL) AS kept FROM e LEFT JOIN x ON e.doc_id = x.doc_id AND e.p = x.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

_OP3_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p) WHERE rank <= 5"""

_BIT = lambda k: f"CAST(substr(bits, CAST(5 * i + {k} AS BIGINT), 1) AS INTEGER)"
_OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, html FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * {_BIT(1)} + 8 * {_BIT(2)} + 4 * {_BIT(3)} + 2 * {_BIT(4)} + {_BIT(5)}, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
g AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM t))),
h AS (SELECT g.doc_id, g.s, g.n, t.item_id FROM g JOIN t ON g.n = t.n AND g.g = t.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""

_OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
m AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
             regexp_matches(text, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS f FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, f),
k(k) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT part, o, step, o[step] AS filter, f[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda b: b)) AS n_fails, n, good, toxic FROM c CROSS JOIN s),
r AS (SELECT part, o, step, filter, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND n_fails = 1) AS unique_fails,
             sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost FROM x GROUP BY part, o, step, filter)
SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM r"""

ORACLE_SQL = {"op2_substring_dedup": _OP2_SQL, "op3_exact_top_k": _OP3_SQL, "op4_decontaminate": _OP4_SQL, "op5_warc": _OP5_SQL, "op1_license_scan": _op1_sql(), "op6_mix_sources": _OP6_SQL, "op10_line_dedup": _OP10_SQL, "op13_filter_audit": _OP13_SQL}
