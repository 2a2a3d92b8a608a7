"""The registered queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, html_extraction, license_scan, warc_index
from .decontaminate import build_index, contaminated, search
from .line_dedup import drop_repeated_lines
from .mtree_search import top_k
from .ngram_join import jaccard_groups
from .periodic_runs import collapse_runs
from .quality import classify, fit
from .substring_dedup import drop_repeated_passages
from .url_filter import Rule, judge_urls
from .whitening import whiten

#: The rules that the URL query applies, as (verdict, host, path).
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("d").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs)[1]).select("doc_id", F.round("quality_model.score", 6).alias("score"), "quality_model.keep")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_groups(_table(spark, sf_dir, "documents"), k=3, percent=90)
    return out.select(F.col("d").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, captures = warc_index.write_archives(_table(spark, sf_dir, "pages"))
    out = warc_index.read_keys(folder, warc_index.build_index(folder, captures), captures.select("key"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    """Where the vocabulary file lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_automaton.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "url_filter.host", "url_filter.path", "url_filter.rule", "url_filter.verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return license_scan.scan(docs).select("doc_id", "license_scan.license", "license_scan.score", "license_scan.origin", "license_scan.directory")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extraction.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents gets a tail that repeats, as the contract of operator 13 has it."""
    words = docs.select("doc_id", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    at = words.selectExpr("doc_id", "text", "w", "h", "size(w) as n", "h div 10 as g").selectExpr("*", "cast(g % greatest(n, 1) as int) as a")
    at = at.selectExpr("*", "cast(1 + (n - a) div (3 + g % 8) as int) as p")
    tail = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(1 + (n - a) div p as int)))), 1, n), ' ')")
    return at.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), tail).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(planted(_table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("periodic_runs.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    runs = F.when(F.size("periodic_runs.runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = [f"periodic_runs.{c}" for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    return out.select("doc_id", *best, F.sha2(runs, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_quality": op3_quality,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_html": op12_html,
    "op13_periodic_runs": op13_periodic_runs,
}

_SQL1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT k FROM q),
p AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, s WHERE len(w) >= k),
g AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM p),
m AS (SELECT g.doc_id, g.i, g.k, q.item_id FROM g JOIN q ON g.k = q.k AND g.g = q.g),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_SQL2 = r"""
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.uid <> c.uid),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_SQL4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 90 * (x.n + y.n - k)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.id WHERE r.c < b.v)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""

_SQL5 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep <> page_id THEN keep END AS refers_to FROM w
"""

_SQL7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS pos FROM p WHERE g IN (SELECT g FROM r)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT u.doc_id, count(*) FILTER (WHERE h.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY u.pos) FILTER (WHERE h.pos IS NULL) AS kept
  FROM u LEFT JOIN h ON u.doc_id = h.doc_id AND u.pos = h.pos GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_SQL8 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_SQL9 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, b.keep IS NOT NULL AND b.keep <> doc_id AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_SQL10 = r"""
WITH tpl AS (SELECT * FROM (VALUES %s) AS v(template, license, body, must, never)),
tt AS (SELECT template, license, term, count(*) AS c FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+(?:[.][0-9]+)*')) AS term FROM tpl) GROUP BY ALL),
docs AS (SELECT doc_id, concat_ws('/', source, lang) AS dir, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM docs),
low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM docs),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+(?:[.][0-9]+)*')) AS term FROM low) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM tt CROSS JOIN n LEFT JOIN df USING (term)),
w AS (SELECT template, license, term, c * idf / sqrt(sum((c * idf) * (c * idf)) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
seg AS (SELECT doc_id, 'header' AS kind, i, unnest(string_split(regexp_replace(text, '([.!?])[ \t]+([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS body FROM docs, (SELECT 1 AS i)
  UNION ALL SELECT doc_id, 'header', 2, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) FROM docs
  UNION ALL SELECT doc_id, 'file', 3, text FROM docs),
ns AS (SELECT *, row_number() OVER () AS ord FROM seg),
tf AS (SELECT doc_id, kind, ord, term, count(*) AS c FROM (SELECT doc_id, kind, ord, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:[.][0-9]+)*')) AS term FROM ns) GROUP BY ALL),
sw AS (SELECT tf.*, c * coalesce(idf, ln(1 + n) + 1) AS w FROM tf CROSS JOIN n LEFT JOIN idf USING (term)),
nm AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM sw GROUP BY ord),
nt AS (SELECT ord, sum(c) AS n_terms FROM tf GROUP BY ord),
sc AS (SELECT doc_id, kind, ord, license, template, any_value(n_terms) AS n_terms, round(sum(w * weight) / any_value(norm), 6) AS score FROM sw JOIN w USING (term) JOIN nm USING (ord) JOIN nt USING (ord) GROUP BY doc_id, kind, ord, license, template),
st AS (SELECT ord, list(term) AS terms FROM tf GROUP BY ord),
g AS (SELECT sc.*, bool_or(kind = 'file') OVER (PARTITION BY doc_id) AS whole FROM sc JOIN tpl USING (template) JOIN st USING (ord) WHERE score >= 0.7 AND list_has_all(terms, must) AND NOT list_has_any(terms, never)),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_terms DESC, score DESC, template) = 1),
fl AS (SELECT dir, license, score FROM b JOIN docs USING (doc_id) WHERE whole QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, dir || '/' || doc_id::VARCHAR || '.txt') = 1)
SELECT d.doc_id, coalesce(b.license, fl.license) AS license, coalesce(b.score, fl.score) AS score,
  CASE WHEN b.license IS NOT NULL THEN 'header' WHEN fl.license IS NOT NULL THEN 'directory' END AS origin,
  CASE WHEN b.license IS NULL AND fl.license IS NOT NULL THEN d.dir END AS directory
FROM docs d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN fl ON fl.dir = d.dir
""" % ", ".join(
    "({}, '{}', '{}', {}::VARCHAR[], {}::VARCHAR[])".format(k, name, body.replace("'", "''"), *(str(sorted(x)) for x in license_scan.telling(body))) for k, (name, body) in enumerate(license_scan.TEMPLATES)
)

_SQL12 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
  regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\s\x0B\x{A0}]+', ' ', 'g'))) AS lines FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

_SQL13 = r"""
WITH t AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x::BIGINT) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295) AS h FROM documents),
g AS (SELECT *, (h // 10) % len(w) AS a, CASE WHEN h % 10 = 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p FROM t),
x0 AS (SELECT u, p, a, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM g WHERE len(w) > 0),
x AS (SELECT x0.u, x0.i, y.word FROM x0 JOIN x0 y ON y.u = x0.u AND y.i = CASE WHEN x0.p IS NULL OR x0.i < x0.a THEN x0.i ELSE x0.a + (x0.i - x0.a) % x0.p END),
n AS (SELECT u, count(*) AS n FROM x GROUP BY u),
l AS (SELECT u, n, q, greatest(24 - q, 2 * q) AS m FROM (SELECT u, n, unnest(generate_series(1, n // 3)) AS q FROM n WHERE n >= 24)),
s AS (SELECT u, n, q, m, unnest(range(0, n - q, m // 4)) AS j FROM l),
e AS (SELECT s.u, n, q, m, j FROM s JOIN x b ON b.u = s.u AND b.i = s.j JOIN x c ON c.u = s.u AND c.i = s.j + s.q WHERE b.word = c.word),
c AS (SELECT DISTINCT e.u, e.n, e.q, e.m FROM e JOIN e f ON f.u = e.u AND f.q = e.q AND f.j = e.j + e.m // 4 JOIN e k ON k.u = e.u AND k.q = e.q AND k.j = e.j + 2 * (e.m // 4)),
b AS (SELECT c.u, c.q, c.m, y.i FROM c JOIN x y ON y.u = c.u AND y.i < c.n - c.q JOIN x z ON z.u = c.u AND z.i = y.i + c.q WHERE y.word <> z.word
  UNION ALL SELECT u, q, m, -1 FROM c UNION ALL SELECT u, q, m, n - q FROM c),
r AS (SELECT u, start, length, min(q) AS period FROM (SELECT u, q, m, i + 1 AS start, lead(i) OVER (PARTITION BY u, q ORDER BY i) - i - 1 AS same FROM b) AS v, LATERAL (SELECT same + q AS length) WHERE same >= m GROUP BY ALL),
o AS (SELECT u, count(*) AS n_runs, arg_max(struct_pack(start, length, period), struct_pack(e := length / period, s := -start, p := -period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY u),
k AS (SELECT u, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = x.u AND x.i >= start + period AND x.i < start + length) GROUP BY u)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length) // best.period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN o USING (u) LEFT JOIN k USING (u)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _SQL1, "op2_mtree_topk": _SQL2, "op4_ngram_jaccard": _SQL4, "op5_warc": _SQL5, "op7_substring_dedup": _SQL7, "op8_url_filter": _SQL8, "op9_line_dedup": _SQL9, "op10_license_scan": _SQL10, "op12_html": _SQL12, "op13_periodic_runs": _SQL13}
