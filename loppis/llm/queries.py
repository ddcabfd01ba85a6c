"""One query for each training-data operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, htmltext, jaccard, lexical, linededup, pii, quality, resample, secrets, sharding, substring, topk
from .common import table


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"), shards=24)


def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf, "documents"), fdr=0.01))


def vocabulary() -> str:
    """Place of the public tokenizer's file on the machines of the cluster; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), vocabulary())


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.digests(linededup.dedup(table(spark, sf, "documents"), min_docs=10, min_chars=1))


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan(table(spark, sf, "documents"))


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring.digests(substring.dedup(table(spark, sf, "documents"), width=35))


def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(table(spark, sf, "documents"), size=5, percent=80)


def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return htmltext.extract(table(spark, sf, "pages"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"), width=10))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report(table(spark, sf, "documents"))


def op11_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.nearest(table(spark, sf, "embeddings"), k=5, every=50, scale=256.0)


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), percent=25, least_words=20, buckets=10000, seed=7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_topk_search": op11_topk_search,
    "op12_lexical_search": op12_lexical_search,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op11_topk_search": r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT DISTINCT iid, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark)),
g AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * g.n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
m AS (SELECT rid, doc_id, 50 + (50 * len(t) * g.n) // g.l AS m FROM d, g WHERE len(t) > 0),
s AS (SELECT iid, item_id, m.rid, m.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * m.m))) AS BIGINT) AS score
      FROM b JOIN p USING (term) JOIN w USING (term) JOIN m ON p.rid = m.rid GROUP BY iid, item_id, m.rid, m.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_importance_resampling": r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT rid, f, count(*) AS n FROM (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY rid, f),
fb AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY f),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(len(x) // 2 AS BIGINT)), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT))), lambda a, y: xor(a >> 8, tab[xor(a & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM h, c),
s AS (SELECT bucket, sum(n) AS s FROM fd JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM fb JOIN k USING (f) GROUP BY bucket),
al AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS alls, (SELECT coalesce(sum(t), 0) FROM t) AS allt),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (alls + 10000) AS DOUBLE) / ((s + 1) * (allt + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), al),
wt AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY rid),
e AS (SELECT d.rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || doc_id), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN wt USING (rid)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS fits FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (25 * fits) // 100 THEN place END AS rank FROM r""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) >= 2),
hit AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM x JOIN r USING (h)),
t AS (SELECT rid, k, w[k] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
g AS (SELECT t.rid, count(hit.k) AS n_removed, string_agg(word, ' ' ORDER BY t.k) FILTER (WHERE hit.k IS NULL) AS kept
      FROM t LEFT JOIN hit ON t.rid = hit.rid AND t.k = hit.k GROUP BY t.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)""",
    "op3_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT d.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM d JOIN l USING (rid) LEFT JOIN f ON l.k = f.k GROUP BY d.rid, d.doc_id""",
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT rid, n, i, w[i : i + n - 1] AS win
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT rid, i, x.n, item_id FROM x JOIN p ON x.n = p.n AND x.win = p.win),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)""",
}
