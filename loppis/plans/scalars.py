"""Scalar functions over whole columns of the stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loppis.functions import dates, money, nested, text
from loppis.session import table

from .base import Book

book = Book()


def _over(name: str, source: str, key: str, made: Callable[[], dict[str, Column]], sql: dict[str, str] | str, where: str | None = None) -> None:
    """A query of `key` and made columns (built when a session is there) over a whole table; sql: the same columns for
    DuckDB, or the whole statement."""

    def run(spark, sf):
        df = table(spark, sf, source)
        return (df.filter(where) if where else df).select(*key.split(", "), *[c.alias(n) for n, c in made().items()])

    if isinstance(sql, dict):
        listed = ", ".join(f"{s} AS {n}" for n, s in sql.items())
        sql = f"SELECT {key}, {listed} FROM {source}{f' WHERE {where}' if where else ''}"
    book.add(name, run, sql)


T = lambda: F.col("text")
_norm = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_dash = "regexp_replace(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_over("f01_normalized_text", "documents", "doc_id", lambda: {"value": text.normalized_text(T())}, {"value": _norm.format("text")})
_over("f02_alnum_key", "documents", "doc_id", lambda: {"value": text.alnum_key(T())}, {"value": "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')"})
_over("f03_without_separators", "documents", "doc_id", lambda: {"value": text.without_separators(T())}, {"value": r"regexp_replace(lower(text), '[-\s_]+', '', 'g')"})
_over(
    "f04_normalize_query", "documents", "doc_id", lambda: {"value": text.normalize_query(T())},
    {"value": "trim(regexp_replace(regexp_replace(replace(replace(replace(translate(lower(text), 'àáâãèéêëìíîïòóôõùúûüýÿñç', 'aaaaeeeeiiiioooouuuuyync'), 'ß', 'ss'), 'ö', 'oe'), 'ä', 'ae'), '[^a-z0-9æøå\\-* ]', '', 'g'), ' +', ' ', 'g'))"},
)
_over("f05_slug_accents", "documents", "doc_id", lambda: {"value": text.slugify_accents(T())}, {"value": _dash.format("strip_accents(lower(text))")})
_over("f06_slug", "documents", "doc_id", lambda: {"value": text.slugify(T())}, {"value": _dash.format("lower(text)")})
_over("f07_slug_partial", "documents", "doc_id", lambda: {"value": text.slugify_partial(T())}, {"value": _dash.format("translate(lower(text), 'àáâäéèêë', 'aaaaeeee')")})
_over(
    "f08_slug_hyphen_first", "documents", "doc_id", lambda: {"value": text.slugify_hyphen_first(T())},
    {"value": r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[\s/\-]+', '-', 'g'), '[^a-z0-9\-]', '', 'g'), '^-+|-+$', '', 'g')"},
)
_over(
    "f09_contains_token", "documents", "doc_id",
    lambda: {"has_with": text.contains_token(T(), F.lit("with")), "has_the": text.contains_token(T(), F.lit("The")), "has_of": text.contains_token(T(), F.lit("of"))},
    {"has_with": r"regexp_matches(' ' || text || ' ', '(?i)[^\w-]with[^\w-]')", "has_the": r"regexp_matches(' ' || text || ' ', '(?i)[^\w-]the[^\w-]')", "has_of": "false"},
)
_over("f10_regex_escape", "pages", "page_id", lambda: {"value": text.regex_escape(F.col("url"))}, {"value": r"regexp_replace(url, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')"})
_tok = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
_over("f11_tokens", "documents", "doc_id", lambda: {"n_tokens": F.size(text.tokens(T())).cast("long"), "joined": F.array_join(text.tokens(T()), " ")}, {"n_tokens": f"len({_tok.format('text')})", "joined": f"array_to_string({_tok.format('text')}, ' ')"})
_title = lambda: F.concat_ws(" ", "p_name", "p_type", "p_brand")
_sqltitle = "p_name || ' ' || p_type || ' ' || p_brand"
_want = lambda: F.concat_ws(" ", F.split("p_name", " ")[1], F.lower("p_type"), F.lit("extra"))
_sqlwant = "split_part(p_name, ' ', 2) || ' ' || lower(p_type) || ' extra'"


def token_score_sql(want: str, title: str) -> str:
    """DuckDB's form of the token score of two string expressions."""
    w, t = _tok.format(want), _tok.format(title)
    share = f"(len(list_filter({w}, lambda t: list_contains({t}, t))) / len({w}))"
    return f"floor((CASE WHEN starts_with(array_to_string({t}, ' '), array_to_string({w}, ' ')) THEN least(1.0, {share} + 0.1) ELSE {share} END) * 100 + 0.5) / 100"


_sqlscore = token_score_sql(_sqlwant, _sqltitle)
_over(
    "f12_token_score", "part", "p_partkey",
    lambda: {"score": text.token_score(_want(), _title()), "own": text.token_score(F.col("p_name"), _title()), "back": text.token_score(_title(), F.col("p_name"))},
    {"score": _sqlscore, "own": token_score_sql("p_name", _sqltitle), "back": token_score_sql(_sqltitle, "p_name")},
)
_over(
    "f13_confidence", "part", "p_partkey", lambda: {"level": text.confidence(text.token_score(_want(), _title()), F.size(text.tokens(_want())))},
    {"level": f"CASE WHEN {_sqlscore} >= 0.95 THEN 'high' WHEN {_sqlscore} >= 0.75 THEN 'medium' WHEN {_sqlscore} >= 0.5 THEN 'low' ELSE 'none' END"},
)
_over(
    "f14_extract_model", "part", "p_partkey", lambda: {"model": text.extract_model(F.concat_ws(" - ", F.upper("p_brand"), "p_name", "p_type"), F.col("p_brand"))},
    {"model": "left(p_name || ' - ' || p_type, 80)"},
)
_small = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def search_term_sql(rows: str, z: str = "z") -> str:
    """DuckDB CTEs that end in z (key, value): the search terms of rows (key, t)."""
    adjectives = "|".join(text.NOISE_ADJECTIVES)
    return rf"""{z}1 AS (SELECT key, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM ({rows})),
{z}2 AS (SELECT key, t, string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g'), '[:|*!]', '', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM {z}1),
{z}3 AS (SELECT key, t, array_to_string(CASE WHEN len(w) > 2 AND {_small.format("w[1]")} = {_small.format("w[2]")} THEN list_concat(w[1:1], w[3:]) ELSE w END, ' ') AS u FROM {z}2),
{z}4 AS (SELECT key, t, regexp_replace(regexp_replace(regexp_replace(u, '\s*\d{{4}}.*$', ''), '(?i)\s*\d+[-\s]?keys?\b', '', 'g'), '(?i)\b({adjectives})\b', '', 'g') AS u FROM {z}3),
{z} AS (SELECT key, coalesce(nullif(array_to_string(string_split(trim(regexp_replace(regexp_replace(u, '[-\s]+$', ''), '\s+', ' ', 'g')), ' ')[1:4], ' '), ''), t) AS value FROM {z}4)"""


_heads = ["", "Korg KORG Classic [x] (y) 61-Keys: ", "Moog Vintage!  ", "Roland Jupiter-8 Black | 1983 "]
_headed = lambda: F.concat(F.element_at(F.array(*map(F.lit, _heads)), (F.col("doc_id") % 4 + 1).cast("int")), T())
_sqlheaded = f"{_heads!r}[doc_id % 4 + 1] || text"
_over(
    "f15_strip_search_term", "documents", "doc_id", lambda: {"value": text.strip_search_term(T()), "headed": text.strip_search_term(_headed())},
    f"WITH {search_term_sql('SELECT doc_id AS key, text AS t FROM documents', 'a')}, {search_term_sql(f'SELECT doc_id AS key, {_sqlheaded} AS t FROM documents', 'b')} SELECT key AS doc_id, a.value, b.value AS headed FROM a JOIN b USING (key)",
)
_sqlgrams = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_ga, _gb = _sqlgrams.format("p_name"), _sqlgrams.format("p_type || ' ' || p_name || ' ' || p_brand")
_over(
    "f16_trigram", "part", "p_partkey", lambda: {"sim": F.round(text.trigram_similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", "p_brand")), 6)},
    {"sim": f"round(len(list_intersect({_ga}, {_gb})) / len(list_distinct(list_concat({_ga}, {_gb}))), 6)"},
)
_x, _y = _norm.format("p_name || p_name"), _norm.format("p_name || ' ' || p_type")
_ba, _bb = (f"list_transform(range(1, len({v})), lambda i: substr({v}, i, 2))" for v in (_x, _y))
_over(
    "f17_dice", "part", "p_partkey", lambda: {"sim": F.round(text.dice(F.concat("p_name", "p_name"), F.concat_ws(" ", "p_name", "p_type")), 6)},
    {"sim": f"round(2.0 * len(list_filter({_ba}, lambda g: list_contains({_bb}, g))) / (len({_ba}) + len({_bb})), 6)"},
)
_sqlonce = rf"CASE WHEN {_small.format('m.a')} = {_small.format('m.c')} AND m.a <> '' THEN m.a || substr({{0}}, len(m.a) + len(m.b) + len(m.c) + 1) ELSE {{0}} END"
_sqlclean = rf"trim(regexp_replace({_sqlonce}, '(?i)\s+-\s+({'|'.join(text.COLOURS)})\s*$', ''))"
_sqlpair = r"regexp_extract({0}, '^(\S+)(\s+)(\S+)\s', ['a', 'b', 'c'])"
_named = lambda: F.concat(F.when(F.col("doc_id") % 3 > 0, "JoMox jomox\t").otherwise(""), T(), F.when(F.col("doc_id") % 2 == 0, " - Vintage white ").otherwise(" - "))
_sqlnamed = "CASE WHEN doc_id % 3 > 0 THEN 'JoMox jomox' || chr(9) ELSE '' END || text || CASE WHEN doc_id % 2 = 0 THEN ' - Vintage white ' ELSE ' - ' END"
_over(
    "f18_clean_name", "documents", "doc_id", lambda: {"value": text.clean_name(T()), "named": text.clean_name(_named())},
    f"""WITH d AS (SELECT doc_id, text, {_sqlnamed} AS n FROM documents)
SELECT a.doc_id, value, named FROM (SELECT doc_id, {_sqlclean.format("text")} AS value FROM (SELECT *, {_sqlpair.format("text")} AS m FROM d)) a
JOIN (SELECT doc_id, {_sqlclean.format("n")} AS named FROM (SELECT *, {_sqlpair.format("n")} AS m FROM d)) b USING (doc_id)""",
)
_flags = (
    "CASE WHEN regexp_matches(text, '\\d{4}') THEN 'has_year' END, CASE WHEN regexp_matches(text, '(?i)refin|relic|aged|murphy\\s+lab|played\\s+in') THEN 'has_condition_word' END, "
    "CASE WHEN regexp_matches(text, '(?i)chitarra|basso|clavier|guitare|elektrisch|gitarre|acustica|elettrico|elettrica') THEN 'has_language_qualifier' END, "
    "CASE WHEN source = lang THEN 'duplicated_brand' END, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) > 8 THEN 'too_long' END"
)
_over(
    "f19_dirty_flags", "documents", "doc_id", lambda: {"flags": F.array_join(text.dirty_flags(F.concat_ws("-", "source", "lang"), F.regexp_replace(T(), "^ +| +$", "")), ",")},
    {"flags": f"concat_ws(',', {_flags})"},
)
_over(
    "f20_brand_name", "part", "p_partkey", lambda: {"name": text.brand_name(text.slugify(F.concat_ws(" ", "p_brand", "p_name")))},
    {"name": "'Brand ' || substr(p_brand, 7) || ' ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"},
)
U = lambda: F.col("url")
_over(
    "f21_listing_id", "pages", "page_id", lambda: {"value": text.listing_id(F.regexp_replace(U(), "/(en|de)/", "/item/"))},
    {"value": r"coalesce(nullif(regexp_extract(regexp_replace(url, '/(en|de)/', '/item/', 'g'), '/item/(\d+)', 1), ''), regexp_replace(url, '/(en|de)/', '/item/', 'g'))"},
)
_over("f22_url_host", "pages", "page_id", lambda: {"host": text.url_host(U())}, {"host": r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '')"})
_market = lambda: F.regexp_replace(F.regexp_replace(U(), r"https?://(www|m)\.[^/]+/en/", "https://www.dba.dk/recommerce/"), r"https?://blog\.[^/]+/(en|fr)/", "https://reverb.com/item/")
_sqlmarket = r"regexp_replace(regexp_replace(url, 'https?://(www|m)\.[^/]+/en/', 'https://www.dba.dk/recommerce/'), 'https?://blog\.[^/]+/(en|fr)/', 'https://reverb.com/item/')"
_over(
    "f22_marketplace", "pages", "page_id", lambda: {"market": text.marketplace_of(_market()), "dba": text.is_dba_listing(_market())},
    {"market": f"CASE WHEN {_sqlmarket} LIKE 'https://www.dba.dk/%' THEN 'dba' WHEN {_sqlmarket} LIKE 'https://reverb.com/item/%' THEN 'reverb' END", "dba": f"{_sqlmarket} LIKE 'https://www.dba.dk/%'"},
)
_file = lambda: F.concat(F.lit("https://www.thomann.dk/gb/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 3 == 0, "_set").otherwise(""), F.lit(".htm"))
_sqlfile = "replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '_set' ELSE '' END"
_over(
    "f24_sitemap_filename", "part", "p_partkey", lambda: {"file": text.sitemap_filename(_file()), "bundle": text.is_bundle(text.sitemap_filename(_file()))},
    {"file": _sqlfile, "bundle": f"regexp_matches({_sqlfile}, '(?i)[_-](bundle|pack|set|kit|rig|starter|combo|value|deal)\\b')"},
)
_over("f23_is_dba", "pages", "page_id", lambda: {"dba": text.is_dba_listing(_market())}, {"dba": f"{_sqlmarket} LIKE 'https://www.dba.dk/%'"})
_over(
    "f25_is_bundle", "part", "p_partkey", lambda: {"bundle": text.is_bundle(text.sitemap_filename(_file()))},
    {"bundle": f"regexp_matches({_sqlfile}, '(?i)[_-](bundle|pack|set|kit|rig|starter|combo|value|deal)\\b')"},
)
_product = lambda: F.when(F.col("p_size") % 3 == 0, F.concat_ws(" ", "p_brand", "p_name", F.concat(F.lit("MX-"), F.col("p_size").cast("string")))).when(F.col("p_size") % 3 == 1, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.concat_ws(" ", F.split("p_name", " ")[0], F.concat(F.lit("X"), F.col("p_size").cast("string")), "p_type"))
_over(
    "f26_synonym_variants", "part", "p_partkey", lambda: {"variants": F.array_join(text.synonym_variants(text.slugify(_product()), _product()), "|")},
    f"""WITH a AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ' ' || p_name || ' MX-' || p_size WHEN 1 THEN p_brand || ' ' || p_name ELSE split_part(p_name, ' ', 1) || ' X' || p_size || ' ' || p_type END AS name FROM part),
b AS (SELECT p_partkey, {_dash.format("lower(name)")} AS key, string_split(name, ' ') AS w FROM a),
c AS (SELECT *, coalesce(list_min(list_filter(range(2, len(w) + 1), lambda i: regexp_matches(w[i], '^([0-9]|[A-Z]([^a-z]|$))'))) - 1, 1) AS n FROM b),
d AS (SELECT p_partkey, key, lower(array_to_string(w[1:n], ' ')) AS brand, lower(array_to_string(w[n + 1:], ' ')) AS model FROM c),
e AS (SELECT *, replace(model, '-', ' ') AS spaced, replace(replace(model, '-', ''), ' ', '') AS joined FROM d),
v AS (SELECT p_partkey, key, unnest([model, spaced, brand || ' ' || spaced, CASE WHEN len(joined) > 2 OR joined = model THEN joined END, CASE WHEN len(joined) BETWEEN 2 AND 8 THEN brand || joined END]) AS v FROM e)
SELECT p_partkey, coalesce(string_agg(DISTINCT v, '|' ORDER BY v) FILTER (WHERE len(v) > 1 AND v <> key AND v <> replace(key, '-', ' ')), '') AS variants FROM v GROUP BY 1""",
)
_over(
    "f27_query_synonym", "part", "p_partkey", lambda: {"term": text.query_synonym(F.when(F.col("p_size") % 2 == 0, "re201").otherwise(F.col("p_name")))},
    {"term": "CASE WHEN p_size % 2 = 0 THEN 're-201' END"},
)
_kw = "lower(text)"
_over(
    "f28_instrument_type", "documents", "doc_id", lambda: {"kind": text.instrument_type(T())},
    {"kind": "CASE " + " ".join(f"WHEN regexp_matches({_kw}, '{y}')" + (f" AND NOT regexp_matches({_kw}, '{n}')" if n else "") + f" THEN '{k}'" for k, y, n in text.TYPE_RULES) + " ELSE 'synthesizer' END"},
)
_year = lambda n: (F.col("page_id") % n + 1970).cast("string")
_told = lambda: F.concat(
    F.lit(" "),
    F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("It was Introduced by them in "), _year(29)))
    .when(F.col("page_id") % 5 == 1, F.concat(F.lit("1996-2021, then "), _year(7), F.lit(" – "), _year(40)))
    .when(F.col("page_id") % 5 == 2, F.concat(F.lit("in 1965, "), _year(11), F.lit(", 1964, "), _year(13), F.lit(" and 1965, 1964")))
    .when(F.col("page_id") % 5 == 3, F.concat(F.lit("1951 to 1990, once "), _year(17)))
    .otherwise("no year"),
    F.lit(". "),
)
_YR = r"19[5-9]\d|20[012]\d"
_over(
    "f29_production_era", "pages", "page_id", lambda: {"era": text.production_era(F.concat("html", _told(), "html")), "none": text.production_era(F.col("html"))},
    rf"""WITH a AS (SELECT page_id, html || ' ' || CASE page_id % 5 WHEN 0 THEN 'It was Introduced by them in ' || (1970 + page_id % 29) WHEN 1 THEN '1996-2021, then ' || (1970 + page_id % 7) || ' – ' || (1970 + page_id % 40)
WHEN 2 THEN 'in 1965, ' || (1970 + page_id % 11) || ', 1964, ' || (1970 + page_id % 13) || ' and 1965, 1964' WHEN 3 THEN '1951 to 1990, once ' || (1970 + page_id % 17) ELSE 'no year' END || '. ' || html AS h FROM pages),
b AS (SELECT page_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, substr(t, 501, greatest(len(t) - 1500, 0)) AS t FROM b),
d AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(t, '\b({_YR})\s*[-–to]+\s*({_YR})\b'), lambda r: [CAST(left(r, 4) AS INT), CAST(right(r, 4) AS INT)]), lambda p: NOT (p[1] = 1996 AND p[2] >= 2020) AND p[2] - p[1] <= 30 AND p[1] >= 1960 AND p[2] <= 2030) AS spans,
nullif(regexp_extract(t, '(?i)(?:{text.INTRODUCED})[^.]{{0,60}}\b({_YR})\b', 1), '') AS intro, list_filter(regexp_extract_all(t, '\b(19[6-9]\d|20[01]\d)\b'), lambda y: y BETWEEN '1963' AND '2025') AS ys FROM c),
e AS (SELECT page_id, y, count(*) AS n, min(i) AS i FROM (SELECT page_id, unnest(ys) AS y, generate_subscripts(ys, 1) AS i FROM d) GROUP BY 1, 2 HAVING count(*) > 1),
f AS (SELECT page_id, arg_min(y, (-n, i)) AS y FROM e GROUP BY 1)
SELECT page_id, coalesce(spans[1][1] || '-' || spans[1][2], intro, y, '') AS era, '' AS none FROM d LEFT JOIN f USING (page_id)""",
)
_over(
    "f30_deterministic_id", "pages", "page_id", lambda: {"id": text.deterministic_id(F.lit("shop"), U())},
    {"id": "regexp_replace(left(sha256('shop:' || url), 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"},
)
_over(
    "f31_normal_specs", "part", "p_partkey",
    lambda: {"specs": F.to_json(text.normal_specs(F.create_map(F.lit("Control"), F.concat(F.lit("MIDI "), "p_type"), F.lit("Polyphony"), F.col("p_name"), F.lit("Other"), F.col("p_brand"))))},
    {"specs": "'{\"control\":\"MIDI ' || p_type || '\",\"polyphony\":\"' || p_name || '\",\"midi\":\"true\"}'"},
)
_over(
    "f32_shorten", "documents", "doc_id", lambda: {"value": text.shorten(T())},
    {"value": "CASE WHEN len(text) <= 60 THEN text WHEN contains(left(text, 60), ' ') THEN regexp_replace(left(text, 60), '(?s) [^ ]*$', '') ELSE left(text, 60) END"},
)
_over(
    "f33_unescape", "pages", "page_id", lambda: {"value": F.md5(text.unescape_slashes(text.unescape_entities(F.col("html"))))},
    {"value": "md5(replace(replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&amp;', '&'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\\/', '/'))"},
)
_over("f34_bump_minor", "part", "p_partkey", lambda: {"version": text.bump_minor(F.concat_ws(".", F.lit("2"), F.col("p_size").cast("string"), F.lit("7")))}, {"version": "'2.' || (p_size + 1) || '.0'"})
_over("f35_slug_tail", "part", "p_partkey", lambda: {"tail": text.slug_tail(F.when(F.col("p_size") % 2 == 0, F.concat_ws("/", "p_type", "p_name")).otherwise(F.col("p_type")))}, {"tail": "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END"})
_over(
    "f36_brand_of_path", "part", "p_partkey", lambda: {"brand": text.brand_of_path(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Keys / "), "p_name", F.lit(" / Item"))).when(F.col("p_size") % 3 == 1, F.lit("Keys / Synths / Korg M1")).otherwise(F.lit("Keys / Roland")))},
    {"brand": "CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'korg' ELSE 'roland' END"},
)
_over("f37_unfence", "events", "event_id", lambda: {"value": text.unfence(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))}, {"value": "props"})

# money
_cur = lambda: F.element_at(F.array(*map(F.lit, ["DKK", "SEK", "NOK", "EUR", "USD", "GBP", "XYZ"])), F.col("c_nationkey") % 7 + 1)
_sqlcur = "c_nationkey % 7"
_c = lambda: F.col("c_acctbal")
_case = lambda rates, other: f"CASE {_sqlcur} " + " ".join(f"WHEN {i} THEN {r}" for i, r in rates.items()) + f" ELSE {other} END"
_approx = _case({0: 1.0, 1: 0.65, 2: 0.60, 3: 7.45, 4: 7.0, 5: 8.8}, "NULL")
_batch = {0: 1.0, 1: 0.65, 2: 0.63, 3: 7.46, 4: 7.0}
_over("f40_to_dkk_null", "customer", "c_custkey", lambda: {"dkk": money.to_dkk(_c(), _cur())}, {"dkk": f"CAST(floor(c_acctbal * CAST({_approx} AS DOUBLE) + 0.5) AS BIGINT)"})
_over("f41_to_dkk_usd", "customer", "c_custkey", lambda: {"dkk": money.to_dkk(_c(), _cur(), money.BATCH, "usd")}, {"dkk": f"CAST(floor(c_acctbal * CAST({_case(_batch, 7.0)} AS DOUBLE) + 0.5) AS BIGINT)"})
_over("f43_to_dkk_one", "customer", "c_custkey", lambda: {"dkk": money.to_dkk(_c(), _cur(), money.BATCH, "one")}, {"dkk": f"CAST(floor(c_acctbal * CAST({_case(_batch, 1.0)} AS DOUBLE) + 0.5) AS BIGINT)"})
_usd = lambda: money.cross_rates({"DKK": F.col("c_acctbal") + 1, "EUR": F.col("c_nationkey") + 1})
_inv = lambda: money.inverted_rates({"EUR": F.col("c_nationkey") + 1})
_over("f42_cross_rates", "customer", "c_custkey", lambda: {"eur": F.round(_usd()["EUR"], 6), "inverted": F.round(_inv()["EUR"], 6)}, {"eur": "round((c_acctbal + 1) / (c_nationkey + 1), 6)", "inverted": "round(1 / (c_nationkey + 1), 6)"})
_over("f44_round_half_up", "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", lambda: {"r": money.round_half_up(F.col("l_quantity") / 2 - 12)}, {"r": "CAST(floor(l_quantity / 2 - 12 + 0.5) AS BIGINT)"})
_over(
    "f45_parse_number", "customer", "c_custkey", lambda: {"i": money.parse_int(F.concat(F.col("c_acctbal").cast("string"), F.lit("abc"))), "none": money.parse_int(F.col("c_name")), "f": money.parse_float(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(".5x")))},
    {"i": "CAST(trunc(c_acctbal) AS BIGINT)", "none": "CAST(NULL AS BIGINT)", "f": "c_nationkey + 0.5"},
)
_over("f46_parse_amount", "customer", "c_custkey", lambda: {"amount": money.parse_amount(F.concat(F.format_number(F.abs(_c()), 0), F.lit(" DKK")))}, {"amount": "CAST(round_even(abs(c_acctbal), 0) AS BIGINT)"})
_over("f47_discount", "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", lambda: {"off": money.discount_percent(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice"))}, {"off": "CASE WHEN l_extendedprice > l_extendedprice * (1 - l_discount) THEN CAST(floor((1 - l_extendedprice * (1 - l_discount) / l_extendedprice) * 100 + 0.5) AS BIGINT) END"})
_over("f48_format_price", "part", "p_partkey", lambda: {"shown": money.format_dkk(F.col("p_size") * 12345)}, {"shown": "replace(format('{:,}', p_size * 12345), ',', '.') || ' kr.'"})
_over("f49_page_maths", "part", "p_partkey", lambda: {"pages": money.page_count(F.col("p_size"), F.lit(20)), "size": money.clamp(F.col("p_size"), 5, 40)}, {"pages": "CAST(ceil(p_size / 20) AS BIGINT)", "size": "least(greatest(p_size, 5), 40)"})
_tier = lambda: F.when(F.col("p_size") >= 45, "legendary").when(F.col("p_size") >= 35, "classic").otherwise("standard")
_hero = lambda: F.when(F.col("p_partkey") % 3 == 0, "hero.jpg")
_img = lambda: F.when(F.col("p_partkey") % 2 == 0, "img.jpg")
_over(
    "f50_image_score", "part", "p_partkey", lambda: {"score": money.image_score(_tier(), _hero(), _img())},
    {"score": "CASE WHEN p_size >= 45 AND p_partkey % 3 = 0 THEN 6 WHEN p_size BETWEEN 35 AND 44 AND p_partkey % 3 = 0 THEN 5 WHEN p_size >= 45 AND p_partkey % 2 = 0 THEN 4 WHEN p_size BETWEEN 35 AND 44 AND p_partkey % 2 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END"},
)

# dates
_over(
    "f60_hammered_date", "orders", "o_orderkey", lambda: {"day": F.date_format(dates.hammered_date(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Hammered "), F.date_format("o_orderdate", "d MMM yyyy"))).otherwise("Ends soon")), "yyyy-MM-dd")},
    {"day": "CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END"},
)
_over("f61_epoch_order", "events", "event_id", lambda: {"ms": F.unix_millis(F.col("ts").cast("timestamp"))}, {"ms": "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"})
_NOW = lambda: F.lit("2024-01-20 00:00:00").cast("timestamp")
_over("f62_stale", "events", "event_id", lambda: {"stale": F.col("ts").cast("timestamp") < dates.stale_before(_NOW(), hours=48), "old": F.col("ts").cast("timestamp") < dates.stale_before(_NOW(), days=14)}, {"stale": "ts < TIMESTAMP '2024-01-18'", "old": "ts < TIMESTAMP '2024-01-06'"})
_sec = "CAST(floor(epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts))) AS BIGINT)"
_over(
    "f63_age", "events", "event_id", lambda: {"age": dates.age(F.col("ts").cast("timestamp"), _NOW())},
    {"age": f"CASE WHEN {_sec} < 60 THEN 'Just now' WHEN {_sec} < 3600 THEN CAST(floor({_sec} / 60) AS BIGINT) || 'm ago' WHEN {_sec} < 86400 THEN CAST(floor({_sec} / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor({_sec} / 86400) AS BIGINT) || 'd ago' END"},
)
_over("f64_production_years", "part", "p_partkey", lambda: {"years": text.production_years(F.concat(F.lit("It was introduced in 19"), (F.col("p_size") + 40).cast("string"), F.lit(".")))}, {"years": "'19' || (p_size + 40) || '–'"}, where="p_size < 50")
_over("f65_valid_year", "part", "p_partkey", lambda: {"ok": dates.valid_year(F.col("p_size") * 5 + 1850)}, {"ok": "p_size * 5 + 1850 BETWEEN 1900 AND 2030"})

# arrays, maps, JSON
_over("f70_slice", "documents", "doc_id", lambda: {"first": F.array_join(F.slice(F.split(T(), " "), 1, 6), " ")}, {"first": "array_to_string(string_split(text, ' ')[1:6], ' ')"})
_over("f71_every_some", "documents", "doc_id", lambda: {"every": text.all_words(T(), F.array(F.lit("th"), F.lit("An"))), "some": F.exists(F.split(T(), " "), lambda w: w == "the")}, {"every": "contains(lower(text), 'th') AND contains(lower(text), 'an')", "some": "list_contains(string_split(text, ' '), 'the')"})
_over("f72_distinct_sorted", "documents", "doc_id", lambda: {"n": F.size(F.array_distinct(F.split(T(), " "))).cast("long"), "least": F.sort_array(F.array_distinct(F.split(T(), " ")))[0]}, {"n": "len(list_distinct(string_split(text, ' ')))", "least": "list_min(string_split(text, ' '))"})
_over("f73_json_path", "events", "event_id", lambda: {"k": F.get_json_object("props", "$.k").cast("int")}, {"k": "CAST(json_extract_string(props, '$.k') AS INTEGER)"})
_over("f74_object_merge", "events", "event_id", lambda: {"merged": F.to_json(nested.merged(F.from_json("props", "map<string,int>"), F.create_map(F.lit("v"), F.lit(1))))}, {"merged": "replace(replace(props, ' ', ''), '}', ',\"v\":1}')"})
_over("f75_shown_specs", "events", "event_id", lambda: {"shown": F.to_json(nested.shown_specs(F.create_map(F.lit("_source"), F.col("event_type"), F.lit("type"), F.col("event_type"), F.lit("none"), F.lit(None).cast("string"))))}, {"shown": "'{\"type\":\"' || event_type || '\"}'"})
_over("f76_tuple_index", "part", "p_partkey", lambda: {"low": F.get(F.array("p_size", F.col("p_size") + 5), F.lit(0)), "none": F.get(F.array("p_size"), F.lit(1))}, {"low": "p_size", "none": "CAST(NULL AS INTEGER)"})
_over("f77_array_membership", "documents", "doc_id", lambda: {"has": F.array_contains(F.split(T(), " "), "of")}, {"has": "list_contains(string_split(text, ' '), 'of')"})
_over(
    "f78_location", "customer", "c_custkey", lambda: {"code": nested.country_code(F.concat_ws(", ", "c_name", F.when(F.col("c_nationkey") % 2 == 0, "Denmark").otherwise("Atlantis"))), "shown": nested.location_shown(F.when(F.col("c_nationkey") % 3 == 0, "reverb").when(F.col("c_nationkey") % 3 == 1, "finn").otherwise("thomann"), F.lit("Lyon, France"))},
    {"code": "CASE WHEN c_nationkey % 2 = 0 THEN 'DK' END", "shown": "CASE c_nationkey % 3 WHEN 0 THEN 'FR France' WHEN 1 THEN 'NO' END"},
)
