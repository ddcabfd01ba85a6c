"""String functions over listing titles, names and slugs, as Column expressions.

Only the accent-stripping slug needs Python, Arrow-batched.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nested import let


def _lit_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# --- normal forms ---------------------------------------------------------------------------------------------------


def normalized_text(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def alnum_key(c: Column) -> Column:
    """Lower case without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def without_separators(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-\s_]+", "")


#: Letters folded one to one, ü to u before the two-letter foldings.
FOLD_FROM, FOLD_TO = "àáâãèéêëìíîïòóôõùúûüýÿñç", "aaaaeeeeiiiioooouuuuyync"


def normalize_query(c: Column) -> Column:
    """Search-query form: folded, a-z, 0-9, æøå, hyphen, space and * only. Tabs are deleted, not spaced."""
    folded = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    for letter, pair in (("ß", "ss"), ("ö", "oe"), ("ä", "ae")):
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9æøå\-* ]", ""), " +", " "))


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(c: Column) -> Column:
    """ASCII slug: everything else becomes a hyphen, accented letters too."""
    return _dashed(F.lower(c))


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    marks = re.compile("[̀-ͯ]")
    return s.map(lambda x: x if x is None or x.isascii() else marks.sub("", unicodedata.normalize("NFD", x)))


def slugify_accents(c: Column) -> Column:
    """Slug of the letters without their accents."""
    return _dashed(_decomposed(F.lower(c)))


def slugify_partial(c: Column) -> Column:
    """Slug that folds only the a and e accents."""
    return _dashed(F.translate(F.lower(c), "àáâäéèêë", "aaaaeeee"))


def slugify_hyphen_first(c: Column) -> Column:
    """Spaces, slashes and hyphens to one hyphen; other characters vanish."""
    spaced = F.regexp_replace(F.lower(c), r"[\s/\-]+", "-")
    return F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9\-]", ""), "^-+|-+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased alphanumeric tokens."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


# --- tokens in titles -----------------------------------------------------------------------------------------------


def regex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def contains_token(text: Column, token: Column) -> Column:
    """Whether the token, of three characters or more, stands in the text without a word character or hyphen beside
    it, whatever the case."""
    pattern = F.concat(F.lit(r"(?i)(?<![\w-])"), regex_escape(token), F.lit(r"(?![\w-])"))
    return F.coalesce((F.length(token) >= 3) & F.regexp_like(text, pattern), F.lit(False))


def all_words(text: Column, words: Column) -> Column:
    """Whether every word of an array occurs in the text, as a substring, whatever the case."""
    return F.forall(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def extract_model(title: Column, brand: Column) -> Column:
    """Title without the brand and leading separators, at most 80 characters."""
    bare = F.regexp_replace(title, F.concat(F.lit("(?i)"), regex_escape(brand)), F.lit(""))
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[\s\-–|:,]+", ""), r"\s{2,}", " ")), 1, 80)


#: Descriptive words that a search term drops.
NOISE_ADJECTIVES = (
    "Synthesizer", "Monophonic", "Analog", "Polyphonic", "Vintage", "Black", "White", "Silver", "Gold", "Original", "Standard",
    "Classic", "Serviced", "Restored", "Modified",
)


def strip_search_term(name: Column) -> Column:
    """At most four words that identify a product; the name itself if nothing is left."""
    trimmed = F.regexp_replace(name, r"^\s+|\s+$", "")
    steps = (
        (r"\[.*?\]", ""),
        (r"\(.*?\)", ""),
        (r"[:|*!]", ""),
        (r"\s+", " "),
        (r"^ | $", ""),
        (r"(?i)^(\S+)\s+\1\s+", "$1 "),
        (r"\s*\d{4}.*$", ""),
        (r"(?i)\s*\d+[-\s]?Keys?\b", ""),
        (r"(?i)\b(" + "|".join(NOISE_ADJECTIVES) + r")\b", ""),
        (r"[-\s]+$", ""),
        (r"\s+", " "),
        (r"^ | $", ""),
    )
    s = trimmed
    for pattern, to in steps:
        s = F.regexp_replace(s, pattern, to)
    first = F.array_join(F.slice(F.split(s, " "), 1, 4), " ")
    return F.when(first == "", trimmed).otherwise(first)


#: Colours that end a product name.
COLOURS = ("Black", "White", "Silver", "Red", "Blue", "Green", "Gold", "Natural", "Sunburst", "Cream", "Vintage White")


def clean_name(name: Column) -> Column:
    """Without a doubled first word and a trailing " - colour"."""
    once = F.regexp_replace(name, r"(?i)^(\S+)\s+\1(\s+)", "$1$2")
    return F.trim(F.regexp_replace(once, rf"(?i)\s+-\s+({'|'.join(COLOURS)})\s*$", ""))


#: Words that mark condition and language in a product name.
CONDITION_WORDS = r"refin|relic|aged|murphy\s+lab|played\s+in"
LANGUAGE_WORDS = "chitarra|basso|clavier|guitare|elektrisch|gitarre|acustica|elettrico|elettrica"
MAX_NAME_WORDS = 8


def dirty_flags(slug: Column, name: Column, brand: Column | None = None) -> Column:
    """Array of flags. With a brand, its slug must stand doubled in the slug; without, the first two slug parts."""
    if brand is None:
        parts = F.split(slug, "-")
        doubled = (F.size(parts) >= 2) & (parts[0] == F.get(parts, 1))
    else:
        b = slugify(brand)
        doubled = (b != "") & F.contains(slug, F.concat(b, F.lit("-"), b))
    checks = {
        "has_year": F.regexp_like(name, F.lit(r"\d{4}")),
        "has_condition_word": F.regexp_like(name, F.lit("(?i)" + CONDITION_WORDS)),
        "has_language_qualifier": F.regexp_like(name, F.lit("(?i)" + LANGUAGE_WORDS)),
        "duplicated_brand": doubled,
        "too_long": F.size(F.split(F.regexp_replace(name, r"^\s+|\s+$", ""), r"\s+")) > MAX_NAME_WORDS,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(flag)) for flag, test in checks.items()]))


#: Words of accessories and spares.
ACCESSORY_WORDS = (
    "cover", "case", "dust", "parts", "replacement", "adapter", "cable", "strap", "stand", "bag", "gig", "manual", "knob", "screw", "bolt",
)


def is_noise(name: Column) -> Column:
    """Whether a suggested name is too long, decorated or an accessory."""
    word = F.exists(F.array(*map(F.lit, ACCESSORY_WORDS)), lambda w: F.contains(F.lower(name), w))
    emoji = F.regexp_like(name, F.lit("[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"))
    return (F.length(name) > 80) | F.contains(name, F.lit("*")) | emoji | word


# --- similarity -----------------------------------------------------------------------------------------------------


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded by two spaces before and one after."""
    padded = F.transform(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of all trigrams of two names; 0 if neither has one."""

    def share(p: Column) -> Column:
        union = F.size(F.array_union(p["x"], p["y"]))
        return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(p["x"], p["y"])) / union)

    return let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), share)


def bigrams(c: Column) -> Column:
    def cut(s: Column) -> Column:
        n = F.length(s)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))
        return F.when(n < 2, F.array().cast("array<string>")).otherwise(pairs)

    return let(c, cut)


def dice(a: Column, b: Column) -> Column:
    """Bigram coefficient that counts every bigram of a, repeats included, which occurs in b: not symmetric."""

    def score(s: Column) -> Column:
        p, q = s["p"], s["q"]
        both = F.size(F.filter(p, lambda g: F.array_contains(q, g)))
        return (
            F.when((s["x"] == s["y"]) | ((F.size(p) == 0) & (F.size(q) == 0)), F.lit(1.0))
            .when((F.size(p) == 0) | (F.size(q) == 0), F.lit(0.0))
            .otherwise(2.0 * both / (F.size(p) + F.size(q)))
        )

    with_pairs = lambda n: F.struct(n["x"], n["y"], bigrams(n["x"]).alias("p"), bigrams(n["y"]).alias("q"))
    return let(let(F.struct(normalized_text(a).alias("x"), normalized_text(b).alias("y")), with_pairs), score)


def token_score(canonical: Column, title: Column) -> Column:
    """Share of the canonical tokens (repeats count) in the title, 0.1 more for a prefix, at most 1, two places."""

    def score(s: Column) -> Column:
        want, have = s["want"], s["have"]
        share = F.size(F.filter(want, lambda t: F.array_contains(have, t))) / F.size(want)
        prefix = F.startswith(F.array_join(have, " "), F.array_join(want, " "))
        raised = F.when(prefix, F.least(F.lit(1.0), share + 0.1)).otherwise(share)
        return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(F.floor(raised * 100 + 0.5) / 100)

    return let(F.struct(tokens(canonical).alias("want"), tokens(title).alias("have")), score)


def confidence(score: Column, n_tokens: Column) -> Column:
    return (
        F.when(n_tokens < 2, "low").when(score >= 0.95, "high").when(score >= 0.75, "medium").when(score >= 0.5, "low").otherwise("none")
    )


# --- names, urls, small parsers -------------------------------------------------------------------------------------

#: Brand names that capitals alone do not give.
BRAND_NAMES = {
    "ssl": "SSL", "api": "API", "ua": "Universal Audio", "emu": "E-mu", "bae": "BAE Audio", "kush-audio": "Kush Audio",
    "tube-tech": "Tube-Tech", "warm-audio": "Warm Audio", "poul-kjærholm": "Poul Kjærholm", "hans-j-wegner": "Hans J. Wegner",
    "arne-jacobsen": "Arne Jacobsen", "teenage-engineering": "Teenage Engineering", "hp": "HP",
}


def brand_name(slug: Column) -> Column:
    """Display name: a fixed one, or each part with its first letter as a capital and the rest unchanged."""
    parts = F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.coalesce(F.try_element_at(_lit_map(BRAND_NAMES), slug), F.array_join(parts, " "))


#: Canonical terms of curated queries.
QUERY_SYNONYMS = {
    "space echo": "roland re-201", "re201": "re-201", "macmini": "mac mini", "apple mac mini": "mac mini", "imac": "imac",
    "macbook pro": "macbook pro", "airpods pro": "airpods pro",
}


def query_synonym(query: Column) -> Column:
    """Canonical term of a normalised query, or null."""
    return F.try_element_at(_lit_map(QUERY_SYNONYMS), query)


def query_variants(query: Column) -> Column:
    """The query, its form without hyphens and its synonym, each once."""
    return F.array_distinct(F.array_compact(F.array(query, F.replace(query, F.lit("-"), F.lit(" ")), query_synonym(query))))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """First match or null."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def listing_id(url: Column) -> Column:
    """Number of /item/N, else of /id-N, else the url."""
    return F.coalesce(_first(url, r"/item/(\d+)"), _first(url, r"/id-(\d+)"), url)


def url_host(url: Column) -> Column:
    """Host without "www."; null for what is no url."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def marketplace_of(url: Column) -> Column:
    """Which marketplace's listing page a url is, or null."""
    host, path = url_host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    search = F.startswith(path, F.lit("/soeg")) | F.startswith(path, F.lit("/recommerce/forsale/search"))
    return (
        F.when((host == "dba.dk") & ~search, "dba")
        .when(host.isin("thomann.de", "thomann.dk", "thomann.com", "thomannmusic.com") & F.regexp_like(path, F.lit(r"\.html?$")), "thomann")
        .when((host == "reverb.com") & (F.startswith(path, F.lit("/item/")) | F.startswith(path, F.lit("/p/"))), "reverb")
    )


def is_dba_listing(url: Column) -> Column:
    return F.coalesce(marketplace_of(url) == "dba", F.lit(False))


def sitemap_filename(url: Column) -> Column:
    """Lower-cased file name of a product page in the sitemap, or null."""
    return F.lower(_first(url, r"(?i)thomann\.dk/(?:gb/)?([a-z0-9_]+)\.htm$"))


def is_bundle(filename: Column) -> Column:
    """An underscore is a word character, so "_set_x" is no bundle."""
    return F.regexp_like(filename, F.lit(r"(?i)[_-](bundle|pack|set|kit|rig|starter|combo|value|deal)\b"))


#: Instrument types by keyword, first hit; a type with a second pattern must not match that.
TYPE_RULES = (
    ("drum machine", "drum machine|drum computer", None),
    ("sampler", "sampler", None),
    ("sequencer", "sequencer", "synth"),
    ("workstation", "workstation", None),
    ("groovebox", "groovebox|groove box", None),
    ("vocoder", "vocoder", None),
    ("organ", "organ", None),
    ("module", "expander|module", None),
    ("software synth", "software|virtual", None),
    ("effects processor", "effects", "keyboard"),
)


def instrument_type(keywords: Column) -> Column:
    low = F.lower(keywords)
    chain = F
    for kind, yes, no in TYPE_RULES:
        hit = F.regexp_like(low, F.lit(yes))
        chain = chain.when(hit & ~F.regexp_like(low, F.lit(no)) if no else hit, kind)
    return chain.otherwise("synthesizer")


#: How a page writes a year, and the verbs before the year of an introduction.
YEAR = r"19[5-9]\d|20[012]\d"
INTRODUCED = "introduced|released|launched|produced|manufactured|first appeared|built|designed|debuted"


def production_era(page: Column) -> Column:
    """Years a page gives for an instrument: a range, else the year of its introduction, else a year named twice.

    The first 500 and last 1000 characters of the visible text are site furniture. "1996-2020" and later ends are
    the site's own, ranges over 30 years are none. Separators are any mix of -, –, t and o.
    """
    text = page
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>", "&nbsp;", r"\s+"):
        text = F.regexp_replace(text, pattern, " ")
    body = F.substr(text, F.lit(501), F.greatest(F.length(text) - 1500, F.lit(0)))
    ranges = F.regexp_extract_all(body, F.lit(rf"\b({YEAR})\s*[-–to]+\s*({YEAR})\b"), F.lit(0))
    pairs = F.transform(ranges, lambda r: F.struct(F.substring(r, 1, 4).cast("int").alias("a"), F.substring(r, -4, 4).cast("int").alias("b")))
    good = F.filter(pairs, lambda p: ~((p["a"] == 1996) & (p["b"] >= 2020)) & (p["b"] - p["a"] <= 30) & (p["a"] >= 1960) & (p["b"] <= 2030))
    span = F.transform(good, lambda p: F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string")))
    intro = _first(body, rf"(?i)(?:{INTRODUCED})[^.]{{0,60}}\b({YEAR})\b")
    years = F.filter(F.regexp_extract_all(body, F.lit(r"\b(19[6-9]\d|20[01]\d)\b"), F.lit(1)), lambda y: y.between("1963", "2025"))

    def most_named(ys: Column) -> Column:
        counted = F.transform(
            F.array_distinct(ys),
            lambda y: F.struct((-F.size(F.filter(ys, lambda z: z == y))).alias("n"), F.array_position(ys, y).alias("at"), y.alias("y")),
        )
        return let(F.get(F.array_sort(counted), F.lit(0)), lambda top: F.when(top["n"] <= -2, top["y"]))

    return F.coalesce(F.get(span, F.lit(0)), intro, let(years, most_named), F.lit(""))


def production_years(extract: Column) -> Column:
    """"introduced in YYYY", "YYYY-YYYY" or "since YYYY" as an open or closed range, or null."""
    pattern = r"(?i)introduced in (\d{4})|(\d{4})[–-](\d{4})|since (\d{4})"
    group = lambda g: F.nullif(F.regexp_extract(extract, pattern, g), F.lit(""))
    start = F.coalesce(group(1), group(2), group(4))
    return F.when(start.isNotNull(), F.concat(start, F.lit("–"), F.coalesce(group(3), F.lit(""))))


#: Specification names and the keys they become.
SPEC_KEYS = {
    "Polyphony": "polyphony", "Oscillators": "oscillators", "LFO": "lfo", "Filter": "filter", "VCA": "vca", "Keyboard": "keys",
    "Memory": "memory", "Control": "control", "Date Produced": "production_years", "Arpeg/Seq": "arpeggiator", "Effects": "effects",
}


def normal_specs(raw: Column) -> Column:
    """Known specifications under their own keys, with midi = "true" where the control field names it."""
    names = _lit_map(SPEC_KEYS)
    known = F.map_filter(raw, lambda k, v: F.try_element_at(names, k).isNotNull() & (F.coalesce(v, F.lit("")) != ""))
    renamed = F.transform_keys(known, lambda k, v: F.try_element_at(names, k))
    midi = F.coalesce(F.regexp_like(F.try_element_at(renamed, F.lit("control")), F.lit("(?i)midi")), F.lit(False))
    return F.when(midi, F.map_concat(renamed, F.create_map(F.lit("midi"), F.lit("true")))).otherwise(renamed)


def shorten(title: Column, limit: int = 60) -> Column:
    """At most `limit` characters, cut at the last space if there is one."""
    head = F.substring(title, 1, limit)
    return F.when(F.length(title) <= limit, title).otherwise(
        F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    )


def unescape_entities(c: Column) -> Column:
    """The five entities of attribute values."""
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def unescape_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\/"), F.lit("/"))


def bump_minor(version: Column) -> Column:
    """major.minor.patch to major.minor+1.0."""
    p = F.split(version, r"\.")
    return F.concat_ws(".", p[0], (F.get(p, 1).cast("int") + 1).cast("string"), F.lit("0"))


def slug_tail(slug: Column) -> Column:
    """What follows the slash of a compound slug, or the slug."""
    return F.coalesce(F.get(F.split(slug, "/"), 1), slug)


#: Brands looked for in category paths, in this order.
PATH_BRANDS = (
    "roland", "korg", "yamaha", "moog", "sequential", "oberheim", "akai", "casio", "alesis", "novation", "behringer", "elektron",
    "emu", "fender", "gibson",
)
#: Brands that may be a part of such a path as a whole.
EXACT_BRANDS = (
    "roland", "korg", "yamaha", "moog", "sequential", "oberheim", "akai", "casio", "alesis", "novation", "behringer", "elektron",
    "fender", "gibson", "arturia",
)
#: Path parts that are no brand.
NOT_BRANDS = ("synths", "effects", "accessories")


def brand_of_path(path: Column) -> Column:
    """Brand slug of a "Category / Part / Brand" path: a known part, else the last part but one, else a name in it."""
    parts = F.transform(F.split(path, "/"), lambda x: F.trim(x))
    known = F.get(F.filter(F.transform(parts, lambda x: slugify_hyphen_first(x)), lambda s: s.isin(*EXACT_BRANDS)), 0)
    parent = F.get(parts, F.size(parts) - 2)
    named = F.when((F.size(parts) >= 3) & (parent != "") & ~F.lower(parent).isin(*NOT_BRANDS), slugify_hyphen_first(parent))
    within = F.get(F.filter(F.array(*map(F.lit, PATH_BRANDS)), lambda b: F.contains(F.lower(path), b)), 0)
    return F.coalesce(known, named, within)


def unfence(c: Column) -> Column:
    """JSON without a Markdown fence around it."""
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def deterministic_id(source: Column, key: Column) -> Column:
    """Hash of source and key in the form of a UUID."""
    h = F.sha2(F.concat_ws(":", source, key), 256)
    return F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def synonym_variants(key: Column, name: Column) -> Column:
    """Sorted spelling variants of a product from its hyphenated key and its display name.

    The brand ends before the first later word that begins with a digit or with a capital that no small letter
    follows, else after the first word. Variants are the model as it is, spaced or joined, alone and behind the brand;
    joined ones only if short enough to be told apart. Nulls count as empty.
    """

    def forms(n: Column) -> Column:
        spaced, joined = F.replace(n["model"], F.lit("-"), F.lit(" ")), F.regexp_replace(n["model"], r"[-\s]", "")
        return F.array(
            n["model"],
            spaced,
            F.concat_ws(" ", n["brand"], spaced),
            F.when((F.length(joined) > 2) | (joined == n["model"]), joined),
            F.when(F.length(joined).between(2, 8), F.concat(n["brand"], joined)),
        )

    def split(w: Column) -> Column:
        starts = F.transform(w, lambda x, i: (i > 0) & x.rlike("^[A-Z0-9]") & ~x.rlike("^[A-Z][a-z]"))
        length = F.greatest(F.array_position(starts, True) - 1, F.lit(0)).cast("int")
        length = F.when(length == 0, 1).otherwise(length)
        part = lambda start, n: F.lower(F.array_join(F.slice(w, start, n), " "))
        return F.struct(part(F.lit(1), length).alias("brand"), part(length + 1, F.size(w)).alias("model"))

    key = F.coalesce(key, F.lit(""))
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    own = F.array(key, F.replace(key, F.lit("-"), F.lit(" ")))
    others = F.filter(F.array_compact(let(let(words, split), forms)), lambda v: ~F.array_contains(own, F.trim(v)))
    spaced_once = F.transform(others, lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(spaced_once, lambda v: F.length(v) > 1)))
