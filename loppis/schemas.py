"""The data model: typed tables with their keys, enumerations, references and defaults.

Fixed values of the model are stated in one place, table by table. `operators.constraints` checks tables against them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: How a unique key treats nulls: a null never conflicts, equals another null, or leaves the row out of the key.
DISTINCT, NOT_DISTINCT, PARTIAL = "distinct", "not distinct", "partial"


@dataclass(frozen=True)
class Key:
    columns: tuple[str, ...]
    nulls: str = DISTINCT
    #: Of a partial key: the columns that must be there for a row to count.
    where: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reference:
    column: str
    table: str
    key: str = "id"
    #: What becomes of a row whose parent is deleted: "cascade", "set null" or "restrict".
    on_delete: str = "restrict"


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    keys: tuple[Key, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    references: tuple[Reference, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)


KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "smallint": T.ShortType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """From "name type" or "name type not null", comma-separated; needs no session, unlike a DDL string."""
    parts = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(name, KINDS[kind], not required) for name, kind, *required in parts])


def _table(name: str, columns: str, *keys: Key, enums=None, ranges=None, references=(), defaults=None) -> Table:
    return Table(name, _schema(columns), keys, enums or {}, ranges or {}, tuple(references), defaults or {})


ID = Key(("id",))
_SOLD = "id string not null, watchlist_id string, query string, source string, listing_url string not null, listing_title string, price double, currency string, condition string, sold_at timestamp, created_at timestamp"

# --- fixed values of the model: columns, keys, enumerations, defaults -------------------------------------------------

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        _table(
            "listings",
            "id string not null, title string not null, price int, currency string not null, url string not null, image_url string, location string, scraped_at timestamp, source string not null, watchlist_id string, notified_at timestamp, normalized_text string, external_id string, platform string, condition string, brand_id string, is_active boolean",
            ID, Key(("url", "watchlist_id"), PARTIAL, ("watchlist_id",)), Key(("external_id", "source"), PARTIAL, ("external_id",)),
            references=[Reference("watchlist_id", "watchlists", on_delete="cascade"), Reference("brand_id", "kg_brand", on_delete="set null")],
            defaults={"currency": "DKK", "source": "dba.dk", "is_active": True},
        ),
        _table(
            "watchlists",
            "id string not null, user_id string not null, query string not null, created_at timestamp, active boolean not null, type string not null, source_url string, max_price int, min_price int",
            ID, enums={"type": ("query", "listing")}, defaults={"active": True, "type": "query"},
        ),
        _table(
            "price_snapshots",
            "id string not null, listing_url string not null, watchlist_id string, price int, currency string not null, title string, scraped_at timestamp",
            ID, references=[Reference("watchlist_id", "watchlists", on_delete="cascade")], defaults={"currency": "DKK"},
        ),
        _table("user_preferences", "user_id string not null, categories array<string>, brands array<string>, onboarding_completed boolean, is_admin boolean", Key(("user_id",)), defaults={"onboarding_completed": False, "is_admin": False}),
        _table(
            "kg_category",
            "id string not null, slug string not null, name_da string, name_en string, domain string not null, parent_id string, image_url string, reverb_uuid string",
            ID, Key(("slug",)), Key(("reverb_uuid",), PARTIAL, ("reverb_uuid",)), enums={"domain": ("music", "design", "other")}, references=[Reference("parent_id", "kg_category", on_delete="set null")], defaults={"domain": "music"},
        ),
        _table("kg_brand", "id string not null, slug string not null, name string not null, category_id string", ID, Key(("slug",)), references=[Reference("category_id", "kg_category")]),
        _table(
            "kg_product",
            "id string not null, slug string not null, canonical_name string not null, model_name string, brand_id string not null, category_id string not null, attributes string, price_min_dkk int, price_max_dkk int, era string, reference_url string, status string not null, created_at timestamp, msrp_dkk int, thomann_url string, thomann_price_dkk int, thomann_price_updated_at timestamp, image_url string, hero_image_url string, subcategory_id string, subcategory_confidence double, reverb_root_slug string, reverb_sub_slug string, reverb_csp_id string, tier string not null, tags array<string>, year_released int, cleanup_status string",
            ID, Key(("slug",)), enums={"tier": ("standard", "classic", "legendary")},
            references=[Reference("brand_id", "kg_brand"), Reference("category_id", "kg_category"), Reference("subcategory_id", "kg_category", on_delete="set null")], defaults={"status": "active", "tier": "standard"},
        ),
        _table(
            "kg_identifier",
            "id string not null, product_id string not null, type string not null, value string not null, confidence smallint not null, source string not null",
            ID, enums={"type": ("EAN", "SKU", "MODEL", "PART_NUMBER")}, ranges={"confidence": (0, 100)}, references=[Reference("product_id", "kg_product", on_delete="cascade")], defaults={"confidence": 80, "source": "seed"},
        ),
        _table(
            "kg_relation",
            "id string not null, from_product_id string not null, to_product_id string not null, type string not null, weight smallint not null, notes string",
            ID, enums={"type": ("sibling", "successor", "predecessor", "clone", "alternative", "compatible")}, ranges={"weight": (0, 100)},
            references=[Reference("from_product_id", "kg_product", on_delete="cascade"), Reference("to_product_id", "kg_product", on_delete="cascade")], defaults={"weight": 50},
        ),
        _table(
            "synonym",
            "id string not null, alias string not null, canonical_query string, product_id string, category_id string, lang string not null, match_type string not null, priority smallint not null",
            ID, enums={"match_type": ("exact", "alias", "abbrev")}, ranges={"priority": (0, 100)}, references=[Reference("product_id", "kg_product", on_delete="cascade"), Reference("category_id", "kg_category")], defaults={"lang": "da", "match_type": "alias", "priority": 50},
        ),
        _table(
            "listing_product_match",
            "listing_id string not null, product_id string not null, method string not null, score smallint not null, explain string, created_at timestamp",
            Key(("listing_id", "product_id")), enums={"method": ("EAN", "SKU", "MODEL", "SYNONYM", "FUZZY")}, ranges={"score": (0, 100)},
            references=[Reference("listing_id", "listings", on_delete="cascade"), Reference("product_id", "kg_product", on_delete="cascade")],
        ),
        _table(
            "price_observation",
            "id string not null, product_id string not null, listing_id string, price_dkk int, price_min_dkk int, price_max_dkk int, source string not null, user_id string, created_at timestamp",
            ID, enums={"source": ("user", "admin", "scrape")}, references=[Reference("product_id", "kg_product", on_delete="cascade"), Reference("listing_id", "listings", on_delete="set null")],
        ),
        _table("listing_price_history", "id string not null, listing_id string not null, price_dkk int not null, observed_at timestamp", ID, references=[Reference("listing_id", "listings", on_delete="cascade")]),
        _table("saved_listings", "user_id string not null, listing_id string not null, saved_at timestamp, listing_data string", Key(("user_id", "listing_id"))),
        _table("notification_preferences", "user_id string not null, email_enabled boolean, push_enabled boolean, price_drops boolean, new_listings boolean", Key(("user_id",)), defaults={"email_enabled": True, "push_enabled": False, "price_drops": True, "new_listings": True}),
        _table("reverb_price_history", _SOLD + ", kg_product_id string", ID, Key(("listing_url", "watchlist_id")), references=[Reference("watchlist_id", "watchlists", on_delete="cascade"), Reference("kg_product_id", "kg_product", on_delete="set null")], defaults={"source": "reverb"}),
        _table("auctionet_price_history", _SOLD + ", estimate_low double, estimate_high double", ID, Key(("listing_url", "watchlist_id")), references=[Reference("watchlist_id", "watchlists", on_delete="cascade")], defaults={"source": "auctionet"}),
        _table("price_fetch_queue", "id string not null, product_slug string not null, status string not null, created_at timestamp, processed_at timestamp", ID, Key(("product_slug", "status")), enums={"status": ("pending", "processing", "done", "failed")}, defaults={"status": "pending"}),
        _table(
            "kg_product_suggestions",
            "id string not null, canonical_name string not null, brand_id string, brand_name string, category_id string, source string, listing_count int not null, status string not null, reviewed_by string, reviewed_at timestamp, notes string",
            ID, Key(("canonical_name", "brand_id")), enums={"status": ("pending", "approved", "rejected")}, references=[Reference("brand_id", "kg_brand"), Reference("category_id", "kg_category")], defaults={"listing_count": 1, "status": "pending"},
        ),
        _table("thomann_product", "thomann_url string not null, canonical_name string not null, image_url string, price_dkk int, scraped_at timestamp, kg_product_id string", Key(("thomann_url",)), references=[Reference("kg_product_id", "kg_product", on_delete="set null")]),
    )
}
