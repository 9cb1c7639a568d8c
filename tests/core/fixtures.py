"""Small hand-written documents with nulls, empty values and mixed types."""

PRODUCTS_SCHEMA = "_id string, name string, price double, category string, year long, description string, tags array<string>, in_stock boolean, deleted_at string"
PRODUCTS = [
    ("p1", "Steel Bolt", 9.99, "automotive", 2020, "engine replacement, steel.", ["a", "b"], True, None),
    ("p2", "Widget", 4.99, "deals", 2024, "Engine  mount", [], False, ""),
    ("p3", "a", 10.0, "deals", 2025, "the is a", None, None, "2024-01-01"),
    ("p4", None, None, "electronics", 2019, None, ["steel"], True, None),
    ("p5", "STEEL bolt", 0.0, None, 2020, "ecommerce.product replacement", ["b"], False, None),
]
FIELDS = ["name", "price", "category", "year", "description", "tags", "in_stock", "deleted_at"]


def documents() -> list[dict]:
    """The products as documents; nulls are left out or stored, by turns."""
    out = []
    for n, row in enumerate(PRODUCTS):
        doc = dict(zip(["_id", *FIELDS], row, strict=True))
        out.append({k: v for k, v in doc.items() if v is not None or n % 2})
    return out
