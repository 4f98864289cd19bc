"""Word lists, name patterns and domain profiles (fixed values)."""

from __future__ import annotations

import re

# Name fragments of likely target columns.
TARGET_PATTERNS = [
    "target", "label", "class", "churn", "fraud", "risk", "default", "status", "outcome",
    "survived", "approved", "bought", "late", "flag", "response", "clicked", "converted",
    "is_", "has_", "result",
]

# Name patterns of identifier columns.
ID_PATTERNS = [
    "id$", "_id$", "identifier", "guid", "uuid", "key$", "code$", "number$", "num$",
    "url", "image", "street", "address",
]

# Names of geographic columns.
GEO_NAMES = [
    "state", "city", "warehouse", "country", "region", "zipcode", "zip_code", "postal_code",
    "latitude", "longitude", "street", "address", "market", "territory", "store", "department",
]

# Columns known only after the event to predict, and why (in our words).
LEAKAGE_NAMES = {
    "delivery status": "It states how the delivery went, which nobody knows before the shipment.",
    "days for shipping (real)": "The days are counted when the order has arrived.",
    "shipping date (dateorders)": "The shipment leaves after the moment of prediction.",
    "days for shipment (scheduled)": "It may hang together with the real shipping days.",
}

# Name fragments of columns recorded after the outcome.
POST_EVENT_FRAGMENTS = ["(real)", "actual", "post_", "outcome", "after_event"]

# Numerator fragment, denominator fragment, feature name.
RATIO_PAIRS = [
    ("order profit per order", "sales", "profit_to_revenue_ratio"),
    ("profit", "revenue", "profit_to_revenue_ratio"),
    ("profit", "sales", "profit_to_sales_ratio"),
    ("cost", "price", "cost_to_price_ratio"),
]

# Normalised column names that mark the supply-chain domain.
SUPPLY_CHAIN_INDICATORS = [
    "late delivery risk",
    "delivery status",
    "days for shipping (real)",
    "days for shipping real",
    "days for shipment scheduled",
    "order item quantity",
    "sales per customer",
    "shipping mode",
]

# Domain profiles.
DOMAIN_PROFILES = {
    "general": {"key": "general", "target_hints": [], "class_labels": {}},
    "supply_chain": {
        "key": "supply_chain",
        "target_hints": ["late_delivery_risk"],
        "class_labels": {"0": "On-Time Delivery", "1": "Late Delivery Risk"},
    },
}


def normal(name: str) -> str:
    return name.strip().lower()


def is_geographic(name: str) -> bool:
    """Whole-word match; an underscore is part of a word, so customer_city passes."""
    lowered = name.lower()
    return any(re.search(rf"\b{re.escape(g)}\b", lowered) for g in GEO_NAMES)


def looks_like_id(name: str) -> bool:
    return any(re.search(p, name.lower()) for p in ID_PATTERNS)


def target_pattern(name: str) -> str | None:
    return next((p for p in TARGET_PATTERNS if p in name.lower()), None)


def detect_domain(columns: list[str]) -> str:
    seen = {normal(c).replace("_", " ") for c in columns}
    hits = seen.intersection(SUPPLY_CHAIN_INDICATORS)
    return "supply_chain" if len(hits) >= 2 else "general"


def domain_profile(key: str | None, columns: list[str]) -> dict:
    if not key or key == "auto":
        key = detect_domain(columns)
    return DOMAIN_PROFILES.get(key, DOMAIN_PROFILES["general"])


def class_labels(profile: dict, classes: list) -> dict:
    """Display label per class value, by value, text or whole number; else the text."""
    known = profile["class_labels"]

    def label(c) -> str:
        whole = str(int(c)) if isinstance(c, (int, float)) else str(c)
        return known.get(str(c), known.get(whole, str(c)))

    return {c: label(c) for c in classes}


def ratio_specs(numeric: list[str]) -> list[dict]:
    """At most one ratio feature, from the first pair of fragments that both match."""
    plain = [(c.lower().replace("_", " "), c) for c in numeric]
    for num_part, den_part, name in RATIO_PAIRS:
        num = next((c for k, c in plain if num_part in k), None)
        den = next((c for k, c in plain if den_part in k and c != num), None)
        if num and den:
            return [{"name": name, "numerator_col": num, "denominator_col": den, "leakage_risk": False}]
    return []
