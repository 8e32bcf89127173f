"""Category taxonomy: a small key -> name map, kept as a constant map expression."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from echotide.functions.fixed_values import TAXONOMY_MAP
from echotide.functions.text import slug


def load_taxonomy(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as handle:
        return clean_taxonomy(json.load(handle))


def clean_taxonomy(raw: object) -> dict[str, str]:
    """Lower-case keys; blank names take the fallback; non-text entries are skipped."""
    if not isinstance(raw, dict):
        raise ValueError("the taxonomy must be a JSON object")
    fallback = raw.get("__fallback__")
    fallback = fallback if isinstance(fallback, str) and fallback.strip() else "Other"
    cleaned = {"__fallback__": fallback}
    for key, name in raw.items():
        if key == "__fallback__" or not isinstance(name, str) or not key.strip():
            continue
        cleaned[key.strip().lower()] = name.strip() or fallback
    return cleaned


def category_taxonomy(category_raw: Column, taxonomy: dict[str, str] | None = None) -> Column:
    """The lookup join as one constant map, given as JSON so that the plan does not grow with it; no row moves."""
    names = dict(taxonomy or TAXONOMY_MAP)
    fallback = F.lit(names.pop("__fallback__", "Other"))
    if not names:
        return fallback
    lookup = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    return F.coalesce(F.try_element_at(lookup, slug(category_raw)), fallback)
