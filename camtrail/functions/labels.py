"""Ordered substring rules: the first key that a text contains decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in order.
EMPTY_SCENE = "empty"
DEMO_RULES = (("empty", "empty"), ("deer", "梅花鹿"), ("boar", "野猪"), ("fox", "狐狸"), ("wolf", "狼"))
DEMO_LABELS = ("梅花鹿", "野猪", "狐狸", "狼")
KNOWLEDGE_KEYS = ("梅花鹿", "野猪", "狐狸", "狼", "Tapirus", "Mazama", "Canis", "Unknown")
UNKNOWN_KEY = "Unknown"


def first_match(text: Column, rules, default: Column | None = None) -> Column:
    """The value of the first rule (key, value) whose key the text contains, case-sensitively; else the default or null."""
    chain = F
    for key, value in rules:
        chain = chain.when(F.contains(text, F.lit(key)), F.lit(value))
    return chain.otherwise(F.lit(None) if default is None else default)


def demo_label(source_name: Column) -> Column:
    """Label that a file name stands for, `empty` for empty scenes, or null."""
    return first_match(F.lower(F.coalesce(source_name, F.lit(""))), DEMO_RULES)


def knowledge_key(label: Column) -> Column:
    """Key of the knowledge entry for a species label; null labels and labels without a key have Unknown's."""
    return first_match(F.coalesce(label, F.lit(UNKNOWN_KEY)), [(k, k) for k in KNOWLEDGE_KEYS], F.lit(UNKNOWN_KEY))
