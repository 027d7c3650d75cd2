"""Rules on column names."""

from __future__ import annotations

import re

#: Words in names that make a column money-like, a rating, an id or a time.
MONEY = ("price", "amount", "sum", "value", "cost")
RATING = ("score", "rating")
IDENTITY = ("user", "id", "uid")
TIME = ("date", "time", "timestamp")
TIME_TO_CONVERT = ("date", "time", "timestamp", "year")


def name_matches(name: str, words: tuple[str, ...], match: str = "substring") -> bool:
    """Whether ``name`` has one of ``words``: anywhere, or with match='token' as a whole part of it."""
    low = name.lower()
    if match == "token":
        return bool(set(re.split(r"[^a-z0-9]+", low)) & set(words))
    return any(w in low for w in words)
