"""Redaction of Aadhaar numbers, phone numbers and e-mail addresses, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_POINTS

# The patterns and what replaces them.
AADHAAR = rf"(?<!\p{{Nd}})\p{{Nd}}{{4}}[\-{SPACE_POINTS}]?\p{{Nd}}{{4}}[\-{SPACE_POINTS}]?\p{{Nd}}{{4}}(?!\p{{Nd}})"
PHONE = rf"(?<!\p{{Nd}})(?:(?:\+91|91|0)[\-{SPACE_POINTS}]?)?[6-9]\p{{Nd}}{{4}}[\-{SPACE_POINTS}]?\p{{Nd}}{{5}}(?!\p{{Nd}})"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PLACEHOLDERS = {"aadhaar": (AADHAAR, "[AADHAAR]"), "phone": (PHONE, "[PHONE]"), "email": (EMAIL, "[EMAIL]")}


def redact(text: Column, unicode_phone: bool = False) -> tuple[Column, dict[str, Column]]:
    """The redacted text, and each kind's matches counted in the text as the kinds before left it.

    With ``unicode_phone`` a phone number's first digit may be of any script."""
    counts: dict[str, Column] = {}
    for kind, (pattern, mark) in PLACEHOLDERS.items():
        if kind == "phone" and unicode_phone:
            pattern = pattern.replace("[6-9]", "[6-9\\x{096c}-\\x{096f}]")
        counts[kind] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, mark)
    return text, counts
