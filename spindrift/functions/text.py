"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ACCENTS

# Fixed phrases that report text may not hold.
BANNED_PHRASES = ("statistically significant", "statistical significance", "significant improvement", "sota", "state-of-the-art", "state of the art")
UNSURE = "unsure"


def normalise_key(raw: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(raw), r"(?U)\s+", " "))


def split_accents(raw: Column) -> Column:
    """Values separated by commas outside parentheses, trimmed, empty ones dropped (null: none)."""
    parts = F.split(F.coalesce(raw, F.lit("")), r",(?![^()]*\))")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def token_set(text: Column) -> Column:
    """Distinct words at white space, case kept."""
    return F.filter(F.array_distinct(F.split(text, r"(?U)\s+")), lambda w: w != "")


def speaker_key(source: Column, speaker: Column) -> Column:
    return F.concat(source, F.lit(":"), speaker)


def l1_or_accent(l1: Column, accent: Column) -> Column:
    """The first language where one other than English is named, else the accent; blank is null."""
    first = F.trim(F.coalesce(l1, F.lit("")))
    named = ~F.lower(first).isin("english", "nan", "")
    plain = F.trim(F.coalesce(accent, F.lit("")))
    return F.when(named, first).when(~F.lower(plain).isin("", "nan"), plain)


def parse_label(text: Column, labels: list[str] = ACCENTS) -> Column:
    """The one label that a reply names, in any case; `unsure` for none or several."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.contains(low, F.lower(x)))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(F.lit(UNSURE))


def banned_phrase(text: Column) -> Column:
    """The banned phrases found as whole words, in any case."""
    phrases = F.array(*[F.lit(p) for p in BANNED_PHRASES])
    return F.filter(phrases, lambda p: F.regexp(text, F.concat(F.lit(r"(?i)\b"), p, F.lit(r"\b"))))


_BANNED = re.compile(rf"\b(?:{'|'.join(map(re.escape, BANNED_PHRASES))})\b", re.IGNORECASE)


def check_wording(text: str) -> None:
    """ValueError, naming all of them, if a report holds banned phrases as whole words."""
    found = sorted({m.lower() for m in _BANNED.findall(text)})
    if found:
        raise ValueError(f"wording not allowed in a report: {', '.join(found)}; state what the speaker bootstrap's interval shows")


def clip_name(prefix: str, *parts: Column, number: Column, width: int = 6) -> Column:
    """`prefix:part:…:000123`."""
    return F.concat_ws(":", F.lit(prefix), *parts, F.lpad(number.cast("string"), width, "0"))


def augmented_name(clip_id: Column, factor: Column) -> Column:
    return F.concat(clip_id, F.lit("#aug-sp"), factor.cast("string"))


def base_clip(clip_id: Column) -> Column:
    return F.substring_index(clip_id, "#", 1)
