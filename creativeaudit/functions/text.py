"""String and tag-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creativeaudit.constants import CASE_FOLDS, SLUG_PATTERN, WHITE_SPACE



def trim_space(c: Column) -> Column:
    """Strip every kind of white space; ``trim`` alone strips only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def fold_case(c: Column) -> Column:
    """Case folding as far as it can yield ASCII letters."""
    folded = F.lower(c)
    # 'ẞ' lower-cases to 'ß', so its own entry is never needed here.
    for char, ascii_text in CASE_FOLDS.items():
        if char != "ẞ":
            folded = F.replace(folded, F.lit(char), F.lit(ascii_text))
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(F.lower(c))


def slugify(label: Column) -> Column:
    """Identifier made from a display name; '' when nothing is left."""
    out = F.regexp_replace(fold_case(trim_space(label)), "[^a-z0-9]+", "_")
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.regexp_replace(out, "^[^a-z]+", "")


def is_slug(slug: Column) -> Column:
    # \z instead of $: a trailing line break must not pass.
    return slug.rlike(SLUG_PATTERN.replace("$", r"\z"))


def clean_tags(tags: Column) -> Column:
    """P1 on an array: trim, drop empties, keep the first of each."""
    trimmed = F.transform(tags, trim_space)
    return F.array_distinct(F.filter(trimmed, lambda t: t.isNotNull() & (t != "")))


def tags_from_csv(csv: Column) -> Column:
    """P1 on a comma-separated string."""
    return clean_tags(F.split(csv, ",", -1))


def tag_key(tags: Column) -> Column:
    """Order-free form of a tag list, used in cache keys."""
    return F.array_sort(tags)


def client_identity(peer: Column, forwarded: Column, hops: int) -> Column:
    """The address a per-caller limit is charged to.

    Each proxy appends the address it saw, so only entries counted from the
    right can be trusted.
    """
    socket = F.coalesce(peer, F.lit("unknown"))
    if hops <= 0:
        return socket
    parts = F.transform(F.split(F.coalesce(forwarded, F.lit("")), ",", -1), trim_space)
    chain = F.filter(parts, lambda p: p != "")
    n = F.size(chain)
    nth = F.get(chain, n - F.least(F.lit(hops), n))
    return F.when(n == 0, socket).otherwise(nth)
