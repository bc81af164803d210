"""Column expressions on ids, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelling variants of structure names and the name they stand for.
LABEL_ALIASES = {
    "beta_galactoside": "beta_galactosidase",
    "betagalactoside": "beta_galactosidase",
    "betaamylase": "beta_amylase",
    "apo_ferritin": "apoferritin",
    "vlp": "virus_like_particle",
}
BACKGROUND = "background"
SNR_PATTERN = r"snr[-_]?(\d+\.?\d*)"


def canonical_label(label: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, '-' and ' ' as '_', known variants replaced, null as 'unknown'.

    The alias list is a handful of fixed names, so it is part of the
    expression and needs no join; see ``clean.canonicalize`` for alias tables.
    """
    names = LABEL_ALIASES if aliases is None else aliases
    plain = F.translate(F.lower(label.cast("string")), "- ", "__")
    out = plain
    if names:
        lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        out = F.coalesce(F.try_element_at(lookup, plain), plain)
    return F.coalesce(out, F.lit("unknown"))


def stem_id(stem: Column) -> Column:
    """A trailing '_<digits>' of a file stem becomes '-<digits>'."""
    return F.regexp_replace(stem, "_([0-9]+)$", "-$1")


def snr_of(text: Column) -> Column:
    """Signal-to-noise ratio named in a folder or source type; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(text), SNR_PATTERN, 1), F.lit("")).cast("double")


def is_background(label: Column) -> Column:
    return label.isNull() | (label == BACKGROUND)
