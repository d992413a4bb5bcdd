"""Text clean-up, labels, version numbers and canonical JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, most: int = 40, empty: str = "label") -> Column:
    """Lower-case ASCII letters and digits, runs of anything else as one hyphen, none at the ends."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")
    return F.when(plain == "", empty).otherwise(F.regexp_replace(F.left(plain, F.lit(most)), "-+$", ""))


def decode_entities(text: Column) -> Column:
    """The five XML entities; the ampersand last, so nothing is decoded twice."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def scrub_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", "")


def elapsed_label(seconds: Column) -> Column:
    """``42s``, ``3m 07s`` or ``2h 05m``."""
    s, m, h = seconds.cast("long"), F.floor(seconds / 60), F.floor(seconds / 3600)
    return F.when(seconds < 60, F.format_string("%ds", s)).when(seconds < 3600, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%dh %02dm", h, m % 60))


def byte_label(size: Column) -> Column:
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024**2, F.format_string("%.1f KB", F.round(size / 1024.0, 1))).when(size < 1024**3, F.format_string("%.1f MB", F.round(size / 1024.0**2, 1))).otherwise(F.format_string("%.1f GB", F.round(size / 1024.0**3, 1)))


def semver_key(version: Column) -> Column:
    """A struct that orders versions: major, minor, patch, releases after pre-releases; null for other texts."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    part = lambda i: F.regexp_extract(version, pattern, i)
    return F.when(version.rlike(pattern), F.struct(*(part(i).try_cast("long").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))), (part(4) == "").alias("release"), part(4).alias("pre")))


def canonical_map(entries: Column) -> Column:
    """A map as JSON text with sorted keys, so that key order does not count."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def safe_path(path: Column) -> Column:
    """Relative, without empty, dot or parent parts, backslashes or drive letters."""
    return path.rlike(r"^[^/\\:]+(/[^/\\:]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)")


def valid_name(name: Column, most: int = 120) -> Column:
    """Something besides blanks, no longer than ``most``, no control characters."""
    trimmed = F.trim(name)
    return (trimmed != "") & (F.length(trimmed) <= most) & ~trimmed.rlike(r"\p{Cc}")


# The error classes, the first whose words occur wins.
ERROR_RULES = (
    ("markers", ("flag marker", "flag socket")),
    ("mounting", ("wall mount", "wall plate", "cleat", "mount pocket")),
    ("surface", ("openstreetmap", "overpass")),
    ("elevation", ("elevation", "mapzen", "mapterhorn")),
)
WRITE_WORDS = ("write", "output directory", "3mf", "stl")


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def piece_of(error: Column, part: int) -> Column:
    """Row (1) or column (2) of the piece that an error text names."""
    return F.regexp_extract(error, r"build piece\s+(\d+)\s*,\s*(\d+)\s*(?::|$)", part).try_cast("int")


def classify_error(error: Column) -> Column:
    lower = F.lower(error)
    out = None
    for name, words in ERROR_RULES:
        out = (F.when if out is None else out.when)(any_word(lower, words), name)
    piece = piece_of(error, 1).isNotNull() & piece_of(error, 2).isNotNull()
    out = out.when(any_word(lower, ("shaped outline", "shaped tray")) & any_word(lower, ("tray", "top-lip")), "tray")
    out = out.when(~piece & any_word(lower, ("outline", "super-tile mode")), "outline").when(piece, "piece").when(any_word(lower, WRITE_WORDS), "output")
    return out.when(error.isNotNull(), "other")
