"""Path, tag and plan expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Picture extensions, and directory names that label what lies in them.
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp"]
FAKE_DIRECTORIES = ["ai", "fake", "fakes", "synthetic", "generated", "1"]
REAL_DIRECTORIES = ["real", "reals", "nature", "natural", "0"]


def strip_leading(path: Column) -> Column:
    """Without any leading run of dots and slashes."""
    return F.regexp_replace(path, r"^[./]+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def is_picture(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def category(path: Column) -> Column:
    """File name without extension and without a trailing _digits."""
    return F.regexp_replace(stem(path), r"_\d+$", "")


def shard_of(path: Column) -> Column:
    """What stands before the last # of a row pointer."""
    return F.regexp_extract(path, r"^(.*)#[^#]*$", 1)


def row_of(path: Column) -> Column:
    return F.regexp_extract(path, r"#(\d+)$", 1).try_cast("bigint")


def directory_label(path: Column) -> Column:
    """0 or 1 by the nearest ancestor directory with a telling name, null if none has one."""
    dirs = F.reverse(F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    told = F.filter(dirs, lambda d: d.isin(*FAKE_DIRECTORIES, *REAL_DIRECTORIES))
    return F.when(F.size(told) > 0, F.when(F.element_at(told, 1).isin(*FAKE_DIRECTORIES), 1).otherwise(0))


def directory_split(path: Column) -> Column:
    """The first part of the path that is train, val or test."""
    return F.get(F.filter(F.split(F.lower(path), "/"), lambda d: d.isin("train", "val", "test")), 0)


def condition_tag(transform: Column, level: Column) -> Column:
    """clean, or <transform>_<level text>."""
    return F.when(level.isNull(), transform).otherwise(F.concat_ws("_", transform, level))


def plan_steps(plan: Column) -> Column:
    """'jpeg:30|blur:1.0' as array of (family, level); an empty text is an empty plan."""
    parts = F.filter(F.split(plan, r"\|"), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(F.substring_index(s, ":", 1).alias("family"), F.substring_index(s, ":", -1).try_cast("double").alias("level")))


def plan_text(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["family"], s["level"].cast("string"))), "|")


def keep_any(path: Column, pieces: list[str]) -> Column:
    """Contains any of the literal pieces; no piece keeps everything."""
    kept = F.lit(not pieces)
    for p in pieces:
        kept = kept | path.contains(p)
    return kept


def class_ratio(real: Column, fake: Column) -> Column:
    """'1:x', fakes for each real, two digits, halves to the even one."""
    return F.when(real > 0, F.format_string("1:%.2f", F.rint(fake / real * 100) / 100))


def plain(text: Column) -> Column:
    """Letter case and surrounding or repeated white space do not matter."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def is_clip_id(text: Column) -> Column:
    """Lower-case letters, digits and underscores only."""
    return text.rlike("^[a-z0-9_]+$")


def problems(checks: list[tuple[Column, Column]]) -> Column:
    """The texts of the predicates that hold, joined by commas; null if none does."""
    found = F.array_compact(F.array(*[F.when(c, text) for c, text in checks]))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def file_digest(content: Column) -> Column:
    """SHA-256 of a file's content."""
    return F.sha2(content, 256)


def cache_key(*parts: Column) -> Column:
    """First ten hexadecimal digits of the MD5 of the parts, joined by a bar."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10)


def head_map(names: list[str], scores: list[Column]) -> Column:
    """Scores of heads as a map by name."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*scores))


def all_names(a: Column, b: Column) -> Column:
    """Names of either array, each once."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


# What may stand before a base source.
SOURCE_PREFIXES = ["val", "altreal", "external"]


def source_prefix(source: Column) -> Column:
    return F.regexp_extract(plain(source), "^(" + "|".join(SOURCE_PREFIXES) + "):", 1)


def base_source(source: Column) -> Column:
    return F.regexp_replace(plain(source), "^((" + "|".join(SOURCE_PREFIXES) + "):)+", "")
