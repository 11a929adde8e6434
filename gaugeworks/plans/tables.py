"""The tables that the queries start from, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators.grids import with_tag


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Usable scores, with the tag and order of their condition; rows that stand twice count once (by a hash aggregate of whole
    rows: one that picks a row for each key would have to sort)."""
    e = table(spark, d, "errors_top").select("err_id", "arm", "path", "score", "label", "condition")
    e = e.filter(F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1))
    return with_tag(e.distinct(), table(spark, d, "conditions"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows, each once: labels above 1 are 1, source and split in plain spelling."""
    s = table(spark, d, "samples").dropDuplicates(["sample_id"])
    label = F.when(F.col("label") > 1, 1).otherwise(F.col("label"))
    return s.select("sample_id", "path", label.alias("label"), F.col("label").alias("raw_label"), S.plain(F.col("source")).alias("source"), S.plain(F.col("split")).alias("split"), "meta", "harmonize", F.lower("content_hash").alias("content_hash"), "width", "height")


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """(path, source, real_set): one row for each path of the manifest."""
    return samples(spark, d).groupBy("path").agg(F.min(S.base_source(F.col("source"))).alias("source"), F.when(F.max(F.col("source").startswith("altreal:").cast("int")) == 1, "alt").otherwise("primary").alias("real_set"))


def scored_pictures(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).join(pictures(spark, d), "path")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Scored frames, each (vid, seq) once."""
    return table(spark, d, "frame_scores").dropDuplicates(["vid", "seq"]).filter("ok and p is not null")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors, each once: (vec_id, tag, path, label, plans, feats)."""
    from ..functions.vectors import usable

    v = table(spark, d, "feature_cache").filter(usable(F.col("feats"), 64)).dropDuplicates(["vec_id"])
    return v.select("vec_id", "tag", F.col("paths").alias("path"), F.col("labels").cast("int").alias("label"), "plans", "feats")


def plain_sql(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


_PREFIX = "|".join(S.SOURCE_PREFIXES)
SCORED = r"""scored as (
  select distinct on (e.err_id) e.err_id, e.arm, e.path, e.score, e.label, c.tag, c.ord
  from (select *, lower(trim(regexp_replace(condition, '\s+', ' ', 'g'))) as spelt from errors_top) e join conditions c
    on regexp_extract(e.spelt, '^([^0-9@_:= -]+)', 1) = lower(c.transform)
    and try_cast(regexp_extract(e.spelt, '([0-9]+\.?[0-9]*|\.[0-9]+)$', 1) as double) is not distinct from try_cast(c.level as double)
  where e.label is not null and e.score is not null and not isnan(e.score) and e.score between 0 and 1)"""
SAMPLES = f"""s as (
  select distinct on (sample_id) sample_id, path, case when label > 1 then 1 else label end as label, label as raw_label, {plain_sql('source')} as source,
    {plain_sql('split')} as split, meta, harmonize, lower(content_hash) as content_hash, width, height from samples)"""
PICTURES = f"""{SAMPLES},
pictures as (
  select path, min(regexp_replace(source, '^(({_PREFIX}):)+', '')) as source,
    case when max(case when source like 'altreal:%' then 1 else 0 end) = 1 then 'alt' else 'primary' end as real_set from s group by path),
scored_pictures as (select scored.*, pictures.source, pictures.real_set from scored join pictures using (path))"""
FRAMES = "f as (select * from (select distinct on (vid, seq) * from frame_scores) where ok and p is not null)"
VECTORS = """v as (
  select distinct on (vec_id) vec_id, tag, paths as path, labels::int as label, plans, feats from feature_cache
  where len(feats) = 64 and len(list_filter(feats, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64)"""


def with_(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"
