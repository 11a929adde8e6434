"""Manifests of labelled samples from CSV files, Parquet shards and directory trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings as S
from ..operators.sampling import seeded_sample, stratified_sample

#: A manifest: identity is path; pos orders it explicitly.
MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("source", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("harmonize", T.BooleanType())])
_CSV = "Generator string, Architecture string, Weight string, Category string, IsAdvanced int, IsFake int, Image_path string, Num int"
_COLUMNS = [f.name for f in MANIFEST]


class PolicyError(ValueError):
    """A manifest breaks a rule of the workload."""


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path) of all files under root, relative to it, without reading their content."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")
    base = "file:" + root if "://" not in root and not root.startswith("file:") else root
    prefix = base.rstrip("/").replace("file:///", "file:/") + "/"
    return d.select(F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:/'), {len(prefix) + 1})").alias("path"))


def _manifest(df: DataFrame, path: Column, label: Column, source: Column, meta: Column | None = None, harmonize: bool = False) -> DataFrame:
    none = F.lit(None).cast("map<string,string>")
    return df.select(path.alias("path"), label.cast("int").alias("label"), source.cast("string").alias("source"), (none if meta is None else meta).alias("meta"), F.lit(harmonize).alias("harmonize"))


def label_csv(spark: SparkSession, root: str, name: str, n: int | None = None, seed: int = 0, path_filter: str | None = None, require_exists: bool = True, prefix: str = "") -> DataFrame:
    """Rows of <root>/csv/<name>.csv, whose pictures lie under <root>/images: literal filter on the path, leading dots and
    slashes stripped, existing files only, a seeded sample of n if given."""
    d = spark.read.csv(f"{root}/csv/{name}.csv", header=True, schema=_CSV)
    root = root.rstrip("/") + "/images"
    if path_filter:
        d = d.filter(F.col("Image_path").contains(path_filter))
    d = d.withColumn("_p", S.strip_leading(F.col("Image_path")))
    if require_exists:
        d = d.join(files(spark, root).select(F.col("path").alias("_p")), "_p", "left_semi")
    out = _manifest(d, F.concat(F.lit(root + "/"), "_p"), F.col("IsFake"), F.lit(f"{prefix}wildfake:{name}"), F.create_map(F.lit("advanced"), F.col("IsAdvanced").cast("string")))
    return out if n is None else seeded_sample(out, n, seed)


def validation_set(spark: SparkSession, root: str) -> DataFrame:
    """Reals of one file whose path holds /val2017/, then fakes of another whose path holds /Advanced/."""
    return union([label_csv(spark, root, "real_coco", path_filter="/val2017/", prefix="val:"), label_csv(spark, root, "dalle3", path_filter="/Advanced/", prefix="val:")])


def alternative_reals(spark: SparkSession, root: str, name: str = "real_imagenet", n: int = 2000, seed: int = 0) -> DataFrame:
    return label_csv(spark, root, name, n, seed, prefix="altreal:")


def label_shards(spark: SparkSession, pattern: str, source: str, n: int | None = None, seed: int = 0, include_tampered: bool = False) -> DataFrame:
    """Parquet shards (img_id, label 0 / 1 / 2): label 2 is dropped, or counts as 1 if tampered pictures are
    included, a null label stays null, path is shard#row. Only these two columns are read."""
    d = spark.read.parquet(pattern).select("img_id", "label", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    if not include_tampered:
        d = d.filter("label is null or label <> 2")
    out = _manifest(d, F.concat_ws("#", "_f", F.col("_r").cast("string")), F.when(F.col("label") >= 1, 1).when(F.col("label") == 0, 0), F.lit(source), F.create_map(F.lit("img_id"), F.col("img_id"), F.lit("raw_label"), F.col("label").cast("string")))
    return out if n is None else stratified_sample(out, n, seed)


def shard_content(spark: SparkSession, pattern: str, manifest: DataFrame, column: str = "image") -> DataFrame:
    """The manifest with the picture bytes of its shard rows, the cell being a struct with `bytes` or the bytes themselves.
    Bytes are read only for rows of the manifest's shards and travel once, after the row pointers are joined."""
    raw = spark.read.parquet(pattern)
    cell = F.col(f"{column}.bytes") if isinstance(raw.schema[column].dataType, T.StructType) else F.col(column)
    content = raw.select(F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("path"), cell.alias("content"))
    return manifest.join(content, "path")


def materialised(spark: SparkSession, pattern: str, manifest: DataFrame, folder: str, column: str = "image") -> DataFrame:
    """Write the pictures of shard rows as files <folder>/<img_id>, by the tasks that read them, and return the manifest with
    these paths. What is there already is neither read nor written again."""
    from ..storage import filesystem

    fs, p = filesystem(spark, folder)
    fs.mkdirs(p)
    named = manifest.withColumn("_file", F.col("meta")["img_id"])
    present = files(spark, folder).select(F.col("path").alias("_file"))
    missing = shard_content(spark, pattern, named.join(present, "_file", "left_anti"), column).filter("content is not null").select("_file", "content")

    def write(batches, folder=folder):
        from pyarrow import fs as arrow_fs

        store, base = arrow_fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_output_stream(f"{base}/{name}") as f:
                    f.write(data)
            yield b.select([0])

    missing.mapInArrow(write, "_file string").write.format("noop").mode("overwrite").save()
    return named.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "_file")).drop("_file")


def labelled_tree(spark: SparkSession, root: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """Pictures under root, labelled by the nearest ancestor directory with a telling name; unlabelled ones are skipped.
    Columns: path, label, split, category."""
    d = files(spark, root).filter(S.is_picture(F.col("path"))).withColumn("label", S.directory_label(F.col("path"))).filter("label is not null")
    out = d.select("path", "label", S.directory_split(F.col("path")).alias("split"), S.category(F.col("path")).alias("category"))
    return out.orderBy("path") if n is None else seeded_sample(out, n, seed)


def two_class_tree(spark: SparkSession, root: str, n: int | None = None, seed: int = 0, source: str = "cifake") -> DataFrame:
    """{train,test}/{REAL,FAKE}/* with the label of the directory."""
    d = files(spark, root).filter(S.is_picture(F.col("path"))).withColumn("_d", F.element_at(F.split("path", "/"), -2)).filter(F.col("_d").isin("REAL", "FAKE"))
    out = _manifest(d, F.concat(F.lit(root.rstrip("/") + "/"), "path"), F.when(F.col("_d") == "FAKE", 1).otherwise(0), F.lit(source))
    return out if n is None else seeded_sample(out, n, seed)


def score_rows(spark: SparkSession, pattern: str, picture: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """External shards: label, bytes and, where they exist, model_name, architecture and real_source; other columns are not read."""
    raw = spark.read.parquet(pattern)
    cell = F.col(f"{picture}.bytes") if isinstance(raw.schema[picture].dataType, T.StructType) else F.col(picture)
    extra = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("model_name", "architecture", "real_source")]
    out = raw.select(F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("path"), "label", *extra, cell.alias("content"))
    return out if n is None else seeded_sample(out, n, seed)


def pictures(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the pictures under root, by extension in any letter case."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return d.filter(S.is_picture(F.col("path"))).select("path", "content").orderBy("path")


def decoded_pictures(spark: SparkSession, root: str) -> DataFrame:
    """(path, picture) of the pictures under root, decoded by the JVM (JPEG, PNG, BMP, GIF); a picture that it cannot read has nulls."""
    from ..functions.images import from_image_source

    d = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    return d.filter(S.is_picture(F.col("image.origin"))).select(F.col("image.origin").alias("path"), from_image_source(F.col("image")).alias("picture"))


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows in the order of the parts, with `part` as an explicit ordinal."""
    return reduce(DataFrame.unionByName, [p.select(*_COLUMNS, F.lit(i).alias("part")) if "part" not in p.columns else p.drop("part").withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


#: The piece of the path that training rows of a source must hold.
TRAINING_PIECES = {"real_coco": "/test2017/"}


def training_set(spark: SparkSession, root: str, names: list[str], n: int | None = None, seed: int = 0, forbidden: tuple[str, ...] = ("dalle3",)) -> DataFrame:
    """Training rows of the named CSV files; a forbidden one raises before anything is read, and reals of the validation's file come
    from another part of it."""
    if set(names) & set(forbidden):
        raise PolicyError(f"training must not use {sorted(set(names) & set(forbidden))}")
    return training_manifest([label_csv(spark, root, x, n, seed, TRAINING_PIECES.get(x)) for x in names])


def training_manifest(parts: list[DataFrame], forbidden: list[str] = ("wildfake:dalle3",)) -> DataFrame:
    """Union of the training sources, all to be harmonised; a forbidden source raises before anything is computed."""
    out = union(parts).withColumn("harmonize", F.lit(True))
    if forbidden and not out.filter(F.col("source").isin(*forbidden)).isEmpty():
        raise PolicyError(f"training must not use {list(forbidden)}")
    return out


def with_position(manifest: DataFrame) -> DataFrame:
    """Add pos, the row's place by (part, path), from 0. The sorted table is written; places go in two levels, by its partitions
    and within each, so that no task sees all rows. Seeds never use it."""
    from pyspark.sql.window import Window

    from ..storage import save

    d = save(manifest.orderBy("part", "path").withColumn("_pid", F.spark_partition_id()), "sorted")
    sizes = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy("part", "path")) - 1
    return d.withColumn("_in", inside).join(sizes.select("_pid", before.alias("_before")), "_pid").withColumn("pos", F.col("_before") + F.col("_in")).drop("_pid", "_in", "_before")


def read_config(path: str) -> dict:
    """A configuration file: YAML where a reader of it is installed, JSON in any case."""
    import json

    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path} needs a YAML reader; JSON is read without") from e
    return yaml.safe_load(text) or {}


def summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON summaries of arms, one file each; missing files are left out. `arm` is the directory above eval/."""
    import os

    there = [p for p in paths if "://" in p or os.path.exists(p)]
    if not there:
        return spark.createDataFrame([], "arm string")
    return spark.read.option("multiLine", "true").json(there).withColumn("arm", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))


def clip_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each clip of a manifest {clips: [...]} with nested trim."""
    return spark.read.option("multiLine", "true").json(path).select(F.inline("clips"))


def feed(clips: DataFrame, present: DataFrame, checks: DataFrame) -> DataFrame:
    """Clips to be shipped whose file is present, with their check results if any. All three keyed by id."""
    return clips.filter("ship").join(present.select("id"), "id", "left_semi").join(checks, "id", "left")


def shard_numbers(spark: SparkSession, first: int = 12, then: int = 20, step: int = 22, last: int = 413) -> DataFrame:
    """Which shards to fetch: the first ones, then every step-th."""
    return spark.range(first).select(F.col("id").cast("int").alias("shard")).union(spark.range(then, last, step).select(F.col("id").cast("int")))


# Training shards by download round, first and last.
TRAINING_SHARDS = [(0, 7), (8, 23)]


def training_shards(spark: SparkSession) -> DataFrame:
    """(shard, download): which training shards are fetched in which round."""
    parts = [spark.range(a, b + 1).select(F.col("id").cast("int").alias("shard"), F.lit(i).alias("download")) for i, (a, b) in enumerate(TRAINING_SHARDS)]
    return reduce(DataFrame.unionByName, parts)


def wanted_members(members: DataFrame, wanted: DataFrame, present: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """Archive members whose base name is wanted and not yet present (by name), a seeded sample of n of them if given."""
    named = members.withColumn("_b", S.basename(F.col("name")))
    out = named.join(wanted.select(S.basename(F.col("name")).alias("_b")).distinct(), "_b", "left_semi").join(present.select(S.basename(F.col("name")).alias("_b")), "_b", "left_anti").drop("_b")
    return out if n is None else seeded_sample(out, n, seed, "name")


def missing_members(members: DataFrame, present: DataFrame) -> DataFrame:
    """Members that are not present with the same size (name, size)."""
    return members.join(present.select("name", "size"), ["name", "size"], "left_anti")
