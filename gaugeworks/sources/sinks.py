"""What results are written as: lists, tables, JSON, a versioned feature store and Markdown."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import clamp
from ..storage import filesystem


@contextmanager
def text_file(spark: SparkSession, path: str) -> Iterator[Callable[[str], None]]:
    """A text file on the store that `path` names, written piece by piece from the driver."""
    fs, p = filesystem(spark, path)
    out = spark.sparkContext._jvm.java.io.OutputStreamWriter(fs.create(p, True), "UTF-8")
    try:
        yield out.write
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file on the store, None if there is none."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_list(df: DataFrame, column: str, path: str) -> int:
    """Distinct non-null values in order, one on a line, in files sorted among each other; returns their number."""
    df.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path).count()


def write_table(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for report tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_predictions(scored: DataFrame, path: str, score: str = "p", key: str = "path", parts: bool = False) -> tuple[int, int]:
    """A JSON array of image_path and pred in path order; rows without a score are left out. Returns (written, skipped).

    Tasks sort and format; one sorted partition at a time passes through the driver into the file. parts: JSON lines
    written by the tasks themselves into a folder, for any size.
    """
    spark = scored.sparkSession
    d = scored.select(F.col(key).alias("image_path"), clamp(F.col(score)).alias("pred"))
    lines = d.filter("pred is not null").orderBy("image_path").select(F.to_json(F.struct("image_path", "pred")).alias("value"))
    written = 0
    if parts:
        lines.write.mode("overwrite").text(path)
        written = spark.read.text(path).count()
    else:
        with text_file(spark, path) as write:
            write("[")
            for r in lines.toLocalIterator():
                write((",\n " if written else "\n ") + r.value)
                written += 1
            write("\n]\n" if written else "]\n")
    return written, d.filter("pred is null").count()


def write_validation(validation: DataFrame, alternative: DataFrame, path: str) -> None:
    """One JSON document with the rows [path, label, source] of `val` and of `alt_real`."""
    with text_file(validation.sparkSession, path) as write:
        for name, df in (("val", validation), ("alt_real", alternative)):
            write(("{" if name == "val" else ",\n") + json.dumps(name) + ": [")
            for i, r in enumerate(df.select("path", "label", "source").toLocalIterator()):
                write((",\n " if i else "\n ") + json.dumps([r.path, r.label, r.source]))
            write("]")
        write("}\n")


def digest(manifest: DataFrame) -> str:
    """A fingerprint of the set of (path, label): an order-independent sum of row hashes, and the row count."""
    r = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "label").cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}-{r.h}"


class FeatureStore:
    """Feature vectors in Parquet, partitioned by backbone and tag, each with the digest of the manifest it was made from."""

    def __init__(self, root: str):
        self.root = root

    def _note(self, backbone: str, tag: str) -> str:
        return f"{self.root}/_digest-{backbone}-{tag}"

    def get_or_extract(self, manifest: DataFrame, backbone: str, tag: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stored vectors if they were made from this manifest, else new ones, which replace them."""
        spark, now = manifest.sparkSession, digest(manifest)
        note = self._note(backbone, tag)
        part = f"{self.root}/backbone={backbone}/tag={tag}"
        if read_text(spark, note) != now:
            extract(manifest).write.mode("overwrite").parquet(part)
            with text_file(spark, note) as write:
                write(now)
        return spark.read.parquet(part).withColumn("backbone", F.lit(backbone)).withColumn("tag", F.lit(tag))

    def read(self, spark: SparkSession, tag: str | None = None) -> DataFrame:
        """All stored vectors, or one tag by partition pruning; a tag that is not there is an error."""
        d = spark.read.parquet(self.root)
        if tag is None:
            return d
        d = d.filter(F.col("tag") == tag)
        if d.isEmpty():
            raise FileNotFoundError(f"no features of {tag}")
        return d

    def one(self, spark: SparkSession, tag: str) -> DataFrame:
        """The vectors of a tag, which exactly one backbone must have; mirrored copies (_flip_) do not count."""
        d = self.read(spark, tag).filter(~F.col("backbone").contains("_flip_"))
        n = d.select("backbone").distinct().count()
        if n != 1:
            raise ValueError(f"{n} backbones have {tag}")
        return d


def markdown(df: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A report table: the columns that exist, nulls blank, floats with four digits."""
    cols = [c for c in columns if c in df.columns]
    show = lambda v: "" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[c]) for c in cols) + " |" for r in df.select(*cols).limit(limit).collect())])


def save_head(spark: SparkSession, rows: list[tuple], name: str, epoch: int, path: str) -> None:
    """A head as a one-row table of its classes' weights."""
    spark.createDataFrame([(name, epoch, rows)], "name string, epoch int, head array<struct<class:int,weights:array<double>,bias:double>>").write.mode("overwrite").parquet(path)


def save_best_head(spark: SparkSession, rows: list[tuple], name: str, epoch: int, value: float, path: str) -> bool:
    """save_head if `value` is above that of the head kept at `path`; whether it was."""
    kept = read_text(spark, f"{path}.best")
    if kept is not None and value <= float(kept):
        return False
    save_head(spark, rows, name, epoch, path)
    with text_file(spark, f"{path}.best") as write:
        write(repr(float(value)))
    return True


def read_head(spark: SparkSession, path: str) -> tuple[list[list[float]], list[float]]:
    """(weights, bias) of a kept head, by class."""
    head = sorted(spark.read.parquet(path).first()["head"], key=lambda c: c["class"])
    return [list(c["weights"]) for c in head], [c["bias"] for c in head]
