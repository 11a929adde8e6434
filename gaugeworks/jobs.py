"""Jobs from manifests to reports: python -m gaugeworks.jobs {build_val,train,evaluate,predict,compare} ...

Feature vectors come from a provider; the default is eight numbers of a picture, which stands in for a deep backbone.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import images, strings
from .functions.vectors import scores
from .operators import grids, leakage, models, roc
from .session import session
from .sources import manifests, sinks
from .storage import save


def features_of(pictures: DataFrame) -> DataFrame:
    """Add feats to rows with a picture; null where it could not be read."""
    return pictures.withColumn("feats", images.stub_features("picture"))


def _with_pictures(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """The manifest with its decoded pictures; `decode_ok` says whether one could be read."""
    strip = lambda c: F.regexp_replace(c, "^file:/+", "/")
    seen = manifests.decoded_pictures(spark, root).select(strip(F.col("path")).alias("_path"), "picture")
    d = manifest.withColumn("_path", strip(F.col("path"))).join(seen, "_path", "left").drop("_path")
    return d.withColumn("decode_ok", F.col("picture.rgb").isNotNull())


def predict(spark: SparkSession, folder: str, output: str, head: str) -> tuple[int, int]:
    """Score every picture under a folder and write [{image_path, pred}]; unreadable ones are left out. (written, skipped)."""
    weights, bias = sinks.read_head(spark, head)
    d = features_of(manifests.decoded_pictures(spark, folder)).select("path", "feats")
    return sinks.write_predictions(scores(d, "feats", {"head": (weights, bias)}).select("path", F.col("p_head").alias("p")), output)


def build_val(spark: SparkSession, root: str, out: str, alternative: str = "real_imagenet", n_alternative: int = 1000) -> int:
    """Write the validation manifest and the exclusion list of its pictures; the number of distinct hashes."""
    val, alt = manifests.validation_set(spark, root), manifests.alternative_reals(spark, root, alternative, n_alternative)
    sinks.write_validation(val, alt, f"{out}/validation.json")
    both = manifests.union([val, alt])
    hashed = _with_pictures(spark, both, f"{root}/images").select(images.content_hash_udf("picture").alias("content_hash"))
    return sinks.write_list(hashed, "content_hash", f"{out}/exclusion")


def train(spark: SparkSession, root: str, names: list[str], out: str, exclusion: str, alternative: str = "real_imagenet", given: dict | None = None) -> dict:
    """Train a head on a clean and a degraded draw of the training pictures, after the leakage check; the summary.

    Refuses to start without an exclusion list, and if a training picture is on it."""
    excluded = leakage.read_exclusion(spark, exclusion)
    rows = save(_with_pictures(spark, manifests.training_set(spark, root, names), f"{root}/images").filter("decode_ok"), "pictures")
    leakage.assert_no_leak(rows.withColumn("content_hash", images.content_hash_udf("picture")), excluded)
    rows = rows.withColumn("picture", images.harmonize_udf("picture", "harmonize"))
    draw = lambda seed: save(features_of(rows.withColumn("picture", images.degrade_udf(seed)("picture", "path"))).select("path", "label", "feats"), "draw")
    val = save(features_of(_with_pictures(spark, manifests.validation_set(spark, root), f"{root}/images").filter("decode_ok")), "val")
    alt = save(features_of(_with_pictures(spark, manifests.alternative_reals(spark, root, alternative), f"{root}/images").filter("decode_ok")), "alt")
    worse = save(features_of(val.withColumn("picture", images.degrade_udf(999)("picture", "path"))).select("label", "feats"), "worse")
    heads, history, summary = models.train_frozen([draw(0), draw(1)], val.select("label", "feats"), worse, alt.select("label", "feats"), given or models.setting(norm="none", epochs=40, lr=0.3, wd=0.0))
    rows_ = [(0, [0.0] * heads.weights.shape[1], 0.0), (1, heads.weights[0].tolist(), float(heads.bias[0]))]
    sinks.save_best_head(spark, rows_, "head", summary["best_epoch"], summary["best_robust_val_auc"], f"{out}/head")
    for name, value in (("train_history.json", history), ("train_summary.json", summary)):
        with sinks.text_file(spark, f"{out}/{name}") as write:
            write(json.dumps(value, indent=1))
    return summary


def evaluate(spark: SparkSession, root: str, head: str, out: str, alternative: str = "real_imagenet", n_alternative: int = 1000, name: str = "head") -> dict:
    """Score validation and alternative reals under every condition once, and write grid, thresholds, errors and summary from that table."""
    weights, bias = sinks.read_head(spark, head)
    val, alt = manifests.validation_set(spark, root), manifests.alternative_reals(spark, root, alternative, n_alternative)
    both = manifests.union([val, alt]).withColumn("real_set", F.when(F.col("part") == 1, "alt").otherwise("primary"))
    pictures = save(_with_pictures(spark, both, f"{root}/images").withColumn("content_hash", images.content_hash_udf("picture")), "pictures")
    parts, order = [], 0
    for family, level in [("clean", None), *((f, x) for f, k in images.FAMILIES.items() for x in k.levels)]:
        tag = family if level is None else f"{family}_{level}"
        shown = pictures.withColumn("picture", images.condition_udf(family, level)("picture", "path"))
        parts.append(scores(features_of(shown), "feats", {"head": (weights, bias)}).select("path", "label", "real_set", "content_hash", F.lit(tag).alias("tag"), F.lit(order).alias("ord"), F.col("p_head").alias("score"), F.monotonically_increasing_id().alias("err_id")))
        order += 1
    scored = save(models.union_all(parts), "scored")
    grid = save(grids.auc_grid(scored), "grid")
    sinks.write_table(grid.orderBy("ord"), f"{out}/auc_grid")
    clean = scored.filter("tag = 'clean' and real_set = 'primary'")
    curve = roc.roc_curve(clean, [])
    sinks.write_table(roc.threshold_table(clean, [], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]).withColumn("note", F.lit(None).cast("string")).unionByName(roc.operating_points(curve, []).select("threshold", "fpr", "tpr", F.concat(F.lit("@FPR<="), F.col("max_fpr")).alias("note"))), f"{out}/thresholds")
    sinks.write_table(grids.top_errors(scored.filter("real_set = 'primary'")).select("path", "score", "label", F.col("tag").alias("condition")), f"{out}/errors_top")
    whole, once = roc.metrics(clean, []).first(), roc.metrics(leakage.keep_first(clean, "content_hash", ["path"]), []).first()
    s = grids.grid_summary(grid).first().asDict()
    first = grid.filter("tag = 'clean'").first()
    ratio = scored.sparkSession.range(1).select(strings.class_ratio(F.lit(first.n_real_primary), F.lit(first.n_fake))).first()[0]
    summary = s | {"config": name, "parameters": len(weights[1]) + 1, "clean_auc_alt_real": first.auc_alt, "shortcut_gap_clean": first.shortcut_gap, "class_ratio": ratio, "n_full_set": whole.n, "clean_auc_full_set": whole.auc, "n_full_set_dedup": once.n, "clean_auc_full_set_dedup": once.auc}
    with sinks.text_file(spark, f"{out}/summary.json") as write:
        write(json.dumps(summary, indent=1))
    return summary


def compare(spark: SparkSession, folders: list[str], out: str) -> DataFrame:
    """One row for each arm that has eval/summary.json; the others are left out."""
    found = manifests.summaries(spark, [f"{f}/eval/summary.json" for f in folders])
    if "config" not in found.columns:
        return found
    columns = ["config", "parameters", "clean_auc", "clean_auc_alt_real", "mean_degraded_auc", "worst_condition", "worst_auc", "max_delta"]
    table = found.select(*[c for c in columns if c in found.columns]).withColumnRenamed("config", "arm")
    sinks.write_table(table, out)
    return table


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="gaugeworks.jobs")
    sub = ap.add_subparsers(dest="job", required=True)

    def job(name, *flags):
        p = sub.add_parser(name)
        for f in flags:
            p.add_argument(f"--{f}", required=True, nargs="+" if f in ("sources", "dirs") else None)

    job("build_val", "root", "out")
    job("train", "root", "sources", "out", "exclusion")
    job("evaluate", "root", "head", "out")
    job("predict", "image_dir", "head", "output")
    job("compare", "dirs", "out")
    a = ap.parse_args(argv)
    spark = session(f"gaugeworks {a.job}")
    run = {
        "build_val": lambda: build_val(spark, a.root, a.out), "train": lambda: train(spark, a.root, a.sources, a.out, a.exclusion), "evaluate": lambda: evaluate(spark, a.root, a.head, a.out),
        "predict": lambda: predict(spark, a.image_dir, a.output, a.head), "compare": lambda: compare(spark, a.dirs, a.out).show(truncate=False)}
    print(run[a.job]())


if __name__ == "__main__":
    main()
