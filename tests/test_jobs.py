"""From pictures to predictions: reals are reddish, fakes bluish, and one file cannot be read."""

import json

import numpy as np
import pytest

from gaugeworks import jobs
from gaugeworks.functions.images import encode_png
from gaugeworks.operators import leakage
from gaugeworks.sources import manifests

FILES = {"real_coco": ("val2017", 12), "real_imagenet": ("x", 10), "dalle3": ("Advanced", 14), "real_laion5b": ("y", 16), "dalle2": ("z", 16)}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("wild")
    rng = np.random.default_rng(0)
    (at / "csv").mkdir()
    for name, (folder, n) in FILES.items():
        fake = name.startswith("dalle")
        rows = ["Generator,Architecture,Weight,Category,IsAdvanced,IsFake,Image_path,Num"]
        (at / f"images/{name}/{folder}").mkdir(parents=True)
        for i in range(n):
            x = rng.integers(0, 90, (24, 32, 3)) + np.array([20, 40, 130] if fake else [130, 40, 20])
            (at / f"images/{name}/{folder}/{i}.png").write_bytes(encode_png(x.astype(np.uint8)))
            rows.append(f"g,a,w,c,1,{int(fake)},./{name}/{folder}/{i}.png,{i}")
        (at / f"csv/{name}.csv").write_text("\n".join(rows))
    return str(at)


def test_build_train_evaluate_predict_compare(spark, root, tmp_path):
    out = str(tmp_path)
    assert jobs.build_val(spark, root, out, n_alternative=10) == 36
    doc = json.load(open(f"{out}/validation.json"))
    assert len(doc["val"]) == 26 and len(doc["alt_real"]) == 10
    summary = jobs.train(spark, root, ["real_laion5b", "dalle2"], out, f"{out}/exclusion")
    assert summary["clean_auc_primary"] > 0.9
    with pytest.raises(leakage.LeakageError):  # validation pictures are held out
        jobs.train(spark, root, ["real_imagenet", "dalle2"], out, f"{out}/exclusion")
    with pytest.raises(manifests.PolicyError):
        jobs.train(spark, root, ["dalle3"], out, f"{out}/exclusion")
    with pytest.raises(FileNotFoundError):
        jobs.train(spark, root, ["dalle2"], out, f"{out}/none")
    told = jobs.evaluate(spark, root, f"{out}/head", f"{out}/arm/eval", n_alternative=10, name="arm")
    assert told["clean_auc"] > 0.9 and told["n_full_set"] == 26 and told["class_ratio"] == "1:1.17" and told["worst_condition"]
    grid = spark.read.csv(f"{out}/arm/eval/auc_grid", header=True)
    assert grid.count() == 15 and spark.read.csv(f"{out}/arm/eval/thresholds", header=True).count() == 14 and spark.read.csv(f"{out}/arm/eval/errors_top", header=True).count() == 40
    assert [(r.arm, r.worst_condition) for r in jobs.compare(spark, [f"{out}/arm", f"{out}/gone"], f"{out}/comparison").collect()] == [("arm", told["worst_condition"])]
    (tmp_path / "cut.png").write_bytes(b"no picture")
    import shutil

    shutil.copytree(f"{root}/images", f"{out}/asked")
    shutil.copy(tmp_path / "cut.png", f"{out}/asked/cut.png")
    assert jobs.predict(spark, f"{out}/asked", f"{out}/pred.json", f"{out}/head") == (68, 1)
    got = json.load(open(f"{out}/pred.json"))
    assert len(got) == 68 and all(0 <= r["pred"] <= 1 for r in got) and [r["image_path"] for r in got] == sorted(r["image_path"] for r in got)
