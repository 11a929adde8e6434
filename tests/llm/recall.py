"""Recall of the registered p2 queries against brute force: python -m tests.llm.recall FOLDER [TIMES] [QUERIES].

TIMES > 1 enlarges feature_cache in /tmp by vectors whose numbers are permuted and slightly moved. Not a test: pytest does not collect it.
"""

import os
import shutil
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from gaugeworks.llm import neighbours, queries


def enlarge(folder: str, times: int) -> str:
    out = f"/tmp/recall_{times}"
    shutil.rmtree(out, ignore_errors=True)
    os.makedirs(f"{out}/feature_cache.parquet")
    t = ds.dataset(f"{folder}/feature_cache.parquet").to_table(columns=["vec_id", "paths", "feats"]).combine_chunks()
    at, x = neighbours._numbers(t.column("feats").combine_chunks(), 64)
    ids, paths = t.column("vec_id").to_numpy()[at], t.column("paths").take(pa.array(at))
    step, rng = int(ids.max()) + 1, np.random.default_rng(0)
    step += -step % 20
    for k in range(times):
        y = x if not k else x[:, rng.permutation(64)] * (1 + 0.02 * rng.normal(size=x.shape))
        feats = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * 64), pa.array(y.astype(np.float32).ravel()))
        pq.write_table(pa.table({"vec_id": ids + k * step, "paths": paths, "feats": feats}), f"{out}/feature_cache.parquet/{k}.parquet", row_group_size=50_000)
    return out


def main() -> None:
    folder, times, asked = sys.argv[1], int((sys.argv + ["1"])[2]) if len(sys.argv) > 2 else 1, int(sys.argv[3]) if len(sys.argv) > 3 else 1000
    if times > 1:
        folder = enlarge(folder, times)
    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "32")
             .config("spark.checkpoint.dir", "file:///tmp/recall_tables").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    t = ds.dataset(f"{folder}/feature_cache.parquet").to_table(columns=["vec_id", "feats"]).combine_chunks()
    at, x = neighbours._numbers(t.column("feats").combine_chunks(), 64)
    ids, first = np.unique(t.column("vec_id").to_numpy()[at], return_index=True)
    x = x[first].astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.random.default_rng(1).permutation(np.flatnonzero(ids % 20 == 0))[:asked]
    near, cos = [], []
    for i in range(0, len(q), 50):
        own = q[i : i + 50]
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -2
        top = np.argpartition(-sim, 9, axis=1)[:, :10]
        near.append(ids[top])
        cos.append(np.take_along_axis(sim, top, 1))
    near, cos = np.concatenate(near), np.concatenate(cos)
    began = time.time()
    got = queries.p2_neighbours(spark, folder).select("vec_id", "neighbour_id").toPandas()
    took = time.time() - began
    have = set(zip(got["vec_id"], got["neighbour_id"]))
    pairs = [(int(ids[a]), int(b)) for a, row in zip(q, near) for b in row]
    print(f"p2_neighbours: {len(ids)} vectors, {len(q)} queries, recall {np.mean([p in have for p in pairs]):.4f}, {took:.0f} s", flush=True)
    began = time.time()
    got = queries.p2_found(spark, folder).toPandas()
    took = time.time() - began
    have = set(zip(got["vec_a"], got["vec_b"]))
    close = [(min(p), max(p)) for p, c in zip(pairs, cos.ravel()) if c >= 0.9 + 1e-6]
    print(f"p2_found: {len(close)} close pairs of the queries, recall {np.mean([p in have for p in close]):.4f}, {took:.0f} s", flush=True)


if __name__ == "__main__":
    main()
