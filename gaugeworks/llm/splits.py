"""Splits that keep related records together (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, filesystem, plain, prefix_sums, save, small_rows

# What stands in an author field and names nobody.
NOBODY = ["", "-", "--", "?", "n/a", "na", "n.a.", "none", "null", "nan", "nil", "unknown", "anonymous", "anon", "not given", "not available", "not known", "unnamed", "nobody", "no author", "unspecified", "undefined", "various", "tbd", "unknown author", "author unknown", "."]
# The fields that name an author, and what may stand before a base source.
AUTHOR_FIELDS = ["author", "creator", "photographer"]
PREFIXES = ["val", "altreal", "external"]
#: A key is hot if it holds more than this share of all links, so there are at most 1 / share of them.
HOT_SHARE = 1 / 2000
#: A key of fewer links is never hot.
HOT_LEAST = 10_000
#: Rows of a contraction's table up to which one task can take a join key's whole group.
ONE_TASK = 1_000_000
QUARANTINE = "quarantine"


def base_source(source: Column | str) -> Column:
    """A source in lower case without its prefixes."""
    return F.regexp_replace(plain(source), r"^((" + "|".join(PREFIXES) + r") ?: ?)+", "")


def record_links(samples: DataFrame, meta: str = "meta") -> DataFrame:
    """(item, key): what a record shares with others: its author, under any of the fields, and its original picture within
    its base source. Null or empty meta, placeholders instead of an author, a null img_id or a null source give no key.
    Letter case and white space of keys, values and sources never matter."""
    low = F.transform_keys(F.map_filter(F.col(meta), lambda k, v: F.lower(F.trim(k)).isin(*AUTHOR_FIELDS, "img_id")), lambda k, v: k)
    authors = F.transform(F.filter(F.map_entries(low), lambda e: F.lower(F.trim(e["key"])).isin(*AUTHOR_FIELDS)), lambda e: plain(e["value"]))
    named = F.transform(F.filter(authors, lambda a: a.isNotNull() & ~a.isin(*NOBODY)), lambda a: F.concat(F.lit("a:"), a))
    pictures = F.transform(F.filter(F.map_entries(low), lambda e: F.lower(F.trim(e["key"])) == "img_id"), lambda e: plain(e["value"]))
    source = base_source("source")
    shown = F.transform(F.filter(pictures, lambda p: p.isNotNull() & (p != "")), lambda p: F.concat(F.lit("i:"), p, F.lit("|"), source))
    keys = F.filter(F.concat(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(shown, F.array().cast("array<string>"))), lambda k: k.isNotNull())
    return samples.select(F.col("sample_id").cast("long").alias("item"), F.explode(keys).alias("key")).filter("item is not null")


def _join_skewed(big: DataFrame, small: DataFrame, on: str, n: int) -> DataFrame:
    """big join small (one row for each value of `on`, with its `n` rows in big): hot values by broadcast of their rows, of
    which there are at most 1 / HOT_SHARE, the others by shuffle."""
    limit = max(HOT_LEAST, int(n * HOT_SHARE))
    hot = small.filter(F.col("_n") > limit).drop("_n")
    if hot.isEmpty():
        return big.join(small.drop("_n"), on)
    hot = F.broadcast(hot)
    cold = big.join(F.broadcast(hot.select(on)), on, "left_anti").join(small.filter(F.col("_n") <= limit).drop("_n"), on)
    return big.join(hot, on).unionByName(cold)


def _join_hot(big: DataFrame, small: DataFrame, on: str, n: int, how: str = "inner") -> DataFrame:
    """big (n rows) join small (at most one row for each value of `on`): values that are hot in big by broadcast of their
    rows of small, of which there are at most 1 / HOT_SHARE, the others by shuffle."""
    if n <= ONE_TASK:
        return big.join(small, on, how)
    hot = save(big.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n * HOT_SHARE).select(on), "hot")
    if hot.isEmpty():
        return big.join(small, on, how)
    few, hot = F.broadcast(small.join(F.broadcast(hot), on)), F.broadcast(hot)
    return big.join(hot, on, "left_semi").join(few, on, how).unionByName(big.join(hot, on, "left_anti").join(small, on, how))


def contract(edges: DataFrame) -> DataFrame:
    """Components of a graph given by edges (u, v): (node, root), root the smallest node of the component.

    Each round points every node to the smallest of itself and its neighbours, shortens these pointers by jumping
    (pointer of the pointer, twice), and replaces nodes by what they point to; edges inside a new node vanish. A pointer
    that is not at its root yet stays as an edge. The graph shrinks to nothing in a number of rounds that grows as the
    logarithm of its size. Every round is a written table. The root of a giant component is a hot key of every join here.
    """
    edges = save(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    nodes = save(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node")), "roots")
    n_nodes = nodes.count()
    while n_edges := edges.count():
        both = edges.union(edges.select("v", "u"))
        point = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        drafts = []
        for _ in range(2):
            point = save(point, "pointers")
            drafts.append(point)
            up = point.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            point = _join_hot(point, up, "p", n_nodes, "left").select("u", F.coalesce("pp", "p").alias("p"))
        point = save(point, "pointers")
        for d in drafts:
            discard(d)
        rest = point.select(F.col("u").alias("p"), F.col("p").alias("v")).filter("p <> v")  # where a pointer goes on
        rest = point.select("p").distinct().join(rest, "p").select(F.col("p").alias("u"), "v")
        a, b = point.select("u", F.col("p").alias("pu")), point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        new = _join_hot(_join_hot(edges, a, "u", n_edges), b, "v", n_edges).select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        new = save(new.union(rest.select(F.least("u", "v"), F.greatest("u", "v"))).filter("u <> v").distinct(), "edges")
        moved = save(_join_hot(nodes, point.select(F.col("u").alias("root"), "p"), "root", n_nodes, "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        for d in (edges, nodes, point):
            discard(d)
        edges, nodes = new, moved
    return nodes


def link_components(links: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of items that share a key, directly or through others.

    links: (item bigint, key string) of new items. known: the persisted component table (key, component) of earlier items.
    A key stands for its component where it is known, else for its smallest item; an item of several keys is an edge
    between what they stand for. Only these edges are contracted, so neither the size of a key's group nor that of
    the known part matters to the loop. Of the known part only the rows of the new items' keys are used.

    Returns (members, fresh, touched): members (item, component) of the linked new items, component being the smallest
    item; fresh (key, component), the keys that were not known; touched (component, old), the known components that new
    items joined, under their new and old names, which differ where components merged or a smaller item came.
    """
    n = links.count()
    groups = links.groupBy("key").agg(F.min("item").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if known is not None:
        groups = groups.join(known.select("key", F.col("component").alias("_known")), "key", "left")
    else:
        groups = groups.withColumn("_known", F.lit(None).cast("long"))
    groups = save(groups.select("key", F.coalesce("_known", "_first").alias("node"), "_n", F.col("_known").isNotNull().alias("old")), "keys")
    member = _join_skewed(links, groups.select("key", "node", "_n"), "key", n).select("item", "node")
    member = save(member.groupBy("item").agg(F.array_sort(F.collect_set("node")).alias("nodes")), "members")  # the few keys of one record
    edges = member.filter(F.size("nodes") > 1).select(F.col("nodes")[0].alias("u"), F.explode(F.slice("nodes", F.lit(2), F.size("nodes") - 1)).alias("v"))
    if known is not None:  # an item may be smaller than the component it joins: the smallest names it
        edges = edges.union(member.select(F.col("nodes")[0].alias("u"), F.col("item").alias("v")).filter("v < u"))
    roots = contract(edges)
    sizes = member.select(F.col("nodes")[0].alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    names = save(sizes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "_n"), "names")
    members = _join_skewed(member.select("item", F.col("nodes")[0].alias("node")), names, "node", n).select("item", "component")
    named = groups.select("key", "node", "old").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    return members, named.filter("not old").select("key", "component"), named.filter("old").select("component", F.col("node").alias("old")).distinct()


def _assign(samples: DataFrame, targets: DataFrame, known: tuple[DataFrame, DataFrame] | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(assignment, fresh, touched, changed): see assign_splits; changed is the rows of the component table that are new or
    other than before."""
    shares = [(r[0], float(r[1])) for r in small_rows(targets.select("split", "share"), 1000, "targets") if r[0] is not None and r[1] and r[1] > 0]
    ids = samples.select(F.col("sample_id").cast("long").alias("item")).filter("item is not null").distinct()
    members, fresh, touched = link_components(record_links(samples), known and known[0])
    members, fresh, touched = save(members, "linked"), save(fresh, "fresh"), save(touched, "touched")
    whole = save(ids.join(members, "item", "left").select("item", F.coalesce("component", "item").alias("component")), "components")
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("records"))
    sizes = sizes.withColumn("splits", F.array().cast("array<string>"))
    held: dict = {}
    if known is not None:
        old = known[1].withColumnRenamed("component", "old").join(touched, "old").groupBy("component").agg(F.sum("records").alias("records"), F.collect_set("split").alias("splits"))
        sizes = sizes.unionByName(old).groupBy("component").agg(F.sum("records").alias("records"), F.flatten(F.collect_set("splits")).alias("splits"))
        rest = known[1].join(touched.select(F.col("old").alias("component")), "component", "left_anti")
        held = {r[0]: r[1] for r in rest.groupBy("split").agg(F.sum("records").alias("n")).collect()}  # a row for each split
    fate = F.when(F.size("splits") > 1, F.lit(QUARANTINE)).when(F.size("splits") == 1, F.col("splits")[0])
    sizes = save(sizes.select("component", "records", (fate if shares else F.coalesce(fate, F.lit(QUARANTINE))).alias("split")), "sizes")

    for r in sizes.groupBy("split").agg(F.sum("records").alias("n")).collect():
        held[r[0]] = held.get(r[0], 0) + r[1]
    total = sum(held.values())
    scale = sum(s for _, s in shares) or 1.0
    lack = {s: 0.0 for s, _ in shares}
    for s, share in shares:
        lack[s] += share / scale * total
    for s in lack:
        lack[s] -= held.get(s, 0)
    unset = sizes.filter("split is null")
    large = unset.filter(F.col("records") > max(1, total // 1000)).orderBy(F.desc("records"), "component").collect()  # fewer than 1000
    fixed = []
    for r in large:
        best = max(lack, key=lambda s: lack[s])
        lack[best] -= r.records
        fixed.append((r.component, best))
    spark = samples.sparkSession
    by_hand = F.broadcast(spark.createDataFrame(fixed, "component bigint, _split string"))
    small = unset.join(by_hand.select("component"), "component", "left_anti").select("component", "records", F.lit(0).alias("_all"))
    room = sum(max(0.0, x) for x in lack.values()) or 1.0
    left = held.get(None, 0) - sum(r.records for r in large)
    placed = prefix_sums(small, "_all", F.xxhash64(F.lit(seed), "component"), "records", max(1, left), ties=("component",))
    middle = F.col("upto") - F.col("records") / 2
    split, edge, last = None, 0.0, None
    for s in sorted(lack):
        if lack[s] > 0:
            edge += lack[s] / room * left
            split = F.when(middle <= edge, F.lit(s)) if split is None else split.when(middle <= edge, F.lit(s))
            last = s
    chosen = F.lit(last or QUARANTINE) if split is None else split.otherwise(F.lit(last))
    changed = sizes.filter("split is not null").unionByName(unset.join(by_hand, "component").select("component", "records", F.col("_split").alias("split"))).unionByName(placed.select("component", "records", chosen.alias("split")))
    changed = save(changed, "assigned")
    named = changed.select("component", "split", F.col("records").alias("_n"))
    assignment = _join_skewed(whole, named, "component", total).select(F.col("item").alias("sample_id"), "component", "split")
    return assignment, fresh, touched, changed


def assign_splits(samples: DataFrame, targets: DataFrame, known: tuple[DataFrame, DataFrame] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A split for every record, so that linked records share one and the splits have about their shares of all records.

    samples: (sample_id, source, meta, ...) of new records. targets: (split, share), scaled to sum to 1. known: the two
    tables returned for earlier records, (keys, components).

    A component that has a split keeps it. A merge of components with different splits is put into the split "quarantine",
    and stays there. New components fill the deficits: those of more than a thousandth of all records one by one, largest
    first, each to the largest deficit; the others in a random order (a hash) that prefix sums of their sizes cut at
    the remaining deficits. A record without any link is a component of its own.

    Returns (assignment, keys, components): assignment (sample_id, component, split) of the new records, keys (key,
    component), components (component, records, split). Repeated rows count once; a null sample_id takes no part.
    Without targets of positive share all new components go to quarantine.
    """
    assignment, fresh, touched, changed = _assign(samples, targets, known, seed)
    if known is None:
        return assignment, fresh, changed
    moved = touched.select(F.col("old").alias("component"), F.col("component").alias("_new"))
    keys = known[0].join(moved, "component", "left").select("key", F.coalesce("_new", "component").alias("component")).unionByName(fresh)
    components = known[1].join(moved, "component", "left_anti").select("component", "records", "split").unionByName(changed)
    return assignment, keys, components


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(filesystem(spark, f"{path}/{n}/components/_SUCCESS")[1]))


def _kept(spark: SparkSession, path: str, versions: list[int], name: str, schema: str) -> DataFrame:
    """The rows of all versions, with `version`."""
    parts = [spark.read.schema(schema).parquet(f"{path}/{v}/{name}").withColumn("version", F.lit(v)) for v in versions]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def kept_components(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(keys, components) as the finished versions under `path` leave them, None if there is none.

    A version holds what its records changed: `keys`, keys that were new; `moves`, old and new names of renamed components
    (with those renamed before to the old name); `components`, rows that were new or changed. The last version counts.
    """
    versions = _versions(spark, path)
    if not versions:
        return None
    moves = _kept(spark, path, versions, "moves", "old bigint, component bigint").groupBy("old").agg(F.max_by("component", "version").alias("_new"))
    keys = _kept(spark, path, versions, "keys", "key string, component bigint").withColumnRenamed("component", "old").join(moves, "old", "left").select("key", F.coalesce("_new", "old").alias("component"))
    rows = _kept(spark, path, versions, "components", "component bigint, records bigint, split string")
    rows = rows.groupBy("component").agg(F.max_by(F.struct("records", "split"), "version").alias("r")).join(moves.select(F.col("old").alias("component")), "component", "left_anti")
    return keys, rows.select("component", "r.records", "r.split")


def assign_kept(samples: DataFrame, targets: DataFrame, path: str, seed: int = 0) -> DataFrame:
    """assign_splits of new records on what `path`, a durable folder that no driver deletes, keeps of earlier runs: the
    assignment. What the new records change is added there as the next version; nothing that was written before is
    written again. Records of an earlier run must not come again, as they would be counted twice. One writer at a time;
    components are written last, and a version without them is not finished and is never read.
    """
    spark = samples.sparkSession
    known = kept_components(spark, path)
    assignment, fresh, touched, changed = _assign(samples, targets, known, seed)
    versions = _versions(spark, path)
    moves = touched.filter("old <> component").select("old", "component")
    if versions:
        before = _kept(spark, path, versions, "moves", "old bigint, component bigint").groupBy("old").agg(F.max_by("component", "version").alias("via"))
        moves = moves.unionByName(before.join(moves.select(F.col("old").alias("via"), "component"), "via").select("old", "component"))
    folder = f"{path}/{max([0, *versions]) + 1}"
    for name, df in (("keys", fresh), ("moves", moves), ("components", changed)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return assignment


def linked_records(samples: DataFrame) -> DataFrame:
    """(first_id, sample_id): every record that is linked to another, except the smallest of each component."""
    members = link_components(record_links(samples))[0]
    return members.filter("item <> component").select(F.col("component").alias("first_id"), F.col("item").alias("sample_id")).distinct()


def split_report(assignment: DataFrame) -> DataFrame:
    """(split, records, share)."""
    per = assignment.groupBy("split").agg(F.count(F.lit(1)).alias("records"))
    return per.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy()))
