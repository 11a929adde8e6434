"""Queries of this subpackage and the SQL that must give the same rows. Each takes a session and a folder of Parquet tables."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import filesystem, shared_folder
from . import drawing, lookalike, mixing, neighbours, overlap, packing, splits, topn

#: Placement of p2: rows of a posting list, lists that a vector belongs to and searches.
PAIR_SETTINGS = {"list_rows": 2048, "members": 3, "probes": 3, "member_ratio": 1.3, "probe_ratio": 1.3, "spread": 0.0}
SEARCH_SETTINGS = {"list_rows": 4096, "members": 4, "probes": 40, "member_ratio": 1.4, "probe_ratio": 2.0, "spread": 0.0}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _draw(spark, d):
    samples = _table(spark, d, "samples").select(F.col("sample_id").alias("item"), "source", "label")
    return drawing.draw(samples, _table(spark, d, "draw_targets"))


def p1_found(spark, d):
    """Categories for which samples has too few records."""
    return _draw(spark, d)[1].filter("gap > 0").select("draw_id", "source", "label")


def p1_report(spark, d):
    return _draw(spark, d)[1]


def p1_kept(spark, d):
    """What every draw must keep, by category: the floor where there are as many records, the aim rounded up or down, and no
    record twice."""
    sample, report = _draw(spark, d)
    once = sample.groupBy("draw_id", "source", "label").agg(F.count_distinct("item").alias("items"))
    floors = _table(spark, d, "draw_targets").select("draw_id", "source", F.col("label").cast("int").alias("label"), "min_rows")
    r = report.join(once, ["draw_id", "source", "label"], "left").join(floors, ["draw_id", "source", "label"])
    kept = (F.abs(F.col("drawn") - F.col("aim")) < 1) & (F.coalesce("items", F.lit(0)) == F.col("drawn")) & (F.col("drawn") >= F.least("min_rows", "available"))
    return r.select("draw_id", "source", "label", F.round("goal", 6).alias("goal"), "available", F.round("gap", 6).alias("gap"), kept.alias("kept"))


def p1_size(spark, d):
    """Records of every draw against its size, where the categories hold as many: off by less than one for each category."""
    report = _draw(spark, d)[1]
    size = _table(spark, d, "draw_targets").groupBy("draw_id").agg(F.max("n_rows").alias("n_rows"))
    per = report.groupBy("draw_id").agg(F.sum("drawn").alias("drawn"), F.count(F.lit(1)).alias("categories"), F.sum(F.when(F.col("goal") > 0, F.col("available")).otherwise(0)).alias("available"))
    near = F.abs(F.col("drawn") - F.least("n_rows", "available")) < F.col("categories")
    return per.join(size, "draw_id").select("draw_id", "n_rows", near.alias("met"))


def p1_sample(spark, d):
    return _draw(spark, d)[0].withColumnRenamed("item", "sample_id")


def _vectors(spark, d):
    return _table(spark, d, "feature_cache").select(F.col("vec_id").alias("item"), "feats")


def p2_found(spark, d):
    pairs = neighbours.close_pairs(_vectors(spark, d), 0.9, 10, **PAIR_SETTINGS)
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p2_neighbours(spark, d):
    """The 10 nearest of all vectors for every vector whose id is divisible by 20, with their paths."""
    near = neighbours.nearest(_vectors(spark, d), 10, asks=F.col("item") % 20 == 0, **SEARCH_SETTINGS)
    paths = _table(spark, d, "feature_cache").groupBy(F.col("vec_id").alias("b")).agg(F.min("paths").alias("path"))
    return near.join(paths, "b").select(F.col("a").alias("vec_id"), "rank", F.col("b").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "path")


def p3_found(spark, d):
    pairs = overlap.cross_split_pairs(_table(spark, d, "samples"))
    return pairs.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b")).distinct()


def p3_report(spark, d):
    return overlap.overlap_report(_table(spark, d, "samples"))


def p4_found(spark, d):
    return p4_top_errors(spark, d).select("err_id").distinct()


def p4_top_errors(spark, d):
    return topn.top_errors(_table(spark, d, "errors_top"), _table(spark, d, "conditions"), 5)


def p5_found(spark, d):
    return splits.linked_records(_table(spark, d, "samples"))


def p5_splits(spark, d):
    return splits.assign_splits(_table(spark, d, "samples"), _table(spark, d, "split_targets"))[0]


def p5_components(spark, d):
    """The component table after two batches: records loaded within a day of being added, then the others. The first batch is
    kept in a folder and the second joins it."""
    samples, targets = _table(spark, d, "samples"), _table(spark, d, "split_targets")
    first = samples.groupBy("sample_id").agg(F.min(F.coalesce(F.col("loaded_at") - F.col("added_at") <= F.expr("interval 1 day"), F.lit(False))).alias("early"))
    batches = samples.join(first, "sample_id")
    path = f"{shared_folder(spark)}/gaugeworks/components-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)  # a trial of two batches; a pipeline names a folder that stays
    splits.assign_kept(batches.filter("early"), targets, path)
    splits.assign_kept(batches.filter("not early"), targets, path)
    return splits.kept_components(spark, path)[1].select("component", "records")


def p5_kept(spark, d):
    """What the splits must keep: every record in one split, every component in one, shares within one part in a hundred or the largest component."""
    samples, targets = _table(spark, d, "samples"), _table(spark, d, "split_targets")
    got = splits.assign_splits(samples, targets)[0]
    per = got.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("items"), F.count_distinct("split").alias("splits"))
    whole = per.agg(F.sum("n").alias("records"), F.sum("items").alias("items"), F.max("splits").alias("splits"), F.max("n").alias("largest"))
    part = got.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    share = targets.select("split", (F.col("share") / F.sum("share").over(Window.partitionBy())).alias("share"))  # a row for each split
    d = share.join(part, "split", "left").crossJoin(whole)  # one row
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("records") - F.col("share")) <= F.greatest(F.lit(0.01), F.col("largest") / F.col("records"))
    return d.select("split", "records", "items", "splits", near.alias("near"))


def _packed(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.octet_length("text").alias("tokens"))
    return packing.pack(docs, _table(spark, d, "pack_specs"))


def p6_found(spark, d):
    return _packed(spark, d).filter("pieces > 1").select("spec_id", F.col("item").alias("doc_id")).distinct()


def p6_containers(spark, d):
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


def p6_report(spark, d):
    return packing.pack_report(_packed(spark, d))


def p6_kept(spark, d):
    """What the containers must keep: all tokens, every document whole that fits, no container over its capacity."""
    packed, specs = _packed(spark, d), _table(spark, d, "pack_specs").select("spec_id", "capacity")
    fill = packed.filter("container is not null").groupBy("spec_id", "container").agg(F.sum("tokens").alias("fill")).join(specs, "spec_id")
    fill = fill.groupBy("spec_id").agg(F.sum("fill").alias("tokens"), F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"), F.max("capacity").alias("capacity"))
    item = packed.groupBy("spec_id", "item").agg(F.sum("tokens").alias("t"), F.count("container").alias("parts")).join(specs, "spec_id")
    item = item.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("t") <= F.col("capacity")) & (F.col("parts") > 1)).alias("cut"))
    return fill.join(item, "spec_id").select("spec_id", "documents", "tokens", "overfull", "cut")


def _mixed(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("item"), "source", F.octet_length("text").alias("tokens"))
    return mixing.mix(docs, _table(spark, d, "mix_targets"))


def p7_found(spark, d):
    return mixing.short_sources(_mixed(spark, d)[1]).select("mix_id", "source").distinct()


def p7_choice(spark, d):
    return _mixed(spark, d)[0].withColumnRenamed("item", "doc_id")


def p7_report(spark, d):
    return _mixed(spark, d)[1]


def p7_kept(spark, d):
    """What the mixes must keep, by source: its budget but for the largest document, or all that it may give."""
    choice, report = _mixed(spark, d)
    per = choice.groupBy("mix_id", "source").agg(F.max("tokens").alias("largest"), F.max("repeats").alias("most"))
    r = report.join(per, ["mix_id", "source"], "left")
    ends = (F.abs(F.col("target_tokens") - F.col("reached_tokens")) <= F.coalesce("largest", F.lit(0))) | (F.col("reached_tokens") == F.col("max_repeats") * F.col("available_tokens")) | ((F.col("reached_tokens") == 0) & (F.col("target_tokens") < F.col("available_tokens")))
    return r.select("mix_id", "source", F.round("target_tokens", 3).alias("target_tokens"), "available_tokens", (ends & (F.coalesce("most", F.lit(0)) <= F.col("max_repeats"))).alias("kept"))


def _texts(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")


def p8_found(spark, d):
    return lookalike.look_alike_pairs(_texts(spark, d)).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p8_classes(spark, d):
    return lookalike.look_alike_classes(_texts(spark, d)).withColumnRenamed("item", "doc_id")


def p8_forms(spark, d):
    return lookalike.forms(_texts(spark, d)).withColumnRenamed("item", "doc_id")


def queries():
    named = [p1_found, p1_report, p1_kept, p1_size, p1_sample, p2_found, p2_neighbours, p3_found, p3_report, p4_found, p4_top_errors, p5_found, p5_splits, p5_components, p5_kept, p6_found, p6_containers, p6_report, p6_kept, p7_found, p7_choice, p7_report, p7_kept, p8_found, p8_classes, p8_forms]
    return {f.__name__: f for f in named}


def _plain(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def _texts_in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_P1 = f"""
with have as (
  select {_plain('source')} as source, least(label, 1) as label, count(distinct sample_id) as n
  from samples where source is not null and label is not null group by 1, 2)
select t.draw_id, t.source, t.label from draw_targets t left join have h on h.source = t.source and h.label = t.label
where greatest(t.share * t.n_rows, t.min_rows) > coalesce(h.n, 0)
"""

_STEP = r"regexp_replace({}, '(^|/)[^/]+/\.\.(/|$)', '\1')"
_PATH = r"lower(replace(url_decode(replace(trim(path), '+', '%2B')), '\', '/'))"
_PATH = rf"regexp_replace(regexp_replace(regexp_replace({_PATH}, '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/', '')"
for _ in range(3):
    _PATH = _STEP.format(_PATH)
_PATH = rf"regexp_replace({_PATH}, '\.({'|'.join(overlap.IMAGE_EXTENSIONS)})$', '')"
_P3_ROWS = f"""
with r as (
  select distinct sample_id, {_plain('split')} = 'train' as train, {_PATH} as file, lower(content_hash) as pixels,
    case when lower(phash) <> repeat('0', 32) then ('0x' || substr(phash, 1, 16))::ubigint end as hi,
    case when lower(phash) <> repeat('0', 32) then ('0x' || substr(phash, 17, 16))::ubigint end as lo
  from samples where split is not null)"""
_P3 = _P3_ROWS + f""",
pairs as (
  select t.sample_id as a, o.sample_id as b from r t join r o on t.train and not o.train and t.file = o.file
  union select t.sample_id, o.sample_id from r t join r o on t.train and not o.train and t.pixels = o.pixels
  union select t.sample_id, o.sample_id from r t join r o on t.train and not o.train and t.hi is not null and o.hi is not null
    and bit_count(xor(t.hi, o.hi)) + bit_count(xor(t.lo, o.lo)) <= {overlap.MAX_BITS})
select distinct least(a, b) as id_a, greatest(a, b) as id_b from pairs
"""

_P3_REPORT = _P3_ROWS + f""",
marks as (
  select o.sample_id, true as f, false as p, false as n from r o where not o.train and o.file in (select file from r where train)
  union all select o.sample_id, false, true, false from r o where not o.train and o.pixels in (select pixels from r where train)
  union all select o.sample_id, false, false, true from r t join r o on t.train and not o.train and t.hi is not null and o.hi is not null
    and bit_count(xor(t.hi, o.hi)) + bit_count(xor(t.lo, o.lo)) <= {overlap.MAX_BITS}),
per as (select sample_id, bool_or(f) as f, bool_or(p) as p, bool_or(n) as n from marks group by sample_id),
held as (select distinct sample_id, {_plain('split')} as split, {_plain('source')} as source from samples where split is not null and sample_id is not null)
select h.split, h.source, count(*) as records, count(per.sample_id) as overlapping, count(*) filter (f) as same_file, count(*) filter (p) as same_pixels, count(*) filter (n) as near_picture
from held h left join per using (sample_id) where h.split <> 'train' group by h.split, h.source
"""

_P4 = r"""
with c as (select distinct on (lower(transform), try_cast(level as double)) lower(transform) as t, try_cast(level as double) as l, tag from conditions),
e as (
  select distinct arm, label, path, score, err_id, lower(trim(regexp_replace(condition, '\s+', ' ', 'g'))) as spelt
  from errors_top where label is not null and score is not null and not isnan(score) and score between 0 and 1),
n as (
  select e.*, coalesce(c.tag, e.spelt) as condition from e left join c
  on regexp_extract(e.spelt, '^([^0-9@_:= -]+)', 1) = c.t
  and try_cast(regexp_extract(e.spelt, '([0-9]+\.?[0-9]*|\.[0-9]+)$', 1) as double) is not distinct from c.l),
k as (
  select *, row_number() over (partition by arm, condition, label order by case when label = 0 then -score else score end,
    path nulls first, err_id) as rank from n)
"""

_SOURCE = rf"regexp_replace({_plain('source')}, '^(({'|'.join(splits.PREFIXES)}) ?: ?)+', '')"
_P5 = f"""
with recursive keys as (
  select sample_id, 'a:' || {_plain('v')} as k from (select sample_id, unnest([{', '.join(f"meta['{a}']" for a in splits.AUTHOR_FIELDS)}]) as v from samples)
  where v is not null and {_plain('v')} not in {_texts_in(splits.NOBODY)}
  union select sample_id, 'i:' || {_plain("meta['img_id']")} || '|' || {_SOURCE} from samples where meta['img_id'] is not null and source is not null),
node as (select k, min(sample_id) as n from keys group by k),
own as (select distinct sample_id, n from keys join node using (k)),
edge as (select distinct x.n as u, y.n as v from own x join own y on x.sample_id = y.sample_id and x.n <> y.n),
reach(n, r) as (select n, n from node union select e.v, reach.r from reach join edge e on e.u = reach.n where reach.r < e.v),
root as (select n, min(r) as r from reach group by n)
select distinct root.r as first_id, own.sample_id from own join root using (n) where own.sample_id <> root.r
"""

_P6 = "select s.spec_id, d.doc_id from documents d, pack_specs s where strlen(d.text) > s.capacity"

_P7 = f"""
with have as (select {_plain('source')} as source, sum(strlen(text)) as tokens from documents where source is not null and text is not null group by 1),
goal as (select mix_id, source, max_repeats, weight / sum(weight) over (partition by mix_id) * budget_tokens as goal from mix_targets)
select g.mix_id, g.source from goal g left join have h using (source) where g.goal > g.max_repeats * coalesce(h.tokens, 0)
"""


# By brute force. On the small tables, where one posting list holds all vectors, the search is exhaustive too.
_P2 = """
with v as (
  select distinct on (vec_id) vec_id, feats::double[] as f from feature_cache
  where len(feats) = 64 and len(list_filter(feats, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64 and len(list_filter(feats, lambda x: x <> 0)) > 0),
near as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.f, b.f) as c from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.f, b.f) >= 0.9),
best as (select *, row_number() over (partition by a order by c desc, b) as n from near)
select distinct least(a, b) as vec_a, greatest(a, b) as vec_b from best where n <= 10
"""


_P1_KEPT = f"""
with have as (
  select {_plain('source')} as source, least(label, 1) as label, count(distinct sample_id) as n from samples where source is not null and label is not null group by 1, 2)
select t.draw_id, t.source, t.label::int as label, round(greatest(t.share * t.n_rows, t.min_rows), 6) as goal, coalesce(h.n, 0) as available,
  round(greatest(greatest(t.share * t.n_rows, t.min_rows) - coalesce(h.n, 0), 0), 6) as gap, true as kept
from draw_targets t left join have h on h.source = t.source and h.label = t.label
"""
_P1_SIZE = "select draw_id, max(n_rows) as n_rows, true as met from draw_targets group by draw_id"
_P5_COMPONENTS = _P5.rsplit("select distinct root.r", 1)[0] + """select coalesce(c.r, s.sample_id) as component, count(*) as records
from (select distinct sample_id from samples where sample_id is not null) s left join (select distinct own.sample_id, root.r from own join root using (n)) c using (sample_id) group by 1
"""
_P5_KEPT = "select split, (select count(distinct sample_id) from samples)::bigint as records, (select count(distinct sample_id) from samples)::bigint as items, 1::bigint as splits, true as near from split_targets"
_P6_KEPT = "select s.spec_id, count(*) as documents, coalesce(sum(strlen(d.text)), 0)::bigint as tokens, 0::bigint as overfull, 0::bigint as cut from documents d, pack_specs s group by s.spec_id"
_P7_KEPT = f"""
with have as (select {_plain('source')} as source, sum(strlen(text))::bigint as tokens from documents where source is not null and text is not null group by 1)
select mix_id, source, round(weight / sum(weight) over (partition by mix_id) * budget_tokens, 3) as target_tokens, coalesce(h.tokens, 0)::bigint as available_tokens, true as kept from mix_targets left join have h using (source)
"""
_P2_NEAR = """
with v as (
  select distinct on (vec_id) vec_id, feats::double[] as f from feature_cache
  where len(feats) = 64 and len(list_filter(feats, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64 and len(list_filter(feats, lambda x: x <> 0)) > 0),
p as (select vec_id, min(paths) as path from feature_cache group by vec_id),
near as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.f, b.f) as c from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
best as (select *, row_number() over (partition by a order by c desc, b) as n from near)
select a as vec_id, n::int as rank, b as neighbour_id, round(c, 6) as cosine, path from best join p on p.vec_id = b where n <= 10
"""

_PAIRS = [pair for pairs in lookalike.LOOKALIKES.values() for pair in pairs.split()]
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NFC = lambda x: unicodedata.normalize("NFC", x)
_PAIRS += [a + b for p in _PAIRS for m in map(chr, range(0x300, 0x330)) if len(a := _NFC(p[0] + m)) == 1 == len(b := _NFC(p[1] + m))]  # those with a mark
_FROM, _TO = _WIDE + "".join(p[0] for p in _PAIRS), "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + "".join(p[1] for p in _PAIRS)
_IGNORED = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in lookalike.IGNORABLE)
_LOOK = f"regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[{_IGNORED}]', '', 'g')"
_LOOK = f"regexp_replace({_LOOK}, '[\\t\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
_LOOK = f"translate({_LOOK}, '{_FROM.replace(chr(39), chr(39) * 2)}', '{_TO.replace(chr(39), chr(39) * 2)}')"
for _old, _new in (("\u00b5", "\u03bc"), ("\u2010", "-"), ("\u2011", "-"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\u2026", "...")):
    _LOOK = f"replace({_LOOK}, '{_old}', '{_new}')"
#: The differences that the documents hold, undone one by one; by far not all that the operator knows.
_P8 = f"""
with f as (select distinct doc_id, text, nfc_normalize({_LOOK}) as form from documents where text is not null)
select distinct least(a.doc_id, b.doc_id) as doc_a, greatest(a.doc_id, b.doc_id) as doc_b from f a join f b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id
"""
_P8_CLASSES = f"""
with f as (select distinct doc_id, text, nfc_normalize({_LOOK}) as form from documents where text is not null),
c as (select form, min(doc_id) as class_id, count(*) as items, count(distinct text) as spellings from f group by form)
select doc_id, class_id, items, spellings from f join c using (form)
"""


def oracle_sql():
    return {
        "p1_kept": _P1_KEPT, "p1_size": _P1_SIZE, "p2_neighbours": _P2_NEAR, "p5_components": _P5_COMPONENTS, "p5_kept": _P5_KEPT, "p6_kept": _P6_KEPT, "p7_kept": _P7_KEPT,
        "p8_found": _P8,
        "p8_classes": _P8_CLASSES,
        "p8_forms": f"select doc_id, form, form <> text as changed from (select doc_id, text, nfc_normalize({_LOOK}) as form from documents)",
        "p2_found": _P2,
        "p1_found": _P1, "p3_found": _P3, "p4_found": _P4 + "select distinct err_id from k where rank <= 5",
        "p4_top_errors": _P4 + "select arm, condition, label, err_id, path, score, rank::int as rank from k where rank <= 5",
        "p3_report": _P3_REPORT, "p5_found": _P5, "p6_found": _P6, "p7_found": _P7,
    }
