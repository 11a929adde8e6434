"""The named queries over the workload's operators, each with SQL that must give the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import strings as S
from ..functions import vectors as V
from ..operators import grids, leakage, models, roc, sampling, traces, windows
from ..storage import filesystem, save, shared_folder
from . import tables as T
from .tables import FRAMES, PICTURES, SAMPLES, SCORED, VECTORS, plain_sql, with_

#: Fixed weights of two linear heads on 64 numbers, made by rule.
HEADS = {"ship": ([[0.0] * 64, [((i * 37) % 19 - 9) / 40 for i in range(64)]], [0.0, 0.1]), "gan": ([[0.01] * 64, [((i * 53) % 23 - 11) / 50 for i in range(64)]], [0.05, 0.0])}
# Thresholds of the table.
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _sql_metrics(source: str, group: list[str], score: str = "score", label: str = "label") -> str:
    """SQL of roc.metrics over a relation."""
    g = "".join(f"{x}, " for x in group)
    by = f"partition by {', '.join(group)} " if group else ""
    tail = f" group by {', '.join(group)}" if group else ""
    return f"""(select {g}n_fake + n_real as n, n_fake, n_real,
      case when n_fake > 0 and n_real > 0 then u / (n_fake * n_real) end as auc, case when n_fake > 0 and n_real > 0 then 1 - u / (n_fake * n_real) end as err,
      case when n_fake > 0 and n_real > 0 then (tp + tn) / (n_fake + n_real) end as acc, case when n_fake > 0 and n_real > 0 then (tp / n_fake + tn / n_real) / 2 end as bal_acc,
      case when n_fake > 0 and n_real > 0 then greatest(n_fake, n_real) / (n_fake + n_real) end as majority_baseline
    from (select {g}sum(pos)::bigint as n_fake, sum(neg)::bigint as n_real, sum(pos * (below + 0.5::double * neg)) as u,
        sum(case when {score} >= 0.5 then pos else 0 end)::double as tp, sum(case when {score} < 0.5 then neg else 0 end)::double as tn
      from (select *, coalesce(sum(neg) over ({by}order by {score} rows between unbounded preceding and 1 preceding), 0) as below
        from (select {g}{score}, count(*) filter ({label} >= 1) as pos, count(*) filter ({label} = 0) as neg from {source} where {label} is not null and {score} is not null group by {g}{score})){tail}))"""


_CURVE = """counts as (select score, count(*) filter (label >= 1) as pos, count(*) filter (label = 0) as neg from scored group by score),
curve as (select score as threshold, (sum(pos) over (order by score desc))::bigint as tp, (sum(neg) over (order by score desc))::bigint as fp,
  sum(pos) over () as pn, sum(neg) over () as nn from counts),
vertices as (select * from (select *, (lead(tp) over w - tp) - (tp - lag(tp) over w) as dt, (lead(fp) over w - fp) - (fp - lag(fp) over w) as df from curve window w as (order by threshold desc)) where dt is null or dt <> 0 or df <> 0)"""


#: The same for every arm, over all scores.
_CURVES = """counts as (select arm, score, count(*) filter (label >= 1) as pos, count(*) filter (label = 0) as neg from scored group by arm, score),
curve as (select arm, score as threshold, (sum(pos) over (partition by arm order by score desc))::bigint as tp, (sum(neg) over (partition by arm order by score desc))::bigint as fp,
  nullif(sum(pos) over (partition by arm), 0) as pn, nullif(sum(neg) over (partition by arm), 0) as nn from counts),
vertices as (select * from (select *, (lead(tp) over w - tp) - (tp - lag(tp) over w) as dt, (lead(fp) over w - fp) - (fp - lag(fp) over w) as df from curve window w as (partition by arm order by threshold desc)) where dt is null or dt <> 0 or df <> 0)"""


# ---- ROC and metrics ------------------------------------------------------------------------------------------------

@query(with_(SCORED) + f"select n_fake as n_pos, n_real as n_neg, round(auc, 6) as auc from {_sql_metrics('scored', [])}")
def auc_overall(spark, d):
    return _round(roc.auc(T.scored(spark, d), []), "auc")


@query(with_(SCORED, PICTURES) + f"select source, n_fake as n_pos, n_real as n_neg, round(auc, 6) as auc from {_sql_metrics('scored_pictures', ['source'])}")
def auc_by_source(spark, d):
    return _round(roc.auc(T.scored_pictures(spark, d), ["source"]), "auc")


@query(with_(SCORED) + f"select arm, n, n_fake, n_real, round(auc, 6) as auc, round(err, 6) as err, round(acc, 6) as acc, round(bal_acc, 6) as bal_acc, round(majority_baseline, 6) as majority_baseline from {_sql_metrics('scored', ['arm'])}")
def binary_metrics(spark, d):
    return _round(roc.metrics(T.scored(spark, d), ["arm"]), "auc", "err", "acc", "bal_acc", "majority_baseline")


@query(with_(SCORED, _CURVE) + "select threshold, tp, fp, round(tp / pn, 6) as tpr, round(fp / nn, 6) as fpr from curve")
def roc_curve(spark, d):
    return _round(roc.roc_curve(T.scored(spark, d), []), "tpr", "fpr")


@query(with_(SCORED, _CURVE) + "select threshold, tp, fp from vertices")
def roc_vertices(spark, d):
    return roc.roc_vertices(roc.roc_curve(T.scored(spark, d), []), []).select("threshold", "tp", "fp")


@query(with_(SCORED, _CURVE) + """select r as max_fpr, arg_min(threshold, threshold) filter (fp / nn <= r) as threshold, coalesce(round(max(fp / nn) filter (fp / nn <= r), 6), 0) as fpr, coalesce(round(max(tp / pn) filter (fp / nn <= r), 6), 0) as tpr
from vertices, (select unnest([0.001::double, 0.01, 0.05]) as r) group by r""")
def operating_points(spark, d):
    return _round(roc.operating_points(roc.roc_curve(T.scored(spark, d), []), []), "fpr", "tpr")


@query(with_(SCORED, _CURVES) + "select arm, threshold, tp, fp, round(tp / pn, 6) as tpr, round(fp / nn, 6) as fpr from curve")
def roc_curve_by_arm(spark, d):
    return _round(roc.roc_curve(T.scored(spark, d), ["arm"]), "tpr", "fpr")


@query(with_(SCORED, _CURVES) + "select arm, threshold, tp, fp from vertices")
def roc_vertices_by_arm(spark, d):
    return roc.roc_vertices(roc.roc_curve(T.scored(spark, d), ["arm"]), ["arm"]).select("arm", "threshold", "tp", "fp")


@query(with_(SCORED, _CURVES) + """select arm, r as max_fpr, min(threshold) filter (fp / nn <= r) as threshold, case when max(nn) > 0 then coalesce(round(max(fp / nn) filter (fp / nn <= r), 6), 0) end as fpr,
  case when max(pn) > 0 then coalesce(round(max(tp / pn) filter (fp / nn <= r), 6), 0) end as tpr
from vertices, (select unnest([0.001::double, 0.01, 0.05]) as r) group by arm, r""")
def operating_points_by_arm(spark, d):
    return _round(roc.operating_points(roc.roc_curve(T.scored(spark, d), ["arm"]), ["arm"]), "fpr", "tpr")


@query(with_(SCORED) + f"select tag, t as threshold, round(avg(case when label = 0 then (score >= t)::int end), 6) as fpr, round(avg(case when label >= 1 then (score >= t)::int end), 6) as tpr from scored, (select unnest({THRESHOLDS}::double[]) as t) group by tag, t")
def threshold_table(spark, d):
    return _round(roc.threshold_table(T.scored(spark, d), ["tag"], THRESHOLDS), "fpr", "tpr")


@query(with_(SCORED) + "select i / 200.0::double as threshold, round(avg((score >= i / 200.0::double)::int), 6) as fpr from scored, range(201) r(i) where label = 0 group by i")
def fpr_curve(spark, d):
    return _round(roc.fpr_curve(T.scored(spark, d)), "fpr")


@query(with_(SCORED, PICTURES, """neg as (select score, count(*) as n from scored where label = 0 group by score),
cum as (select score, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as below, n, sum(n) over () as nn from neg),
p as (select source, score, count(*) as k from scored_pictures where label >= 1 and source is not null group by 1, 2)""") +
"""select source, sum(k)::bigint as n_fake, round(sum(k * beats) / sum(k), 6) as auc, round(sum(k * score) / sum(k), 6) as mean_score from (
  select p.*, (select (coalesce(sum(case when neg.score < p.score then neg.n end), 0) + 0.5::double * coalesce(sum(case when neg.score = p.score then neg.n end), 0)) / sum(neg.n) from neg) as beats from p)
group by source having sum(k) >= 20""")
def auc_per_group_vs_all_negatives(spark, d):
    both = T.scored(spark, d).join(T.pictures(spark, d).select("path", "source"), "path", "left").filter("source is not null or label = 0")
    grouped = both.withColumn("source", F.when(F.col("label") >= 1, F.col("source")))  # reals belong to no group
    return _round(roc.auc_vs_all_negatives(grouped, "source"), "auc", "mean_score")


@query(with_(SCORED) + f"select round(auc, 6) as overall, round(auc, 6) as weighted from {_sql_metrics('scored', [])}")
def weighted_auc_identity(spark, d):
    """The weighted mean of the groups' AUC against all negatives is the overall AUC."""
    s = save(T.scored(spark, d).select("arm", "score", "label"), "scored")
    per = roc.auc_vs_all_negatives(s, "arm", least=1)
    return roc.auc(s, []).crossJoin(per.agg((F.sum(F.col("n_fake") * F.col("auc")) / F.sum("n_fake")).alias("weighted"))).select(F.round("auc", 6).alias("overall"), F.round("weighted", 6).alias("weighted"))  # one row each


_GRID = f"""grid as (
  select k.tag, k.ord, a.auc as auc_primary, b.auc as auc_alt, a.err as err_primary, b.err as err_alt, a.bal_acc, a.acc, a.majority_baseline, coalesce(a.n_fake, b.n_fake) as n_fake, coalesce(a.n_real, 0) as n_real_primary, coalesce(b.n_real, 0) as n_real_alt
  from (select distinct tag, ord from scored_pictures) k
  left join {_sql_metrics("(select * from scored_pictures where label >= 1 or real_set <> 'alt')", ['tag'])} a using (tag)
  left join {_sql_metrics("(select * from scored_pictures where label >= 1 or real_set = 'alt')", ['tag'])} b using (tag)),
full_grid as (select *, max(case when tag = 'clean' then auc_primary end) over () - auc_primary as delta_primary, max(case when tag = 'clean' then auc_alt end) over () - auc_alt as delta_alt, auc_primary - auc_alt as shortcut_gap from grid)"""
_GRID_FLOATS = ["auc_primary", "auc_alt", "err_primary", "err_alt", "bal_acc", "acc", "majority_baseline", "delta_primary", "delta_alt", "shortcut_gap"]


@query(with_(SCORED, PICTURES, _GRID) + "select tag, ord, n_fake, n_real_primary, n_real_alt, " + ", ".join(f"round({c}, 6) as {c}" for c in _GRID_FLOATS) + " from full_grid")
def auc_grid(spark, d):
    return _round(grids.auc_grid(T.scored_pictures(spark, d)), *_GRID_FLOATS)


@query(with_(SCORED, PICTURES, _GRID) + """select round(max(case when tag = 'clean' then auc_primary end), 6) as clean_auc, arg_min(tag, (auc_primary, ord)) filter (tag <> 'clean') as worst_condition, round(min(auc_primary) filter (tag <> 'clean'), 6) as worst_auc,
  round(max(delta_primary) filter (tag <> 'clean'), 6) as max_delta, round(avg(auc_primary) filter (tag <> 'clean'), 6) as mean_degraded_auc, round(avg(auc_primary) filter (tag <> 'clean'), 6) as robust_auc from full_grid""")
def worst_condition(spark, d):
    return _round(grids.grid_summary(grids.auc_grid(T.scored_pictures(spark, d))), "clean_auc", "worst_auc", "max_delta", "mean_degraded_auc", "robust_auc")


_TOP = "err_id, path, score, label, tag from scored where label"


@query(with_(SCORED) + f"(select {_TOP} = 0 order by score desc, ord, path, err_id limit 20) union all (select {_TOP} >= 1 order by score, ord, path, err_id limit 20)")
def topk_errors(spark, d):
    return grids.top_errors(T.scored(spark, d)).select("err_id", "path", "score", "label", "tag")


@query(with_(SCORED, f"top as ((select {_TOP} = 0 order by score desc, ord, path, err_id limit 20) union all (select {_TOP} >= 1 order by score, ord, path, err_id limit 20))") + "select tag, err_id, round(abs(score - label) + 1e-11::double, 6) as miss, row_number() over (order by tag, abs(score - label) desc, err_id)::int as place from top")
def contact_sheet_order(spark, d):
    """The most confident errors in the order of their contact sheet: by condition, the furthest from their label first."""
    miss = F.abs(F.col("score") - F.col("label"))
    w = Window.orderBy("tag", F.desc(miss), "err_id")  # 40 rows
    return grids.top_errors(T.scored(spark, d)).select("tag", "err_id", F.round(miss + F.lit(1e-11), 6).alias("miss"), F.row_number().over(w).alias("place"))


@query(with_(SCORED) + "select arm, tag, err_id, round(abs(score - label) + 1e-11::double, 6) as miss, row_number() over (partition by arm, tag order by abs(score - label) desc, err_id)::int as place from scored")
def contact_sheet_order_by_arm(spark, d):
    miss = F.abs(F.col("score") - F.col("label"))
    w = Window.partitionBy("arm", "tag").orderBy(F.desc(miss), "err_id")
    return T.scored(spark, d).select("arm", "tag", "err_id", F.round(miss + F.lit(1e-11), 6).alias("miss"), F.row_number().over(w).alias("place"))


_PAIRS = """views as (
  select path, max(label) as label, avg(case when tag = 'clean' then score end) as clean, avg(case when tag = 'resize_0.5' then score end) as degraded from scored group by path
  having count(*) filter (tag = 'clean') > 0 and count(*) filter (tag = 'resize_0.5') > 0),
rows_ as (
  select 'clean' as view, label, clean as score from views union all select 'both', label, degraded from views
  union all select 'fakes_only', label, case when label >= 1 then degraded else clean end from views union all select 'reals_only', label, case when label >= 1 then clean else degraded end from views),
rounded as (select view, label, round(score, 9) as score from rows_)"""


def _views(spark, d):
    """Mean clean and degraded score of each picture that has both."""
    of = lambda t: F.avg(F.when(F.col("tag") == t, F.col("score")))
    v = T.scored(spark, d).groupBy("path").agg(F.max("label").alias("label"), of("clean").alias("clean"), of("resize_0.5").alias("degraded"))
    return v.filter("clean is not null and degraded is not null").withColumns({c: F.round(c, 9) for c in ("clean", "degraded")})


@query(with_(SCORED, _PAIRS) + f"select m.view, n_fake, n_real, round(auc, 6) as auc, round(flagged, 6) as reals_flagged from {_sql_metrics('rounded', ['view'])} m left join (select view, avg((score > 0.5)::int) as flagged from rounded where label = 0 group by view) using (view)")
def one_class_counterfactual(spark, d):
    return _round(grids.counterfactual(_views(spark, d)), "auc", "reals_flagged")


@query(with_(SCORED, _PAIRS, "avgd as (select label, round((clean + degraded) / 2, 9) as score from views), first as (select label, round(clean, 9) as score from views)") + f"select round(a.auc, 6) as single_view, round(b.auc, 6) as two_views, round(b.auc - a.auc, 6) as gain from {_sql_metrics('first', [])} a, {_sql_metrics('avgd', [])} b")
def view_average_pivot(spark, d):
    v = _views(spark, d)
    both = models.two_views(v.select("path", "label", F.col("clean").alias("p")), v.select("path", F.col("degraded").alias("p")), ["path"])
    long = v.select("label", F.col("clean").alias("score"), F.lit("single_view").alias("scoring")).unionByName(both.select("label", F.round("p", 9).alias("score"), F.lit("two_views").alias("scoring")))
    wide = roc.auc(long, ["scoring"]).groupBy().pivot("scoring", ["single_view", "two_views"]).agg(F.first("auc"))
    return _round(wide.withColumn("gain", F.col("two_views") - F.col("single_view")), "single_view", "two_views", "gain")


@query(with_(SCORED) + """select arm, round(auc, 3) as clean_auc, n_fake, n_real, case when n_real > 0 then '1:' || format('{:.2f}', n_fake::double / n_real) end as class_ratio from """ + _sql_metrics("(select * from scored where tag = 'clean')", ["arm"]))
def arm_leaderboard(spark, d):
    m = roc.metrics(T.scored(spark, d).filter("tag = 'clean'"), ["arm"])
    return m.select("arm", F.round("auc", 3).alias("clean_auc"), "n_fake", "n_real", S.class_ratio(F.col("n_real"), F.col("n_fake")).alias("class_ratio"))


@query(with_(SCORED) + "select tag, round(avg(0.5 * pow(1 - pt, 2) * -ln(pt)), 6) as loss from (select *, greatest(case when label >= 1 then score else 1 - score end, 1e-12) as pt from scored) group by tag")
def focal_loss(spark, d):
    s = T.scored(spark, d)
    return s.groupBy("tag").agg(F.round(F.avg(V.focal_loss(F.col("score"), F.col("label"))), 6).alias("loss"))


@query("select distinct err_id, least(greatest(score, 0), 1) as pred from errors_top where score is not null and not isnan(score)")
def clamped_predictions(spark, d):
    e = T.table(spark, d, "errors_top").filter(F.col("score").isNotNull() & ~F.isnan("score")).dropDuplicates(["err_id"])
    return e.select("err_id", V.clamp(F.col("score")).alias("pred"))


# ---- manifests ------------------------------------------------------------------------------------------------------

@query(with_(SAMPLES) + "select source, label, count(*) as n, (sum(count(*)) over ())::bigint as total, round((sum(case when label >= 1 then count(*) else 0 end) over ()) / greatest(sum(count(*)) over (), 1), 6) as fake_fraction from s group by source, label")
def source_summary(spark, d):
    per = T.samples(spark, d).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # a row for each source and label
    fakes = F.sum(F.when(F.col("label") >= 1, F.col("n")).otherwise(0)).over(whole)
    return per.withColumn("total", F.sum("n").over(whole)).withColumn("fake_fraction", F.round(fakes / F.greatest(F.col("total"), F.lit(1)), 6))


_LEADING = "regexp_replace(path, '^[./]+', '')"


@query(with_(SAMPLES) + f"select {_LEADING} as path, label, source, map_extract_value(meta, 'advanced') as advanced from s where contains(path, '/images/') and source like 'wildfake:%'")
def wildfake_manifest(spark, d):
    s = T.samples(spark, d).filter(F.col("path").contains("/images/") & F.col("source").startswith("wildfake:"))
    return s.select(S.strip_leading(F.col("path")).alias("path"), "label", "source", F.col("meta")["advanced"].alias("advanced"))


@query(with_(SAMPLES) + "select 0 as part, path, label, 'val:' || source as source from s where source = 'wildfake:real_harbor' and contains(path, '/harbor19/') union all select 1, path, label, 'val:' || source from s where source = 'wildfake:diff_aurora' and contains(path, '/Advanced/')")
def validation_manifest(spark, d):
    s = T.samples(spark, d)
    part = lambda i, src, piece: s.filter((F.col("source") == src) & F.col("path").contains(piece)).select(F.lit(i).alias("part"), "path", "label", F.concat(F.lit("val:"), "source").alias("source"))
    return part(0, "wildfake:real_harbor", "/harbor19/").unionByName(part(1, "wildfake:diff_aurora", "/Advanced/"))


@query(with_(SAMPLES) + "select sample_id, regexp_extract(path, '^(.*)#[^#]*$', 1) as shard, try_cast(regexp_extract(path, '#([0-9]+)$', 1) as bigint) as row_index, case when raw_label >= 1 then 1 when raw_label = 0 then 0 end as label from s where contains(path, '#')")
def shard_rows(spark, d):
    s = T.samples(spark, d).filter(F.col("path").contains("#"))
    return s.select("sample_id", S.shard_of(F.col("path")).alias("shard"), S.row_of(F.col("path")).alias("row_index"), F.when(F.col("raw_label") >= 1, 1).when(F.col("raw_label") == 0, 0).alias("label"))


_NAMES = "[" + ", ".join(f"'{x}'" for x in [*S.FAKE_DIRECTORIES, *S.REAL_DIRECTORIES]) + "]"
_FAKES = "[" + ", ".join(f"'{x}'" for x in S.FAKE_DIRECTORIES) + "]"


@query(with_(SAMPLES) + f"""select sample_id, case when told is not null then list_contains({_FAKES}, told)::int end as label, list_filter(string_split(lower(path), '/'), lambda x: x in ('train', 'val', 'test'))[1] as split,
  regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '_\\d+$', '') as category, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]+)$', 1)) in ('jpg', 'jpeg', 'png', 'webp', 'bmp') as picture
from (select *, list_filter(list_reverse(string_split(lower(path), '/')[:-2]), lambda x: list_contains({_NAMES}, x))[1] as told from s)""")
def path_labels(spark, d):
    p = F.col("path")
    return T.samples(spark, d).select("sample_id", S.directory_label(p).alias("label"), S.directory_split(p).alias("split"), S.category(p).alias("category"), S.is_picture(p).alias("picture"))


@query(with_(SAMPLES) + "select sample_id, regexp_extract(source, '^(" + "|".join(S.SOURCE_PREFIXES) + "):', 1) as prefix, regexp_replace(source, '^((" + "|".join(S.SOURCE_PREFIXES) + "):)+', '') as base from s")
def source_prefixes(spark, d):
    return T.samples(spark, d).select("sample_id", S.source_prefix(F.col("source")).alias("prefix"), S.base_source(F.col("source")).alias("base"))


# ---- sampling and splits --------------------------------------------------------------------------------------------

def _md5(seed: int, key: str) -> str:
    return f"md5('{seed}' || {key})"


@query(with_(SAMPLES) + f"select sample_id, path from (select sample_id, path, row_number() over (order by {_md5(7, 'sample_id::varchar')}, sample_id) as n from s) where n <= 500")
def seeded_sample(spark, d):
    s = T.samples(spark, d).select("path", F.col("sample_id"), F.col("sample_id").cast("string").alias("key"))
    return sampling.seeded_sample(s, 500, 7, "key").select("sample_id", "path")


@query(with_(SAMPLES, "c as (select label, count(*) as c from s where label is not null group by label)", "q as (select label, round_even(800 * c / sum(c) over (), 0)::bigint as k from c)",
    "q2 as (select label, case when label = max(label) over () then 800 - (sum(k) over () - k) else k end as k from q)") +
    f"select sample_id, label from (select sample_id, label, row_number() over (partition by label order by {_md5(3, 'sample_id::varchar')}, sample_id) as n from s) join q2 using (label) where n <= k")
def stratified_sample(spark, d):
    s = T.samples(spark, d).filter("label is not null").select("label", "sample_id", F.col("sample_id").cast("string").alias("key"))
    return sampling.stratified_sample(s, 800, 3, "key").select("sample_id", "label")


@query(with_(SAMPLES, "c as (select split, label, count(*) as c from s where label is not null and split is not null group by 1, 2)", "q as (select split, label, least(c, round_even(100 * c / sum(c) over (partition by split), 0)::bigint) as k from c)") +
    f"select sample_id, split, label from (select *, row_number() over (partition by split, label order by {_md5(5, 'sample_id::varchar')}, sample_id) as n from s) join q using (split, label) where n <= k")
def stratified_draws(spark, d):
    s = T.samples(spark, d).filter("label is not null and split is not null").select("split", "label", "sample_id", F.col("sample_id").cast("string").alias("key"))
    return sampling.stratified_draws(s, 100, 5, "split", "key").select("sample_id", "split", "label")


@query(with_(SAMPLES, f"g as (select source, row_number() over (order by {_md5(11, 'source')}, source) as n, count(*) over () as c from (select distinct source from s where source is not null))") + "select sample_id, case when g.n <= floor(g.c / 3) then 'test' else 'train' end as part from s join g using (source)")
def grouped_split(spark, d):
    return sampling.grouped_split(T.samples(spark, d).filter("source is not null"), "source", 11).select("sample_id", "part")


@query(with_(SAMPLES) + "select label, count(*) as n, 1.0::double / count(*) as weight from s where label is not null group by label")
def class_weights(spark, d):
    return sampling.class_weights(T.samples(spark, d))


# ---- leakage --------------------------------------------------------------------------------------------------------

_HELD = "held as (select distinct content_hash from s where split <> 'train' and content_hash is not null)"


@query(with_(SAMPLES, _HELD) + "select content_hash from held")
def exclusion_list(spark, d):
    return leakage.exclusion_list(T.samples(spark, d).filter("split <> 'train'"))


@query(with_(SAMPLES, _HELD) + "select sample_id, path, content_hash from s where split = 'train' and content_hash in (select content_hash from held)")
def leak_check_exact(spark, d):
    s = T.samples(spark, d)
    return leakage.leaked(s.filter("split = 'train'"), leakage.exclusion_list(s.filter("split <> 'train'"))).select("sample_id", "path", "content_hash")


@query(with_(SAMPLES, _HELD) + "select sample_id from s where split = 'train' and (content_hash is null or content_hash not in (select content_hash from held))")
def clean_anti(spark, d):
    s = T.samples(spark, d)
    return leakage.without_leaks(s.filter("split = 'train'"), leakage.exclusion_list(s.filter("split <> 'train'"))).select("sample_id")


@query(with_(SAMPLES) + "select sample_id, content_hash from (select *, row_number() over (partition by content_hash order by sample_id) as n from s) where n = 1")
def dedup_keep_first(spark, d):
    return leakage.keep_first(T.samples(spark, d), "content_hash", ["sample_id"]).select("sample_id", "content_hash")


@query(with_(SCORED, SAMPLES, "kept as (select path from (select path, row_number() over (partition by content_hash order by sample_id) as n from s) where n = 1)") + f"select n, n_fake, n_real, round(auc, 6) as auc, round(acc, 6) as acc from {_sql_metrics('(select * from scored where path in (select path from kept))', [])}")
def metrics_dedup(spark, d):
    kept = leakage.keep_first(T.samples(spark, d), "content_hash", ["sample_id"]).select("path")
    m = roc.metrics(T.scored(spark, d).join(kept, "path", "left_semi"), [])
    return m.select("n", "n_fake", "n_real", F.round("auc", 6).alias("auc"), F.round("acc", 6).alias("acc"))


@query(with_(SAMPLES) + "select source, count(*) as n_rows, count(distinct content_hash) as distinct_hashes from s group by source")
def source_overlap(spark, d):
    return leakage.overlap_counts(T.samples(spark, d), "source", "content_hash")


@query(with_(SAMPLES) + "select content_hash from s where split = 'train' and content_hash is not null intersect select content_hash from s where split = 'test'")
def split_intersection(spark, d):
    s = T.samples(spark, d).filter("content_hash is not null")
    return s.filter("split = 'train'").select("content_hash").intersect(s.filter("split = 'test'").select("content_hash"))


# ---- conditions, plans, vectors -------------------------------------------------------------------------------------

@query(with_(SAMPLES) + "select sample_id, s.split, c.ord, c.tag, c.transform, c.level, case when c.level is null then c.transform else c.transform || '_' || c.level end as name from s, conditions c where s.split in ('val', 'alt_real', 'test')")
def condition_expansion(spark, d):
    e = grids.expand_conditions(T.samples(spark, d).filter(F.col("split").isin("val", "alt_real", "test")).select("sample_id", "split"), T.table(spark, d, "conditions"))
    return e.select("sample_id", "split", "ord", "tag", "transform", "level", S.condition_tag(F.col("transform"), F.col("level")).alias("name"))


@query(with_(VECTORS) + """select vec_id, x.step as step, string_split(x.item, ':')[1] as family, try_cast(string_split(x.item, ':')[2] as double) as level
from (select vec_id, unnest(list_transform(range(1, len(items) + 1), lambda i: {'step': i, 'item': items[i]})) as x from (select vec_id, list_filter(string_split(plans, '|'), lambda x: x <> '') as items from v))""")
def plan_strings(spark, d):
    return T.vectors(spark, d).select("vec_id", F.posexplode(S.plan_steps(F.col("plans"))).alias("step", "s")).select("vec_id", (F.col("step") + 1).cast("bigint").alias("step"), "s.family", "s.level")


def _dot_sql(w: list[float]) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: feats[i]::double * ({w}::double[])[i]))"


@query(with_(VECTORS) + f"select vec_id, round({_dot_sql(HEADS['ship'][0][1])}, 5) as logit from v")
def dot_scores(spark, d):
    return T.vectors(spark, d).select("vec_id", F.round(V.dot(F.col("feats"), V.constant(HEADS["ship"][0][1])), 5).alias("logit"))


def _head_sql(name: str) -> str:
    (a, b), (c0, c1) = HEADS[name]
    return f"round(1 / (1 + exp(-({_dot_sql([y - x for x, y in zip(a, b)])} + {c1 - c0}::double))), 6)"


@query(with_(VECTORS) + "select vec_id, " + ", ".join(f"{_head_sql(h)} as p_{h}" for h in HEADS) + " from v")
def multi_head_scores(spark, d):
    return _round(V.scores(T.vectors(spark, d), "feats", HEADS).select("vec_id", *[f"p_{h}" for h in HEADS]), *[f"p_{h}" for h in HEADS])


@query(with_(VECTORS) + "select vec_id, round(n, 5) as norm, round(feats[1] / greatest(n, 1e-8), 6) as first, round(feats[64] / greatest(n, 1e-8), 6) as last from (select *, sqrt(list_sum(list_transform(feats, lambda x: x::double * x::double))) as n from v)")
def l2_normalize(spark, d):
    v = T.vectors(spark, d).select("vec_id", V.norm(F.col("feats")).alias("norm"), V.l2_normalize(F.col("feats")).alias("u"))
    return v.select("vec_id", F.round("norm", 5).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query(with_(VECTORS) + "select (i - 1)::int as pos, round(avg(feats[i]::double), 6) as mean, round(stddev_pop(feats[i]::double), 6) as std from v, range(1, 65) r(i) where tag = 'clean' group by i")
def standardize_stats(spark, d):
    return _round(V.column_stats(T.vectors(spark, d).filter("tag = 'clean'"), "feats"), "mean", "std")


@query(with_(VECTORS) + f"select tag, n_fake, n_real, round(auc, 5) as auc from {_sql_metrics('(select tag, label, ' + _head_sql('ship') + ' as score from v)', ['tag'])}")
def head_auc_by_tag(spark, d):
    s = V.scores(T.vectors(spark, d), "feats", {"ship": HEADS["ship"]}).select("tag", "label", F.round("p_ship", 6).alias("score"))
    return roc.metrics(s, ["tag"]).select("tag", "n_fake", "n_real", F.round("auc", 5).alias("auc"))


_ARMS = "(select unnest(arms) as arm, label, score from (select list_filter([case when contains(path, 'Real') or contains(path, 'gan') then 'gan_only' end, 'all'], lambda x: x is not null) as arms, label, " + _head_sql("ship") + " as score from v))"


@query(with_(VECTORS) + f"select arm, n_fake, n_real, round(auc, 5) as auc from {_sql_metrics(_ARMS, ['arm'])}")
def ablation_keep_any(spark, d):
    """AUC on the rows that each arm keeps: any of its pieces in the path, or all."""
    arms = {"gan_only": ["Real", "gan"], "all": []}
    s = V.scores(T.vectors(spark, d), "feats", {"ship": HEADS["ship"]})
    kept = F.array_compact(F.array(*[F.when(S.keep_any(F.col("path"), pieces), F.lit(a)) for a, pieces in arms.items()]))
    s = s.select(F.explode(kept).alias("arm"), "label", F.round("p_ship", 6).alias("score"))
    return roc.metrics(s, ["arm"]).select("arm", "n_fake", "n_real", F.round("auc", 5).alias("auc"))


@query(with_(SCORED) + "select label, said, n, round(n / sum(n) over (partition by label), 6) as share from (select label, (score >= 0.5)::int as said, count(*) as n from scored group by 1, 2)")
def label_confusion_pct(spark, d):
    pairs = T.scored(spark, d).groupBy("label", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("said")).agg(F.count(F.lit(1)).alias("n"))
    return _round(models.confusion(pairs, "label", "said"), "share")


@query("select event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as k_sum, round(avg(value), 6) as mean_value from events group by event_type")
def json_props_stats(spark, d):
    e = T.table(spark, d, "events").select("event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("select a.label, count(*) as n, round(avg(list_cosine_similarity(a.embedding, b.embedding)), 5) as mean_cosine from embeddings a join (select label, embedding from embeddings qualify row_number() over (partition by label order by vec_id) = 1) b using (label) group by a.label")
def embedding_cosine_to_first(spark, d):
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    cos = V.dot(F.col("embedding"), F.col("first")) / (V.norm(F.col("embedding")) * V.norm(F.col("first")))
    return e.join(first, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cos), 5).alias("mean_cosine"))


# ---- traces ---------------------------------------------------------------------------------------------------------

_MED = "m as (select *, case when row_number() over w >= 3 then median(p) over (partition by vid order by seq rows between 4 preceding and current row) end as med from f window w as (partition by vid order by seq))"
_UPPER = "m as (select *, case when n >= 3 then list_sort(near)[len(near) // 2 + 1] end as med from (select *, row_number() over (partition by vid order by seq) as n, list(p) over (partition by vid order by seq rows between 4 preceding and current row) as near from f))"


@query(with_(FRAMES, _MED) + "select vid, seq, round(med, 6) as med from m")
def rolling_median5(spark, d):
    return traces.rolling_median(T.frames(spark, d)).select("vid", "seq", F.round("med", 6).alias("med"))


@query(with_(FRAMES, _UPPER) + "select vid, seq, round(med, 6) as med from m")
def rolling_median5_upper(spark, d):
    return traces.rolling_upper_median(T.frames(spark, d)).select("vid", "seq", F.round("med", 6).alias("med"))


@query(with_(FRAMES, "o as (select vid, seq, p, row_number() over (partition by vid order by seq) as n from f)", f"e as (select vid, seq, p, n, p as ema from o where n = 1 union all select o.vid, o.seq, o.p, o.n, {traces.ALPHA}::double * o.p + {1 - traces.ALPHA}::double * e.ema from e join o on o.vid = e.vid and o.n = e.n + 1)") + "select vid, seq, p, round(ema + 1e-11::double, 9) as ema from e")
def ema_scores(spark, d):
    return traces.ema(T.frames(spark, d)).withColumn("ema", F.round(F.col("ema") + F.lit(1e-11), 9))  # decimal ties must round alike everywhere


def _badge_sql(med: str, dwell: float | None) -> list[str]:
    """The badge as a recursion over updates: state is (on, up, down, since), updated from the state before."""
    counts = f"u.med <= {traces.CLEAR_AT}" + (f" and u.t - b.since >= {dwell}" if dwell else "")
    return [FRAMES, med, "u as (select vid, seq, t, med, row_number() over (partition by vid order by seq) as n from m)",
        f"""b as (
  select vid, seq, n, med, false as badge, (case when med >= {traces.RAISE_AT} then 1 else 0 end) as up, 0 as down, null::double as since from u where n = 1
  union all
  select vid, seq, n, med, case when up2 >= {traces.RAISE_AFTER} then true when down2 >= {traces.CLEAR_AFTER} then false else was end, case when up2 >= {traces.RAISE_AFTER} then 0 else up2 end,
    case when down2 >= {traces.CLEAR_AFTER} then 0 else down2 end, case when up2 >= {traces.RAISE_AFTER} then t else since end
  from (select u.vid, u.seq, u.n, u.med, u.t, b.badge as was, b.since, case when not b.badge and u.med >= {traces.RAISE_AT} then b.up + 1 else 0 end as up2, case when b.badge and {counts} then b.down + 1 else 0 end as down2
    from b join u on u.vid = b.vid and u.n = b.n + 1))"""]


@query(with_(*_badge_sql(_MED, None)) + "select vid, seq, round(med, 6) as med, badge from b")
def hysteresis_badge(spark, d):
    return traces.badge(T.frames(spark, d)).select("vid", "seq", F.round("med", 6).alias("med"), F.col("on").alias("badge"))


@query(with_(*_badge_sql(_UPPER, traces.DWELL)) + "select vid, seq, round(med, 6) as med, badge from b")
def hysteresis_dwell(spark, d):
    return traces.badge(T.frames(spark, d), dwell=traces.DWELL, upper=True).select("vid", "seq", F.round("med", 6).alias("med"), F.col("on").alias("badge"))


_SUMMARY = "sm as (select vid, count(*) as updates, avg(badge::int) as on_fraction, (sum(turn))::bigint as transitions, coalesce(max(med), 0) as max_median from (select *, case when badge <> lag(badge) over (partition by vid order by seq) then 1 else 0 end as turn from b) group by vid)"
_LABEL = "case when ('0x' || substr(md5(vid), 1, 2))::int % 2 = 0 then 'ai' else 'real' end"


@query(with_(*_badge_sql(_MED, None), _SUMMARY) + f"""select vid, updates, round(on_fraction, 6) as on_fraction, transitions, round(max_median, 6) as max_median, round({traces.RAISE_AT} - max_median, 6) as headroom,
  case when transitions > 2 then 'flickering' when (label = 'ai' and on_fraction > 0.5) or (label = 'real' and on_fraction < 0.02) then 'pinned_correct' when on_fraction between 0.02 and 0.5 then 'crosses_mid_clip' else 'pinned_wrong' end as verdict,
  label = 'real' and {traces.RAISE_AT} - max_median < 0.05 as near_threshold from (select *, {_LABEL} as label from sm)""")
def clip_verdict(spark, d):
    """Badge history of each clip and what it amounts to; a clip's class is a hash of its name, as the table has none."""
    label = F.when(F.conv(F.substring(F.md5("vid"), 1, 2), 16, 10).cast("int") % 2 == 0, "ai").otherwise("real")
    s = traces.badge_summary(traces.badge(T.frames(spark, d))).withColumn("label", label)
    s = s.withColumn("verdict", traces.verdict(F.col("label"), F.col("on_fraction"), F.col("transitions"))).withColumn("near_threshold", (F.col("label") == "real") & (F.col("headroom") < 0.05))
    return _round(s.drop("label"), "on_fraction", "max_median", "headroom")


_CORR = "select vid, round(case when count(*) <= 2 or stddev_pop(p) <= 1e-9 or c is null or isnan(c) then 1.0 else c end, 6) as frame_corr from (select *, lag(p) over (partition by vid order by seq) as q from f) join (select vid as v2, corr(q, p) as c from (select *, lag(p) over (partition by vid order by seq) as q from f) group by vid) on vid = v2 group by vid, c"


@query(with_(*_badge_sql(_MED, None), _SUMMARY, f"cr as ({_CORR})", f"md as (select vid, median(p) as mid, {', '.join(f'avg((p >= {t})::int) as s{i}' for i, t in enumerate(traces.SHARES))} from f group by vid)") + f"""select count(*) as clips, count(*) filter (label = 'ai' and on_fraction > 0.5) as flagged_ai, count(*) filter (label = 'real' and on_fraction > 0.02) as false_alarms, round(avg(on_fraction), 6) as mean_on,
  round(median(mid) filter (label = 'ai'), 6) as median_ai, round(median(mid) filter (label = 'real'), 6) as median_real, round(avg(frame_corr), 5) as mean_corr, {', '.join(f"round(avg(s{i}) filter (label = '{k}'), 6) as share_{k}_{i}" for i in range(len(traces.SHARES)) for k in ('ai', 'real'))} from (select *, {_LABEL} as label from sm) join cr using (vid) join md using (vid)""")
def clip_totals(spark, d):
    """What is told about all clips: flagged and false alarms, mean shares, medians of medians, mean correlation of frames."""
    label = F.when(F.conv(F.substring(F.md5("vid"), 1, 2), 16, 10).cast("int") % 2 == 0, "ai").otherwise("real")
    f = save(T.frames(spark, d).select("vid", "seq", "t", "p"), "frames")
    shares = [f"frac_ge_{str(t).replace('.', '_')}" for t in traces.SHARES]
    s = traces.badge_summary(traces.badge(f)).join(_round(traces.lag_correlation(f), "frame_corr"), "vid").join(traces.trace_stats(f).select("vid", "median_p", *shares), "vid").withColumn("label", label)
    of = lambda k, c: F.when(F.col("label") == k, F.col(c))
    return s.agg(F.count(F.lit(1)).alias("clips"), F.count_if((F.col("label") == "ai") & (F.col("on_fraction") > 0.5)).alias("flagged_ai"), F.count_if((F.col("label") == "real") & (F.col("on_fraction") > 0.02)).alias("false_alarms"),
        F.round(F.avg("on_fraction"), 6).alias("mean_on"), F.round(F.percentile(of("ai", "median_p"), F.lit(0.5)), 6).alias("median_ai"), F.round(F.percentile(of("real", "median_p"), F.lit(0.5)), 6).alias("median_real"), F.round(F.avg("frame_corr"), 5).alias("mean_corr"),
        *[F.round(F.avg(of(k, c)), 6).alias(f"share_{k}_{i}") for i, c in enumerate(shares) for k in ("ai", "real")])


@query(with_(FRAMES) + "select vid, count(*) as n, min(p) as min_p, round(quantile_cont(p, 0.05), 9) as p05, round(median(p), 9) as median_p, round(avg(p), 9) as mean_p, round(quantile_cont(p, 0.95), 9) as p95, max(p) as max_p, " + ", ".join(f"round(avg((p >= {t})::int), 9) as frac_ge_{str(t).replace('.', '_')}" for t in traces.SHARES) + " from f group by vid")
def trace_stats(spark, d):
    return _round(traces.trace_stats(T.frames(spark, d)), "p05", "median_p", "mean_p", "p95", *[f"frac_ge_{str(t).replace('.', '_')}" for t in traces.SHARES], digits=9)


@query(with_(FRAMES) + _CORR)
def lag1_corr(spark, d):
    return _round(traces.lag_correlation(T.frames(spark, d)), "frame_corr")


@query(with_(FRAMES) + "select vid, e.key as head, round(median(e.value), 6) as median_p from (select vid, unnest(map_entries(heads)) as e from f where heads is not null) group by 1, 2")
def head_medians(spark, d):
    return _round(traces.head_medians(T.frames(spark, d)), "median_p")


@query(with_(FRAMES) + "select vid, seq, round(case when n > 1 and span > 0 then (n - 1) / span end, 5) as fps from (select vid, seq, count(*) over w as n, t - min(t) over w as span from f window w as (partition by vid order by seq rows between 19 preceding and current row))")
def fps_last20(spark, d):
    return _round(traces.recent_rate(T.frames(spark, d)), "fps", digits=5)


@query(with_(FRAMES) + "select vid, max(n) as n, round(sum(p), 6) as recent_sum from (select *, row_number() over (partition by vid order by seq desc) as back, count(*) over (partition by vid) as n from f) where back <= 60 group by vid")
def bounded_history(spark, d):
    t = traces.traces(T.frames(spark, d))
    last = traces.recent(F.col("trace"), 60)
    return t.select("vid", F.size("trace").cast("bigint").alias("n"), F.round(F.aggregate(last, F.lit(0.0), lambda s, r: s + r["p"]), 6).alias("recent_sum"))


@query("select count(*) filter (ok) as scored, count(*) filter (not ok) as busy, round(quantile_cont(ms, 0.5) filter (ok), 5) as ms_p50, round(quantile_cont(ms, 0.95) filter (ok), 5) as ms_p95 from (select distinct on (vid, seq) * from frame_scores)")
def stream_counters(spark, d):
    f = T.table(spark, d, "frame_scores").dropDuplicates(["vid", "seq"])
    ms = F.when(F.col("ok"), F.col("ms"))
    return f.agg(F.count_if("ok").alias("scored"), F.count_if(~F.col("ok")).alias("busy"), F.round(F.percentile(ms, F.lit(0.5)), 5).alias("ms_p50"), F.round(F.percentile(ms, F.lit(0.95)), 5).alias("ms_p95"))


@query("select vid, epoch_us(time_bucket(interval 1 minute, sent_at))::bigint as minute_us, count(*) as frames, count(p) as scored from (select distinct on (vid, seq) * from frame_scores) group by 1, 2")
def minute_windows(spark, d):
    f = T.table(spark, d, "frame_scores").dropDuplicates(["vid", "seq"])
    minute = F.date_trunc("minute", F.col("sent_at"))
    return f.groupBy("vid", F.unix_micros(minute.cast("timestamp")).alias("minute_us")).agg(F.count(F.lit(1)).alias("frames"), F.count("p").alias("scored"))


@query(with_(*_badge_sql(_MED, None)) + "select vid, seq, round(med, 6) as med, badge from b")
def stream_badge(spark, d):
    """The badge by Structured Streaming over the table's frames, all of which arrive in one micro-batch in any order."""
    from ..streaming import badge as B

    folder = f"{shared_folder(spark)}/gaugeworks/stream-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, folder)
    fs.deleteOnExit(p)
    T.frames(spark, d).select("vid", "seq", "t", "p").write.parquet(f"{folder}/frames")
    source = spark.readStream.schema("vid string, seq bigint, t double, p double").parquet(f"{folder}/frames")
    out = B.run_to_table(B.badge_stream(source, idle_ms=None), f"{folder}/badges", f"{folder}/checkpoint")
    return out.select("vid", "seq", F.round("med", 6).alias("med"), "badge")


# ---- archives, feed, heads ------------------------------------------------------------------------------------------

_ARCHIVE = "regexp_replace(source, '^((" + "|".join(S.SOURCE_PREFIXES) + "):)+', '')"
_MEMBERS = SAMPLES + f""",
members as (select {_ARCHIVE} as archive, sample_id, path as name, width::bigint * height as size,
  coalesce(sum(width::bigint * height + (sample_id % 7) * 300000) over (partition by {_ARCHIVE} order by sample_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset_
  from s where source is not null and width is not null and height is not null and path is not null),
ends as (select *, offset_ + {windows.HEADER + windows.EXTRA} + strlen(name) + size as stop from members),
gaps as (select *, lag(stop) over (partition by archive order by offset_, name) as before from ends),
islands as (select *, (sum(case when before is null or offset_ - before > {windows.MAX_GAP} then 1 else 0 end) over (partition by archive order by offset_, name))::bigint as island from gaps)"""


def _members(spark, d):
    """Archive directories made from the manifest: the size of a member is its area, and some leave a gap behind."""
    s = T.samples(spark, d).filter("source is not null and width is not null and height is not null and path is not null")
    s = s.select(S.base_source(F.col("source")).alias("archive"), "sample_id", F.col("path").alias("name"), (F.col("width").cast("bigint") * F.col("height")).alias("size"))
    w = Window.partitionBy("archive").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("offset", F.coalesce(F.sum(F.col("size") + (F.col("sample_id") % 7) * 300000).over(w), F.lit(0)))


@query(with_(_MEMBERS) + "select archive, island, min(offset_) as start, max(stop) as stop, count(*) as members from islands group by archive, island")
def gap_islands(spark, d):
    return windows.gap_windows(_members(spark, d)).groupBy("archive", "island").agg(F.min("offset").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("members"))


@query(with_(_MEMBERS, "o as (select *, row_number() over (partition by archive order by offset_, name) as n from ends)",
    f"""wn as (
  select archive, n, offset_ as start, stop, 1 as members, 1 as win from o where n = 1
  union all
  select archive, n2, case when cut then begins else start end, stop2, case when cut then 1 else members + 1 end, case when cut then win + 1 else win end
  from (select wn.*, o.n as n2, o.offset_ as begins, o.stop as stop2, o.stop - wn.start > {windows.MAX_WINDOW} or o.offset_ - wn.stop > {windows.MAX_GAP} as cut from wn join o on o.archive = wn.archive and o.n = wn.n + 1))""") +
    "select archive, max(start) as start, max(stop) as stop, max(members)::int as members from wn group by archive, win")
def byte_windows(spark, d):
    return windows.byte_windows(_members(spark, d))


@query(with_(_MEMBERS) + f"select archive, name, size from (select archive, name, size, row_number() over (partition by 1 order by {_md5(4, 'name')}, name) as n from members where contains(name, '/images/')) where n <= 300")
def archive_select(spark, d):
    """Members whose name holds a piece: a seeded choice of 300, as a fetch by offset would take them."""
    return windows.select_members(_members(spark, d), "/images/", 300, 4).select("archive", "name", "size")


@query("""with c as (select vid, max(width_) as w, max(bytes) as size, count(*) as n from (select vid, (seq % 5) * 320 as width_, seq * 9000 as bytes from (select distinct on (vid, seq) * from frame_scores)) group by vid)
select vid, coalesce(nullif(concat_ws(', ', case when w <> 1280 then 'width ' || w end, case when size < 100000 then 'under 100 KB' end, case when n / 2.0 not between 3.0 and 14.0 then 'dur ' || format('{:.1f}', n / 2.0::double) || 's' end, case when not regexp_full_match(vid, '[a-z0-9_]+') then 'bad id' end), ''), 'ok') as problems from c""")
def clip_problems(spark, d):
    """Validation predicates of clips joined to a text; sizes are made from the frames, as the table has none."""
    f = T.table(spark, d, "frame_scores").dropDuplicates(["vid", "seq"])
    c = f.groupBy("vid").agg(F.max((F.col("seq") % 5) * 320).alias("w"), F.max(F.col("seq") * 9000).alias("size"), F.count(F.lit(1)).alias("n"))
    seconds = F.col("n") / F.lit(2.0)
    found = S.problems([(F.col("w") != 1280, F.concat(F.lit("width "), "w")), (F.col("size") < 100_000, F.lit("under 100 KB")), (~seconds.between(3.0, 14.0), F.format_string("dur %.1fs", seconds)), (~S.is_clip_id(F.col("vid")), F.lit("bad id"))])
    return c.select("vid", F.coalesce(found, F.lit("ok")).alias("problems"))


@query("select a.vid, a.frames, b.heads from (select vid, count(distinct seq) as frames from frame_scores group by vid) a join (select distinct vid from frame_scores where ok) using (vid) left join (select vid, count(distinct active_head) as heads from frame_scores where not ok group by vid) b using (vid)")
def feed_join(spark, d):
    """Clips that have a scored frame (semi join), with the number of heads of their failed frames if any (left join)."""
    f = T.table(spark, d, "frame_scores")
    clips = f.groupBy("vid").agg(F.count_distinct("seq").alias("frames"))
    failed = f.filter("not ok").groupBy("vid").agg(F.count_distinct("active_head").alias("heads"))
    return clips.join(f.filter("ok").select("vid"), "vid", "left_semi").join(failed, "vid", "left").select("vid", "frames", "heads")


def _labelled_vectors(spark, d):
    """Training rows (clean and augmented draws of two thirds of the pictures) and evaluation rows (clean and every condition of
    the others), each picture on one side."""
    v = T.vectors(spark, d).filter("label is not null").withColumn("label", F.when(F.col("label") >= 1, 1).otherwise(0))
    v = save(sampling.grouped_split(v, "path", 1), "vectors")
    return v.filter("part = 'train'").filter(F.col("tag").isin("clean", "train_aug")), v.filter("part = 'test' and tag <> 'train_aug'")


@query()
def logreg_scores(spark, d):
    """A head trained by logistic regression on two thirds of the pictures, tested on the others: (tag, n, auc)."""
    train, test = _labelled_vectors(spark, d)
    model = models.train_head(train, reg=0.001)
    return _round(roc.metrics(models.head_scores(model, test), ["tag"], "p").select("tag", "n", "auc"), "auc")


@query()
def head_sweep(spark, d):
    """All settings of the three sweeps (regularisation 40, normalisation 3, loss 6), trained together."""
    train, test = _labelled_vectors(spark, d)
    every = [x for kind in ("reg", "norm", "loss") for x in models.sweep_settings(kind)]
    return _round(models.sweep_heads(train, test, every), "clean_auc", "worst_auc", "mean_degraded_auc", digits=4)


@query()
def train_history(spark, d):
    """The frozen training: draws, head, the epoch of the best degraded AUC, shortcut gap; one row for each epoch."""
    train, test = _labelled_vectors(spark, d)
    clean, degraded = test.filter("tag = 'clean'"), test.filter("tag <> 'clean'")
    alternative = T.vectors(spark, d).filter("tag = 'clean'").join(T.pictures(spark, d).filter("real_set = 'alt'").select("path"), "path", "left_semi")
    _, history, summary = models.train_frozen([train.filter(F.col("tag") == t) for t in ("clean", "train_aug")], clean, degraded, alternative)
    rows = [(h["epoch"], h["train_auc"], h["val_clean"], h["val_degraded"], h["epoch"] == summary["best_epoch"], summary["shortcut_gap"]) for h in history]
    return _round(spark.createDataFrame(rows, "epoch int, train_auc double, val_clean double, val_degraded double, best boolean, shortcut_gap double"), "train_auc", "val_clean", "val_degraded", "shortcut_gap", digits=4)


@query()
def clean_draws(spark, d):
    """Whether a clean draw helps: degraded draws, degraded and clean, and as many degraded as a control of volume."""
    train, test = _labelled_vectors(spark, d)
    clean = train.filter("tag = 'clean'")
    half = F.pmod(F.xxhash64("vec_id"), F.lit(3))
    e0, e1, e2 = (train.filter("tag = 'train_aug'").filter(half == i) for i in range(3))
    return _round(models.draw_arms({"two degraded": [e0, e1], "two degraded, one clean": [e0, e1, clean], "three degraded": [e0, e1, e2]}, test), "clean_auc", "worst_auc", "mean_degraded_auc", digits=4)


@query()
def gate_probe(spark, d):
    """Which degradation a vector underwent, by condition, family and degraded or not: confusion on held-out pictures, by row."""
    p = models.probe(T.vectors(spark, d).filter("tag <> 'train_aug'").select("tag", "path", "feats"), "tag", "path")
    return _round(p.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grain", "label"))), "share")


@query(with_(VECTORS) + "select round(max(n) / sum(n), 6) as majority_share from (select tag, count(*) as n from v group by tag)")
def majority_share(spark, d):
    return _round(models.majority_share(T.vectors(spark, d), "tag"), "majority_share")


@query(with_(VECTORS, "st as (select i, avg(feats[i]::double) as m, stddev_pop(feats[i]::double) as s from v, range(1, 65) r(i) where tag = 'clean' group by i)") + "select v.vec_id, round((feats[1] - a.m) / greatest(a.s, 1e-6), 5) + 0.0::double as first, round((feats[64] - b.m) / greatest(b.s, 1e-6), 5) + 0.0::double as last from v, st a, st b where a.i = 1 and b.i = 64")
def standardized(spark, d):
    """Every vector by mean and deviation of the clean ones."""
    v = T.vectors(spark, d)
    stats = {r.pos: (r.mean, r.std) for r in V.column_stats(v.filter("tag = 'clean'"), "feats").collect()}  # 64 rows
    mean, std = ([stats[i][k] for i in sorted(stats)] for k in (0, 1))
    u = v.select("vec_id", V.standardize(F.col("feats"), V.constant(mean), V.constant(std)).alias("u"))
    return u.select("vec_id", (F.round(F.col("u")[0], 5) + F.lit(0.0)).alias("first"), (F.round(F.col("u")[63], 5) + F.lit(0.0)).alias("last"))  # no negative zero
