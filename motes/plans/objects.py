"""Registered queries over the object table, each with its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.functions.scalars import significance_label
from motes.operators import compare, cooccur, learn, matrix, profile, qc
from motes.plans.fixtures import LONG, MARKERS, OBJECTS, SPARSE, objects, sparse, table
from motes.schema import MarkerSchema, requested_markers
from motes.sources import export, tables

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function name, with SQL that gives the same table."""
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def r(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), places) for c in columns})


def long(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.long_form(objects(spark, sf), MARKERS)


BIN = """b as (select object_id, m1 > 25 as b0, m2 > 0.05 as b1, m3 > 0.04 as b2, m4 > 950 as b3 from objects)"""
COMBOS = """k as (select m, list_filter([0, 1, 2, 3], lambda i: (m >> i) & 1 = 1) as idx from range(16) t(m)),
n as (select count(*)::double n, [avg(b0::int), avg(b1::int), avg(b2::int), avg(b3::int)] f from b),
x as (select b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int as mask, count(*) c from b group by 1),
o as (select k.m, any_value(idx) idx, coalesce(sum(c) filter ((mask & k.m) = k.m), 0) obs from k, x group by k.m)"""

PREDS = dict(area_range=(5, 45), circularity_range=(0.15, 0.85), min_score=1500.0, score_column="pan_score",
             min_marker={"m1": 3.0})
PREDS_SQL = """area > 0 and perimeter > 0 and circularity is not null and area between 5 and 45
  and circularity between 0.15 and 0.85 and pan_score >= 1500 and m1 >= 3"""


@query(f"with {OBJECTS} select object_id, sample, position, area, pan_score from objects where {PREDS_SQL}")
def qc_filter(spark, sf):
    o = objects(spark, sf)
    return qc.qc_filter(o, qc.qc_predicates(o.columns, **PREDS)).select(
        "object_id", "sample", "position", "area", "pan_score")


@query(f"""with {OBJECTS}, c as (select count(*) n, count(*) filter ({PREDS_SQL}) k from objects)
select n as n_before, k as n_after, n - k as n_removed, round((n - k) / n * 100.0, 6) as removed_pct,
  'area > 0, perimeter > 0, circularity present, area range, circularity range, score, marker m1' as filters from c""")
def qc_summary(spark, sf):
    o = objects(spark, sf)
    return rounded(qc.qc_summary(o, qc.qc_predicates(o.columns, **PREDS)), ["removed_pct"])


def sparse_objects(spark, sf) -> DataFrame:
    """The sparse table under the column names of an object table."""
    s = sparse(spark, sf)
    fixed = {c: F.lit(1.0) for c in ("centroid_x", "centroid_y", "area", "perimeter", "circularity")}
    return s.withColumns(fixed).withColumnsRenamed({f"L{i}": f"L{i}_positive" for i in range(1, 8)})


SHARES = f"""{SPARSE}, shares as (
  select marker, avg(case when value is null then 1.0 else 0.0 end) as share
  from sparse unpivot include nulls (value for marker in (L1, L2, L3, L4, L5, L6, L7)) group by marker)"""


@query(f"""with {SHARES}, low as (select min(share) m, count(*) filter (share <= 0.5) k from shares)
select marker, round(share, 6) as missing_share,
  case when (k > 0 and share <= 0.5) or (k = 0 and share = m) then 1 else 0 end as valid from shares, low""")
def marker_validity(spark, sf):
    df = sparse_objects(spark, sf)
    schema = MarkerSchema.infer(df.columns)
    shares = tables.missing_shares(tables.typed_objects(df, schema), schema)
    keep = set(tables.valid_markers(shares, 0.5))
    rows = [(m, round(s, 6), int(m in keep)) for m, s in shares.items()]
    return spark.createDataFrame(rows, "marker string, missing_share double, valid int")


@query(f"""with {SPARSE} select object_id, sample, {', '.join(f'round(coalesce(L{i}, 0), 4) as L{i}' for i in range(1, 8))} from sparse""")
def typed_ingest(spark, sf):
    df, _ = tables.load_objects(sparse_objects(spark, sf), 0.6)
    return df.select("object_id", "sample", *[r(f"L{i}", 4) for i in range(1, 8)])


@query(f"""with {SPARSE} {' union all '.join(f"select 'L{i}' as marker, 'L{i}_positive' as source_column, 0 as is_score, count(L{i}) as present, round(sum(L{i}), 2) as total from sparse" for i in range(1, 8))}
  union all select 'pan', 'pan_score', 1, count(pan_score), round(sum(pan_score), 2) from sparse""")
def marker_metadata(spark, sf):
    """The inferred markers, with the present values of each source column."""
    df = sparse_objects(spark, sf)
    meta = MarkerSchema.infer(df.columns).metadata(spark).withColumn("is_score", F.col("is_score").cast("int"))
    names = [r["source_column"] for r in meta.select("source_column").collect()]  # a row per marker
    return meta.join(df.agg(F.array(*[F.struct(F.lit(c).alias("source_column"), F.count(c).alias("present"), F.round(F.sum(c), 2).alias("total"))
                                      for c in names]).alias("a")).select(F.inline("a")), "source_column")


@query(f"""with {OBJECTS} select count(*) as n, count(distinct l_orderkey) = count(*) as ids_were_unique,
  1 as min_id, count(*) as max_id, count(*) as n_distinct from lineitem""")
def union_rekey(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linestatus").alias("position"),
                                             F.col("l_quantity").alias("m1"))
    unique = li.groupBy("object_id").count().where("count > 1").isEmpty()
    u = tables.union_tables([li.where("position = 'F'"), li.where("position = 'O'").select("m1", "position", "object_id")])
    return u.agg(F.count("*").alias("n"), F.lit(unique).alias("ids_were_unique"), F.min("object_id").cast("int").alias("min_id"),
                 F.max("object_id").alias("max_id"), F.countDistinct("object_id").alias("n_distinct"))


@query(f"""with {OBJECTS} select a.object_id, a.sample, b.m1 as raw__m1, b.m2 as raw__m2, c.m3 as bg__m3
from objects a left join (select * from objects where m1 > 10) b using (object_id)
left join (select * from objects where m3 < 0.05) c using (object_id)""")
def enrich_three_tables(spark, sf):
    o = objects(spark, sf)
    return tables.enriched(o.select("object_id", "sample"), o.where("m1 > 10").select("object_id", "sample", "m1", "m2"),
                           o.where("m3 < 0.05").select("object_id", "m3"))


@query(f"""with {OBJECTS} select object_id, sample, position, round(m1 / (pan_score + 1e-6), 9) as m1,
  round(m2 / (pan_score + 1e-6), 9) as m2, round(m3 / (pan_score + 1e-6), 9) as m3,
  round(m4 / (pan_score + 1e-6), 9) as m4 from objects""")
def normalize_anchor(spark, sf):
    n = matrix.normalize(objects(spark, sf), "pan_score", {m: m for m in MARKERS})
    return rounded(n, MARKERS, 9)


@query(f"""with {OBJECTS} select count(*) as objects, count(*) filter (pan_score < 2000) as low,
  round(avg(case when pan_score < 2000 then 1.0 else 0.0 end), 6) as low_fraction from objects""")
def low_anchor_fraction(spark, sf):
    return rounded(matrix.low_anchor_fraction(objects(spark, sf), "pan_score", 2000.0), ["low_fraction"])


def _scaled(spark, sf, method):
    o = objects(spark, sf).select("object_id", *MARKERS)
    return rounded(matrix.scale(o, MARKERS, method), MARKERS, 5)


def _scale_sql(expr: str, stats: str) -> str:
    cols = ", ".join(f"round({expr.format(m=m)}, 5) as {m}" for m in MARKERS)
    st = ", ".join(stats.format(m=m) for m in MARKERS)
    return f"with {OBJECTS}, s as (select {st} from objects) select object_id, {cols} from objects, s"


@query(_scale_sql("(objects.{m} - s.a_{m}) / s.s_{m}", "avg({m}) as a_{m}, stddev_pop({m}) as s_{m}"))
def scale_zscore(spark, sf):
    return _scaled(spark, sf, "zscore")


@query(_scale_sql("objects.{m} / s.x_{m}", "max({m}) as x_{m}"))
def scale_max(spark, sf):
    return _scaled(spark, sf, "max")


@query(_scale_sql("(objects.{m} - s.b_{m}) / (s.c_{m} - s.a_{m})",
                  "quantile_cont({m}, 0.25) as a_{m}, quantile_cont({m}, 0.5) as b_{m}, quantile_cont({m}, 0.75) as c_{m}"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query(f"""with {OBJECTS}, {LONG} select marker, round(quantile_cont(value, 0.95), 6) as threshold,
  'percentile' as method from long group by marker""")
def threshold_percentile(spark, sf):
    return rounded(matrix.thresholds_percentile(objects(spark, sf), MARKERS), ["threshold"])


@query(f"""with {OBJECTS}, {LONG}, t as (select * from (values ('m1', 10.0::double, 'manual'), ('m2', 0.5, 'manual'), ('m3', 0.25, 'global'), ('m4', 0.25, 'global')) t(marker, threshold, method))
select marker, threshold, method, count(*) filter (value > threshold) as above from t join long using (marker) group by 1, 2, 3""")
def threshold_fixed(spark, sf):
    """Manual and global thresholds with the objects above them."""
    t = matrix.thresholds_manual(spark, ["m1", "m2"], {"m1": 10, "m2": .5}).union(matrix.thresholds_global(spark, ["m3", "m4"], .25))
    return F.broadcast(t).join(long(spark, sf), "marker").groupBy("marker", "threshold", "method").agg(
        F.count_if(F.col("value") > F.col("threshold")).alias("above"))


OTSU = """, e as (select marker, min(value) lo, max(value) hi from long group by marker),
h as (select marker, case when hi > lo then least(cast(floor((value - lo) / (hi - lo) * 256) as int), 255) else 0 end as bin,
      count(*) n, any_value(lo) lo, any_value(hi) hi from long join e using (marker) group by 1, 2),
c as (select *, lo + (bin + 0.5) * (hi - lo) / 256 as mid from h),
w as (select *, sum(n) over (partition by marker order by bin) w1, sum(n * bin) over (partition by marker order by bin) s1,
      sum(n) over (partition by marker) w, sum(n * bin) over (partition by marker) s from c),
v as (select *, (cast(s1 as double) * cast(w as double) - cast(s as double) * cast(w1 as double)) * (cast(s1 as double) * cast(w as double) - cast(s as double) * cast(w1 as double))
  / (cast(w1 as double) * (cast(w as double) - cast(w1 as double))) as var from w where w > w1)
"""


@query(f"""with {OBJECTS}, {LONG} {OTSU}, f as (select *, row_number() over (partition by marker order by var desc, bin) k from v)
select marker, round(mid, 6) as threshold, 'otsu' as method from f where k = 1""")
def threshold_otsu(spark, sf):
    return rounded(matrix.thresholds_otsu(objects(spark, sf), MARKERS), ["threshold"])


@query(f"""with {OBJECTS}, t as (select {', '.join(f'quantile_cont({m}, 0.75) as t_{m}' for m in MARKERS)} from objects)
select object_id, sample, position, {', '.join(f'cast(coalesce(objects.{m} > t_{m}, false) as tinyint) as {m}' for m in MARKERS)}
from objects, t""")
def binarize_matrix(spark, sf):
    o = objects(spark, sf)
    return matrix.binarize(o, MARKERS, matrix.thresholds_percentile(o, MARKERS, 75.0))


L = [f"L{i}" for i in range(1, 8)]


@query(f"""with {SPARSE} select object_id, sample, position, {', '.join(f'cast(coalesce({m}, 0) >= 0.5 as tinyint) as {m}' for m in L)} from sparse""")
def binarize_source(spark, sf):
    return matrix.binarize_source(sparse(spark, sf), {m: m for m in L})[0]


@query(f"""with {SPARSE}, ids as (select o_orderkey as object_id from orders)
select object_id, cast(coalesce(cast(L2 > 100 as int), 0) as int) as L2 from ids left join
(select object_id, L2 from sparse where L2 is not null) using (object_id)""")
def align_to_ids(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"))
    m = sparse(spark, sf).where("L2 is not null").select("object_id", (F.col("L2") > 100).cast("int").alias("L2"))
    return matrix.aligned(ids, m, 0)


DESCRIBE = """count(value) as count, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median,
  round(stddev_samp(value), 6) as std, min(value) as min, round(quantile_cont(value, 0.25), 6) as q25,
  round(quantile_cont(value, 0.75), 6) as q75, max(value) as max"""


@query(f"with {OBJECTS}, {LONG} select marker, sample, {DESCRIBE} from long group by marker, sample")
def describe_by_sample(spark, sf):
    return rounded(compare.describe(long(spark, sf)), ["mean", "median", "std", "q25", "q75"])


@query(f"""with {OBJECTS} select sample, {', '.join(f'round(avg({m} / (pan_score + 1e-6)), 9) as {m}' for m in MARKERS)}
from objects group by sample""")
def avg_by_sample(spark, sf):
    o = objects(spark, sf)
    n = matrix.normalize(o, "pan_score", {m: m for m in MARKERS}, keep=["object_id"])
    return rounded(profile.mean_by_group(n, o, "sample", MARKERS), MARKERS, 9)


AVG_POS = [*MARKERS, "area", "perimeter", "circularity"]


@query(f"with {OBJECTS} select position, {', '.join(f'round(avg({m}), 6) as {m}' for m in AVG_POS)} from objects group by position")
def avg_by_position(spark, sf):
    return rounded(profile.means(objects(spark, sf), ["position"], AVG_POS), AVG_POS)


@query(f"with {OBJECTS} select sample, position, count(*) as object_count from objects group by sample, position")
def count_sample_position(spark, sf):
    return profile.counts(objects(spark, sf), "sample", "position", name="object_count")


@query(f"""with {OBJECTS} select position, count(*) filter (sample = 'A') as "A", count(*) filter (sample = 'N') as "N",
  count(*) filter (sample = 'R') as "R" from objects group by position""")
def count_pivot(spark, sf):
    return profile.count_pivot(objects(spark, sf), values=["A", "N", "R"])


@query(f"""with {SPARSE}, c as (select sample, position, count(*) as count from sparse group by 1, 2)
select sample, position, count, round(count / sum(count) over (partition by sample), 6) as share from c""")
def crosstab_share(spark, sf):
    return rounded(profile.crosstab(sparse(spark, sf), "sample", "position"), ["share"])


@query(f"""with {OBJECTS}, g as (select case when sample = 'N' then 'nan' else sample end as "group", count(*) n,
  {', '.join(f'round(avg({m}), 6) as {m}' for m in MARKERS)} from objects group by 1)
select *, "group" || ' (n=' || n || ')' as label from g""")
def group_profile(spark, sf):
    o = objects(spark, sf).withColumn("sample", F.when(F.col("sample") != "N", F.col("sample")))
    return rounded(profile.group_profile(o, "sample", MARKERS), MARKERS)


@query(f"""with {OBJECTS}, {LONG} select marker, sample, position, round(quantile_cont(value, 0.25), 6) as q25,
  round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q75 from long group by 1, 2, 3""")
def quartiles_by_group(spark, sf):
    return rounded(profile.quartiles(long(spark, sf), ["marker", "sample", "position"]), ["q25", "median", "q75"])


@query(f"""with {OBJECTS}, {LONG}, e as (select marker, min(value) lo, max(value) hi from long group by marker),
h as (select marker, least(cast(floor((value - lo) / (hi - lo) * 50) as int), 49) as bin, count(*) n,
      any_value(lo) lo, any_value(hi) hi from long join e using (marker) group by 1, 2)
select marker, bin, n, round(lo + bin * ((hi - lo) / 50), 6) as left_edge, round(lo + (bin + 1) * ((hi - lo) / 50), 6) as right_edge from h""")
def distribution_histogram(spark, sf):
    return rounded(profile.histogram_table(long(spark, sf), ["marker"], "value", 50), ["left_edge", "right_edge"])


@query(f"""with {OBJECTS}, s as (select min(pan_score) lo, max(pan_score) hi from objects)
select object_id, round(10 + (pan_score - lo) / (hi - lo) * 90, 6) as size from objects, s""")
def display_sizes(spark, sf):
    return rounded(profile.display_sizes(objects(spark, sf), "pan_score").select("object_id", "size"), ["size"])


@query(f"""with {OBJECTS} select min(pan_score) as min_score, max(pan_score) as max_score,
  round(avg(pan_score), 6) as mean_score from objects""")
def score_report(spark, sf):
    return rounded(profile.score_report(objects(spark, sf), "pan_score"), ["mean_score"])


@query(f"""with {OBJECTS}, {BIN}, {COMBOS}, c as (select count(*) n, count(*) filter (pan_score < 2000) low, count(*) filter ({PREDS_SQL}) k,
  min(pan_score) a, max(pan_score) z from objects),
t as (select array_to_string(list_transform(idx, lambda i: 'm' || (i + 1)), '+') as combination, obs from o where len(idx) >= 2)
select 'score' as section, 'range' as item, printf('%.2f to %.2f', a, z) as text from c
union all select 'low_anchor', 'sentence', case when low / n > 0.05 then 'Warning: ' else '' end || printf('%.1f', low * 100.0 / n) || '% of objects have a low anchor score' from c
union all select 'qc', 'sentence', 'Objects before filtering: ' || n || ' | After: ' || k || ' | Removed: ' || (n - k) || ' (' || printf('%.1f', (n - k) * 100.0 / n) || '%)' from c
union all select 'top_combinations', combination, obs::bigint::varchar from (select * from t order by obs desc, combination limit 20)""")
def report_sections(spark, sf):
    """The tables of the report as one long table of texts."""
    o = objects(spark, sf)
    combos = cooccur.combinations(binary(spark, sf), MARKERS).withColumn("fdr_pvalue", F.lit(1.0))
    t = export.report_tables(o, "pan_score", combos, matrix.low_anchor_fraction(o, "pan_score", 2000.0),
                             qc.qc_summary(o, qc.qc_predicates(o.columns, **PREDS)))
    rows = {"score": (F.lit("range"), F.format_string("%.2f to %.2f", "min_score", "max_score")), "low_anchor": (F.lit("sentence"), F.col("sentence")),
            "qc": (F.lit("sentence"), F.col("sentence")), "top_combinations": (F.col("combination"), F.col("observed_count").cast("string"))}
    return reduce(DataFrame.union, [t[k].select(F.lit(k).alias("section"), item.alias("item"), text.alias("text")) for k, (item, text) in rows.items()])


@query(f"with {OBJECTS} select object_id, sample, position, pan_score from objects order by pan_score desc, object_id limit 30")
def report_preview(spark, sf):
    o = objects(spark, sf).select("object_id", "sample", "position", "pan_score")
    return profile.preview(o, [F.desc("pan_score"), "object_id"], 30)


@query(f"""with {OBJECTS} select list_sort(list(distinct sample))::varchar as samples,
  list_sort(list(distinct position))::varchar as positions from objects""")
def distinct_lists(spark, sf):
    d = profile.distinct_lists(objects(spark, sf), ["sample", "position"])
    text = {n: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")) for n, c in
            (("samples", "sample"), ("positions", "position"))}
    return d.select(*[c.alias(n) for n, c in text.items()])


@query(f"""with {OBJECTS} select count(*) as total_objects, 'A,N,R' as samples, 'F,O' as positions,
  'm1,m2,m3,m4' as markers, 100.0::double as m4_threshold from objects""")
def summary_document(spark, sf):
    d = export.summary_document(objects(spark, sf), MARKERS, matrix.thresholds_global(spark, MARKERS, 100.0))
    return d.select("total_objects", F.array_join("samples", ",").alias("samples"), F.array_join("positions", ",").alias("positions"),
                    F.array_join("markers", ",").alias("markers"),
                    F.element_at("thresholds", -1)["threshold"].alias("m4_threshold"))


# -- rank tests ----------------------------------------------------------------

RANKS = """, rk as (select marker, sample, rank() over (partition by marker order by value)
  + (count(*) over (partition by marker, value) - 1) / 2 as rnk, count(*) over (partition by marker, value) as t from long)"""


@query(f"with {OBJECTS}, {LONG} {RANKS} select marker, sample, count(*) as n, round(sum(rnk), 1) as rank_sum from rk group by 1, 2")
def rank_sums(spark, sf):
    return rounded(compare.rank_sums(long(spark, sf)), ["rank_sum"], 1).withColumn("n", F.col("n").cast("long"))


@query(f"""with {OBJECTS}, {LONG} {RANKS}, g as (select marker, sample, count(*) n, sum(rnk) rs, sum(t * t - 1.0) tie from rk group by 1, 2),
k as (select marker, count(*) g, sum(n)::double nn, sum(rs * rs / n) q, sum(tie) tie from g group by 1)
select marker, g as groups, cast(nn as bigint) as n,
  round((12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - tie / (nn * nn * nn - nn)), 3) as h_statistic,
  round(exp(-(12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - tie / (nn * nn * nn - nn)) / 2), 5) as pvalue from k""")
def kruskal_h(spark, sf):
    k = compare.kruskal(long(spark, sf))
    return k.select("marker", "groups", F.col("n").cast("long").alias("n"), r("h_statistic", 3), r("pvalue", 5))


MWU = f"""{OBJECTS}, {LONG}, c as (select marker, sample, value, count(*)::double n from long group by 1, 2, 3),
p as (select a.marker, a.sample s1, b.s2, value, a.n c1, 0.0 c2 from c a join (select distinct sample s2 from c) b on a.sample < b.s2
  union all select a.marker, b.s1, a.sample, value, 0.0, a.n from c a join (select distinct sample s1 from c) b on a.sample > b.s1),
v as (select marker, s1, s2, value, sum(c1) c1, sum(c2) c2 from p group by 1, 2, 3, 4),
u as (select *, sum(c2) over (partition by marker, s1, s2 order by value) upto from v),
z as (select marker, s1, s2, sum(c1) n1, sum(c2) n2, sum(c1 * (upto - c2 / 2)) u, sum(power(c1 + c2, 3) - (c1 + c2)) ties from u group by 1, 2, 3)"""


@query(f"""with {MWU} select marker, s1 as sample_1, s2 as sample_2, cast(n1 as bigint) as n_1, cast(n2 as bigint) as n_2, round(u, 1) as u_statistic,
  round(2 * u / (n1 * n2) - 1, 6) as effect_size_rbc from z""")
def mann_whitney_u(spark, sf):
    u = compare.mann_whitney(long(spark, sf))
    return u.select("marker", "sample_1", "sample_2", "n_1", "n_2", r("u_statistic", 1), r("effect_size_rbc"))


# the normal tail as a midpoint sum of its density, as SQL has no error function;
# the step keeps the sum's own error under 1e-9
PAIRWISE = f"""{MWU}, zs as (select *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) as zz from z),
pv as (select marker, s1, s2, least(1.0, any_value(case when zz < 0 then 1.0 else 0.0 end)
   + 2 * sum(exp(-0.5 * power(greatest(zz, 0) + (i + 0.5) * 0.0002, 2)) * 0.0002 / sqrt(2 * pi()))) as p from zs, range(50000) t(i) group by 1, 2, 3),
k as (select *, row_number() over (partition by marker order by p, s1, s2) k from pv),
a as (select *, least(1.0, min(p * 3 / k) over (partition by marker order by k desc rows between unbounded preceding and current row)) as adj from k)"""


@query(f"""with {PAIRWISE} select marker, s1 || ' vs ' || s2 as sample_pair, round(p, 5) as pvalue, round(adj, 5) as adj_pvalue,
  case when adj < 0.001 then '***' when adj < 0.01 then '**' when adj < 0.05 then '*' else 'ns' end as significance from a""")
def compare_samples_pairwise(spark, sf):
    p = compare.pairwise_tests(long(spark, sf))
    return p.select("marker", "sample_pair", r("pvalue", 5), r("adj_pvalue", 5), "significance")


@query(f"""with {PAIRWISE} select marker, {', '.join(f"round(max(-log10(adj)) filter (s1 = '{x}' and s2 = '{y}'), 3) as " + f'"{x} vs {y}"' for x, y in ("AN", "AR", "NR"))} from a group by marker""")
def pairwise_matrix(spark, sf):
    pairs = ["A vs N", "A vs R", "N vs R"]
    return rounded(compare.pairwise_matrix(compare.pairwise_tests(long(spark, sf)), pairs), pairs, 3)


P_TABLE = """p as (select l_suppkey as test, l_returnflag as sample, round(avg(l_tax * l_discount) * 100, 6) as p
  from lineitem group by 1, 2)"""


@query(f"""with {P_TABLE}, a as (select *, row_number() over (partition by sample order by p, test) k, count(*) over (partition by sample) n from p),
b as (select *, least(1.0, min(p * n / k) over (partition by sample order by k desc rows between unbounded preceding and current row)) as q from a)
select test, sample, p, round(q, 6) as fdr, round(least(1.0, p * n), 6) as bonferroni,
  case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end as label from b""")
def bh_adjust(spark, sf):
    # summed as decimals: the last digit of p does not hang on the order of the rows, halves go up
    product = (F.col("l_tax") * F.col("l_discount")).cast("decimal(38,15)")
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("test"), F.col("l_returnflag").alias("sample")).agg(
        F.round(F.avg(product) * 100, 6).cast("double").alias("p"))
    a = compare.bh_adjust(p, "p", "fdr", ["sample"], ["test"])
    a = compare.bonferroni(a, "p", "bonferroni", ["sample"])
    return rounded(a, ["fdr", "bonferroni"]).withColumn("label", significance_label(F.col("p")))


# -- combinations --------------------------------------------------------------



def binary(spark, sf) -> DataFrame:
    t = matrix.thresholds_manual(spark, MARKERS, {"m1": 25, "m2": .05, "m3": .04, "m4": 950})
    return matrix.binarize(objects(spark, sf), MARKERS, t)




@query(f"""with {OBJECTS}, {BIN}, {COMBOS}
select array_to_string(list_transform(idx, lambda i: 'm' || (i + 1)), '+') as combination, len(idx)::int as degree,
  obs::bigint as observed_count, round(obs / n, 6) as observed_frequency,
  round(n * list_product(list_transform(idx, lambda i: f[i + 1])), 4) as expected_count from o, n where len(idx) >= 2""")
def combo_observed_expected(spark, sf):
    c = cooccur.combinations(binary(spark, sf), MARKERS)
    return c.select("combination", "degree", "observed_count", r("observed_frequency"), r("expected_count", 4))


@query(f"""with {OBJECTS}, {BIN}, {COMBOS}, c as (select idx, obs, n * list_product(list_transform(idx, lambda i: f[i + 1])) e from o, n where len(idx) >= 2)
select array_to_string(list_transform(idx, lambda i: 'm' || (i + 1)), '+') as combination,
  round(log2((obs + 1e-9) / (e + 1e-9)), 6) as x from c where obs >= 10 and len(idx) >= 3 and not list_contains(idx, 0)""")
def enrichment_axis(spark, sf):
    c = cooccur.combinations(binary(spark, sf), MARKERS).withColumn("fdr_pvalue", F.lit(1.0))
    c = cooccur.combination_filter(cooccur.enrichment_axes(c, "log2", min_count=10), 10, 3, without="m1")
    return c.select("combination", r("x"))


# Seventeen markers: bits of four columns.
BITS = {f"q{i}": ("l_quantity", 1, i) for i in range(6)} | {f"n{i}": ("l_linenumber", 1, i) for i in range(3)} | {
    f"d{i}": ("l_discount", 100, i) for i in range(4)} | {f"t{i}": ("l_tax", 100, i) for i in range(4)}


def _superset_sums() -> str:
    """One step per marker: a mask also counts for itself without that marker."""
    steps = [f"s0 as (select mask, count(*) as n from (select {' + '.join(f'((cast(round({c} * {k}) as bigint) >> {b}) & 1) * {1 << i}' for i, (c, k, b) in enumerate(BITS.values()))} as mask from lineitem) group by mask union all select {(1 << len(BITS)) - 1}, 0)"]
    for i in range(len(BITS)):
        steps.append(f"s{i + 1} as (select mask, sum(n) as n from (select mask, n from s{i} union all select mask - {1 << i}, n from s{i} where (mask >> {i}) & 1 = 1) group by mask)")
    return ", ".join(steps)


@query(f"""with {_superset_sums()}
select array_to_string(list_transform(list_filter(range({len(BITS)}), lambda i: (mask >> i) & 1 = 1), lambda i: [{', '.join(f"'{m}'" for m in BITS)}][i + 1]), '+') as combination,
  bit_count(mask)::int as degree, n::bigint as observed_count from s{len(BITS)} where bit_count(mask) >= 2""")
def combo_many_markers(spark, sf):
    """All degrees of seventeen markers."""
    li = table(spark, sf, "lineitem").select(*[F.getbit(F.round(F.col(c) * k).cast("bigint"), F.lit(b)).alias(m) for m, (c, k, b) in BITS.items()])
    return cooccur.combinations(li, list(BITS)).select("combination", "degree", "observed_count")


@query()
def combo_empirical_p(spark, sf):
    return cooccur.combination_statistics(binary(spark, sf), MARKERS).withColumn("markers", F.array_join("markers", ","))


@query()
def top_combinations(spark, sf):
    return cooccur.top_combinations(cooccur.combination_statistics(binary(spark, sf), MARKERS), 20).drop("markers")


REF = """t as (select 'm2' as target_marker, count(*) filter (b1) tp, count(*) filter (b0 and b1) dp, count(*) n, count(*) filter (b0) rp from b
 union all select 'm3', count(*) filter (b2), count(*) filter (b0 and b2), count(*), count(*) filter (b0) from b
 union all select 'm4', count(*) filter (b3), count(*) filter (b0 and b3), count(*), count(*) filter (b0) from b)"""


@query(f"""with {OBJECTS}, {BIN}, {REF} select 'm1' as reference_marker, target_marker, n as total, rp as reference_positive_count,
  tp as target_positive_count, dp as double_positive_count from t""")
def reference_enrichment_counts(spark, sf):
    return cooccur.reference_counts(binary(spark, sf), MARKERS, "m1")


@query(f"""with {OBJECTS}, {BIN}, {REF},
s as (select target_marker, x, lgamma(rp + 1.0) - lgamma(x + 1.0) - lgamma(rp - x + 1.0) + lgamma(n - rp + 1.0) - lgamma(tp - x + 1.0)
        - lgamma(n - rp - tp + x + 1.0) - lgamma(n + 1.0) + lgamma(tp + 1.0) + lgamma(n - tp + 1.0) as lp, dp, rp, tp, n
      from t, lateral (select unnest(range(greatest(0, tp - (n - rp)), least(rp, tp) + 1)) as x)),
f as (select target_marker, sum(exp(lp)) filter (lp <= o + 1e-7) as p, any_value(dp) dp, any_value(rp) rp, any_value(tp) tp, any_value(n) n
      from s join (select target_marker, lp as o from s where x = dp) using (target_marker) group by 1),
a as (select *, row_number() over (order by p) k from f),
q as (select *, least(1.0, min(p * 3 / k) over (order by k desc rows between unbounded preceding and current row)) q from a)
select 'm1' as reference_marker, target_marker, rp as reference_positive_count, dp as double_positive_count,
  round(dp / rp, 6) as fraction_among_reference, round(tp / n, 6) as background_rate, round((dp / rp) / (tp / n), 6) as enrichment_vs_all,
  round(p, 5) as pvalue, round(q, 5) as fdr_pvalue,
  case when q < 0.001 then '***' when q < 0.01 then '**' when q < 0.05 then '*' else 'ns' end as significance from q""")
def fisher_reference(spark, sf):
    e = cooccur.reference_enrichment(binary(spark, sf), MARKERS, "m1")
    e = rounded(e, ["fraction_among_reference", "background_rate", "enrichment_vs_all"])
    return rounded(e, ["pvalue", "fdr_pvalue"], 5)


# -- features and clusters -------------------------------------------------------

@query(f"""with {SPARSE}, m as (select {', '.join(f'quantile_cont({m}, 0.5) m_{m}' for m in L)} from sparse)
select object_id, {', '.join(f'round(coalesce({m}, m_{m}), 4) as {m}' for m in L)} from sparse, m""")
def median_impute(spark, sf):
    return rounded(matrix.median_imputed(sparse(spark, sf).select("object_id", *L), L), L, 4)


def _features(spark, sf) -> DataFrame:
    return learn.features(objects(spark, sf), {m: m for m in MARKERS})


@query()
def pca_coords(spark, sf):
    return learn.pca(_features(spark, sf), MARKERS, 2)[0]


@query(f"""with {OBJECTS}, c as (select corr(m1, m2) a, corr(m1, m3) b, corr(m1, m4) c, corr(m2, m3) d, corr(m2, m4) e, corr(m3, m4) f from objects)
select 4 as components, 1.0::double as total_ratio, round((4 + 2 * (a*a + b*b + c*c + d*d + e*e + f*f)) / 16, 8) as sum_squared_ratio from c""")
def pca_variance(spark, sf):
    """Explained ratios sum to 1 and their squares to the squared norm of the correlation matrix."""
    t = learn.pca(_features(spark, sf), MARKERS, 2)[1]
    e = F.col("explained_ratio")
    return t.agg(F.count("*").cast("int").alias("components"), F.round(F.max("cumulative_ratio"), 6).alias("total_ratio"),
                 F.round(F.sum(e * e), 8).alias("sum_squared_ratio"))


@query(f"""with {OBJECTS}, s as (select avg(m1) a1, avg(m2) a2, avg(m4) a4, stddev_pop(m1) s1, stddev_pop(m2) s2, stddev_pop(m4) s4 from objects)
select object_id, round(((m1 - a1) / s1) ** 2 + ((m2 - a2) / s2) ** 2 + ((m4 - a4) / s4) ** 2, 4) as squared_norm from objects, s""")
def pca_norms(spark, sf):
    """All components of the requested markers keep the length of every object's scaled vector."""
    f = _features(spark, sf)
    chosen = requested_markers(["m4", "m2", "none", "m1"], MARKERS, f.columns)
    coords, names = learn.space(f, chosen, "pca", len(chosen))
    return coords.select("object_id", F.round(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in names]), 4).alias("squared_norm"))


@query()
def kmeans_labels(spark, sf):
    labels, cost = learn.kmeans(_features(spark, sf), MARKERS, k=5)
    return labels.groupBy("cluster").agg(F.count("*").alias("objects"), F.lit(round(cost, 3)).alias("cost"))


@query()
def cluster_profile(spark, sf):
    f = _features(spark, sf)
    labelled, _ = learn.kmeans(f, MARKERS, k=5, keep=f.columns)
    return profile.group_profile(labelled, "cluster", MARKERS)


@query(f"with {OBJECTS} select object_id, m1, m2 from objects where sample in ('A', 'R')")
def prefixed_matrix(spark, sf):
    """The raw matrix of an enriched table for two of the samples, prefix stripped."""
    o = qc.only_samples(objects(spark, sf), ["A", "R"])
    e = o.select("object_id", F.col("m1").alias("raw__m1"), F.col("m2").alias("raw__m2"), F.col("m3").alias("bg__m3"))
    return tables.prefixed_matrix(e, "raw__")


@query(f"with {SPARSE} select sample, count(*) as objects, round(sum(coalesce(L3, 0)), 2) as l3 from sparse group by sample")
def first_matching_table(spark, sf):
    """The first of several candidate tables that has the columns of an object table."""
    from motes.schema import matches
    found = tables.first_matching([table(spark, sf, "orders"), sparse_objects(spark, sf)], matches)
    return found.groupBy("sample").agg(F.count("*").alias("objects"), F.round(F.sum(F.coalesce("L3_positive", F.lit(0.0))), 2).alias("l3"))
