"""The registered queries of the cell-analysis operators, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.arrow import map_arrow
from ..functions.storage import Workspace
from ..operators import cells as C
from ..operators import align, community, components, descent, expression, graph, images, layout, multimodal, patches, report, spatial, transfer, vectors
from ..sources import array_files, arrays, pyramids
from . import tables as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# Expression


@query(f"""with {D.VALUES_SQL}, grid as (select c.cell_id, c.cluster, g.gene from cells c, (select distinct gene from counts) g)
    select g.cluster, g.gene, count(*) as n_cells, round(sum(coalesce(value, 0)) / count(*), 6) as mean_log1p, round(median(coalesce(value, 0)), 6) as median_log1p,
      round(100.0::double * count(case when n > 0 then 1 end) / count(*), 6) as pct_positive, sum(coalesce(n, 0)) as raw_sum
    from grid g left join vals v on v.cell_id = g.cell_id and v.gene = g.gene group by 1, 2""")
def dotplot_cluster_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.cluster_gene(D.cells(spark, sf_dir), D.counts(spark, sf_dir))


@query(f"""with {D.VALUES_SQL} select c.cell_id, round(coalesce(max(value), 0), 6) as value from cells c
    left join vals v on v.cell_id = c.cell_id and v.gene = 'Brand#13' group by 1""")
def gene_expression_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = D.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.min("p_partkey").alias("gene_idx"))
    return expression.gene_per_cell(D.cells(spark, sf_dir), D.counts(spark, sf_dir), genes, "brand#13")


@query(f"""with {D.VALUES_SQL}, n as (select count(*) as n from cells), s as (select gene, sum(value) as s, sum(value * value) as ss from vals group by 1)
    select gene, round(s / n, 6) as mean, round(greatest(sqrt(greatest(ss / n - (s / n) * (s / n), 1e-12)), 1e-6), 6) as std from s, n""")
def gene_scaling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = expression.scaling(D.cells(spark, sf_dir), D.counts(spark, sf_dir))
    return stats.select("gene", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""with {D.VALUES_SQL}, k as (select count(*) as k from cells), s as (select gene, sum(value) / max(k) as mean, sum(value * value) / max(k) as m2 from vals, k group by 1),
    st as (select gene, mean, greatest(sqrt(greatest(m2 - mean * mean, 1e-12)), 1e-6) as std from s)
    select cell_id, gene, round(greatest(least((value - mean) / std, 10), -10) - greatest(least(-mean / std, 10), -10), 5) as score from vals join st using (gene)""")
def shifted_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, counts = D.cells(spark, sf_dir), D.counts(spark, sf_dir)
    values = expression.normalised(counts, expression.libraries(cells, counts))
    return expression.shifted_scores(values, expression.scaling(cells, counts)).select("cell_id", "gene", F.round("score", 5).alias("score"))


@query(f"""with {D.CELLS_SQL}, {D.COUNTS_SQL}, used as (select cell_id, cluster, row_number() over (partition by cluster order by (cell_id * 2654435761) % 1000003, cell_id) as k from cells)
    select cluster, gene, sum(n) as n from counts join used using (cell_id) where k <= 25000 group by 1, 2""")
def label_count_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [S.hashed_order(F.col("cell_id")), F.col("cell_id")]
    return expression.label_sums(D.cells(spark, sf_dir), D.counts(spark, sf_dir), "cluster", 25_000, order)


@query("""with w as (select p_brand, sum(case when p_type = 'SMALL' then p_size end) as small, sum(case when p_type = 'ECONOMY' then p_size end) as economy from part group by 1)
    select p_brand, gene, coalesce(n, 0)::bigint as n from (select p_brand, unnest(['small', 'economy']) as gene, unnest([small, economy]) as n from w)""")
def wide_to_long_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda t: F.coalesce(F.sum(F.when(F.col("p_type") == t, F.col("p_size"))), F.lit(0)).cast("long")
    wide = D.table(spark, sf_dir, "part").groupBy("p_brand").agg(size("SMALL").alias("small"), size("ECONOMY").alias("economy"))
    return expression.wide_to_long(wide, "p_brand")


# Cells


@query(f"""with {D.MEASURED_SQL}, q as (select sample_id, quantile_cont(area, 0.01) as lo, quantile_cont(area, 0.99) as hi from measured group by 1),
    f as (select *, case when total > 0 then control / total else 0 end as cf from measured)
    select cell_id, sample_id, transcripts, round(cf, 6) as control_fraction from f join q using (sample_id) where transcripts >= 20 and cf <= 0.002 and area >= lo and area <= hi""")
def qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = C.quality_control(D.measured(spark, sf_dir), 20, 0.002, 0.01, 0.99)
    return passed.select("cell_id", "sample_id", "transcripts", F.round("control_fraction", 6).alias("control_fraction"))


@query(f"""with {D.POINTS_SQL}, p as (select cell_id, x / 2.5 as x_px, y / 2.5 as y_px from points)
    select cell_id, round(x_px, 6) as x_px, round(y_px, 6) as y_px from p where x_px >= 28 and y_px >= 28 and x_px < 1900 - 28 and y_px < 1700 - 28""")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = C.pixel_position(D.points(spark, sf_dir), F.lit(2.5), "x", "y")
    return C.inside_edges(placed, F.lit(1900), F.lit(1700), 224, 4).select("cell_id", F.round("x_px", 6).alias("x_px"), F.round("y_px", 6).alias("y_px"))


_RETENTION_SQL = """with r as (select d.doc_id, d.source, d.n_chars, coalesce(l.quality = 1 and l.toxic = 1, false) as confirmed, d.n_chars >= 1500 as passes from documents d left join labels l using (doc_id)),
    t as (select *, case when confirmed and passes then 'confirmed_and_count' when confirmed then 'confirmed' when passes then 'count' else 'dropped' end as retention_reason from r)"""


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    flags = D.table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("sure"))
    return C.with_retention(rows.join(flags, "doc_id", "left"), F.col("sure"), F.col("n_chars").cast("double"), 1500).drop("sure")


@query(f"{_RETENTION_SQL} select doc_id, source, n_chars, confirmed, passes, retention_reason from t where confirmed or passes")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retained(_retention(spark, sf_dir))


@query(f"{_RETENTION_SQL} select doc_id, source, n_chars, confirmed, passes, retention_reason from t where not (confirmed or passes)")
def retention_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dropped(_retention(spark, sf_dir))


@query(f"""{_RETENTION_SQL} select source, {', '.join(f"count(case when retention_reason = '{r}' then 1 end) as n_{r}" for r in ('confirmed', 'confirmed_and_count', 'count', 'dropped'))} from t group by 1""")
def retention_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.crosstab(_retention(spark, sf_dir), "source", "retention_reason", ["confirmed", "confirmed_and_count", "count", "dropped"], "n_")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as vertex_id, value as x from events")
def vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.table(spark, sf_dir, "events")
    return C.vertex_ids(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "vertex_id", F.col("value").alias("x"))


@query("select user_id, round(avg(value), 6) as x_centroid, round(avg((event_id % 97)::double), 6) as y_centroid, count(*) as n_boundary_vertices from events group by 1")
def boundary_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.table(spark, sf_dir, "events").select("user_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    out = C.centroids(events, ["user_id"], "x", "y")
    return out.select("user_id", F.round("x_centroid", 6).alias("x_centroid"), F.round("y_centroid", 6).alias("y_centroid"), "n_boundary_vertices")


@query("""select p_partkey as gene_idx, case when k > 0 then p_name || '_' || k else p_name end as gene
    from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as k from part)""")
def make_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_idx"), "p_name")
    return part.withColumn("gene", S.unique_names("p_name", "gene_idx")).drop("p_name")


@query(f"""with {D.MEASURED_SQL} select cell_id, sample_id, transcripts from (select *, row_number() over (partition by sample_id order by (transcripts < 20) desc, (cell_id * 2654435761) % 1000003, cell_id) as k from measured)
    where transcripts < 20 or k <= 1200""")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [S.hashed_order(F.col("cell_id")), F.col("cell_id")]
    return C.stratified_cap(D.measured(spark, sf_dir), "sample_id", F.col("transcripts") < 20, order, 1200).select("cell_id", "sample_id", "transcripts")


@query(f"""with {D.CELLS_SQL} select cell_id, cluster, k - 1 as grid_index from (select cell_id, cluster, row_number() over (partition by cluster order by (cell_id * 2654435761) % 1000003, cell_id) as k from cells) where k <= 20""")
def sample_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [S.hashed_order(F.col("cell_id")), F.col("cell_id")]
    out = C.sample_per_group(D.cells(spark, sf_dir), ["cluster"], order, 20, "grid_index")
    return out.select("cell_id", "cluster", F.col("grid_index").cast("long").alias("grid_index"))


@query(f"""with {D.CELLS_SQL} select sample_id, case when (cell_id * 2654435761 + 17) % 1000003 < 800002 then 'train' else 'validation' end as part, count(*) as n from cells group by 1, 2""")
def train_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sizes(C.split(D.cells(spark, sf_dir), F.col("cell_id"), 0.8), "sample_id", "part")


@query("""select part, count(*) as n from (select case when row_number() over (order by o_orderkey) <= greatest(1, floor(0.8::double * count(*) over ())) then 'train' else 'validation' end as part from orders) group by 1""")
def exact_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_split(D.cells(spark, sf_dir), [F.col("cell_id")], 0.8).groupBy("part").agg(F.count("*").alias("n"))


@query(f"""with {D.CELLS_SQL} select cell_id, row_number() over (order by area, cell_id) - 1 as source_row_index from cells""")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.row_index(D.cells(spark, sf_dir), ["area", "cell_id"]).select("cell_id", "source_row_index")


@query(f"""with {D.CELLS_SQL} select cell_id, left(cluster, 1) as parent from cells""")
def mapped_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = D.cells(spark, sf_dir)
    pairs = cells.select("cluster", F.left("cluster", F.lit(1)).alias("coarse")).distinct()
    return C.mapped(cells, "cluster", pairs, "cluster", "coarse", "parent").select("cell_id", "parent")


@query("""select c_custkey, c_nationkey, n_name from customer join nation on c_nationkey = n_nationkey""")
def joined_when_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    right = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return C.joined_if_complete(left, right, ["c_nationkey"])


@query("""select c_custkey from customer where c_custkey in (select o_custkey from orders)""")
def present_in_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.present_in(D.table(spark, sf_dir, "customer"), ["c_custkey"], ordered).select("c_custkey")


# Reports


@query(f"with {D.CELLS_SQL} select cluster, count(*) as n from cells group by 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sizes(D.cells(spark, sf_dir), "cluster").orderBy(F.desc("n"), "cluster")


_SAMPLES = ["F", "O", "P"]


@query(f"""with {D.CELLS_SQL} select cluster, {', '.join(f"count(case when sample_id = '{s}' then 1 end) as {s}" for s in _SAMPLES)} from cells group by 1""")
def cluster_by_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.crosstab(D.cells(spark, sf_dir), "cluster", "sample_id", _SAMPLES)


@query(f"""with {D.CELLS_SQL} select cluster, {', '.join(f"round(100.0::double * count(case when sample_id = '{s}' then 1 end) / count(*), 6) as {s}" for s in _SAMPLES)} from cells group by 1""")
def cluster_by_sample_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.row_percent(report.crosstab(D.cells(spark, sf_dir), "cluster", "sample_id", _SAMPLES), _SAMPLES)


_STATS_SQL = "round(avg(transcripts), 6) as mean, round(median(transcripts), 6) as median, round(stddev_samp(transcripts), 6) as std, count(transcripts) as n from measured"
_BIN_SQL = "case when transcripts <= 4 then '0-4' when transcripts <= 9 then '5-9' when transcripts <= 29 then '10-29' when transcripts <= 99 then '30-99' else '>=100' end"


@query(f"with {D.MEASURED_SQL} select cluster, {_STATS_SQL} group by 1")
def multi_stats_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.statistics(D.measured(spark, sf_dir), ["cluster"], "transcripts")


@query(f"with {D.MEASURED_SQL} select {_BIN_SQL} as bin, {_STATS_SQL} group by 1")
def stats_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.statistics(D.measured(spark, sf_dir).withColumn("bin", S.count_bin(F.col("transcripts"))), ["bin"], "transcripts")


@query(f"with {D.MEASURED_SQL} select sample_id, {_BIN_SQL} as bin, {_STATS_SQL} group by 1, 2")
def stats_by_sample_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.statistics(D.measured(spark, sf_dir).withColumn("bin", S.count_bin(F.col("transcripts"))), ["sample_id", "bin"], "transcripts")


@query(f"""with {D.MEASURED_SQL} select sample_id, count(transcripts) as n, round(min(transcripts), 6) as least, round(quantile_cont(transcripts, 0.01), 6) as q01, round(quantile_cont(transcripts, 0.05), 6) as q05,
    round(quantile_cont(transcripts, 0.25), 6) as q25, round(median(transcripts), 6) as median, round(avg(transcripts), 6) as mean, round(max(transcripts), 6) as most,
    count(case when transcripts < 20 then 1 end) as n_low, round(avg((transcripts < 20)::int::double), 6) as fraction_low from measured group by 1""")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distribution(D.measured(spark, sf_dir), ["sample_id"], "transcripts")


@query(f"with {D.CELLS_SQL}, {D.COUNTS_SQL}, s as (select cluster, gene, sum(n) as n from counts join cells using (cell_id) group by 1, 2) select cluster, gene, n, rank() over (partition by gene order by n desc) as rank from s")
def marker_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = D.counts(spark, sf_dir).join(D.cells(spark, sf_dir).select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene").agg(F.sum("n").alias("n"))
    return report.rank_descending(sums, "n", "rank", ["gene"])


_FRACTION_SQL = f"with {D.CELLS_SQL}, n as (select cluster, sample_id, count(*) as n from cells group by 1, 2), f as (select cluster, sample_id, n, (sum(n) over (partition by cluster))::bigint as total, round(n / sum(n) over (partition by cluster), 6) as fraction from n)"


@query(f"{_FRACTION_SQL} select cluster, sample_id, n, total, fraction from (select *, row_number() over (partition by cluster order by n desc, sample_id) as k from f) where k = 1")
def cluster_majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.majority(D.cells(spark, sf_dir), "cluster", "sample_id")


@query(f"{_FRACTION_SQL} select * from f")
def label_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.fractions(D.cells(spark, sf_dir), "cluster", "sample_id")


@query("""select label, count(*) as n, round(median(embedding[1]::double), 6) as x, round(median(embedding[2]::double), 6) as y, row_number() over (order by count(*) desc, label) as number from embeddings group by 1""")
def legend_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return report.numbered_labels(rows, "label", "x", "y")


@query(f"""with {D.CELLS_SQL}, n as (select cluster, count(*) as n from cells group by 1)
    select cluster as image_cluster, n as n_cells, '' as lobulated_neutrophil_morphology, '' as confirmed_neutrophil, '' as reviewer, '' as review_notes from n""")
def review_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.review_template(report.sizes(D.cells(spark, sf_dir), "cluster"))


@query("""select label, row_number() over (order by case when regexp_matches(label, '^[0-9]+$') then 0 else 1 end, try_cast(label as bigint), label) - 1 as place
    from (select distinct case when p_size % 3 = 0 then p_brand else p_size::varchar end as label from part)""")
def natural_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return report.positions(D.table(spark, sf_dir, "part").select(label.alias("label")), "label", "place")


@query("""with n as (select p_size as resolution, count(distinct p_brand) as n_clusters from part group by 1) select resolution, n_clusters from n order by abs(n_clusters - 12), resolution limit 1""")
def resolution_scan_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = D.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("resolution")).agg(F.countDistinct("p_brand").alias("n_clusters"))
    return report.closest_to_target(scanned, "n_clusters", 12, "resolution")


@query(f"""with {D.CELLS_SQL}, n as (select cluster as a, sample_id as b, count(*)::double as n from cells group by 1, 2), t as (select sum(n) as t from n),
    r as (select a, sum(n) as ra from n group by 1), c as (select b, sum(n) as cb from n group by 1),
    s as (select (select sum(n * (n - 1) / 2) from n) as ab, (select sum(ra * (ra - 1) / 2) from r) as pa, (select sum(cb * (cb - 1) / 2) from c) as pb,
      (select -sum(ra / t * ln(ra / t)) from r, t) as ha, (select -sum(cb / t * ln(cb / t)) from c, t) as hb,
      (select sum(n / t * ln(n * t / (ra * cb))) from n join r using (a) join c using (b), t) as mi, (select t from t) as t)
    select round((ab - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) as ari, round(mi / ((ha + hb) / 2), 6) as nmi from s""")
def ari_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.agreement(D.cells(spark, sf_dir), "cluster", "sample_id")


@query("""select event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as k_sum, max((props->>'$.k')::bigint) as k_max from events group by 1""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return D.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


# Vectors


@query("""select vec_id, 0::bigint as n_bad, sqrt(list_sum(list_transform(e, lambda x: x * x))) <= 1e-12 as zero_norm, list_min(e) = list_max(e) as zero_variance,
    round(e[1] / greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-8), 6) as first from (select vec_id, embedding::double[] as e from embeddings)""")
def l2_normalize_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.normalised_with_checks(D.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", "n_bad", "zero_norm", "zero_variance", F.round(F.col("embedding")[0], 6).alias("first"))


@query("""with x as (select unnest(range(0, 64)) as dim, unnest(embedding::double[]) as x from embeddings), v as (select dim, var_pop(x) as variance from x group by 1)
    select dim::int as dim, round(variance, 6) as variance, rank from (select *, row_number() over (order by variance desc, dim desc) as rank from v) where rank <= 10""")
def dims_by_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vectors.top_dimensions(vectors.dimension_variances(D.table(spark, sf_dir, "embeddings"), "embedding"), 10)
    return top.select("dim", F.round("variance", 6).alias("variance"), "rank")


@query(f"""with {D.HALVES_SQL}, m as (select vec_id, list_transform(range(1, 33), lambda i: (rna[i] + image[i]) / 2) as m from halves)
    select vec_id, round(m[1] / greatest(sqrt(list_sum(list_transform(m, lambda x: x * x))), 1e-8), 6) as first, round(m[32] / greatest(sqrt(list_sum(list_transform(m, lambda x: x * x))), 1e-8), 6) as last from m""")
def fused_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = D.halves(spark, sf_dir).select("vec_id", S.mean_vector(F.col("rna"), F.col("image")).alias("f"))
    return fused.select("vec_id", F.round(F.col("f")[0], 6).alias("first"), F.round(F.col("f")[31], 6).alias("last"))


_KNN_SQL = """e as (select vec_id, label, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as l from embeddings),
    d as (select a.vec_id as src, b.vec_id as dst, 1 - list_dot_product(a.v, b.v) / (a.l * b.l) as distance from e a join e b on a.vec_id <> b.vec_id),
    knn as (select src, dst, distance, row_number() over (partition by src order by round(distance, 9), dst) as rank from d qualify rank <= 15)"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_neighbours(D.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 15)


@query(f"with {_KNN_SQL} select src, dst, rank, round(distance, 6) as distance from knn")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("src", "dst", "rank", F.round("distance", 6).alias("distance"))


@query(f"""with {_KNN_SQL}, o as (select avg((a.label = b.label)::int::double) as observed from knn join e a on a.vec_id = src join e b on b.vec_id = dst),
    x as (select sum(p * p) as expected from (select count(*) / (sum(count(*)) over ())::double as p from e group by label))
    select round(observed, 6) as observed, round(expected, 6) as expected, round(observed - expected, 6) as excess, round(observed / expected, 6) as ratio from o, x""")
def sample_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sample_effect(_knn(spark, sf_dir), D.table(spark, sf_dir, "embeddings"), "vec_id", "label")


@query("""select unnest(['incremental', 'randomised']) as method, count(*) as n_rows, true as shares_are_near, true as basis_is_unit, true as mean_is_zero from embeddings""")
def components_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two ways to 10 components: rows, whether their shares of the variance add up to nearly those of the exact ones, whether they are a basis of unit
    length, and whether scores have mean 0."""
    rows = D.halves(spark, sf_dir)
    _, _, shares = vectors.principal_components(rows, "embedding", 10)
    out = None
    for method, (mean, parts, share) in {"incremental": components.incremental_fit(rows, "embedding", 10).components(10), "randomised": components.randomised_components(rows, "embedding", 10)}.items():
        basis = bool(abs(parts @ parts.T - np.eye(len(parts))).max() < 1e-9)
        scores = vectors.project(rows, "embedding", mean, parts).select(F.posexplode("scores").alias("d", "x"), "vec_id")
        sums = scores.groupBy("d").agg(F.avg("x").alias("m"), F.countDistinct("vec_id").alias("n"))
        row = sums.agg(F.max("n").alias("n_rows"), (F.max(F.abs("m")) < 1e-9).alias("mean_is_zero"))
        row = row.select(F.lit(method).alias("method"), "n_rows", F.lit(bool(share.sum() > 0.98 * shares.sum())).alias("shares_are_near"), F.lit(basis).alias("basis_is_unit"), "mean_is_zero")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def knn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.approximate_neighbours(D.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 15)


@query("""select count(*) as n_rows, 15 * count(*) as n_pairs, true as recall_is_enough, 0::bigint as n_wrong_distances from embeddings""")
def knn_descent_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the approximate lists: rows, pairs, whether they hold nine tenths of the exact ones, and pairs whose distance isn't the exact one."""
    e = D.table(spark, sf_dir, "embeddings")
    found = Workspace(spark, "checked").save(descent.approximate_neighbours(e, "vec_id", "embedding", 15))
    a, b = e.select(F.col("vec_id").alias("src"), F.col("embedding").alias("a")), e.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("b"))
    wrong = F.abs(1 - S.cosine(F.col("a"), F.col("b")) - F.col("distance")) > 1e-9
    totals = found.join(a, "src").join(b, "dst").agg(F.countDistinct("src").alias("n_rows"), F.count("*").alias("n_pairs"), F.count(F.when(wrong, 1)).alias("n_wrong_distances"))
    share = descent.recall(found, _knn(spark, sf_dir)).scalar()
    return totals.select("n_rows", "n_pairs", (share >= 0.9).alias("recall_is_enough"), "n_wrong_distances")


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.halves(spark, sf_dir)
    mean, parts, _ = vectors.principal_components(rows, "embedding", 10)
    scores = vectors.project(rows, "embedding", mean, parts).select("vec_id", "scores")
    return scores.select("vec_id", *(F.round(F.col("scores")[i], 6).alias(f"pc{i + 1}") for i in range(10)))


@query()
def svd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.halves(spark, sf_dir)
    mean, parts, _ = vectors.principal_components(rows, "embedding", 8, centred=False)
    scores = vectors.project(rows, "embedding", mean, parts, normalise=True).select("vec_id", "scores")
    return scores.select("vec_id", *(F.round(F.col("scores")[i], 6).alias(f"sv{i + 1}") for i in range(8)))


@query()
def harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multimodal.harmonised(D.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query()
def wnn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, _ = multimodal.modality_weights(D.halves(spark, sf_dir), "vec_id", "rna", "image", 30)
    return weights.select("vec_id", F.round("w1", 6).alias("w_rna"), F.round("w2", 6).alias("w_image"))


@query()
def wnn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = multimodal.weighted_neighbours(D.halves(spark, sf_dir), "vec_id", "rna", "image")
    return edges.select("src", "dst", "rank", F.round("w", 6).alias("w"))


@query("""select count(*) as n_rows, 0::bigint as n_unbalanced, 30 * count(*) as n_edges, 0::bigint as n_loops, 0::bigint as n_out_of_order from embeddings""")
def wnn_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of weighted neighbours: rows, those whose weights don't add up to 1 or leave 0 to 1, edges, loops, and edges that are stronger than one of lower
    rank."""
    rows = D.halves(spark, sf_dir)
    weights, edges = multimodal.weights_and_neighbours(rows, "vec_id", "rna", "image")
    fine = (F.abs(F.col("w1") + F.col("w2") - 1) < 1e-9) & F.col("w1").between(0, 1) & F.col("w2").between(0, 1)
    before = F.lag("w").over(Window.partitionBy("src").orderBy("rank"))
    found = edges.withColumn("before", before).agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("n_loops"), F.count(F.when(F.col("w") > F.col("before") + 1e-8, 1)).alias("n_out_of_order"))
    one = weights.agg(F.count("*").alias("n_rows"), F.count(F.when(~fine, 1)).alias("n_unbalanced"))
    both = one.unionByName(found, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in ("n_rows", "n_unbalanced", "n_edges", "n_loops", "n_out_of_order")))


@query("""select count(*) as n_rows, 0::bigint as n_not_unit, true as batches_are_no_further from embeddings""")
def harmony_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of corrected vectors: rows, those whose length isn't 1, and whether the batches' mean vectors lie no further apart than before."""
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", S.l2_normalised(F.col("embedding")).alias("embedding"))
    after = Workspace(spark, "checked").save(multimodal.harmonised(e, "vec_id", "embedding", "label").select("vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id"))

    def spread(rows: DataFrame) -> DataFrame:
        means = rows.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
        return means.groupBy("d").agg(F.var_pop("m").alias("v")).agg(F.sum("v").alias("v"))

    off = F.count(F.when(F.abs(S.norm(F.col("embedding")) - 1) > 1e-6, 1)).alias("n_not_unit")
    return after.agg(F.count("*").alias("n_rows"), off).select("n_rows", "n_not_unit", (spread(after).scalar() <= spread(e).scalar()).alias("batches_are_no_further"))


# Alignment: the halves as image and gene sides, batches of 64


_BATCH_SQL = f"""{D.HALVES_SQL}, u as (select vec_id, vec_id // 64 as batch, list_transform(image, lambda x: x / greatest(sqrt(list_sum(list_transform(image, lambda y: y * y))), 1e-8)) as i,
      list_transform(rna, lambda x: x / greatest(sqrt(list_sum(list_transform(rna, lambda y: y * y))), 1e-8)) as g from halves),
    p as (select a.batch, a.vec_id as i, b.vec_id as j, list_dot_product(a.g, b.g) as gg, list_dot_product(a.i, b.i) as ii, list_dot_product(a.i, b.g) / 0.1 as s from u a join u b using (batch)),
    t as (select batch, i, j, exp((gg + ii) / 2 / 0.1) / sum(exp((gg + ii) / 2 / 0.1)) over (partition by i) as target, s - ln(sum(exp(s)) over (partition by i)) as p, s - ln(sum(exp(s)) over (partition by batch, j)) as q from p)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.halves(spark, sf_dir).withColumn("batch", F.expr("vec_id div 64"))


@query(f"with {_BATCH_SQL} select batch, i, j, round(target, 6) as target from t")
def contrastive_target_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = align.target_table(_batches(spark, sf_dir), "vec_id", "batch", "image", "rna")
    return targets.select("batch", "i", "j", F.round("target", 6).alias("target"))


@query(f"with {_BATCH_SQL} select batch, count(distinct i) as n, round(-sum(target * (p + q)) / (2 * count(distinct i)), 6) as loss from t group by 1")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batches(spark, sf_dir)
    losses = align.loss_table(rows, "vec_id", "batch", "image", "rna", 0.1, align.target_table(rows, "vec_id", "batch", "image", "rna"))
    return losses.select("batch", "n", F.round("loss", 6).alias("loss"))


@query(f"with {_BATCH_SQL} select batch, count(*) as n, round(-sum(p + q) / (2 * count(*)), 6) as loss from t where i = j group by 1")
def infonce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.loss_table(_batches(spark, sf_dir), "vec_id", "batch", "image", "rna").select("batch", "n", F.round("loss", 6).alias("loss"))


# Space


@query(f"""with {D.POINTS_SQL} select a.cell_id, count(*) as n_near from points a join points b on a.sample_id = b.sample_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000 group by 1""")
def radius_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_counts(D.points(spark, sf_dir), "cell_id", "x", "y", 100.0, "sample_id")


_CENTRES_SQL = "centres as (select sample_id, cell_id as target_id, x, y from points where cell_id % 37 = 0)"


@query(f"""with {D.POINTS_SQL}, {_CENTRES_SQL}, d as (select p.cell_id, t.target_id, round((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y), 9) as d2 from points p join centres t using (sample_id))
    select cell_id, target_id, round(sqrt(d2), 6) as distance from (select *, row_number() over (partition by cell_id order by d2, target_id) as k from d) where k = 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.points(spark, sf_dir)
    targets = points.where("cell_id % 37 = 0").withColumnRenamed("cell_id", "target_id")  # the boundary cells of this query
    return spatial.nearest(points, targets, "cell_id", "target_id", "x", "y", 100.0, "sample_id").select("cell_id", "target_id", F.round("distance", 6).alias("distance"))


@query(f"""with {D.POINTS_SQL}, n as (select a.cell_id, a.sample_id, a.x, a.y, count(*) as n_near from points a join points b on a.sample_id = b.sample_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 40000 group by 1, 2, 3, 4),
    f as (select * from (select *, row_number() over (partition by sample_id order by n_near desc, cell_id desc) as k from n) where k = 1),
    s as (select n.*, row_number() over (partition by n.sample_id order by n.n_near desc, n.cell_id desc) as k2 from n join f using (sample_id) where (n.x - f.x) * (n.x - f.x) + (n.y - f.y) * (n.y - f.y) > 160000)
    select sample_id, 1::bigint as pick, cell_id, n_near from f union all select sample_id, 2::bigint, cell_id, n_near from s where k2 = 1""")
def dense_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = spatial.densest(D.points(spark, sf_dir), "cell_id", "x", "y", 200.0, "sample_id")
    return spatial.spread_out(density, "cell_id", "x", "y", "n_near", 400.0, 2, "sample_id").select("sample_id", "pick", "cell_id", "n_near")


# Graphs


_EDGES_SQL = f"{_KNN_SQL}, edges as (select src, dst, round(1 - distance, 9) as w from knn), second_edges as (select src, dst, round(1 - distance, 9) as w from knn where rank <= 7)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(_knn(spark, sf_dir))


def _weighted(knn: DataFrame) -> DataFrame:
    return knn.select("src", "dst", F.round(1 - F.col("distance"), 9).alias("w"))


def _both_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges to 15 neighbours and to the nearest 7 of them, of one search."""
    knn = _knn(spark, sf_dir)
    return _weighted(knn), _weighted(knn.where("rank <= 7"))


@query(f"with {_EDGES_SQL} select src, dst, round(sum(w) / 2, 6) as w from (select src, dst, w from edges union all select dst, src, w from edges) group by 1, 2 having sum(w) <> 0")
def graph_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetrised(_edges(spark, sf_dir)).select("src", "dst", F.round("w", 6).alias("w"))


@query(f"with {_EDGES_SQL} select src, dst, round(sum(w) / 2, 6) as w from (select src, dst, w from edges union all select src, dst, w from second_edges) group by 1, 2 having sum(w) <> 0")
def graph_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fused(*_both_edges(spark, sf_dir)).select("src", "dst", F.round("w", 6).alias("w"))


@query(f"""with {_EDGES_SQL}, s as (select src, dst, sum(w) / 2 as w from (select src, dst, w from edges union all select dst, src, w from edges) group by 1, 2),
    g as (select vec_id, count(s.src)::double as d from e left join s on s.src = vec_id group by 1)
    select (select count(*) from s) as n_edges, round(min(d), 6) as degree_min, round(median(d), 6) as degree_median, round(quantile_cont(d, 0.99), 6) as degree_p99, round(max(d), 6) as degree_max,
      (select round(min(w), 6) from s) as weight_min, (select round(median(w), 6) from s) as weight_median, (select round(quantile_cont(w, 0.99), 6) from s) as weight_p99, (select round(max(w), 6) from s) as weight_max from g""")
def graph_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sanity(graph.symmetrised(_edges(spark, sf_dir)), D.table(spark, sf_dir, "embeddings"), "vec_id")


@query(f"""with {_EDGES_SQL}, bad as (select src, dst, case when dst % 5 = 0 then w * 3 else w end as w from edges), p as (select src, dst from second_edges union select dst, src from second_edges),
    flag as (select (select max(d) from (select count(*) as d from bad group by src)) > 500 or (select max(w) from bad) > 1.000001 as broken),
    i as (select src, dst, greatest(least(w, 1), 0) as w from bad semi join p using (src, dst) where w > 0), m as (select src, dst, max(w) as w from (select * from i union all select dst, src, w from i) group by 1, 2)
    select src, dst, round(w, 6) as w from m, flag where broken union all select src, dst, round(w, 6) from bad, flag where not broken""")
def graph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, second = _both_edges(spark, sf_dir)
    bad = edges.withColumn("w", F.when(F.col("dst") % 5 == 0, F.col("w") * 3).otherwise(F.col("w")))
    return graph.repaired(bad, second, 15).select("src", "dst", F.round("w", 6).alias("w"))


@query(f"""with {_EDGES_SQL}, t as (select * from edges where src % 4 <> 0), x as (select *, row_number() over (partition by src order by w desc, dst desc) as k from edges where src <> dst and src not in (select src from t))
    select src, dst, round(greatest(1e-6, 1 - w), 6) as w from x where k <= 15""")
def fallback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.fallback_distances(edges, edges.where("src % 4 <> 0"), D.table(spark, sf_dir, "embeddings"), "vec_id", 15).select("src", "dst", F.round("w", 6).alias("w"))


_FUZZY_SQL = f"""with recursive {_KNN_SQL}, n as (select src, list(distance) as d, coalesce(min(case when distance > 0 then distance end), 0.0) as rho, avg(distance) as mean from knn group by 1),
    halving as (select src, d, rho, mean, 0 as step, 0.0::double as lo, 1e300::double as hi, 1.0::double as mid from n union all
      select src, d, rho, mean, step + 1, case when over then lo else mid end, case when over then mid else hi end,
        case when (case when over then mid else hi end) >= 1e300 then mid * 2 else ((case when over then lo else mid end) + (case when over then mid else hi end)) / 2 end
      from (select *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) > log2(15) as over from halving where step < 64)),
    s as (select src, rho, greatest(mid, 1e-3 * mean, 1e-12) as sigma from halving where step = 64),
    f as (select src, dst, exp(-greatest(distance - rho, 0) / sigma) as w from knn join s using (src)),
    b as (select src, dst, max(w) as w, max(v) as v from (select src, dst, w, 0.0::double as v from f union all select dst, src, 0.0, w from f) group by 1, 2)
    select src, dst, round(w + v - w * v, 6) as w from b where w + v - w * v > 0"""


@query(_FUZZY_SQL)
def fuzzy_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fuzzy(_knn(spark, sf_dir), 15).select("src", "dst", F.round("w", 6).alias("w"))


@query()
def leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.table(spark, sf_dir, "embeddings").select("vec_id")
    return community.numbered(community.communities(graph.symmetrised(_edges(spark, sf_dir)), nodes, "vec_id"))


@query()
def resolution_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.table(spark, sf_dir, "embeddings").select("vec_id")
    return community.scan(graph.symmetrised(_edges(spark, sf_dir)), nodes, "vec_id", community.resolutions(0.4, 3.0, 0.2), 40)[0]


@query("""select unnest([0.4, 0.8, 1.2, 1.6, 2.0])::double as resolution, count(*) as n_nodes, 0::bigint as n_misnamed, true as as_good_as_one from embeddings""")
def resolution_scan_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each resolution's partition: nodes, communities that aren't named by their smallest node, and whether its modularity is no less than
    that of one community and of 0."""
    grid = community.resolutions(0.4, 2.1, 0.4)
    nodes, edges = D.table(spark, sf_dir, "embeddings").select("vec_id"), Workspace(spark, "checked").save(graph.symmetrised(_edges(spark, sf_dir)))
    found = Workspace(spark, "checked").save(community.partitions(edges, nodes, "vec_id", grid))
    names = found.groupBy("r", "community").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    names = names.groupBy("r").agg(F.sum("n").alias("n_nodes"), F.count(F.when(F.col("least") != F.col("community"), 1)).alias("n_misnamed"))
    a, b = found.toDF("r", "src", "ca"), found.toDF("r", "dst", "cb")
    tagged = edges.join(a, "src").join(b, ["r", "dst"]).groupBy("r", "ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    sums = tagged.groupBy("r").agg(F.sum("k").alias("k"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    resolution = F.element_at(F.array(*(F.lit(g) for g in grid)), F.col("r") + 1)
    score = F.col("inside") / F.col("k") - resolution * F.col("k2") / F.col("k") ** 2
    return names.join(sums, "r").select(resolution.alias("resolution"), "n_nodes", "n_misnamed", (score > F.greatest(1 - resolution, F.lit(0.0)) - 1e-9).alias("as_good_as_one"))


@query("""select count(*) as n_nodes, count(*) as n_placed, true as edges_are_short from embeddings""")
def layout_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a layout: nodes, those with finite places, and whether edges are shorter, by a tenth at least, than what lies between a
    node and the next by number."""
    edges, nodes = graph.symmetrised(_edges(spark, sf_dir)), D.table(spark, sf_dir, "embeddings").select("vec_id")
    at = Workspace(spark, "checked").save(layout.graph_layout(edges, nodes, "vec_id", rounds=8, steps=20, chunk=1 << 12))
    a, b = at.toDF("src", "x1", "y1"), at.toDF("dst", "x2", "y2")
    gap = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    mean = lambda pairs: pairs.join(a, "src").join(b, "dst").agg(F.avg(gap)).scalar()
    others = nodes.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    placed = F.count(F.when(~F.isnan("umap1") & ~F.isnan("umap2"), 1)).alias("n_placed")
    return at.agg(F.count("*").alias("n_nodes"), placed).select("n_nodes", "n_placed", (mean(edges.select("src", "dst")) < 0.9 * mean(others)).alias("edges_are_short"))


@query()
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.table(spark, sf_dir, "embeddings").select("vec_id")
    return layout.graph_layout(graph.symmetrised(_edges(spark, sf_dir)), nodes, "vec_id", rounds=8, steps=20, chunk=1 << 12)


@query(f"""with {_EDGES_SQL} select 7::bigint as k, count(*) as n_edges, count(distinct src) as n_nodes, round(avg(w), 6) as mean_weight from second_edges
    union all select 15::bigint, count(*), count(distinct src), round(avg(w), 6) from edges""")
def graph_summary_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, second = _both_edges(spark, sf_dir)
    return graph.summary_by_k({7: second, 15: edges})


# Label transfer: positive parts of embeddings as counts, half of the rows as reference


_TRANSFER_SQL = """x as (select vec_id, label, unnest(range(0, 64))::int as feature, unnest(embedding::double[]) as v from embeddings), long as (select vec_id, label, feature, round(greatest(v, 0) * 100, 3) as n from x where v > 0),
    q0 as (select vec_id, feature, n, sum(n) over (partition by vec_id) as t from long where vec_id % 2 = 1), q as (select vec_id as cell_id, feature, ln(1 + n / greatest(t, 1) * 10000) as value from q0),
    r0 as (select {label} as label, feature, sum(n) as n from long where vec_id % 2 = 0 group by 1, 2), ref as (select label, feature, ln(1 + n / greatest(sum(n) over (partition by label), 1) * 10000) as value from r0),
    qn as (select cell_id, sqrt(sum(value * value)) as q from q group by 1), rn as (select label, sqrt(sum(value * value)) as r from ref group by 1), dots as (select cell_id, label, sum(q.value * ref.value) as dot from q join ref using (feature) group by 1, 2)"""
_COARSE_SQL = _TRANSFER_SQL.format(label="label % 3") + """, sim as (select cell_id, label, case when q * r > 0 then coalesce(dot, 0) / (q * r) else 0 end as s from (qn cross join rn) left join dots using (cell_id, label)),
    sh as (select cell_id, label, s - min(s) over (partition by cell_id) as s from sim), sc as (select cell_id, label, round(case when sum(s) over (partition by cell_id) > 0 then s / sum(s) over (partition by cell_id) else 0 end, 9) as score from sh),
    rk as (select *, row_number() over (partition by cell_id order by score desc, label) as k from sc), coarse as (select cell_id, max(case when k = 1 then label end) as parent, max(case when k = 1 then score end) as score, max(case when k = 2 then score end) as second_score from rk where k <= 2 group by 1)"""
_FINE_SQL = "with " + _COARSE_SQL + ", " + (
    _TRANSFER_SQL.format(label="label").split("r0 as")[1].join(["fr0 as", ""]).replace(", ref as", ", fref as").replace("from r0)", "from fr0)").split("qn as")[0].rstrip(", \n")
) + """, frn as (select label, sqrt(sum(value * value)) as r from fref group by 1), fdots as (select cell_id, label, sum(q.value * fref.value) as dot from q join fref using (feature) group by 1, 2),
    fsim as (select c.cell_id, c.parent, f.label, case when q * r > 0 then coalesce(dot, 0) / (q * r) else 0 end as s from coarse c join qn using (cell_id) join frn f on f.label % 3 = c.parent left join fdots d on d.cell_id = c.cell_id and d.label = f.label),
    fsh as (select cell_id, parent, label, s - min(s) over (partition by cell_id) as s from fsim), fsc as (select *, round(case when sum(s) over (partition by cell_id) > 0 then s / sum(s) over (partition by cell_id) else 0 end, 9) as score from fsh),
    frk as (select *, row_number() over (partition by cell_id order by score desc, label) as k from fsc),
    fine as (select cell_id, parent, max(case when k = 1 then label end)::varchar as label, round(max(case when k = 1 then score end), 6) as score, round(max(case when k = 2 then score end), 6) as second_score, round(max(case when k = 1 then score end) - max(case when k = 2 then score end), 6) as margin, false as fallback from frk where k <= 2 group by 1, 2),
    final as (select f.*, coalesce(l.quality = 1 and l.toxic = 1, false) as sure, case when coalesce(l.quality = 1 and l.toxic = 1, false) then 'neutrophil' else label end as final_label from fine f left join labels l on l.doc_id = f.cell_id)"""


def _profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query profiles by cell, and the reference's counts by label."""
    rows = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "v")).where("v > 0")
    long = rows.select("vec_id", "label", "feature", F.round(F.col("v") * 100, 3).alias("n"))
    query_rows = transfer.log_profile(long.where("vec_id % 2 = 1").select(F.col("vec_id").alias("cell_id"), "feature", "n"), "cell_id")
    return query_rows, long.where("vec_id % 2 = 0").groupBy("label", "feature").agg(F.sum("n").alias("n"))


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_rows, reference = _profiles(spark, sf_dir)
    coarse = reference.groupBy((F.col("label") % 3).alias("label"), "feature").agg(F.sum("n").alias("n"))
    return transfer.best(transfer.scores(query_rows, transfer.log_profile(coarse, "label")))


def _fine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    query_rows, reference = _profiles(spark, sf_dir)
    parents = reference.select("label", (F.col("label") % 3).alias("parent")).distinct()
    coarse = _coarse(spark, sf_dir).select("cell_id", F.col("label").alias("parent"))
    return transfer.hierarchical(query_rows, transfer.log_profile(reference, "label"), parents, coarse), parents


def _final(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fine, parents = _fine(spark, sf_dir)
    sure = D.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id"), ((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("sure"))
    return transfer.overridden(fine.join(sure, "cell_id", "left"), F.col("sure"), "neutrophil"), parents


@query(f"with {_COARSE_SQL} select cell_id, parent as label, round(score, 6) as score, round(second_score, 6) as second_score, round(score - second_score, 6) as margin from coarse")
def label_transfer_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir)


@query(f"{_FINE_SQL} select * from fine")
def label_transfer_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fine(spark, sf_dir)[0]


@query(f"{_FINE_SQL} select final_label, case when not sure then 'kept' when label = 'neutrophil' then 'confirmed' else 'overridden' end as action, count(*) as n from final group by 1, 2")
def override_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sizes(_final(spark, sf_dir)[0], "final_label", "action")


@query(f"""{_FINE_SQL} select count(*) as n_rows, count(distinct cell_id) as n_cells, 0::bigint as n_fallback, count(case when label::int % 3 <> parent then 1 end) as n_stray, count(case when sure then 1 end) as n_confirmed,
    count(case when final_label = 'neutrophil' then 1 end) as n_named, count(case when sure and label <> 'neutrophil' then 1 end) as n_overridden, true as valid from final""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    final, parents = _final(spark, sf_dir)
    return transfer.validation(final, parents, F.col("sure"), "neutrophil")


@query("""select count(*) as n_rows, true as loss_falls, true as unit_length from embeddings""")
def alignment_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of heads trained over the table and applied to it: rows, whether the loss fell, and whether fused vectors have length 1."""
    rows = D.halves(spark, sf_dir)
    fit = align.fit_heads(rows, "vec_id", "image", "rna", latent=16, epochs=3, steps=4, rate=3e-3)
    one, two = align.apply_head(rows, "vec_id", "image", fit.image, "a"), align.apply_head(rows, "vec_id", "rna", fit.gene, "b")
    fused = one.join(two, "vec_id").select(S.norm(S.mean_vector(F.col("a"), F.col("b"))).alias("length"))
    falls = fit.history[-1]["train_loss"] < fit.history[0]["train_loss"]
    return fused.agg(F.count("*").alias("n_rows"), F.max(F.abs(F.col("length") - 1)).alias("off")).select("n_rows", F.lit(bool(falls)).alias("loss_falls"), (F.col("off") < 1e-6).alias("unit_length"))


# Images: a vector as a picture of 64 x 64, whose pixel is what its row's and its column's components come to


@query("""with v as (select vec_id, embedding::double[] as e, (vec_id * 37) % 64 - 10 as x0, (vec_id * 53) % 64 - 10 as y0 from embeddings),
    p as (select vec_id, y, x, case when y0 + y between 0 and 63 and x0 + x between 0 and 63 then least(floor(abs(e[y0 + y + 1] + e[x0 + x + 1]) * 40), 255)::int else 0 end as v
      from v, (select unnest(range(0, 20)) as y), (select unnest(range(0, 20)) as x))
    select vec_id, md5(string_agg(lpad(printf('%x', v), 2, '0'), '' order by y, x)) as patch from p group by 1""")
def cell_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.halves(spark, sf_dir).select("vec_id", F.col("embedding").alias("e"))
    shade = lambda a, b: F.lpad(F.hex(F.least(F.floor(F.abs(a + b) * 40), F.lit(255))), 2, "0")
    rows = F.transform("e", lambda a: F.array_join(F.transform("e", lambda b: shade(a, b)), ""))
    pictures = v.select(F.col("vec_id").cast("string").alias("image"), F.lit(64).alias("height"), F.lit(64).alias("width"), F.unhex(F.array_join(rows, "")).alias("pixels"))
    at = lambda step: ((F.col("vec_id") * step) % 64).cast("double")
    cells = v.select("vec_id", F.col("vec_id").cast("string").alias("image"), at(37).alias("x_px"), at(53).alias("y_px"))
    cut = patches.cut_patches(cells, images.tile_table(pictures, 24), pictures.select("image", "height", "width"), 24, 20)
    return cut.select("vec_id", F.md5(F.lower(F.hex("patch")).cast("binary")).alias("patch"))


# Files that all tasks write: arrays, a matrix and pyramids, read back


@query("""select row_number() over (order by vec_id) - 1 as row_index, len(embedding) as width, round(list_sum(embedding::double[]), 5) as total from embeddings""")
def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.row_index(D.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], "row_index")
    path = f"{Workspace(spark, 'npy').root}.npy"
    array_files.write_dense(e, path, vector="embedding")
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return arrays.dense(spark, path).select("row_index", F.size("e").cast("long").alias("width"), F.round(total, 5).alias("total"))


@query(f"""with {D.COUNTS_SQL}, g as (select gene, row_number() over (order by gene) - 1 as i from (select distinct gene from counts))
    select cell_id as row_index, count(*) as n_genes, round(sum(n), 6) as total, round(sum(n * (i + 1)), 6) as weighted from counts join g using (gene) where n <> 0 group by 1""")
def npz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Workspace(spark, "counts").save(D.counts(spark, sf_dir))
    genes = C.row_index(counts.select("gene").distinct(), ["gene"], "gene_idx")
    entries = counts.join(genes, "gene").select(F.col("cell_id").alias("row_index"), "gene_idx", "n")
    path = f"{Workspace(spark, 'npz').root}.npz"
    array_files.write_sparse(entries, path, ((counts.agg(F.max("cell_id")).first()[0] or -1) + 1, genes.count()))
    back = arrays.sparse(spark, path)
    return back.groupBy("row_index").agg(F.count("*").alias("n_genes"), F.round(F.sum("n"), 6).alias("total"), F.round(F.sum(F.col("n") * (F.col("gene_idx") + 1)), 6).alias("weighted"))


@query("""with size as (select max(vec_id) // 8 + 1 as r from embeddings), v as (select label, vec_id % 8 as tx, vec_id // 8 as ty, embedding::double[] as e from embeddings),
    p as (select label, ty * 64 + y as y, tx * 64 + x as x, least(floor(abs(e[y + 1] + e[x + 1]) * 40), 255) as s from v, (select unnest(range(0, 64)) as y), (select unnest(range(0, 64)) as x)),
    half as (select label, y // 2 as y, x // 2 as x, floor(sum(s) / 4) as s from p group by 1, 2, 3),
    sums as (select label, 0 as level, sum(s)::bigint as total from p group by 1 union all select label, 1, sum(s)::bigint from half group by 1),
    l as (select label, r, unnest(range(0, 1 + ceil(log2(greatest(r, 8)))::int)) as level from (select distinct label from embeddings), size)
    select l.label::varchar as image, l.level::int as level, (ceil(r / pow(2, l.level)) * ceil(8 / pow(2, l.level)))::bigint as n_places, total from l left join sums using (label, level)""")
def pyramid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each label, its vectors' pictures being the tiles: places of tiles on all levels, and sums of pixels of the first two."""
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("image"), F.col("embedding").cast("array<double>").alias("e"))
    shade = lambda a, b: F.lpad(F.hex(F.least(F.floor(F.abs(a + b) * 40), F.lit(255))), 2, "0")
    rows = F.transform("e", lambda a: F.array_join(F.transform("e", lambda b: shade(a, b)), ""))
    tiles = e.select("image", F.floor(F.col("vec_id") / 8).alias("ty"), (F.col("vec_id") % 8).alias("tx"), F.unhex(F.array_join(rows, "")).alias("pixels"))
    high = e.agg((F.floor(F.max("vec_id") / 8) + 1).alias("r")).first()["r"] or 1
    sizes = e.select("image").distinct().select("image", F.lit(64 * high).alias("height"), F.lit(512).alias("width"))
    path = f"{Workspace(spark, 'pyramids').root}-files"
    pyramids.write_pyramids(tiles, sizes, path, 64)

    def brightness(batches):
        for batch in batches:
            inside = zip(*(batch.column(c).to_pylist() for c in ("pixels", "high", "wide")), strict=True)
            sums = [int(np.frombuffer(p, np.uint8).reshape(64, 64)[:h, :w].sum()) if p else 0 for p, h, w in inside]
            yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("level"), pa.array(sums, pa.int64())], ["image", "level", "s"])

    name = F.regexp_extract("path", r"([^/]*)\.tif$", 1).alias("image")
    back = pyramids.read_tiles(spark, path).select(name, "level", "pixels", (F.col("height") - F.col("ty") * 64).alias("high"), (F.col("width") - F.col("tx") * 64).alias("wide"))
    sums = map_arrow(back, brightness, "image string, level int, s long")
    return sums.groupBy("image", "level").agg(F.count("*").alias("n_places"), F.when(F.col("level") < 2, F.sum("s")).alias("total"))
