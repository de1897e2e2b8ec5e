import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import scalar as S
from lumenframe.functions.storage import Workspace
from lumenframe.operators import align, cells, community, embedding, expression, graph, images, layout, multimodal, report, spatial, transfer, validate, vectors
from lumenframe.sources import arrays, readers, tiff, writers
from lumenframe.streaming import boundaries


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1.0, 0.0, " Yes "), (3.0, 4.0, "no"), (None, 2.0, None)], "a double, b double, t string")
    out = df.select(S.safe_ratio(F.col("a"), F.col("b")).alias("r"), S.truthy(F.col("t")).alias("t")).collect()
    assert [(x.r, x.t) for x in out] == [(0.0, True), (0.75, False), (0.0, False)]
    bins = spark.createDataFrame([(n,) for n in (0, 4, 5, 9, 10, 29, 30, 99, 100)], "n int").select(S.count_bin(F.col("n")).alias("b"))
    assert [r.b for r in bins.collect()] == ["0-4", "0-4", "5-9", "5-9", "10-29", "10-29", "30-99", "30-99", ">=100"]
    assert S.half_patch(224, 4) == 28 and S.half_patch(16, 8) == 4


def test_unique_names(spark):
    df = spark.createDataFrame(list(enumerate("ABAA")), "i int, name string").withColumn("u", S.unique_names("name", "i"))
    assert [r.u for r in df.orderBy("i").collect()] == ["A", "B", "A_1", "A_2"]


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "10", "9", "a", "2")], "c string")
    assert [r.c for r in report.in_natural_order(df, "c").collect()] == ["2", "9", "10", "a", "b"]


def test_quality_control_drops_nulls_and_uses_sample_quantiles(spark):
    rows = [(i, "s", 50.0, 0.0, 10.0, float(i)) for i in range(100)] + [(200, "t", 50.0, 9.0, 10.0, 5.0), (201, "t", None, 0.0, 10.0, 5.0)]
    df = spark.createDataFrame(rows, "cell_id int, sample_id string, transcripts double, control double, total double, area double")
    out = {r.cell_id for r in cells.quality_control(df, 20, 0.5, 0.05, 0.95).collect()}
    assert out == {i for i in range(100) if 4.95 <= i <= 94.05}


def test_edges_are_half_open(spark):
    df = spark.createDataFrame([(28.0, 28.0), (27.9, 50.0), (72.0, 50.0), (71.9, 50.0)], "x_px double, y_px double")
    assert cells.inside_edges(df, F.lit(100), F.lit(100), 224, 4).count() == 2


def test_retention_partitions_the_source(spark):
    df = spark.createDataFrame([(1, True, 3.0), (2, False, 50.0), (3, None, None), (4, True, 60.0)], "i int, sure boolean, n double")
    out = cells.with_retention(df, F.col("sure"), F.col("n"), 20)
    assert values(cells.retained(out), "i") == [(1,), (2,), (4,)] and values(cells.dropped(out), "i") == [(3,)]
    assert {r.i: r.retention_reason for r in out.collect()} == {1: "confirmed", 2: "count", 3: "dropped", 4: "confirmed_and_count"}


def test_vertices_and_polygons(spark):
    df = spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "b", 5.0, 5.0), (2, "a", 2.0, 0.0), (3, "a", 0.0, 0.0)], "o int, c string, x double, y double")
    ids = cells.vertex_ids(df, ["c"], ["o"])
    assert values(ids, "c", "vertex_id", "x") == [("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 0.0), ("b", 0, 5.0)]
    centre = {r.c: r for r in cells.centroids(df, ["c"], "x", "y").collect()}
    assert centre["a"].x_centroid == pytest.approx(2 / 3) and centre["a"].n_boundary_vertices == 3
    shape = cells.polygons(ids, ["c"], "x", "y")
    seen = shape.select("c", cells.any_vertex_in_view(F.col("vertices"), 2, 0, 3, 1).alias("v"))
    assert values(seen, "c", "v") == [("a", True), ("b", False)]


def test_constraints_raise(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        validate.require_unique(df, ["k"])
    with pytest.raises(ValueError):
        validate.require_columns(df, ["x"])
    with pytest.raises(ValueError):
        validate.require_matched(df, df.where("k > 1"), ["k"])
    with pytest.raises(ValueError):
        validate.require_same_size(a=df, b=df.limit(1))
    with pytest.raises(ValueError):
        expression.shared_genes(spark.createDataFrame([("a",)], "gene string"), spark.createDataFrame([(0, "b")], "gene_idx int, gene string"), 1)


def test_median_counts_implied_zeros(spark):
    cell = spark.createDataFrame([(i, "k") for i in range(5)], "cell_id int, cluster string")
    counts = spark.createDataFrame([(0, "g", 2.0), (1, "g", 2.0), (2, "g", 2.0), (0, "h", 1.0)], "cell_id int, gene string, n double")
    out = {r.gene: r for r in expression.cluster_gene(cell, counts).collect()}
    assert out["g"].median_log1p > 0 and out["h"].median_log1p == 0 and out["h"].pct_positive == 20.0 and out["g"].n_cells == 5


def test_radius_and_nearest_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "s" if i % 3 else "t", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 300, (120, 2)))]
    df = spark.createDataFrame(rows, "k int, s string, x double, y double")
    want = {a[0]: sum(a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 900 for b in rows) for a in rows}
    assert dict(values(spatial.radius_counts(df, "k", "x", "y", 30.0, "s"), "k", "n_near")) == want
    goals = [r for r in rows if r[0] % 11 == 0]
    near = {r.k: r.t for r in spatial.nearest(df, df.where("k % 11 = 0").withColumnRenamed("k", "t"), "k", "t", "x", "y", 10.0, "s").collect()}
    assert near == {a[0]: min((round((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, 9), b[0]) for b in goals if a[1] == b[1])[1] for a in rows}


def test_graph_repair_keeps_sane_graphs(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.2), (1, 3, 0.4)], "src int, dst int, w double")
    assert values(graph.repaired(edges, edges, 2), "src", "dst", "w") == values(edges, "src", "dst", "w")
    wild = edges.withColumn("w", F.col("w") * 4)
    fixed = graph.repaired(wild, edges.where("dst < 3"), 2)
    assert values(fixed, "src", "dst", "w") == [(1, 2, 1.0), (2, 1, 1.0)]
    symmetric = values(graph.symmetrised(edges), "src", "dst", "w")
    assert sorted((b, a, w) for a, b, w in symmetric) == symmetric


def _two_cliques(spark):
    pairs = [(a, b, 1.0) for block in (range(6), range(6, 12)) for a in block for b in block if a != b] + [(0, 6, 0.1), (6, 0, 0.1)]
    nodes = spark.range(13).withColumnRenamed("id", "n")
    return spark.createDataFrame(pairs, "src long, dst long, w double"), nodes


@pytest.mark.parametrize("most_local", [0, 1000])
def test_communities(spark, most_local):
    edges, nodes = _two_cliques(spark)
    found = community.communities(edges, nodes, "n", most_local=most_local)
    groups = {r.node: r.community for r in found.collect()}
    assert groups == {**dict.fromkeys(range(6), 0), **dict.fromkeys(range(6, 12), 6), 12: 12}
    assert community.modularity(edges, found) > 0.4


def _some_graph(spark, n, seed):
    rng = np.random.default_rng(seed)
    pairs = {(i, j) for i in range(n) for j in rng.choice(n, 3) if i < j} | {(i, i + 1) for i in range(n - 1)}
    rows = [x for i, j in sorted(pairs) for x in ((int(i), int(j), 1.0), (int(j), int(i), 1.0))]
    return spark.createDataFrame(rows, "src long, dst long, w double").cache(), spark.range(n).withColumnRenamed("id", "n"), pairs


def test_communities_are_the_same_wherever_a_level_is_done(spark):
    edges, nodes, pairs = _some_graph(spark, 24, 2)
    far, near, mixed = ({r.node: r.community for r in community.communities(edges, nodes, "n", most_local=m).collect()} for m in (0, 10_000, 40))
    assert far == near == mixed
    total = 2.0 * len(pairs)
    degree = {i: sum(i in p for p in pairs) for i in range(24)}
    score = lambda own: sum(2.0 for i, j in pairs if own[i] == own[j]) / total - sum(sum(d for i, d in degree.items() if own[i] == c) ** 2 for c in set(own.values())) / total**2
    assert community.modularity(edges, spark.createDataFrame(list(near.items()), "node long, community long")) == pytest.approx(score(near))
    groups = set(near.values())
    assert all(score({i: a if c == b else c for i, c in near.items()}) <= score(near) + 1e-9 for a in groups for b in groups if a != b)  # no two communities gain by merging


@pytest.mark.parametrize("most_local", [60, 10_000])
def test_a_scan_gives_the_partitions_of_single_runs(spark, most_local):
    edges, nodes, _ = _some_graph(spark, 16, 5)
    grid = [0.3, 1.0, 2.5]
    rows, found = community.scan(edges, nodes, "n", grid, 5, most_local)
    single = [{r.node: r.community for r in community.communities(edges, nodes, "n", g).collect()} for g in grid]
    together = [{}, {}, {}]
    for r in found.collect():
        together[r.r][r.node] = r.community
    assert together == single
    n = [len(set(p.values())) for p in single]
    assert n[0] < n[2]
    best = min(zip([abs(x - 5) for x in n], grid, strict=True))[1]
    assert values(rows, "resolution", "n_clusters", "difference", "chosen") == sorted((g, x, abs(x - 5), g == best) for g, x in zip(grid, n, strict=True))


def test_scans_of_nothing(spark):
    none, nodes = spark.createDataFrame([], "src long, dst long, w double"), spark.range(3)
    assert community.scan(none, nodes, "id", [], 5)[0].count() == 0
    assert values(community.scan(none, nodes, "id", [1.0, 2.0], 5)[0], "n_clusters", "chosen") == [(3, False), (3, True)]
    assert values(community.scan(none, nodes.where("false"), "id", [1.0], 5)[0], "n_clusters", "chosen") == [(0, True)]


def test_a_turn_tells_modularity_and_what_nodes_gain(spark):
    """One table of wishes has both, of joins as of arrays, so no turn reads the edges again for its score."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 30, 150), rng.integers(0, 30, 150)
    w = rng.integers(1, 9, 150) / 4.0
    rows = [(int(x), int(y), float(z)) for x, y, z in [*zip(a, b, w, strict=True), *zip(b, a, w, strict=True)]]
    work = Workspace(spark, "test")
    edges = work.save(spark.createDataFrame(rows, "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    level = community._arrays(*(np.array(c) for c in zip(*sorted(tuple(r) for r in edges.collect()), strict=True)))
    degrees = community._degrees(edges, [])
    own = level.nodes % 7
    labels = spark.createDataFrame([(int(i), int(c)) for i, c in zip(level.nodes, own, strict=True)], "node long, community long")
    tables = community.Tables(edges, degrees, level.total, [0.7], work)
    wishes, gaining, score = tables.wishes(labels.select(F.lit(0).alias("r"), "node", "community"))
    assert score[0] == pytest.approx(community.modularity(edges, labels, 0.7)) == pytest.approx(level.score(own, 0.7)) and gaining == {0}
    assert {r.node: r.to for r in wishes.collect()} == dict(zip(level.nodes.tolist(), level.wishes(own, 0.7)[1].tolist(), strict=True))


def test_long_communities_stay_whole(spark):
    path = spark.range(300).selectExpr("id as src", "id + 1 as dst", "1.0D as w")
    edges = path.unionAll(path.selectExpr("dst as src", "src as dst", "w")).where("src <> 199 or dst <> 200").where("src <> 200 or dst <> 199")
    labels = spark.range(301).selectExpr("0 as r", "id as node", "7L as community")
    parts = community._connected(edges, labels, Workspace(spark, "test"))
    assert {r.community: r["count"] for r in parts.groupBy("community").count().collect()} == {0: 200, 200: 101}


def test_communities_of_odd_graphs(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (None,)], "n long")
    for rows in ([], [(1, 2, 0.0)], [(None, 2, 1.0), (1, None, 1.0), (1, 2, None)]):
        edges = spark.createDataFrame(rows, "src long, dst long, w double")
        assert values(community.communities(edges, nodes, "n"), "node", "community") == [(1, 1), (2, 2)]
    twice = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (2, 1, 1.0)], "src long, dst long, w double")
    assert values(community.communities(twice, nodes, "n"), "node", "community") == [(1, 1), (2, 1)]


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [float("nan"), 1.0]), (5, []), (6, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    assert values(vectors.exact_neighbours(df, "k", "v", 3), "src", "dst", "rank") == [(1, 2, 1), (2, 1, 1)]
    assert vectors.exact_neighbours(df.where("k > 99"), "k", "v", 3).count() == 0
    mean, parts, _ = vectors.principal_components(df.where("size(v) = 2"), "v", 2)
    scores = {r.k: r.scores for r in vectors.project(df.withColumn("the_vector", F.lit("x")), "v", mean, parts).collect()}
    assert scores[3] is None and scores[4] is None and scores[6] is None and len(scores[1]) == 2
    with pytest.raises(ValueError, match="no rows"):
        vectors.principal_components(df.where("k > 99"), "v", 2)
    with pytest.raises(ValueError, match="differ in length"):
        vectors.principal_components(df, "v", 2)


def test_hubs_share_neighbours_in_parts(spark, monkeypatch):
    monkeypatch.setattr(multimodal, "PART", 4)
    pairs = spark.createDataFrame([(i, 100) for i in range(11)] + [(i, 200 + i % 3) for i in range(11)], "src long, dst long")
    want = sorted((i, j, 1 + (i % 3 == j % 3)) for i in range(11) for j in range(11) if i != j)
    assert values(multimodal._shared(pairs), "src", "o", "s") == want


def test_harmony_with_null_batches_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) + (i % 3)).tolist(), [None, "a", "b"][i % 3]) for i in range(60)] + [(60, [None, 1.0, 0.0, 0.0], "a"), (61, None, "b")]
    df = spark.createDataFrame(rows, "k long, v array<double>, b string")
    out = {r.k: r.v for r in multimodal.harmonised(df, "k", "v", "b").collect()}
    assert set(out) == set(range(61)) and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in out.values())
    assert multimodal.harmonised(df.where("k > 99"), "k", "v", "b").count() == 0


def test_crowded_cells_and_null_points(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL", 3)
    rng = np.random.default_rng(1)
    points = [(i, "s", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 3, (40, 2)))] + [(90, "s", None, 1.0), (91, None, 1.0, 1.0)]
    df = spark.createDataFrame(points, "k long, s string, x double, y double")
    want = sorted((a[0], sum((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 1 for b in points[:40])) for a in points[:40])
    assert values(spatial.radius_counts(df, "k", "x", "y", 1.0, "s"), "k", "n_near") == want
    targets = df.where("k % 7 = 0").withColumnRenamed("k", "t")
    near = {r.k: r.t for r in spatial.nearest(df, targets, "k", "t", "x", "y", 0.1, "s").collect()}
    assert near == {a[0]: min((round((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, 9), b[0]) for b in points[:40] if b[0] % 7 == 0)[1] for a in points[:40]}


def test_capped_label_sums(spark):
    order = [F.col("cell_id")]
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "cell_id long, cluster string")
    counts = spark.createDataFrame([(i, "g", float(i)) for i in range(10)], "cell_id long, gene string, n double")
    assert values(expression.label_sums(df, counts, "cluster", 2, order), "cluster", "n") == [("a", 2.0), ("b", 4.0)]


def test_median_of_genes_with_ties_and_zeros(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(31)], "cell_id long, cluster string")
    table = {(i, g): float(rng.integers(0, 3)) for i in range(31) for g in ("x", "y")}
    counts = spark.createDataFrame([(i, g, n) for (i, g), n in table.items() if n], "cell_id long, gene string, n double")
    library = {i: sum(n for (j, _), n in table.items() if j == i) for i in range(31)}
    middle = float(np.median([x for x in library.values() if x > 0]))
    for r in expression.cluster_gene(df, counts).collect():
        cells_ = [i for i in range(31) if "abc"[i % 3] == r.cluster]
        value = [np.log1p(table[i, r.gene] * (middle / library[i] if library[i] else 1)) for i in cells_]
        assert (r.mean_log1p, r.median_log1p) == (pytest.approx(np.mean(value), abs=1e-6), pytest.approx(np.median(value), abs=1e-6))


def test_a_correction_is_made_only_where_batches_show(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) + (4 * (i % 2) if i < 80 else 0)).tolist(), "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, v array<double>, b string")
    _, record = multimodal.harmonised_if_needed(df, "k", "v", "b", k=5, most=60)
    assert record["applied"] and record["before"] > 0.1 and record["after"] < record["before"]
    mixed = df.withColumn("b", F.when(F.xxhash64("k") % 2 == 0, "a").otherwise("b"))
    out, record = multimodal.harmonised_if_needed(mixed, "k", "v", "b", threshold=0.3, k=5)
    assert not record["applied"] and values(out, "k") == [(i,) for i in range(80)]
    with pytest.raises(ValueError, match="weight"):
        graph.require_sane(spark.createDataFrame([(1, 2, 3.0)], "src long, dst long, w double"), 15)


def test_vertex_numbers_go_on_between_micro_batches(spark, tmp_path):
    for i, rows in enumerate(([("a", 0), ("b", 1), ("a", 2)], [("b", 3), ("a", 4)], [("c", 5), ("a", 6)])):
        spark.createDataFrame(rows, "c string, o int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = boundaries.stream(spark, str(tmp_path / "in"), "c string, o int")
    boundaries.write_numbered(stream, "c", "o", str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.c: r.ids for r in out.groupBy("c").agg(F.sort_array(F.collect_list("vertex_id")).alias("ids")).collect()} == {"a": [0, 1, 2, 3], "b": [0, 1], "c": [0]}


def test_settings_stages_and_publishing(spark, tmp_path):
    (tmp_path / "settings.json").write_text(json.dumps({"graph": {"neighbours": 7}, "seed": 3}))
    settings = readers.Settings.read(spark, str(tmp_path / "settings.json"))
    assert (settings.neighbours, settings.seed) == (7, 3)
    assert readers.resolved("/base", "x/y") == "/base/x/y" and readers.resolved("/base", "s3://b/y") == "s3://b/y" and readers.float_list("2, 0.5,,2") == [0.5, 2.0]
    steps = {"one": lambda x: x + 1, "two": lambda x: x + 2}
    assert readers.dispatch("two", steps, 1) == 3 and readers.dispatch("all", steps, 1) == {"one": 2, "two": 3}
    with pytest.raises(ValueError, match="one, two"):
        readers.dispatch("three", steps, 1)
    assert readers.StagePaths("/run/").of("pca", "scores") == "/run/pca/scores"
    writers.parquet(spark.range(3), str(tmp_path / "table"))
    assert writers.published(spark, str(tmp_path / "table"), str(tmp_path / "copy")).where("bytes > 0").count() >= 1
    with pytest.raises(ValueError, match="already"):
        writers.published(spark, str(tmp_path / "table"), str(tmp_path / "copy"))


def test_image_preparation():
    x = np.random.default_rng(0).integers(0, 256, (6, 8, 3)).astype(np.uint8)
    assert np.array_equal(images.resized(x[:, :6], 6), x[:, :6])
    assert np.allclose(images.resized(np.full((7, 5), 3.0), 4), 3.0)
    assert images.model_input(x, 4, [0.5] * 3, [0.25] * 3).shape == (3, 4, 4)
    assert images.as_rgb(np.array([[0.0, 0.5, 1.0]]))[0, :, 0].tolist() == [0, 127, 255] and images.as_rgb(np.array([[0.0, 300.0, 7.9]]))[0, :, 0].tolist() == [0, 255, 7]
    two = np.stack([np.arange(100.0).reshape(10, 10), np.arange(100.0).reshape(10, 10) * 50], axis=2)
    assert np.allclose(images.stretched(two)[..., 0], images.stretched(two)[..., 1])
    assert images.pyramid(5, 3, 2) == [(5, 3), (3, 2), (2, 1)] and images.halved(np.ones((5, 3))).shape == (3, 2)
    assert images.tile_positions(5, 50, 10, 4) == [(0, 0)] and images.tile_positions(50, 50, 10, 0) == [] and len(images.tile_positions(50, 50, 10, 4)) == 4


def test_losses_equal_the_training_code(spark):
    rng = np.random.default_rng(5)
    i, g = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    df = spark.createDataFrame([(k, 0, i[k].tolist(), g[k].tolist()) for k in range(6)], "k long, b int, i array<double>, g array<double>")
    target = np.zeros((6, 6))
    table = align.target_table(df, "k", "b", "i", "g", 0.3, 0.2)
    for r in table.collect():
        target[r.i, r.j] = r.target
    assert np.allclose(target, align.soft_targets(i, g, 0.3, 0.2))
    assert align.loss_table(df, "k", "b", "i", "g", 0.1, table).first().loss == pytest.approx(align.soft_loss(i, g, target, 0.1))
    assert align.loss_table(df, "k", "b", "i", "g", 0.1).first().loss == pytest.approx(align.info_nce(i, g, 0.1))


def test_cell_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "i long, c string, x double")
    names = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    assert values(cells.mapped(df, "c", names, "k", "v", "w"), "i", "w") == [(1, 10), (2, 20)]
    with pytest.raises(ValueError, match="no value"):
        cells.mapped(df, "c", names.where("v = 10"), "k", "v", "w")
    with pytest.raises(ValueError, match="repeats"):
        cells.mapped(df, "c", names.unionAll(names), "k", "v", "w")
    assert "v" in cells.joined_if_complete(df, names.withColumnRenamed("k", "c"), ["c"]).columns
    assert "v" not in cells.joined_if_complete(df, names.where("v = 10").withColumnRenamed("k", "c"), ["c"]).columns
    assert values(cells.present_in(df, ["c"], names.where("v = 10").withColumnRenamed("k", "c")), "i") == [(1,)] and values(cells.complete_rows(df, ["x"]), "i") == [(1,)]
    ids = cells.with_polygon_ids(spark.createDataFrame([("2.0",), (None,)], "polygon_id string"))
    assert values(ids, "polygon_id", "vertex_id") == [(1, 0), (2, 0)]
    marked = cells.with_retention(df, F.col("i") == 1, F.col("x"), 1.0)
    assert cells.check_retention(marked, cells.retained(marked), cells.dropped(marked)).count() == 1
    with pytest.raises(ValueError, match="confirmed"):
        cells.check_retention(marked, cells.dropped(marked), cells.retained(marked))
    parts = {r.part: r["count"] for r in cells.exact_split(spark.range(50), [F.col("id")], 0.8).groupBy("part").count().collect()}
    assert parts == {"train": 40, "validation": 10}
    assert [r.part for r in cells.exact_split(spark.range(1), [F.col("id")], 0.8).collect()] == ["both"]
    capped = cells.stratified_cap(spark.createDataFrame([(i, "s", i < 3) for i in range(9)] + [(9, None, None)], "i long, s string, low boolean"), "s", F.col("low"), [F.col("i")], 5)
    assert values(capped, "i") == [(0,), (1,), (2,), (3,), (4,), (9,)]


def test_resolutions():
    for low, high, step in ((0.1, 0.4, 0.1), (0.5, 2.0, 0.25), (1.0, 1.0, 0.1)):
        assert community.resolutions(low, high, step) == [round(float(x), 2) for x in np.arange(low, high, step)]


def test_fuzzy_weights(spark):
    near = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.4), (1, 0, 0.1), (1, 2, 0.2), (2, 1, 0.2), (2, 0, 0.4)], "src int, dst int, distance double")
    w = {(r.src, r.dst): r.w for r in graph.fuzzy(near, 3).collect()}
    assert all(w[a, b] == pytest.approx(w[b, a]) for a, b in w) and all(0 < x <= 1 for x in w.values())
    assert w[0, 1] == pytest.approx(1.0)


def test_principal_components_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    mean, parts, share = vectors.principal_components(df, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs((parts * vt[:3]).sum(1)) == pytest.approx(np.ones(3)) and share == pytest.approx((s**2 / (s**2).sum())[:3])
    got = np.array([r.scores for r in vectors.project(df, "v", mean, parts).orderBy("k").collect()])
    assert got == pytest.approx((x - x.mean(0)) @ parts.T)


def test_weighted_neighbours_and_harmony(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], (rng.normal(size=4) + 3 * (i % 2)).tolist(), rng.normal(size=4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, b string, u array<double>, v array<double>")
    w, _ = multimodal.modality_weights(df, "k", "u", "v", 6, 4)
    assert all(0 <= r.w1 <= 1 and r.w1 + r.w2 == pytest.approx(1) for r in w.collect()) and w.count() == 40
    assert multimodal.weighted_neighbours(df, "k", "u", "v", 5, 8, 4).groupBy("src").count().where("count <> 5").isEmpty()
    out = {r.k: np.array(r.u) for r in multimodal.harmonised(df, "k", "u", "b", clusters=2).collect()}
    gap = lambda d: np.linalg.norm(np.mean([x for k, x in d.items() if k % 2], 0) - np.mean([x for k, x in d.items() if not k % 2], 0))
    unit = {i: np.array(u) / np.linalg.norm(u) for i, _, u, _ in rows}
    assert len(out) == 40 and gap(out) < gap(unit) and all(np.linalg.norm(x) == pytest.approx(1) for x in out.values())


def test_transfer_edge_cases(spark):
    q = spark.createDataFrame([(1, "f", 2.0), (1, "g", 1.0)], "cell_id int, feature string, value double")
    one = spark.createDataFrame([("a", "f", 1.0)], "label string, feature string, value double")
    r = transfer.best(transfer.scores(q, one)).first()
    assert (r.label, r.score, r.margin) == ("a", 0.0, 0.0)
    none = transfer.hierarchical(q, one, spark.createDataFrame([("a", "p")], "label string, parent string"), spark.createDataFrame([(1, "q")], "cell_id int, parent string")).first()
    assert (none.label, none.score, none.fallback) == ("q", None, True)


def test_training_improves_and_keeps_its_best():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(120, 6))
    image, gene = z @ rng.normal(size=(6, 20)), z @ rng.normal(size=(6, 12))
    out = align.train(image, gene, latent=8, epochs=12, batch=32, soft=False)
    losses = [h["val_loss"] for h in out.history]
    assert min(losses) < losses[0] and out.best_epoch == 1 + int(np.argmin(losses))
    assert align.soft_targets(image[:5], gene[:5], 0.5, 0.1).sum(1) == pytest.approx(np.ones(5))


def test_images(spark):
    x = np.arange(30, dtype=np.uint8).reshape(5, 6)
    assert images.crop(x, -1, -1, 4)[0].sum() == 0 and images.crop(x, -1, -1, 4, anchored=True)[0, 0] == x[0, 0]
    assert images.pyramid(1000, 400, 256) == [(1000, 400), (500, 200), (250, 100)] and images.level_for([(9, 9), (4, 4)], 5) == 1
    assert [(a, b) for a, b, _ in images.tiles(x, 4)] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    table = images.tile_table(spark.createDataFrame([("i", 5, 6, bytearray(x.tobytes()))], "image string, height int, width int, pixels binary"), 4)
    assert table.count() == 4
    assert images.stretched(np.zeros((2, 2))).sum() == 0 and images.as_rgb(x).shape == (5, 6, 3)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("i1\tA\tGene Expression\ni2\t\tControl\ni3\tA\tGene Expression\n")
    assert [(r.gene_idx, r.gene) for r in readers.features(spark, str(tmp_path / "f.tsv")).orderBy("gene_idx").collect()] == [(0, "A"), (1, "i2"), (2, "A_1")]
    assert readers.features(spark, str(tmp_path / "f.tsv"), "Control").count() == 1
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n3 2 2\n1 1 5\n3 2 2\n")
    assert values(readers.matrix_market(spark, str(tmp_path / "m.mtx")), "gene_idx", "cell_idx", "n") == [(0, 0, 5.0), (2, 1, 2.0)]
    (tmp_path / "names.txt").write_text("b\n\n a \n")
    assert values(readers.names(spark, str(tmp_path / "names.txt")), "gene_idx", "gene") == [(0, "b"), (1, "a")]
    df = spark.createDataFrame([("x", 2), ("y", 1), ("x", 1)], "g string, k int")
    writers.grouped_csv(df, str(tmp_path / "g"), "g", ["k"])
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.is_dir()) == ["g=x", "g=y"]
    writers.bundle({"t": df}, str(tmp_path / "bundle"), {"a": 1})
    assert json.loads((tmp_path / "bundle/parameters.json").read_text()) == {"a": 1}
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert writers.stage(spark, str(tmp_path / "stages"), writers.fingerprint(a=1), build).count() == 3
    assert calls == [1]
    with pytest.raises(ValueError):
        readers.Settings.of({"unknown": 1})
    with pytest.raises(ValueError):
        readers.sample_specs(["a|b"])
    xml = spark.createDataFrame([('<OME><Pixels PhysicalSizeX="500" PhysicalSizeXUnit="nm"><Channel Name="c"/></Pixels></OME>',), ("<OME/>",)], "xml string")
    assert [r.um_per_px for r in readers.ome_pixel_size(xml).collect()] == [0.5, 1.0]


def test_streaming_equals_batch(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 7).alias("c"), F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"))
    df.repartition(4).write.parquet(str(tmp_path / "v"))
    out = boundaries.run(boundaries.stream(spark, str(tmp_path / "v"), df.schema), ["c"], "x", "y", "streamed", str(tmp_path / "ckpt"))
    want = boundaries.centroids(df, ["c"], "x", "y")
    assert values(out, "c", "x_centroid", "n_boundary_vertices") == values(want, "c", "x_centroid", "n_boundary_vertices")


def test_array_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float64).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    assert [list(r.e) for r in arrays.dense(spark, str(tmp_path / "x.npy")).orderBy("row_index").collect()] == x.tolist()
    np.savez(tmp_path / "c.npz", data=np.array([5.0, 0.0, 2.0]), indices=np.array([1, 2, 0]), indptr=np.array([0, 2, 2, 3]), shape=np.array([3, 3]), format=np.array(b"csr"))
    assert values(arrays.sparse(spark, str(tmp_path / "c.npz")), "row_index", "gene_idx", "n") == [(0, 1, 5.0), (2, 0, 2.0)]


@pytest.mark.parametrize("end", ["<", ">"])
def test_tiff_header(spark, tmp_path, end):
    entry = lambda tag, kind, n, value: struct.pack(f"{end}HHI", tag, kind, n) + value
    short = lambda v: struct.pack(f"{end}HH", v, 0)
    entries = [entry(256, 3, 1, short(640)), entry(257, 3, 1, short(480)), entry(282, 5, 1, struct.pack(f"{end}I", 200)), entry(296, 3, 1, short(3))]
    data = (b"II" if end == "<" else b"MM") + struct.pack(f"{end}HI", 42, 8) + struct.pack(f"{end}H", 4) + b"".join(entries) + bytes(4)
    data = data.ljust(200, b"\0") + struct.pack(f"{end}II", 40000, 1)
    (tmp_path / "i.tif").write_bytes(data)
    row = tiff.headers(spark, str(tmp_path / "i.tif")).first()
    assert (row.width, row.height, row.um_per_px, row.description) == (640, 480, 0.25, None)
    with pytest.raises(ValueError):
        tiff.header(b"nothing at all")


def test_layout_separates_cliques(spark):
    edges, nodes = _two_cliques(spark)
    out = {r.n: np.array([r.umap1, r.umap2]) for r in layout.graph_layout(edges, nodes, "n", rounds=5, steps=20).collect()}
    inner = np.mean([np.linalg.norm(out[a] - out[b]) for a in range(6) for b in range(a)])
    outer = np.mean([np.linalg.norm(out[a] - out[b]) for a in range(6) for b in range(6, 12)])
    assert len(out) == 13 and outer > 2 * inner


def test_profile_embedding_falls_back(spark):
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "gene_idx int, gene string")
    counts = spark.createDataFrame([(i, g, float((i * 7 + j * 3) % 5)) for i in range(8) for j, g in enumerate("abc")], "cell_id int, gene string, value double")

    def missing(_):
        raise ImportError("no model here")

    out, how = embedding.profile_embedding(embedding.dense_profiles(counts, genes), 2, missing)
    assert how == "pca" and out.count() == 8 and len(out.first().embedding) == 2


def test_row_index_is_dense_and_failures_are_recorded(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    assert values(cells.row_index(df, ["k"]), "k", "source_row_index") == [(i, i) for i in range(50)]
    seen = []
    with pytest.raises(KeyError), validate.recorded(seen.append, step="x"):
        raise KeyError("y")
    assert seen[0]["error"] == "KeyError" and seen[0]["step"] == "x"


def test_row_index_of_wide_rows(spark, tmp_path):
    """Numbering and sizes see the same ranges, although Spark joins small partitions by the bytes that each of them reads."""
    wide = F.concat(*(F.sha2(F.concat("id", F.lit(i)), 256) for i in range(6))).alias("wide")
    spark.range(20_000, numPartitions=3).select((F.col("id") * 7).alias("id"), wide).write.parquet(f"{tmp_path}/wide")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = cells.row_index(spark.read.parquet(f"{tmp_path}/wide"), ["id"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.id, r.n) for r in got) == [(7 * i, i) for i in range(20_000)]


def test_nearest_of_dense_targets_and_copies(spark):
    """Many targets in the width asked for, some at one place, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(8)
    at = np.round(rng.uniform(0, 50, (600, 2)), 1)
    at[::5] = at[0]
    at[-1] = (9000.0, -400.0)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(at)], "k long, g string, x double, y double")
    goals = df.where("k % 3 = 0").withColumnRenamed("k", "t")
    got = {r.k: (r.t, round(r.distance, 6)) for r in spatial.nearest(df, goals, "k", "t", "x", "y", 100.0, "g").collect()}
    for i, (x, y) in enumerate(at):
        d = {j: round((x - at[j][0]) ** 2 + (y - at[j][1]) ** 2, 9) for j in range(0, 600, 3) if j % 2 == i % 2}
        t = min(d, key=lambda j: (d[j], j))
        assert got[i] == (t, round(float(np.sqrt(d[t])), 6))
    assert len(got) == 600


def test_radius_counts_work_on_places(spark, monkeypatch):
    """Many rows at few places: places are compared, not rows, and counts are those of all pairs."""
    compared, run = [], spatial.map_arrow
    monkeypatch.setattr(spatial, "map_arrow", lambda df, *a: compared.append(df) or run(df, *a))
    monkeypatch.setattr(spatial, "CELL", 8)
    at = [(float(i % 7), float(i % 3)) for i in range(630)]
    df = spark.createDataFrame([(i, "g", x, y) for i, (x, y) in enumerate(at)], "k long, g string, x double, y double")
    got = {r.k: r.n_near for r in spatial.radius_counts(df, "k", "x", "y", 2.0, "g").collect()}
    assert got == {i: sum((a - c) ** 2 + (b - d) ** 2 <= 4 for c, d in at) for i, (a, b) in enumerate(at)}
    a, b = (F.col(c) for c in compared[0].columns[-2:])
    assert compared[0].agg(F.sum(F.size(a) * F.size(b))).first()[0] <= 21 * 21


def test_weighted_neighbours_search_once_a_modality(spark):
    asked = []

    def search(df, key, vector, k, metric):
        asked.append((vector, k))
        return vectors.exact_neighbours(df, key, vector, k, metric)

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist()) for i in range(40)], "k long, u array<double>, v array<double>")
    assert multimodal.weighted_neighbours(df, "k", "u", "v", 5, 8, 4, search).count() == 200
    assert asked == [("u", 8), ("v", 8)]
