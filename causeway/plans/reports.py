"""Further queries: preparation, lists, paths, communities and reports, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.tables import small
from causeway.operators import community, edges, granger, graph, paths, preprocess, ranking
from causeway.sources.adapters import EV_SQL, LI_SQL, embedding_series, event_replicates, supplier_replicates

from .registry import _TWO, _WEIGHED, EDGE_SQL, FREQ_SQL, GOI, HALVES_SQL, NET_SQL, P_EDGE, PARTS_SQL, RUNS, _frequency, _partitions, _probes, gc_edges, halves, network, query, rounded

# --- Preparation ---------------------------------------------------------------------------


@query(f"WITH r AS ({LI_SQL}), g AS (SELECT gene, exp(avg(ln(nullif(value, 0)))) AS gm FROM r GROUP BY gene), f AS (SELECT t, rep, quantile_cont(value / gm, 0.5) AS q FROM r JOIN g USING (gene) WHERE gm IS NOT NULL GROUP BY t, rep), x AS (SELECT gene, t, ln(1 + value / CASE WHEN q > 0 THEN q ELSE 1 END) AS value FROM r JOIN f USING (t, rep)), w AS (SELECT *, 1 / (1 + abs(value - median(value) OVER (PARTITION BY gene, t))) AS w FROM x) SELECT gene, t, round(sum(w * value) / sum(w), 6) AS value FROM w GROUP BY gene, t")
def prep_two_phase(spark, sf_dir):
    """Size factors and log1p before a robust mean of the replicates."""
    done, _ = preprocess.prepare(supplier_replicates(spark, sf_dir), "deseq2", "log+1", "robust")
    return done.select("gene", "t", F.round("value", 6).alias("value"))


@query(f"WITH r AS ({LI_SQL}), a AS (SELECT gene, t, median(sqrt(value)) AS value FROM r GROUP BY gene, t), s AS (SELECT t, avg(value) AS mu, stddev_samp(value) AS sd FROM a GROUP BY t) SELECT gene, t, round(coalesce((value - mu) / nullif(sd, 0), 0), 6) AS value FROM a JOIN s USING (t)")
def prep_zscore_last(spark, sf_dir):
    """z-scores follow the aggregation, the transform goes before it."""
    done, _ = preprocess.prepare(supplier_replicates(spark, sf_dir), "z-score", "sqrt", "median")
    return done.select("gene", "t", F.round("value", 6).alias("value"))


@query(f"WITH r AS ({LI_SQL}), s AS (SELECT t, rep, avg(value) AS mu, stddev_samp(value) AS sd FROM r GROUP BY t, rep) SELECT gene, t, rep, round(coalesce((value - mu) / nullif(sd, 0), 0), 6) AS value FROM r JOIN s USING (t, rep)")
def prep_zscore_samples(spark, sf_dir):
    return preprocess.normalise_and_transform(supplier_replicates(spark, sf_dir), "zscore", sample=("t", "rep")).select("gene", "t", "rep", F.round("value", 6).alias("value"))


@query(f"WITH r AS ({EV_SQL}) SELECT gene, t, rep, CASE WHEN value > 0 THEN round(ln(value), 6) END AS value FROM r")
def prep_natural_log(spark, sf_dir):
    return preprocess.natural_log(event_replicates(spark, sf_dir)).select("gene", "t", "rep", F.round("value", 6).alias("value"))


@query(f"WITH {EDGE_SQL} SELECT gene1, gene2, round(-log10(greatest(p_value, 1e-300)), 6) AS score FROM e")
def minus_log10(spark, sf_dir):
    return preprocess.minus_log10(gc_edges(spark, sf_dir)).select("gene1", "gene2", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS gene, CASE WHEN p_brand ~ '^[0-9]+$' THEN p_brand::DOUBLE ELSE coalesce(try_cast(regexp_replace(p_brand, 'Brand#', '') AS DOUBLE), 0) END AS value FROM part")
def to_number(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return preprocess.to_number(part.select(F.col("p_partkey").alias("gene"), F.regexp_replace("p_brand", "Brand#", "").alias("value")))


@query(f"WITH r AS (SELECT *, p_key AS pos FROM (SELECT p_partkey AS p_key, p_name AS gene, p_size AS t, p_retailprice AS value FROM part)), w AS (SELECT *, 1 / (1 + abs(value - median(value) OVER (PARTITION BY gene, t))) AS w FROM r), f AS (SELECT gene, min(pos) AS pos FROM r GROUP BY gene) SELECT f.pos, gene, t, round(sum(w * value) / sum(w), 6) AS value FROM w JOIN f USING (gene) GROUP BY f.pos, gene, t")
def collapse_dup_robust(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("gene"), F.col("p_size").alias("t"), F.col("p_retailprice").alias("value"))
    return preprocess.collapse_duplicates(part, "robust").withColumn("value", F.round("value", 6))


@query("SELECT user_id AS gene, day(ts)::INT AS t, 'WT_d' || day(ts) || '_' || event_type AS rep, round(sum(value), 6) AS value FROM events WHERE user_id % 3 = 0 GROUP BY ALL")
def replicate_columns(spark, sf_dir):
    """Sample columns by their labels: every third user's are wild type."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("user_id") % 3 == 0, "WT_d").otherwise("KO_d")
    m = ev.groupBy(F.col("user_id").alias("gene"), F.concat(kind, F.dayofmonth("ts"), F.lit("_"), "event_type").alias("label")).agg(F.sum("value").alias("value"))
    return preprocess.day_replicates(m, "wild_type").withColumn("value", F.round("value", 6))


@query(f"WITH r AS ({EV_SQL}) SELECT t, count(DISTINCT rep) AS n, count(DISTINCT rep) = 5 AS ok FROM r GROUP BY t")
def replicates_per_day(spark, sf_dir):
    return preprocess.replicates_per_day(event_replicates(spark, sf_dir), 5)


@query(f"WITH r AS ({LI_SQL}), a AS (SELECT gene, t, avg(value) AS value FROM r GROUP BY gene, t), w AS (SELECT DISTINCT l_suppkey AS gene, l_suppkey * 7 % 11 AS pos FROM lineitem WHERE l_suppkey % 10 = 1) SELECT w.pos, gene, t, NULL AS rep, round(a.value, 6) AS value FROM a JOIN w USING (gene) UNION ALL SELECT w.pos, gene, t, rep, round(r.value, 6) FROM r JOIN w USING (gene)")
def expression_traces(spark, sf_dir):
    m = supplier_replicates(spark, sf_dir)
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey % 10 = 1").select(F.col("l_suppkey").alias("gene"), (F.col("l_suppkey") * 7 % 11).alias("pos")).distinct()
    return preprocess.traces(preprocess.aggregate_replicates(m), m, wanted).withColumn("value", F.round("value", 6))


@query(f"WITH {EDGE_SQL}, x AS (SELECT gene1 AS gene, 0 AS i, 1 AS o FROM e UNION ALL SELECT gene2, 1, 0 FROM e), d AS (SELECT gene, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i + o)::BIGINT AS total_degree FROM x GROUP BY gene ORDER BY total_degree DESC, gene LIMIT 15) SELECT gene, kind, degree FROM (UNPIVOT d ON in_degree, out_degree, total_degree INTO NAME kind VALUE degree)")
def degrees_long(spark, sf_dir):
    return preprocess.unpivot_degrees(edges.degrees(gc_edges(spark, sf_dir)), 15)


@query("SELECT a.vec_id AS gene1, b.vec_id AS gene2, a.vec_id * (n - 1) + CASE WHEN b.vec_id < a.vec_id THEN b.vec_id ELSE b.vec_id - 1 END AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id, (SELECT count(*) AS n FROM embeddings) WHERE a.label = 0 OR b.label = 0")
def pair_index(spark, sf_dir):
    genes = embedding_series(spark, sf_dir).select("gene")
    return granger.pair_index(granger.probe_pairs(genes, _probes(spark, sf_dir)), genes.withColumn("pos", F.col("gene")))


@query("WITH p AS (SELECT vec_id AS g FROM embeddings WHERE label = 0), t AS (SELECT vec_id AS g FROM embeddings ORDER BY vec_id LIMIT 150) SELECT p.g AS gene1, t.g AS gene2, 1 AS lag, 0.001::DOUBLE AS p_value FROM p JOIN t ON p.g <> t.g UNION SELECT t.g, p.g, 1, 0.001::DOUBLE FROM p JOIN t ON p.g <> t.g")
def fixture_pairs(spark, sf_dir):
    genes = embedding_series(spark, sf_dir).select("gene", F.col("gene").alias("pos"))
    return granger.fixture_pairs(_probes(spark, sf_dir), genes)


# --- Lists and edges -----------------------------------------------------------------------

_LISTS = "a AS (SELECT vec_id AS gene FROM embeddings WHERE label < 6), b AS (SELECT vec_id AS gene FROM embeddings WHERE label > 3)"
_OVERLAP = f"{_LISTS}, n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a SEMI JOIN b USING (gene)) AS o)"


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "gene")
    return emb.where("label < 6").select("gene"), emb.where("label > 3").select("gene")


@query(f"WITH {_LISTS} SELECT coalesce(a.gene, b.gene) AS gene, CASE WHEN b.gene IS NULL THEN 'only_a' WHEN a.gene IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.gene = b.gene")
def gene_list_difference(spark, sf_dir):
    return edges.list_difference(*_lists(spark, sf_dir))


@query(f"WITH {_OVERLAP} SELECT nb AS n_seeds, na AS n_expanded, o AS n_overlap, na - o AS n_new, round(100.0 * o / na, 8) AS overlap_percent, round(100.0 * (na - o) / na, 8) AS new_percent, round(100.0 * o / nb, 8) AS retention_percent FROM n")
def gene_set_growth(spark, sf_dir):
    return rounded(edges.growth(*_lists(spark, sf_dir)), "overlap_percent", "new_percent", "retention_percent")


@query(f"WITH {_OVERLAP} SELECT na AS n_left, nb AS n_right, o AS n_overlap, round(100.0 * o / na, 8) AS left_percent, round(100.0 * o / nb, 8) AS right_percent, 100.0 * o / na >= 95 AND 100.0 * o / nb >= 95 AS alike FROM n")
def gene_list_overlap(spark, sf_dir):
    return rounded(edges.list_overlap(*_lists(spark, sf_dir)), "left_percent", "right_percent")


@query(f"WITH {EDGE_SQL}, p AS (SELECT vec_id AS g FROM embeddings WHERE label = 0 AND vec_id <> 0) SELECT gene1, gene2, round(p_value, 8) AS p_value FROM e WHERE (gene1 = 0 AND gene2 IN (FROM p)) OR (gene2 = 0 AND gene1 IN (FROM p))")
def pairwise_goi(spark, sf_dir):
    return rounded(edges.pairwise(gc_edges(spark, sf_dir), GOI, _probes(spark, sf_dir)), "p_value")


@query(f"WITH {EDGE_SQL}, p AS (SELECT vec_id FROM embeddings WHERE label = 0) SELECT gene1, gene2 FROM e WHERE (gene1 = 0 AND gene2 IN (FROM p)) OR (gene2 = 0 AND gene1 IN (FROM p))")
def connection_goi(spark, sf_dir):
    return edges.connection(gc_edges(spark, sf_dir), _probes(spark, sf_dir), "goi", GOI).select("gene1", "gene2")


@query(f"WITH {EDGE_SQL}, n AS (SELECT count(*) * (count(*) - 1) AS a FROM embeddings) SELECT count(*) AS rows_written, any_value(a)::BIGINT AS pairs_attempted, round(count(*) / any_value(a), 8) AS coverage_fraction, count(*) = any_value(a) AS appears_complete FROM e, n")
def gc_coverage(spark, sf_dir):
    n = embedding_series(spark, sf_dir).count()
    return rounded(edges.coverage(gc_edges(spark, sf_dir), n * (n - 1)), "coverage_fraction")


@query("SELECT o_custkey AS gene1, l_suppkey AS gene2, round(arg_min(l_discount, l_orderkey * 10 + l_linenumber + l_discount + l_tax / 100), 8) AS p_value, round(arg_min(l_tax, l_orderkey * 10 + l_linenumber + l_discount + l_tax / 100), 8) AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def edges_first_wins(spark, sf_dir):
    li, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    e = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("gene1"), F.col("l_suppkey").alias("gene2"), F.col("l_discount").alias("p_value"), F.col("l_tax").alias("tax"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_discount") + F.col("l_tax") / 100).alias("pos"))
    return rounded(edges.first_edges(e, "pos").select("gene1", "gene2", "p_value", "tax"), "p_value", "tax")


@query("WITH x AS (SELECT o_custkey AS gene1, l_suppkey AS gene2, arg_max(l_discount, l_orderkey * 10 + l_linenumber + l_discount + l_tax / 100) AS d, arg_max(l_tax, l_orderkey * 10 + l_linenumber + l_discount + l_tax / 100) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT gene1, gene2, round(d, 8) AS p_value, round(t, 8) AS p_second, round((d + t) / 2, 8) AS p_mean FROM x")
def edges_two_values(spark, sf_dir):
    li, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    e = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("gene1"), F.col("l_suppkey").alias("gene2"), F.col("l_discount").alias("p_value"), F.col("l_tax").alias("p_second"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_discount") + F.col("l_tax") / 100).alias("pos"))
    return rounded(edges.digraph(e, "pos", "p_second"), "p_value", "p_second", "p_mean")


@query(f"WITH {EDGE_SQL}, p AS (SELECT vec_id AS gene FROM embeddings WHERE label = 0), i AS (SELECT * FROM e WHERE p_value <= 0.005 AND gene1 IN (FROM p) AND gene2 IN (FROM p)) SELECT gene, gene NOT IN (SELECT gene1 FROM i UNION SELECT gene2 FROM i) AS isolated FROM p")
def induced_nodes(spark, sf_dir):
    return edges.induced_network(graph._cut(gc_edges(spark, sf_dir), "edges"), _probes(spark, sf_dir), 0.005)[1]


@query(f"WITH {EDGE_SQL}, p AS (SELECT vec_id FROM embeddings WHERE label = 0), um AS (SELECT least(gene1, gene2) AS u, greatest(gene1, gene2) AS v, min(p_value) AS w FROM e GROUP BY ALL) SELECT u, v, round(w + CASE WHEN u IN (FROM p) AND v IN (FROM p) THEN 0 ELSE 0.25 END, 8) AS w FROM um")
def undirected_hop_penalty(spark, sf_dir):
    return rounded(edges.penalised(granger.undirected(embedding_series(spark, sf_dir), P_EDGE), _probes(spark, sf_dir), 0.25), "w")


@query(f"WITH {EDGE_SQL} SELECT gene1, gene2 FROM e WHERE p_value <= 0.001")
def candidate_graph_legacy(spark, sf_dir):
    return edges.candidates(gc_edges(spark, sf_dir), None, 0.02, 0.001).select("gene1", "gene2")


@query(f"WITH {PARTS_SQL}, {EDGE_SQL}, c AS (SELECT gene FROM parts WHERE run = 7 AND community IN (1, 3)) SELECT gene1, gene2 FROM e WHERE gene1 IN (FROM c) AND gene2 IN (FROM c)")
def community_filter(spark, sf_dir):
    return edges.of_communities(gc_edges(spark, sf_dir), _partitions(spark, sf_dir).where("run = 7"), [1, 3]).select("gene1", "gene2")


@query(f"WITH {EDGE_SQL}, {FREQ_SQL}, k AS (SELECT unnest([0.1, 0.2, 0.4])::DOUBLE AS cutoff), md AS (SELECT k.cutoff, mode FROM k, (VALUES ('both'), ('any')) t(mode)), sd AS (SELECT cutoff, gene FROM freq JOIN k ON frequency >= cutoff), xe AS (SELECT md.cutoff, md.mode, gene1, gene2 FROM md JOIN e ON (mode = 'both' AND EXISTS (SELECT 1 FROM sd WHERE sd.cutoff = md.cutoff AND sd.gene = gene1) AND EXISTS (SELECT 1 FROM sd WHERE sd.cutoff = md.cutoff AND sd.gene = gene2)) OR (mode = 'any' AND (EXISTS (SELECT 1 FROM sd WHERE sd.cutoff = md.cutoff AND sd.gene = gene1) OR EXISTS (SELECT 1 FROM sd WHERE sd.cutoff = md.cutoff AND sd.gene = gene2)))) SELECT md.cutoff, md.mode, (SELECT count(*) FROM sd WHERE sd.cutoff = md.cutoff) AS seed_genes, (SELECT count(*) FROM (SELECT gene1 FROM xe WHERE xe.cutoff = md.cutoff AND xe.mode = md.mode UNION SELECT gene2 FROM xe WHERE xe.cutoff = md.cutoff AND xe.mode = md.mode)) AS nodes, (SELECT count(*) FROM xe WHERE xe.cutoff = md.cutoff AND xe.mode = md.mode) AS edges FROM md")
def cutoff_sweep(spark, sf_dir):
    return edges.cutoff_sweep(gc_edges(spark, sf_dir), graph._cut(_frequency(spark, sf_dir), "freq"), [0.1, 0.2, 0.4], once=True)


@query(f"WITH {EDGE_SQL}, x AS (SELECT -log10(greatest(p_value, 1e-300)) AS x FROM e), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT least(floor((x - lo) / ((hi - lo) / 60)), 59)::INT AS bin, round(lo + least(floor((x - lo) / ((hi - lo) / 60)), 59) * ((hi - lo) / 60), 6) AS low, count(*) AS n FROM x, s GROUP BY ALL")
def log_histogram(spark, sf_dir):
    return ranking.log_histogram(graph._cut(gc_edges(spark, sf_dir), "edges")).withColumn("low", F.round("low", 6))


@query(f"WITH {EDGE_SQL} SELECT floor((p_value - 0.0) / 0.05 * 20)::INT AS bin, count(*) AS n FROM e WHERE p_value < 0.05 GROUP BY ALL")
def histogram_drill_down(spark, sf_dir):
    return ranking.drill_down(gc_edges(spark, sf_dir), 0)


# --- Graphs and paths ----------------------------------------------------------------------

_DIST = f"{_WEIGHED}, d(gene, dist) USING KEY (gene) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT s.v, min(d.dist + s.w) FROM d JOIN s ON s.u = d.gene LEFT JOIN recurring.d AS r ON r.gene = s.v WHERE r.dist IS NULL OR d.dist + s.w < r.dist GROUP BY s.v)"
_NECK = "b(gene, dist) USING KEY (gene) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT s.v, min(greatest(b.dist, s.w)) FROM b JOIN s ON s.u = b.gene LEFT JOIN recurring.b AS r ON r.gene = s.v WHERE r.dist IS NULL OR greatest(b.dist, s.w) < r.dist GROUP BY s.v)"


@query(f"WITH RECURSIVE {NET_SQL}, {_DIST}, {_NECK} SELECT vec_id AS terminal, round(d.dist, 6) AS minsum_totalweight, round(b.dist, 6) AS bottleneck_p FROM embeddings LEFT JOIN d ON d.gene = vec_id LEFT JOIN b ON b.gene = vec_id WHERE label = 0")
def path_summary(spark, sf_dir):
    """Both kinds of paths from the probes; their lengths may tie and are left out of the comparison."""
    return paths.combined_summary(*_path_tables(spark, sf_dir)).select("terminal", "minsum_totalweight", "bottleneck_p")


def _path_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, probes = network(spark, sf_dir), _probes(spark, sf_dir)
    links = paths.links_of(e)
    a = paths.path_table(graph._cut(paths.paths_to(e, GOI, links=links), "paths"), probes)
    b = paths.path_table(graph._cut(paths.paths_to(e, GOI, bottleneck=True, links=links), "paths"), probes, weight="bottleneck_p")
    return a, b


@query()
def path_tables(spark, sf_dir):
    """Least-sum paths with their genes."""
    return paths.path_table(paths.paths_to(network(spark, sf_dir), GOI), _probes(spark, sf_dir))


@query(f"WITH RECURSIVE {NET_SQL}, {_DIST}, {_NECK}, x AS (SELECT round(d.dist, 6) AS d, round(b.dist, 6) AS b FROM embeddings LEFT JOIN d ON d.gene = vec_id LEFT JOIN b ON b.gene = vec_id WHERE label = 0) SELECT count(d) AS path_n, round(coalesce(sum(d), 0), 6) AS minsum_cost_sum, round(coalesce(sum(b), 0), 6) AS minmax_bottleneck_sum, round(coalesce(sum(d), 0) / greatest(count(d), 1), 6) AS minsum_cost_mean FROM x")
def path_metrics(spark, sf_dir):
    m = paths.path_metrics(*_path_tables(spark, sf_dir))
    return m.select("path_n", *[F.round(c, 6).alias(c) for c in ("minsum_cost_sum", "minmax_bottleneck_sum", "minsum_cost_mean")])


@query(f"WITH RECURSIVE {NET_SQL}, {_DIST}, x AS (SELECT vec_id AS terminal, round(dist, 6) AS w FROM embeddings LEFT JOIN d ON gene = vec_id), t AS (SELECT quantile_cont(w, 0.05) AS thr FROM x) SELECT terminal, w AS total_weight, 0.05::DOUBLE AS minsum_q, round(thr, 8) AS minsum_thr, coalesce(w <= thr, false) AS keep_minsum_q FROM x, t")
def path_quantile_flags(spark, sf_dir):
    e = network(spark, sf_dir)
    dist = graph.distances(e, GOI).withColumn("dist", F.round("dist", 6))
    t = embedding_series(spark, sf_dir).select("gene").join(dist, "gene", "left").select(F.col("gene").alias("terminal"), F.col("dist").alias("total_weight"))
    return rounded(paths.quantile_flags(graph._cut(t, "flags"), {"minsum": "total_weight"}), "minsum_thr")


# --- Communities and rankings --------------------------------------------------------------

_COUNTS = "n AS (SELECT x.gene AS a, y.gene AS b, count(*) AS n FROM parts x JOIN parts y ON x.run = y.run AND x.community = y.community AND x.gene <= y.gene GROUP BY ALL)"


@query(f"WITH {PARTS_SQL}, {_COUNTS} SELECT a, b, round(n / {RUNS}, 8) AS share FROM n")
def coassociation_incremental(spark, sf_dir):
    """Twelve runs counted first, the other eight added."""
    p = _partitions(spark, sf_dir)
    counts = community.add_runs(community.together(p.where("run < 12")), p.where("run >= 12"))
    return rounded(community.shares(community.expanded(counts), RUNS), "share")


@query(f"WITH {PARTS_SQL}, {_COUNTS}, f AS (SELECT n / {RUNS} AS v FROM n UNION ALL SELECT n / {RUNS} FROM n WHERE a <> b), q AS (SELECT unnest([0.9, 0.95])::DOUBLE AS q) SELECT q, round(CASE q WHEN 0.9::DOUBLE THEN (SELECT quantile_cont(v, 0.9) FROM f) ELSE (SELECT quantile_cont(v, 0.95) FROM f) END, 8) AS value FROM q")
def coassoc_quantiles(spark, sf_dir):
    return rounded(community.coassociation_quantiles(community.together(_partitions(spark, sf_dir)), RUNS), "value")


@query(f"WITH {PARTS_SQL}, home AS (SELECT run, community FROM parts WHERE gene = 0) SELECT DISTINCT gene FROM parts SEMI JOIN home USING (run, community)")
def ever_with_goi(spark, sf_dir):
    return community.ever_together(_partitions(spark, sf_dir), GOI)


_MATRIX = "ALL_ AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <= b.vec_id)"


@query(f"WITH {PARTS_SQL}, p1 AS (SELECT x.gene AS a, y.gene AS b, count(*) AS n FROM (FROM parts WHERE run < 15) x JOIN parts y ON x.run = y.run AND x.community = y.community AND x.gene <= y.gene GROUP BY ALL), {_COUNTS}, {_MATRIX}, d AS (SELECT a, b, abs(coalesce(p1.n, 0) / 15 - coalesce(n.n, 0) / {RUNS}) / greatest(coalesce(p1.n, 0) / 15, 1e-9) AS d FROM ALL_ LEFT JOIN p1 USING (a, b) LEFT JOIN n USING (a, b)), f AS (SELECT d FROM d UNION ALL SELECT d FROM d WHERE a <> b) SELECT round(quantile_cont(d, 0.9), 6) AS rel_change FROM f")
def matrix_change(spark, sf_dir):
    p = _partitions(spark, sf_dir)
    prev, curr = (community.together(x) for x in (p.where("run < 15"), p))
    return community.matrix_change(prev, 15, curr, RUNS).select(F.round("rel_change", 6).alias("rel_change"))


@query()
def consensus_clusters(spark, sf_dir):
    return community.consensus_clusters(graph._cut(_partitions(spark, sf_dir), "parts"))


_RUN7 = "c AS (SELECT gene, community FROM parts WHERE run = 7)"


@query(f"WITH {PARTS_SQL}, {_RUN7}, s AS (SELECT community, count(*) AS n, bool_or(gene = 0) AS own FROM c GROUP BY community) SELECT count(*) AS communities, max(n) AS largest, bool_or(own) AS present, max(community) FILTER (own) AS home, max(n) FILTER (own) AS home_size FROM s")
def consensus_metrics(spark, sf_dir):
    return community.consensus_metrics(_partitions(spark, sf_dir).where("run = 7"), GOI)


@query(f"WITH {PARTS_SQL}, {_RUN7}, h AS (SELECT community FROM c WHERE gene = 0), s AS (SELECT community, count(*) AS n FROM c GROUP BY community) SELECT count(*) AS communities, max(n) AS largest, (SELECT community FROM h) AS home, (SELECT count(*) FROM c SEMI JOIN h USING (community)) AS home_size, (SELECT string_agg(gene, ',' ORDER BY gene) FROM c SEMI JOIN h USING (community)) AS home_genes FROM s")
def subcommunity_summary(spark, sf_dir):
    s = community.subcommunities(_partitions(spark, sf_dir).where("run = 7"), GOI)
    return s.withColumn("home_genes", F.array_join(F.transform("home_genes", lambda g: g.cast("string")), ","))


@query(f"WITH {PARTS_SQL}, {EDGE_SQL}, {_RUN7}, own AS (SELECT gene FROM c WHERE community = (SELECT community FROM c WHERE gene = 0)), i AS (SELECT * FROM e WHERE gene1 IN (FROM own) AND gene2 IN (FROM own)) SELECT gene, (SELECT count(*) FROM i WHERE gene1 = gene) AS out_degree, (SELECT count(*) FROM i WHERE gene2 = gene) AS in_degree, (gene % 4 = 0)::INT AS is_steiner FROM own")
def community_export(spark, sf_dir):
    series, parts = embedding_series(spark, sf_dir), _partitions(spark, sf_dir).where("run = 7")
    # Only edges inside the community count, so only its genes are tested.
    own = series.join(small(community.community_of(parts, GOI)), "gene", "left_semi")
    e = graph._cut(granger.granger(own, max_p=P_EDGE).select("gene1", "gene2", "p_value"), "edges")
    return community.community_export(e, parts, GOI, series.select("gene").where("gene % 4 = 0"))[0]


_TOP = "top AS (SELECT gene FROM freq ORDER BY frequency DESC, lower(gene::VARCHAR), gene LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM freq)), sel AS (FROM top UNION SELECT 0)"


@query(f"WITH {FREQ_SQL}, {_TOP} SELECT gene, round(frequency, 8) AS frequency FROM freq SEMI JOIN sel USING (gene)")
def top_consensus(spark, sf_dir):
    return rounded(ranking.top_consensus(_frequency(spark, sf_dir), 0.1, GOI), "frequency")


@query(f"WITH {FREQ_SQL}, {EDGE_SQL}, {_TOP} SELECT gene1, gene2 FROM e WHERE p_value <= 0.02 AND gene1 IN (FROM sel) AND gene2 IN (FROM sel)")
def top_consensus_network(spark, sf_dir):
    return community.top_consensus_network(graph._cut(gc_edges(spark, sf_dir), "edges"), _frequency(spark, sf_dir), 0.1, GOI, 0.02)[0].select("gene1", "gene2")


@query(f"WITH {FREQ_SQL}, k AS (SELECT * FROM freq WHERE gene > 5), top AS (SELECT gene, frequency FROM k ORDER BY frequency DESC, lower(gene::VARCHAR), gene LIMIT (SELECT ceil(count(*) * 0.07)::BIGINT FROM k)) SELECT gene, round(frequency, 8) AS frequency FROM top UNION ALL SELECT 0, NULL")
def probe_goi_inserted(spark, sf_dir):
    """The gene of interest is not in the table: it is put in all the same."""
    return rounded(ranking.top_percent(_frequency(spark, sf_dir).where("gene > 5"), 7, GOI), "frequency")


@query(f"WITH {FREQ_SQL}, k AS (SELECT * FROM freq WHERE frequency >= 0.2) SELECT gene, round(frequency, 8) AS frequency FROM k ORDER BY k.frequency DESC, lower(gene::VARCHAR), gene LIMIT (SELECT greatest(1, floor(count(*) * 0.05))::BIGINT FROM k)")
def legacy_top_floor(spark, sf_dir):
    return rounded(ranking.legacy_selection(graph._cut(_frequency(spark, sf_dir), "freq"), 0.2, 5), "frequency")


@query(f"WITH {FREQ_SQL}, k AS (SELECT gene FROM freq ORDER BY frequency DESC, lower(gene::VARCHAR), gene LIMIT 40) SELECT count(*) AS n, count(*) FILTER (gene NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)) AS n_new, count(*) FILTER (gene IN (SELECT vec_id FROM embeddings WHERE label = 0)) AS n_known FROM k")
def annotated_counts(spark, sf_dir):
    return ranking.new_counts(ranking.annotate_new(_frequency(spark, sf_dir), _probes(spark, sf_dir), 40))


@query(f"WITH {FREQ_SQL} SELECT gene, round(frequency, 8) AS frequency FROM freq ORDER BY freq.frequency DESC, lower(gene::VARCHAR), gene LIMIT 25")
def priority_head(spark, sf_dir):
    return rounded(ranking.head(_frequency(spark, sf_dir), 25), "frequency")


@query(f"WITH {_TWO}, x AS (SELECT coalesce(a.frequency, 0) AS p, coalesce(b.frequency, 0) AS c FROM (FROM freq WHERE gene % 7 <> 0) a FULL JOIN freq2 b ON a.gene = b.gene), o AS (SELECT count(*) AS hits FROM (SELECT gene FROM freq WHERE gene % 7 <> 0 ORDER BY frequency DESC, gene LIMIT 30) JOIN (SELECT gene FROM freq2 ORDER BY frequency DESC, gene LIMIT 30) USING (gene)) SELECT round(quantile_cont(abs(p - c) / greatest((p + c) / 2, 1e-9), 0.9), 8) AS rel_change, count(*) AS n_common, round(100.0 * any_value(o.hits) / 30, 8)::DOUBLE AS overlap FROM x, o")
def stability_union(spark, sf_dir):
    """Over all genes of either ranking, by their mean, with a given K."""
    prev, curr = _frequency(spark, sf_dir).where("gene % 7 <> 0"), _frequency(spark, sf_dir, RUNS + 5)
    return rounded(ranking.stability(prev, curr, denominator="mean", rows="union", top_k=30), "rel_change", "overlap")


@query(f"WITH {HALVES_SQL}, l AS (SELECT gene1, gene2, p_value, (gene1 % 3)::INT AS lag FROM a), r AS (SELECT gene1, gene2, CASE WHEN gene2 % 50 = 0 THEN NULL ELSE p_value END AS p_value, (gene1 % 2)::INT AS lag FROM a WHERE gene2 % 7 <> 0) SELECT (SELECT count(*) FROM l) AS n_reference, (SELECT count(*) FROM r) AS n_candidate, count(*) FILTER (l.gene1 IS NOT NULL AND r.gene1 IS NOT NULL) AS shared, count(*) FILTER (r.gene1 IS NULL) AS missing, count(*) FILTER (l.gene1 IS NULL) AS extra, count(*) FILTER (l.gene1 IS NOT NULL AND r.gene1 IS NOT NULL AND r.p_value IS NULL) AS p_differs, 0.0::DOUBLE AS max_diff, count(*) FILTER (l.gene1 IS NOT NULL AND r.gene1 IS NOT NULL AND r.p_value IS NULL) AS flips FROM l FULL JOIN r ON l.gene1 = r.gene1 AND l.gene2 = r.gene2 AND l.lag = r.lag")
def gc_parity_lag(spark, sf_dir):
    """Keys with lags; a p-value that one table lacks differs and flips."""
    a = graph._cut(halves(spark, sf_dir)[0], "half")
    left = a.withColumn("lag", (F.col("gene1") % 3).cast("int"))
    right = a.where("gene2 % 7 <> 0").select("gene1", "gene2", F.when(F.col("gene2") % 50 != 0, F.col("p_value")).alias("p_value"), (F.col("gene1") % 2).cast("int").alias("lag"))
    return ranking.edge_parity(left, right, 1e-6, 0.05)
