"""Queries of joins, deduplication, reshaping, set operations and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.functions.transforms import finite
from lodestone.operators import assembly
from lodestone.operators import metrics as m
from lodestone.operators import registry as reg
from lodestone.operators import relational as rel
from lodestone.operators.ranks import percentiles
from lodestone.plans.catalog import COMPOUNDS_SQL, PREDICTIONS_SQL, big, compounds, predictions, query, r6, rounded, table
from lodestone.sources import readers

C = f"WITH {COMPOUNDS_SQL}"
P = f"WITH {PREDICTIONS_SQL}"


@query("dedup_prefer_internal", f"{C} SELECT doc_id, source, _ik FROM (SELECT *, row_number() OVER (PARTITION BY _ik ORDER BY CASE WHEN source = 'internal' THEN 0 ELSE 1 END, doc_id) r FROM c) WHERE r = 1")
def dedup_prefer_internal(s, d):
    return rel.prefer_source(compounds(s, d), ["_ik"], F.col("source"), "internal", [F.col("doc_id")]).select("doc_id", "source", "_ik")


@query("dedup_keep_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def dedup_keep_first(s, d):
    return rel.keep_first(table(s, d, "part"), ["p_name"], [F.col("p_partkey")]).select("p_name", "p_partkey")


@query("group_last", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def group_last(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("first_non_null", f"{C} SELECT origin, arg_min(label, doc_id) FILTER (label IS NOT NULL) IS NOT NULL AS has_label, round(arg_min(label, doc_id) FILTER (label IS NOT NULL), 6) + 0.0 AS label, arg_min(quality, doc_id) FILTER (quality IS NOT NULL) AS quality FROM c GROUP BY origin")
def first_non_null(s, d):
    out = rel.first_values(compounds(s, d), ["origin"], ["label", "quality"], F.col("doc_id"))
    return out.select("origin", F.col("label").isNotNull().alias("has_label"), r6("label").alias("label"), "quality")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("first_non_null_wide", "SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (event_type = '{k}') AS \"{k}\"" for k in TYPES) + " FROM events GROUP BY user_id")
def first_non_null_wide(s, d):
    return rel.long_to_wide(table(s, d, "events"), ["user_id"], "event_type", "value", TYPES, F.col("event_id"))


@query("wide_to_long", "SELECT p_partkey, name AS endpoint, round(value, 2) + 0.0 AS value FROM (UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME name VALUE value)")
def wide_to_long(s, d):
    rows = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rel.wide_to_long(rows, ["p_partkey"], ["p_size", "p_retailprice"]).withColumn("value", F.round("value", 2) + F.lit(0.0))


@query("wide_consolidation", "SELECT l_orderkey, " + ", ".join(f"round(avg(l_quantity) FILTER (l_returnflag = '{k}'), 6) + 0.0 AS q_{k.lower()}" for k in "ANR") + ", count(*) AS n FROM lineitem GROUP BY l_orderkey")
def wide_consolidation(s, d):
    cells = [r6(F.avg(F.when(F.col("l_returnflag") == k, F.col("l_quantity")))).alias(f"q_{k.lower()}") for k in "ANR"]
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(*cells, F.count(F.lit(1)).alias("n"))


@query("natural_join_inner", "SELECT r_name, count(*) AS n FROM (SELECT n_nationkey, n_regionkey AS r_regionkey FROM nation) NATURAL JOIN region GROUP BY r_name")
def natural_join_inner(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return rel.natural_join(n, table(s, d, "region")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("natural_join_left", "SELECT doc_id, lang, quality, toxic FROM (SELECT doc_id, lang FROM documents) NATURAL LEFT JOIN labels")
def natural_join_left(s, d):
    return rel.natural_join(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "left")


@query("keyed_join_counts", "SELECT count(*) AS matched, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey")
def keyed_join_counts(s, d):
    joined = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.agg(F.count(F.lit(1)).alias("matched"), F.countDistinct("o_custkey").alias("customers"))


@query("model_pair_join", f"{P} SELECT a.compound, round(a.pred_y - b.pred_y, 6) + 0.0 AS gap FROM p a JOIN p b ON a.compound = b.compound AND a.arm = 'F' AND b.arm = 'O'")
def model_pair_join(s, d):
    p = predictions(s, d)
    a, b = (p.where(F.col("arm") == x).select("compound", F.col("pred_y").alias(f"y_{x}")) for x in "FO")
    return a.join(b, "compound").select("compound", r6(F.col("y_F") - F.col("y_O")).alias("gap"))


@query("anti_join_leak_exact", f"{C} SELECT doc_id FROM c WHERE source <> 'internal' AND _ik NOT IN (SELECT _ik FROM c WHERE source = 'internal')")
def anti_join_leak_exact(s, d):
    c = compounds(s, d)
    return rel.drop_twins(c.where("source <> 'internal'"), c.where("source = 'internal'")).select("doc_id")


@query("anti_join_leak_skeleton", f"{C} SELECT doc_id FROM c WHERE source <> 'internal' AND substr(_ik, 1, 14) NOT IN (SELECT substr(_ik, 1, 14) FROM c WHERE source = 'internal')")
def anti_join_leak_skeleton(s, d):
    c = compounds(s, d)
    return rel.drop_twins(c.where("source <> 'internal'"), c.where("source = 'internal'"), level="skeleton").select("doc_id")


@query("leak_mask", f"{C} SELECT doc_id, _ik IN (SELECT _ik FROM c WHERE source = 'internal') AS is_twin FROM c WHERE source <> 'internal'")
def leak_mask(s, d):
    c = compounds(s, d)
    return rel.twin_mask(c.where("source <> 'internal'"), c.where("source = 'internal'")).select("doc_id", "is_twin")


@query("semi_join_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_ids(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left_semi")


@query("cache_topup_missing", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def cache_topup_missing(s, d):
    cache = table(s, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rel.missing_ids(table(s, d, "orders").select("o_custkey").distinct(), cache, "o_custkey")


@query("coverage_check", "SELECT count(*) AS n, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def coverage_check(s, d):
    joined = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id").distinct().withColumn("k", F.lit(1)), "doc_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("covered"), F.count_if(F.col("k").isNull()).alias("missing"))


@query("lookup_fill_proxy", f"{C}, x AS (SELECT _ik, arg_min(label, doc_id) AS v FROM c WHERE label IS NOT NULL GROUP BY _ik) SELECT doc_id, round(CASE WHEN source <> 'internal' THEN coalesce(label, v) ELSE label END, 6) + 0.0 AS label FROM c LEFT JOIN x ON c._ik = x._ik")
def lookup_fill_proxy(s, d):
    c = compounds(s, d)
    lookup = c.select("_ik", F.col("label").alias("proxy"), "doc_id")
    out = rel.fill_from(c, lookup, "_ik", "label", "proxy", F.col("source") != "internal", [F.col("doc_id")])
    return out.select("doc_id", r6("label").alias("label"))


@query("aux_join_blank_internal", f"{C}, x AS (SELECT _ik, arg_min(n_chars, doc_id) AS aux FROM c GROUP BY _ik) SELECT doc_id, CASE WHEN source <> 'internal' THEN aux END AS aux FROM c LEFT JOIN x ON c._ik = x._ik")
def aux_join_blank_internal(s, d):
    c = compounds(s, d)
    aux = c.select("_ik", F.col("n_chars").alias("aux"), "doc_id")
    return rel.join_auxiliary(c.drop("aux"), aux, "_ik", ["aux"], F.col("source") == "internal", [F.col("doc_id")]).select(c["doc_id"], "aux")


@query("origin_counts_having", f"{C} SELECT origin, count(*) AS n FROM c WHERE source <> 'internal' GROUP BY origin HAVING count(*) > 28")
def origin_counts_having(s, d):
    return rel.origin_counts(compounds(s, d).where("source <> 'internal'"), "origin", 28)


@query("group_sizes", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def group_sizes(s, d):
    return table(s, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("non_null_counts", f"{C} SELECT count(*) AS n, count(label) AS n_label, count(quality) AS n_quality, count(DISTINCT _ik) AS n_molecules FROM c")
def non_null_counts(s, d):
    return compounds(s, d).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_label"), F.count("quality").alias("n_quality"), F.countDistinct("_ik").alias("n_molecules"))


@query("distribution_summary", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, min(value) AS low, median(value) AS p50, max(value) AS high FROM events GROUP BY event_type")
def distribution_summary(s, d):
    v = "value"
    rows = table(s, d, "events")
    mid = percentiles(rows, ["event_type"], v, [0.5]).select("event_type", F.col("q")[0].alias("p50"))
    return rows.groupBy("event_type").agg(r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high")).join(mid, "event_type")


@query("source_audit_percentiles", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) + 0.0 AS p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lineitem GROUP BY ALL")
def source_audit_percentiles(s, d):
    rows = percentiles(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95])
    return rows.select("l_returnflag", "l_linestatus", *[(F.round(F.col("q")[i], 4) + F.lit(0.0)).alias(f"p{k}") for i, k in enumerate((5, 25, 50, 75, 95))])


@query("collapse_median", "SELECT p_brand, p_type, round(median(p_retailprice), 6) + 0.0 AS solubility, min(p_name) AS smiles FROM part GROUP BY p_brand, p_type")
def collapse_median(s, d):
    rows = table(s, d, "part").select("p_brand", "p_type", F.col("p_retailprice").alias("solubility"), F.col("p_name").alias("smiles"))
    return rounded(readers.collapse(rows, ["p_brand", "p_type"]), "solubility")


@query("dedup_aggregate", "SELECT p_name, round(avg(p_size), 6) + 0.0 AS mean, median(p_size) AS mid, max(p_size) AS high FROM part GROUP BY p_name")
def dedup_aggregate(s, d):
    size = F.col("p_size")
    rows = table(s, d, "part").select("p_name", size.alias("mean"), size.alias("mid"), size.alias("high"))
    return rounded(rel.collapse(rows, ["p_name"], {"mean": "mean", "mid": "median", "high": "max"}), "mean")


@query("union_align", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_align(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return rel.align_union(c, table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("set_difference_ids", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference_ids(s, d):
    return table(s, d, "customer").select("c_custkey").subtract(table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("set_equality", "SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT c_custkey AS b FROM customer) ON a = b")
def set_equality(s, d):
    a, b = table(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    one = a.join(b, "k", "left_anti").agg(F.count(F.lit(1)).alias("only_a"), F.lit(1).alias("x"))
    return one.join(b.join(a, "k", "left_anti").agg(F.count(F.lit(1)).alias("only_b"), F.lit(1).alias("x")), "x").drop("x")


@query("distinct_union", "SELECT count(*) AS n FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)")
def distinct_union(s, d):
    return table(s, d, "documents").select("text").union(table(s, d, "benchmark").select("text")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem)")
def distinct_rows(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("ordered_intersection", "SELECT k AS event_type, place::BIGINT AS place FROM (VALUES ('view', 1), ('gone', 2), ('click', 3)) o(k, place) WHERE k IN (SELECT event_type FROM events)")
def ordered_intersection(s, d):
    order = s.createDataFrame([("view", 1), ("gone", 2), ("click", 3)], "event_type string, place bigint")
    return order.join(table(s, d, "events"), "event_type", "left_semi")


@query("origin_powerset", "SELECT mask::BIGINT AS mask, string_agg(r_name, '+' ORDER BY r_name) AS combo, count(*) AS n FROM generate_series(1, 31) t(mask) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region) ON ((mask >> i) & 1) = 1 GROUP BY mask")
def origin_powerset(s, d):
    subsets = rel.power_set(table(s, d, "region").select("r_name"), "r_name", "r_name")
    return subsets.groupBy(big(F.col("mask")).alias("mask")).agg(F.concat_ws("+", F.array_sort(F.collect_list("r_name"))).alias("combo"), F.count(F.lit(1)).alias("n"))


@query("display_order", "SELECT event_type, n, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def display_order(s, d):
    from pyspark.sql import Window

    rows = rel.display_order(table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", ["view", "click"])
    key = F.array_position(F.array(F.lit("view"), F.lit("click")), F.col("event_type"))
    return rows.withColumn("place", big(F.row_number().over(Window.orderBy(F.when(key > 0, key).otherwise(3), "event_type"))))


@query("sequential_ids", "SELECT p_partkey, 'PUB_' || (row_number() OVER (ORDER BY p_name, p_partkey) - 1) AS compound FROM part")
def sequential_ids(s, d):
    return rel.sequential_ids(table(s, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], "PUB_").select("p_partkey", "compound")


@query("id_batches", "SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 100)::BIGINT AS batch FROM (SELECT DISTINCT p_partkey FROM part)")
def id_batches(s, d):
    return rel.batches(table(s, d, "part"), "p_partkey", 100)


@query("upsert_summary", "SELECT c_mktsegment, count(*) + CASE WHEN c_mktsegment = 'BUILDING' THEN 1000 ELSE 0 END AS n FROM customer GROUP BY c_mktsegment")
def upsert_summary(s, d):
    old = table(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    new = old.where("c_mktsegment = 'BUILDING'").withColumn("n", F.col("n") + 1000)
    return rel.upsert(old, new, ["c_mktsegment"])


@query("missing_stores", "SELECT k AS endpoint FROM (VALUES ('click'), ('hlm'), ('view'), ('ppb')) o(k) WHERE k NOT IN (SELECT event_type FROM events)")
def missing_stores(s, d):
    return readers.missing_stores(s, table(s, d, "events").select(F.col("event_type").alias("endpoint")), ["click", "hlm", "view", "ppb"])


REG_SQL = "r AS (SELECT n_nationkey::BIGINT + 1 AS id, 'exp-' || (n_nationkey % 4) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'rf' ELSE 'cp' END AS framework, 'e' || (n_nationkey % 4) AS endpoint FROM nation)"


def registry_rows(s, d):
    k = F.col("n_nationkey")
    return table(s, d, "nation").select((k.cast("bigint") + 1).alias("id"), F.concat(F.lit("exp-"), k % 4).alias("name"), F.when(k % 2 == 0, "rf").otherwise("cp").alias("framework"), F.concat(F.lit("e"), k % 4).alias("endpoint"))


@query("registry_latest_version", f"WITH {REG_SQL} SELECT name, max(id) AS id FROM r GROUP BY name")
def registry_latest_version(s, d):
    return reg.latest(registry_rows(s, d))


@query("registry_audit", f"""WITH {REG_SQL}, pins(framework, endpoint, id, required) AS (VALUES ('rf', 'e0', 1::BIGINT, true), ('rf', 'e1', NULL, true), ('rf', 'e2', 99, true), ('rf', 'e3', 2, true), ('cp', 'e1', NULL, false))
  SELECT p.framework, p.endpoint, p.id, CASE WHEN p.id IS NULL THEN 'no pin' WHEN r.id IS NULL THEN 'unknown id' ELSE 'other model' END AS problem FROM pins p LEFT JOIN r ON p.id = r.id
  WHERE (p.id IS NULL AND required) OR (p.id IS NOT NULL AND (r.id IS NULL OR r.endpoint <> p.endpoint OR r.framework <> p.framework))""")
def registry_audit(s, d):
    pins = s.createDataFrame([("rf", "e0", 1, True), ("rf", "e1", None, True), ("rf", "e2", 99, True), ("rf", "e3", 2, True), ("cp", "e1", None, False)], "framework string, endpoint string, id bigint, required boolean")
    return reg.audit(pins, registry_rows(s, d))


@query("modelling_frame", f"{C} SELECT doc_id, round(least(label, 3.2), 6) + 0.0 AS label, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN source = 'internal' THEN 0 ELSE 1 END, doc_id) r FROM c WHERE label IS NOT NULL AND doc_id % 10 > 0) WHERE r = 1".replace("3.2)", "log10(1500::DOUBLE))"))
def modelling_frame(s, d):
    c = compounds(s, d)
    long = c.select(F.col("doc_id").alias("compound"), F.col("text").alias("smiles"), "label", "source", "origin", F.lit("n").alias("endpoint"))
    features = c.where("doc_id % 10 > 0").select(F.col("doc_id").alias("compound"), F.col("n_chars").cast("double").alias("F0"))
    out = assembly.modelling_frame(long, features, Endpoint("n", "n_chars", "log10", cap=1500.0), ["F0"])
    return out.select(F.col("compound").alias("doc_id"), r6("label").alias("label"), "source")


@query("training_pools", f"""{C} SELECT 'public' AS pool, count(*) AS n, count(label) AS n_label FROM c WHERE source <> 'internal' AND _ik NOT IN (SELECT _ik FROM c WHERE source = 'internal') AND (label IS NOT NULL OR n_chars > 1000)
  UNION ALL SELECT 'internal', count(*), count(label) FROM c WHERE source = 'internal' AND label IS NOT NULL""")
def training_pools(s, d):
    wide = compounds(s, d).withColumnRenamed("text", "smiles").withColumn("long", F.when(F.col("n_chars") > 1000, F.col("n_chars").cast("double")))
    public, internal = assembly.training_pools(wide, ["label", "long"], "label")
    count = lambda df, name: df.agg(F.lit(name).alias("pool"), F.count(F.lit(1)).alias("n"), F.count("label").alias("n_label"))
    return count(public, "public").union(count(internal, "internal"))


@query("binary_frames", f"{C} SELECT source = 'internal' AS internal, CASE WHEN label >= 3 THEN 1 ELSE 0 END::INTEGER AS class, count(*) AS n FROM c GROUP BY ALL")
def binary_frames(s, d):
    c = compounds(s, d).withColumnRenamed("doc_id", "compound")
    _, _, both = assembly.binary_frames(c.where("source = 'internal'"), c.where("source <> 'internal'"), 3.0)
    return both.groupBy((F.col("source") == "internal").alias("internal"), "class").agg(F.count(F.lit(1)).alias("n"))


@query("minimum_class_guard", "SELECT min(n) AS least FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)")
def minimum_class_guard(s, d):
    return table(s, d, "labels").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))


@query("model_gain_table", f"{P}, q AS (SELECT endpoint, arm, 1 - sum((real_y - pred_y) ** 2) / (var_pop(real_y) * count(*)) AS v FROM p GROUP BY ALL) SELECT a.endpoint, round(a.v, 6) + 0.0 AS f, round(b.v, 6) + 0.0 AS o, round(a.v - b.v, 6) + 0.0 AS gain FROM q a JOIN q b ON a.endpoint = b.endpoint AND a.arm = 'F' AND b.arm = 'O'")
def model_gain_table(s, d):
    q = m.regression(predictions(s, d), ["endpoint", "arm"])
    wide = q.groupBy("endpoint").agg(F.max(F.when(F.col("arm") == "F", F.col("r2det"))).alias("f"), F.max(F.when(F.col("arm") == "O", F.col("r2det"))).alias("o"))
    return rounded(wide.withColumn("gain", F.col("f") - F.col("o")), "f", "o", "gain")


@query("value_override", f"{P} SELECT compound, arm, round(CASE WHEN fold <> 2 THEN pred_y ELSE real_y END, 6) + 0.0 AS value FROM p")
def value_override(s, d):
    from lodestone.operators.serving import override

    p = predictions(s, d).withColumn("x_pred", F.col("real_y")).withColumn("other", F.when(F.col("fold") != 2, F.col("pred_y")))
    return override(p, "x", "other").select("compound", "arm", r6("x_pred").alias("value"))


@query("solubility_sources", """SELECT smiles, origin, "type", round(solubility, 4) + 0.0 AS solubility FROM (
  SELECT p_name AS smiles, 'curated' AS origin, 'thermodynamic' AS "type", pow(10::DOUBLE, -p_size / 10) * 1000000 AS solubility FROM part
  UNION ALL SELECT p_name, 'assay', CASE WHEN lower(p_type) LIKE '%small%' THEN 'kinetic' ELSE 'mixed' END, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 1000 ELSE p_retailprice * 1000 / (p_size + 100) END FROM part)""")
def solubility_sources(s, d):
    part, size = table(s, d, "part"), F.col("p_size").cast("double")
    a = part.select(F.col("p_name").alias("smiles"), (-size / 10).alias("logS"))
    b = part.select(F.col("p_name").alias("smiles"), F.when(F.col("p_size") % 2 == 0, "nM").otherwise("ug.mL-1").alias("units"), F.col("p_retailprice").cast("string").alias("value"), F.when(F.col("p_type") == "SMALL", "Kinetic").otherwise("").alias("description"), (size + 100).alias("mw"))
    sources = {"curated": lambda: readers.curated_logs(a, "curated", "thermodynamic"), "assay": lambda: readers.assay_rows(b, "assay", F.col("mw")), "left out": lambda: readers.plain_rows(a, "x")}
    return readers.load_all(sources, exclude=["left out"]).withColumn("solubility", F.round("solubility", 4) + F.lit(0.0))


@query("contract_check", f"{C} SELECT count(*) AS n, count(*) FILTER (label IS NULL) AS not_finite, count(*) - count(DISTINCT text) AS repeated FROM c")
def contract_check(s, d):
    c = compounds(s, d)
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite(F.col("label"))).alias("not_finite"), (F.count(F.lit(1)) - F.countDistinct("text")).alias("repeated"))


ACTIVITY_SQL = "a AS (SELECT l_orderkey, l_linenumber, p_type AS kind, 'u' || (l_suppkey % 6) AS units, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity END AS value, CASE WHEN l_discount > 0.08 THEN '>' ELSE '=' END AS relation FROM lineitem JOIN part ON p_partkey = l_partkey)"
FACTORS = {"u0": 1.0, "u1": 0.1, "u2": 10.0, "u3": 1000.0}


def activities(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    value, relation = F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity")), F.when(F.col("l_discount") > 0.08, ">").otherwise("=")
    return rows.select("l_orderkey", "l_linenumber", F.col("p_type").alias("kind"), F.concat(F.lit("u"), F.col("l_suppkey") % 6).alias("units"), value.alias("value"), relation.alias("relation"))


def wanted_activities():
    return rel.activity_rules(F.col("kind"), F.col("units"), F.col("value"), F.col("relation"), "[a-m]", "e.*l$", FACTORS)


@query("activity_funnel", f"WITH {ACTIVITY_SQL}, b AS (SELECT regexp_matches(kind, '(?i)^[a-m]') AS r1, NOT regexp_matches(kind, '(?i)e.*l$') AS r2, units IN ('u0', 'u1', 'u2', 'u3') AND value IS NOT NULL AS r3, relation = '=' AS r4 FROM a) SELECT unnest([0, 1, 2, 3, 4]) AS step, unnest(['all', 'wanted type', 'no reverse leg', 'convertible unit', 'uncensored']) AS name, unnest([count(*), count(*) FILTER (r1), count(*) FILTER (r1 AND r2), count(*) FILTER (r1 AND r2 AND r3), count(*) FILTER (r1 AND r2 AND r3 AND r4)]) AS n FROM b")
def activity_funnel(s, d):
    """How many activities each rule of type, direction, unit and relation leaves."""
    return rel.funnel(activities(s, d), wanted_activities())


@query("activity_selection", f"WITH {ACTIVITY_SQL} SELECT l_orderkey, l_linenumber, round(value * CASE units WHEN 'u0' THEN 1 WHEN 'u1' THEN 0.1 WHEN 'u2' THEN 10 ELSE 1000 END::DOUBLE, 6) + 0.0 AS value FROM a WHERE regexp_matches(kind, '(?i)^[a-m]') AND NOT regexp_matches(kind, '(?i)e.*l$') AND units IN ('u0', 'u1', 'u2', 'u3') AND value IS NOT NULL AND relation = '='")
def activity_selection(s, d):
    factor = F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])[F.col("units")]
    rows = rel.passing(activities(s, d), wanted_activities())
    return rows.select("l_orderkey", "l_linenumber", (F.round(F.col("value") * factor, 6) + F.lit(0.0)).alias("value"))
