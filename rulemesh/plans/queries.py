"""Named queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import cascade as K
from ..operators import catalogue as T
from ..operators import cells as X
from ..operators import consistency as L
from ..operators import dedupe as D
from ..operators import evaluation as V
from ..operators import extraction as M
from ..operators import gaps as Y
from ..operators import facets as B
from ..operators import graph as J
from ..operators import guards as G
from ..operators import joins as C
from ..operators import patches as P
from ..operators import postings as Q
from ..operators import retrieval as I
from ..operators import segments as U
from ..operators.steps import cut
from ..operators import tokens as N
from ..operators import windows as E
from ..sources import kb as W
from ..streaming import logs as O
from . import reports as R
from .derived import cte, derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- facets (B, F)


@query(cte("rules") + """
SELECT id, rule_class, coalesce(summary, CASE WHEN length(rule_text) > 160 THEN substr(rule_text, 1, 160) || '...' ELSE rule_text END) AS summary, hardness
FROM rules WHERE list_has_any(list_concat(coalesce(tags, []), [rule_class]), ['small', 'red']) AND (section_types IS NULL OR list_has_any(section_types, ['sec_1', 'sec_2']))
  AND (audience IS NULL OR audience IN ('patient')) AND hardness IN ('hard_constraint', 'strong_default')""")
def facet_query(spark, sf):
    rules = derive(spark, sf, "rules")
    return B.short_rules(B.filter_rules(rules, rule_class=["small", "red"], section_types=["sec_1", "sec_2"], audience=["patient"], hardness=["hard_constraint", "strong_default"]))


@query(cte("rules") + """
SELECT id, total, CASE WHEN total > 160 THEN 160::INT END AS next_offset FROM (
  SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY id) AS r FROM rules
  WHERE section_types IS NULL OR list_has_any(section_types, ['sec_3'])) WHERE r > 80 AND r <= 160""")
def facet_page(spark, sf):
    rules = B.filter_rules(derive(spark, sf, "rules"), section_types=["sec_3"])
    return B.page(rules.select("id"), "id", 80, 80)


@query(cte("rules") + "SELECT id FROM rules WHERE section_types IS NOT NULL AND list_has_any(section_types, ['sec_1']) AND content_sub_type_ids IS NULL")
def facet_null_excluded(spark, sf):
    """Null selectors out for sections; an empty sub-type filter leaves only null selectors."""
    return B.filter_rules(derive(spark, sf, "rules"), section_types=["sec_1"], include_all_section_rules=False, content_sub_type_ids=[]).select("id")


@query(cte("rules") + "SELECT id, gov_type FROM rules WHERE lower(coalesce(gov_type, '')) IN ('legal')")
def governance_facet(spark, sf):
    return B.filter_rules(derive(spark, sf, "rules"), has_governance=True, gov_type=["legal"]).select("id", "gov_type")


@query("""SELECT doc_id, lang, CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END AS summary FROM documents""")
def short_projection(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang", S.shortened(F.col("text")).alias("summary"))


@query(cte("rules") + """
SELECT id FROM rules WHERE section_types IS NULL AND applies_kind IS NULL AND content_sub_type_ids IS NULL
  AND (hardness = 'hard_constraint' OR coalesce(severity = 'block', false))
  AND (content_types IS NULL OR list_contains(content_types, 'email')) AND (audience IS NULL OR audience = 'patient')""")
def baseline_predicate(spark, sf):
    return B.baseline(derive(spark, sf, "rules")).select("id")


@query(cte("rules") + """
SELECT id FROM rules WHERE section_types IS NULL OR list_has_any(section_types, ['sec_2']) OR applies_kind IN ('adjacent_section_state', 'position_in_email')""")
def coverage_candidates(spark, sf):
    return B.candidates(derive(spark, sf, "rules"), ["sec_2"]).select("id")


@query(cte("tokens") + """
SELECT id, key, total FROM (SELECT id, key, count(*) OVER () AS total, row_number() OVER (ORDER BY id) AS r FROM tokens
  WHERE token_type IN ('color', 'spacing') AND contains(lower(key), 'brand.1') AND len(list_filter(element_paths, lambda p: contains(lower(p), 'cta'))) > 0) WHERE r <= 100""")
def token_filter(spark, sf):
    found = B.filter_tokens(derive(spark, sf, "tokens"), token_type=["color", "spacing"], key_contains="BRAND.1", path_contains="CTA")
    return found.select("id", "key", "total")


@query("""SELECT o_orderkey, CASE WHEN k IN ('1-urgent', '2-high', '3-medium') THEN k WHEN k = '5-low' THEN '3-medium' ELSE 'none' END AS priority,
  NOT (k IN ('1-urgent', '2-high', '3-medium') OR k = '5-low') AS defaulted FROM (SELECT o_orderkey, lower(trim(o_orderpriority)) AS k FROM orders)""")
def enum_coerce(spark, sf):
    value, defaulted = B.coerce(F.col("o_orderpriority"), ["1-urgent", "2-high", "3-medium"], {"5-low": "3-medium"}, "none")
    return t(spark, sf, "orders").select("o_orderkey", value.alias("priority"), defaulted.alias("defaulted"))


@query(cte("rules") + """
SELECT id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ',') END AS kept FROM (SELECT id, list_filter(tags, lambda v: v IN ('red', 'bolt', 'hot')) AS kept FROM rules)""")
def enum_list_coerce(spark, sf):
    kept = B.coerce_list(F.col("tags"), ["red", "bolt", "hot"])
    return derive(spark, sf, "rules").select("id", F.array_join(kept, ",").alias("kept"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type WHEN v LIKE 'other.%' THEN substr(v, 7) END AS kind, event_type NOT IN ('click', 'view') AND v LIKE 'other.%' AS is_new
FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN event_type ELSE 'other.' || event_type END AS v FROM events)""")
def vocabulary_discovery(spark, sf):
    raw = F.when(F.col("event_type").isin("click", "view", "error"), F.col("event_type")).otherwise(F.concat(F.lit("Other."), F.col("event_type")))
    value, new = B.discover(raw, ["click", "view"])
    return t(spark, sf, "events").select("event_id", value.alias("kind"), new.alias("is_new"))


@query(cte("rules") + """
SELECT 'rule' AS store, 'rule_' || k AS id FROM (SELECT n AS k FROM rules)
UNION ALL SELECT 'token', 'tok_' || s_suppkey FROM supplier""")
def entity_stores(spark, sf):
    return B.first_store({"rule": derive(spark, sf, "rules"), "token": derive(spark, sf, "tokens"), "again": derive(spark, sf, "rules")})


# -------------------------------------------------------------------- joins (C)


@query(cte("rules", "tokens") + """
SELECT r.id, x.at - 1 AS at, k.id AS ref_id, k.value FROM rules r, LATERAL (SELECT unnest(r.token_ids) AS tid, generate_subscripts(r.token_ids, 1) AS at) x JOIN tokens k ON k.id = x.tid""")
def hydrate_join(spark, sf):
    rules = derive(spark, sf, "rules").select("id", "token_ids")
    tokens = derive(spark, sf, "tokens").select(F.col("id").alias("key_id"), F.col("value"))
    return C.hydrate(rules, "token_ids", tokens, "key_id").select("id", F.col("at").cast("long").alias("at"), "ref_id", "value")


@query("""SELECT o_orderkey, o_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def star_join(spark, sf):
    orders, customer, nation, region = (t(spark, sf, n) for n in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.join(region, nation.n_regionkey == region.r_regionkey).select("o_orderkey", "o_custkey", "n_name", "r_name")


@query(cte("rules", "tokens") + """
SELECT DISTINCT tid AS id, tid IN (SELECT id FROM tokens) AS known FROM (SELECT unnest(token_ids) AS tid FROM rules)""")
def id_lookup_misses(spark, sf):
    wanted = derive(spark, sf, "rules").select(F.explode("token_ids").alias("id")).distinct()
    return C.found_and_missing(wanted, derive(spark, sf, "tokens"), "id")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def anti_join(spark, sf):
    returned = t(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return C.missing(t(spark, sf, "part").select("p_partkey"), returned, "p_partkey")


@query("""SELECT a.s_suppkey, b.s_suppkey AS sibling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def sibling_self_join(spark, sf):
    return C.siblings(t(spark, sf, "supplier"), "s_suppkey", "s_nationkey")


@query(cte("rules") + """
SELECT id, sibling FROM (SELECT a.id, b.id AS sibling, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS r FROM rules a JOIN rules b ON a.group_id = b.group_id AND a.id <> b.id) WHERE r <= 30""")
def related_rules(spark, sf):
    return C.siblings(derive(spark, sf, "rules"), "id", "group_id", 30)


@query(cte("rules") + """, s AS (SELECT id, unnest(section_types) AS section FROM rules)
SELECT section, id, 'targeted' AS kind FROM s UNION SELECT 'all', id, 'null_selector' FROM rules WHERE section_types IS NULL
UNION SELECT section, id, 'via_class' FROM (SELECT id, unnest(content_sub_type_ids) AS section FROM rules)""")
def rules_by_section(spark, sf):
    rules = derive(spark, sf, "rules")
    targeted = rules.select(F.explode("section_types").alias("section"), "id", F.lit("targeted").alias("kind"))
    general = rules.where("section_types IS NULL").select(F.lit("all").alias("section"), "id", F.lit("null_selector").alias("kind"))
    classes = rules.select(F.explode("content_sub_type_ids").alias("section"), "id", F.lit("via_class").alias("kind"))
    return targeted.unionByName(general).unionByName(classes).distinct()


_UNITS = """SELECT doc_id AS doc, (generate_series - 1) * 50 AS unit_start, generate_series * 50 AS unit_end FROM documents, generate_series(1, 20)"""


@query(f"""WITH units AS ({_UNITS}), spans AS (SELECT doc_id AS doc, n_chars % 400 AS span_start, n_chars % 400 + 120 AS span_end FROM documents)
SELECT doc, span_start, span_end, unit_start, unit_end FROM spans JOIN units USING (doc) WHERE unit_start < span_end AND unit_end > span_start""")
def interval_overlap(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "n_chars")
    n = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))).alias("n")
    units = docs.select("doc", n).select("doc", ((F.col("n") - 1) * 50).alias("start"), (F.col("n") * 50).alias("end"))
    spans = docs.select("doc", (F.col("n_chars") % 400).alias("start"), (F.col("n_chars") % 400 + 120).alias("end"))
    return C.overlapping(spans, units, "doc", 200)


@query("""SELECT a.conv_id, a.turn, b.turn AS neighbour FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1""")
def neighbour_join(spark, sf):
    turns = t(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").alias("key"))
    return C.neighbours(turns, "conv_id", "turn", "key").withColumnRenamed("key", "turn")


@query("""WITH owners AS (SELECT DISTINCT substr(p_name, 1, 3) AS o FROM part UNION SELECT DISTINCT substr(p_name, 1, 5) FROM part WHERE p_size < 10)
SELECT p_partkey, p_name, (SELECT max_by(o, length(o)) FROM owners WHERE starts_with(p_name, o)) AS owner FROM part""")
def owning_prefix(spark, sf):
    part = t(spark, sf, "part")
    owners = part.select(F.substring("p_name", 1, 3).alias("o")).union(part.where("p_size < 10").select(F.substring("p_name", 1, 5))).distinct()
    return C.longest_prefix(part.select("p_partkey", "p_name"), F.col("p_name"), owners, "o", 5)


@query("""SELECT event_type, o_orderstatus, r_name FROM (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT o_orderstatus FROM orders), region""")
def context_product(spark, sf):
    return C.product(t(spark, sf, "events").select("event_type").distinct(), t(spark, sf, "orders").select("o_orderstatus").distinct(), t(spark, sf, "region").select("r_name"))


@query("""SELECT k AS key, a.v AS left_value, b.v AS right_value FROM (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def map_differences(spark, sf):
    orders = t(spark, sf, "orders")
    sides = [orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("v")) for s in "FO"]
    return C.full_outer_differences(*sides, "key", "v")


@query(cte("rules") + """
SELECT r.id, c.cls FROM (SELECT id, list_sort(list_distinct(section_types)) AS m FROM rules WHERE n % 2 = 0) r
LEFT JOIN (SELECT list_sort(list_distinct(section_types)) AS m, max(id) AS cls FROM rules WHERE n % 2 = 1 GROUP BY 1) c ON r.m = c.m""")
def signature_link(spark, sf):
    rules = derive(spark, sf, "rules")
    classes = rules.where("n % 2 = 1").select(F.col("id").alias("cls"), "section_types")
    return C.by_signature(rules.where("n % 2 = 0"), "id", "section_types", classes, "cls")


# --------------------------------------------------------------- aggregates (D)


@query(cte("verdicts") + """
SELECT rule_id, array_to_string(list(section ORDER BY ord, section), ',') AS voters, (list(why ORDER BY ord, section) FILTER (why <> ''))[1] AS why, count(*) AS votes FROM verdicts GROUP BY rule_id""")
def vote_union(spark, sf):
    found = A.vote_union(derive(spark, sf, "verdicts"), "rule_id", "section", "ord", "why")
    return found.withColumn("voters", F.array_join("voters", ","))


@query(cte("verdicts") + """, s AS (SELECT section, run, list(DISTINCT rule_id) AS i FROM verdicts GROUP BY ALL)
SELECT x.section, x.run AS a, y.run AS b, len(x.i)::INT AS a_size, len(y.i)::INT AS b_size, round(len(list_intersect(x.i, y.i))::DOUBLE / len(list_distinct(list_concat(x.i, y.i))), 9) AS jaccard
FROM s x JOIN s y ON x.section = y.section AND x.run < y.run""")
def run_comparison(spark, sf):
    return V.compare_runs(derive(spark, sf, "verdicts")).withColumn("jaccard", F.round("jaccard", 9))


@query(cte("verdicts") + """, c AS (SELECT section, rule_id, count(DISTINCT run) AS n FROM verdicts GROUP BY ALL), r AS (SELECT section, count(DISTINCT run) AS runs FROM verdicts GROUP BY ALL)
SELECT section, count(*) FILTER (n = runs) AS by_all, count(*) FILTER (n = 1) AS by_one, count(*) AS union_size FROM c JOIN r USING (section) GROUP BY section""")
def run_agreement(spark, sf):
    return V.agreement(derive(spark, sf, "verdicts"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS i FROM lineitem), n AS (SELECT a, count(*) AS n FROM s GROUP BY a),
p AS (SELECT x.a, y.a AS b, count(*) AS shared FROM s x JOIN s y ON x.i = y.i AND x.a < y.a GROUP BY ALL)
SELECT p.a, p.b, shared, round(shared::DOUBLE / (u.n + v.n - shared), 9) AS jaccard FROM p JOIN n u ON u.a = p.a JOIN n v ON v.a = p.b""")
def jaccard_pairs(spark, sf):
    return A.jaccard_pairs(t(spark, sf, "lineitem"), "l_suppkey", "l_partkey").withColumn("jaccard", F.round("jaccard", 9))


@query("""SELECT source, count(*) FILTER (quality IS NOT NULL) AS required, count(*) FILTER (quality = 1) AS covered,
  CASE WHEN count(*) FILTER (quality IS NOT NULL) > 0 THEN round(count(*) FILTER (quality = 1)::DOUBLE / count(*) FILTER (quality IS NOT NULL), 9) ELSE 0.0::DOUBLE END AS ratio, grouping(source)::INT AS is_total
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), ())""")
def coverage_ratio(spark, sf):
    units = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    found = A.coverage(units, "source", F.col("quality").isNotNull(), F.coalesce(F.col("quality") == 1, F.lit(False)))
    return found.withColumn("ratio", F.round("ratio", 9))


@query("""WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_returnflag, n AS votes, round(n::DOUBLE / total, 9) AS agreement FROM (
  SELECT *, sum(n) OVER (PARTITION BY l_partkey) AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) AS r FROM c) WHERE r = 1""")
def majority_vote(spark, sf):
    return A.majority(t(spark, sf, "lineitem"), ["l_partkey"], "l_returnflag").withColumn("agreement", F.round("agreement", 9))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS item, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, array_to_string(list(item ORDER BY n DESC, item), ',') AS items, max(n) AS most FROM c GROUP BY o_custkey""")
def evidence_merge(spark, sf):
    return A.evidence(t(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority").withColumn("items", F.array_join("items", ","))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'R')")
def quarantine_all_failed(spark, sf):
    return A.all_failed(t(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query("""SELECT a.o_orderstatus, b.o_orderpriority, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b
LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 499000) o ON o.o_orderstatus = a.o_orderstatus AND o.o_orderpriority = b.o_orderpriority GROUP BY ALL""")
def queue_counts(spark, sf):
    orders = t(spark, sf, "orders")
    rich = orders.where("o_totalprice > 499000")
    grid = orders.select("o_orderstatus").distinct().crossJoin(orders.select("o_orderpriority").distinct())
    counted = A.counts_with_zeros(rich, "o_orderstatus", "o_orderpriority")
    return grid.join(counted, ["o_orderstatus", "o_orderpriority"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(cte("rules") + "SELECT value, array_to_string(list_sort(list(DISTINCT id)), ',') AS keys FROM (SELECT id, unnest(token_ids) AS value FROM rules) GROUP BY value")
def reverse_index(spark, sf):
    return A.reverse_index(derive(spark, sf, "rules"), "token_ids", "id").withColumn("keys", F.array_join("keys", ","))


@query(cte("rules") + "SELECT rule_class, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS aliases FROM rules GROUP BY rule_class")
def alias_merge(spark, sf):
    return A.alias_merge(derive(spark, sf, "rules"), "rule_class", "tags").withColumn("aliases", F.array_join("aliases", ","))


@query("""SELECT l_orderkey, max_by(l_returnflag, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) AS status, bool_or(l_returnflag = 'A') AS passed FROM lineitem GROUP BY l_orderkey""")
def best_verification(spark, sf):
    return A.best_verification(t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", {"A": 2, "N": 1, "R": 0})


@query("""SELECT axis, array_to_string(list_sort(list(DISTINCT value)), ',') AS values FROM (
  SELECT 'segment' AS axis, c_mktsegment AS value FROM customer UNION ALL SELECT 'status', o_orderstatus FROM orders UNION ALL SELECT 'status', 'Z' UNION ALL SELECT 'theme', 'none') GROUP BY axis""")
def predicate_domains(spark, sf):
    sources = [t(spark, sf, table).select(F.lit(axis).alias("axis"), F.col(c).alias("value")) for table, axis, c in (("customer", "segment", "c_mktsegment"), ("orders", "status", "o_orderstatus"))]
    return A.domains(sources, {"status": ["Z"], "theme": ["none"]}).withColumn("values", F.array_join("values", ","))


@query("""WITH y AS (SELECT o_orderstatus || '-' || o_orderpriority AS metric, year(o_orderdate) AS y, count(*) AS v FROM orders GROUP BY ALL)
SELECT a.metric, a.v AS now, b.v AS accepted, a.v - b.v AS delta FROM y a JOIN y b USING (metric) WHERE a.y = 1998 AND b.y = 1997 AND CASE WHEN metric LIKE 'O%' THEN a.v < b.v ELSE a.v > b.v END""")
def ratchet(spark, sf):
    metric = F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("metric")
    years = t(spark, sf, "orders").groupBy(metric, F.year("o_orderdate").alias("y")).agg(F.count("*").alias("v"))
    return A.ratchet(years.where("y = 1998"), years.where("y = 1997"), "metric", "v", F.col("metric").startswith("O"))


@query("""SELECT l_orderkey, l_linenumber, p_type, round(CASE WHEN starts_with(p_type, 'SMALL') THEN 2.0 WHEN starts_with(p_type, 'S') THEN 1.0 WHEN starts_with(p_type, 'P') THEN 0.5 END * l_quantity, 6)::DOUBLE AS cost
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def prefix_price(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    priced = A.price(rows, F.col("p_type"), {"S": 1.0, "SMALL": 2.0, "P": 0.5}, F.col("l_quantity"))
    return priced.select("l_orderkey", "l_linenumber", "p_type", F.round("cost", 6).alias("cost"))


@query("""SELECT o_orderstatus AS run, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE / count(*) AS avg_targeted, sum(o_custkey % 5)::DOUBLE / count(*) AS avg_wide FROM orders GROUP BY 1""")
def run_stats(spark, sf):
    orders = t(spark, sf, "orders").withColumnRenamed("o_orderstatus", "run")
    return V.run_stats(orders, "run", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0), F.col("o_custkey") % 5)


@query("""WITH a AS (SELECT DISTINCT l_suppkey % 10 AS g, l_partkey AS i FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey % 10 AS g, l_partkey AS i FROM lineitem WHERE l_linenumber = 1),
j AS (SELECT coalesce(a.g, b.g) AS g, a.i AS x, b.i AS y FROM a FULL JOIN b ON a.g = b.g AND a.i = b.i)
SELECT g, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS tp, count(x) - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS fp, count(y) - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS fn,
 round(CASE WHEN count(x) > 0 THEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)::DOUBLE / count(x) ELSE 0 END, 9) AS precision,
 round(CASE WHEN count(y) > 0 THEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)::DOUBLE / count(y) ELSE 0 END, 9) AS recall FROM j GROUP BY g""")
def retrieval_score(spark, sf):
    items = t(spark, sf, "lineitem").withColumn("g", F.col("l_suppkey") % 10).withColumn("i", F.col("l_partkey"))
    found = V.score(items.where("l_returnflag = 'R'"), items.where("l_linenumber = 1"), "g", "i")
    return found.withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


# ------------------------------------------------------------------ windows (E)


@query("""SELECT conv_id, turn, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS near FROM conversations""")
def neighbour_window(spark, sf):
    found = E.neighbourhood(t(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", F.col("turn").cast("string"))
    return found.withColumn("near", F.array_join("near", ","))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, max((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM conversations) WHERE m = 1""")
def target_context(spark, sf):
    return E.near_targets(t(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "system").drop("role")


@query("""WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), m AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS isle FROM d)
SELECT user_id, min(day)::INT AS first, max(day)::INT AS last, count(*) AS n FROM m GROUP BY user_id, isle HAVING count(*) >= 2""")
def islands(spark, sf):
    days = t(spark, sf, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("day"))
    return E.islands(days, "user_id", "day")


@query("""WITH k AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_returnflag AS c FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY a DESC, b DESC, c DESC, l_orderkey * 10 + l_linenumber DESC) AS rank, dense_rank() OVER (PARTITION BY l_partkey ORDER BY a DESC, b DESC, c DESC) = 1 AS top FROM k)
SELECT l_partkey, l_orderkey, l_linenumber, rank, top AND sum(top::INT) OVER (PARTITION BY l_partkey) > 1 AS tied FROM r""")
def specificity_rank(spark, sf):
    found = E.ranked(t(spark, sf, "lineitem"), "l_partkey", [F.col(c) for c in ("l_quantity", "l_discount", "l_returnflag")], F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return found.select("l_partkey", "l_orderkey", "l_linenumber", "rank", "tied")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_disposition(spark, sf):
    return E.latest(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_occurrence(spark, sf):
    return E.first_of(t(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part)
SELECT p_partkey, slug, CASE WHEN r = 1 THEN slug ELSE slug || '_' || r END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS r FROM s)""")
def uniquify_ids(spark, sf):
    slugs = t(spark, sf, "part").select("p_partkey", S.slugify(F.col("p_name")).alias("slug"))
    return E.uniquified(slugs, "slug", "p_partkey")


@query("""SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER w THEN 'first' WHEN turn = max(turn) OVER w THEN 'last' ELSE 'middle' END AS position FROM conversations WINDOW w AS (PARTITION BY conv_id)""")
def position_flag(spark, sf):
    return E.positions(t(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 40 AS batch FROM documents")
def batches(spark, sf):
    return E.batches(t(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"])


# ------------------------------------------------------------------- dedupe (G)


@query("SELECT md5(lower(text)) AS group_key, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS keys FROM documents GROUP BY 1 HAVING count(*) > 1")
def near_duplicates(spark, sf):
    return D.near_duplicates(t(spark, sf, "documents"), F.md5(F.lower("text")), "doc_id").withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@query("""SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY length(source), doc_id) AS canonical FROM documents""")
def merge_map(spark, sf):
    return D.merge_map(t(spark, sf, "documents"), F.col("text"), "doc_id", [F.length("source")])


@query("""WITH m AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY length(source), doc_id) AS canonical FROM documents)
SELECT coalesce(canonical, l.doc_id) AS doc_id, quality, toxic FROM labels l LEFT JOIN m ON l.doc_id = m.doc_id""")
def remapped_labels(spark, sf):
    merged = D.merge_map(t(spark, sf, "documents"), F.col("text"), "doc_id", [F.length("source")])
    return D.remap(t(spark, sf, "labels"), "doc_id", merged, "doc_id")


@query("""WITH w AS (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '[a-z0-9#]+') AS w FROM documents),
d AS (SELECT doc_id, source || '|' || lang || '|' || w[1] AS block, list_distinct(w) AS w FROM w)
SELECT a.doc_id, b.doc_id AS other, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 9) AS jaccard
FROM d a JOIN d b ON a.block = b.block AND a.doc_id < b.doc_id WHERE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.4""")
def rule_dedupe_jaccard(spark, sf):
    words = t(spark, sf, "documents").select("doc_id", "source", "lang", S.words(F.col("text")).alias("w"))
    blocked = words.select("doc_id", "w", F.concat("source", F.lit("|"), "lang", F.lit("|"), F.get("w", F.lit(0))).alias("block"))
    return D.similar_pairs(blocked, "block", "doc_id", "w", 0.4).withColumn("jaccard", F.round("jaccard", 9))


@query("""SELECT least(l_suppkey, l_linenumber) AS lo, greatest(l_suppkey, l_linenumber) AS hi, min(l_orderkey) AS o FROM lineitem GROUP BY ALL""")
def unordered_pairs(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.col("l_orderkey").alias("o"))
    return D.unordered_pairs(rows, "a", "b", ["o"]).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "o")


@query("""SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text, lang""")
def content_addressed(spark, sf):
    return D.by_content(t(spark, sf, "documents"), ["text", "lang"], "doc_id").select("doc_id", "n")


@query("""SELECT k, CASE WHEN sum(w) = 3 THEN 'both' WHEN sum(w) = 1 THEN 'a' ELSE 'b' END AS side FROM (
  SELECT DISTINCT l_partkey AS k, 1 AS w FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT DISTINCT l_partkey, 2 FROM lineitem WHERE l_returnflag = 'A') GROUP BY k""")
def set_partition(spark, sf):
    items = t(spark, sf, "lineitem").withColumn("k", F.col("l_partkey"))
    return D.symmetric_parts(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'A'"), "k")


@query("""WITH g AS (SELECT l_orderkey AS g, count(DISTINCT l_returnflag) AS runs, bool_or(l_returnflag = 'R') AS v FROM lineitem GROUP BY 1),
u AS (SELECT DISTINCT l_orderkey AS g, l_partkey || '-' || l_suppkey AS unit FROM lineitem)
SELECT DISTINCT u.g FROM u JOIN g USING (g) WHERE runs < 2 AND v AND unit NOT IN (SELECT unit FROM u JOIN g USING (g) WHERE runs >= 2)""")
def ensemble_singletons(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group"), "l_returnflag", F.concat_ws("-", "l_partkey", "l_suppkey").alias("unit"))
    groups = rows.groupBy("group").agg(F.countDistinct("l_returnflag").alias("runs"), F.bool_or(F.col("l_returnflag") == "R").alias("verified"))
    return D.admitted_singletons(groups, rows.select("group", "unit").distinct()).withColumnRenamed("group", "g")


# ------------------------------------------------------------------ scalars (H)


@query("""SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '_'), 48) AS slug FROM part""")
def slugify(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.slugify(F.concat_ws(" ", "p_name", F.lit("/"), F.concat("p_type", F.lit("!")))).alias("slug"))


@query("SELECT doc_id, left(sha1(text), 16) AS h FROM documents")
def stable_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.stable_hash(F.col("text")).alias("h"))


@query("SELECT o_orderkey, sha1(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey) AS h FROM orders")
def cache_key(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", S.cache_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")).alias("h"))


@query(r"""WITH r AS (SELECT s_suppkey, s_suppkey % 256 AS k, s_suppkey % 4 AS m FROM supplier),
x AS (SELECT s_suppkey, m, k, CASE m WHEN 0 THEN '#A' || (k % 10) || 'f' WHEN 1 THEN ' #AbCd' || lpad((k % 100)::VARCHAR, 2, '0') WHEN 2 THEN 'rgb(' || k || ', ' || (k * 2) || ', 7)' ELSE ' Teal ' END AS raw FROM r)
SELECT s_suppkey, raw, CASE m WHEN 0 THEN '#aa' || (k % 10) || (k % 10) || 'ff' WHEN 1 THEN '#abcd' || lpad((k % 100)::VARCHAR, 2, '0')
  WHEN 2 THEN CASE WHEN k * 2 <= 255 THEN '#' || lower(printf('%02x', k) || printf('%02x', k * 2)) || '07' END ELSE 'Teal' END AS canon FROM x""")
def normalize_color(spark, sf):
    k, m = F.col("s_suppkey") % 256, F.col("s_suppkey") % 4
    raw = (
        F.when(m == 0, F.concat(F.lit("#A"), (k % 10).cast("string"), F.lit("f")))
        .when(m == 1, F.concat(F.lit(" #AbCd"), F.lpad((k % 100).cast("string"), 2, "0")))
        .when(m == 2, F.concat(F.lit("rgb("), k.cast("string"), F.lit(", "), (k * 2).cast("string"), F.lit(", 7)")))
        .otherwise(" Teal ")
    )
    return t(spark, sf, "supplier").select("s_suppkey", raw.alias("raw")).withColumn("canon", S.color(F.col("raw")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || 'px' WHEN 1 THEN p_size || '.5em' WHEN 2 THEN p_size || '%' ELSE p_size || 'px ' || p_size || 'px' END AS canon FROM part""")
def normalize_dim(spark, sf):
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(m == 0, F.concat(F.lit(" "), size)).when(m == 1, F.concat(size, F.lit(".500 EM"))).when(m == 2, F.concat(size, F.lit(".0 %"))).otherwise(F.concat(size, F.lit("px   "), size, F.lit("px")))
    return t(spark, sf, "part").select("p_partkey", S.dimension(raw).alias("canon"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '600' WHEN 1 THEN '700' WHEN 2 THEN (s_suppkey % 9)::VARCHAR WHEN 3 THEN 'Odd One' ELSE '100' END AS canon FROM supplier""")
def normalize_weight(spark, sf):
    m = F.col("s_suppkey") % 5
    raw = F.when(m == 0, "Semi-Bold").when(m == 1, " BOLD").when(m == 2, F.concat(F.lit("00"), (F.col("s_suppkey") % 9).cast("string"))).when(m == 3, "Odd One").otherwise("thin")
    return t(spark, sf, "supplier").select("s_suppkey", S.weight(raw).alias("canon"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size % 100 = 0 THEN '0.0' WHEN p_size % 10 = 0 THEN '0.' || (p_size // 10) ELSE '0.' || lpad(p_size::VARCHAR, 2, '0') END
 WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || '.5' ELSE p_size || ':3' END AS canon FROM part""")
def normalize_number(spark, sf):
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(m == 0, F.concat(size, F.lit(" %"))).when(m == 1, size).when(m == 2, F.concat(size, F.lit(".50"))).otherwise(F.concat(size, F.lit(" : 03")))
    return t(spark, sf, "part").select("p_partkey", S.number(raw, ratio=True).alias("canon"))


@query(cte("tokens") + """
SELECT id, CASE token_type WHEN 'color' THEN '#aabb' || (n % 10) || (n % 10) WHEN 'spacing' THEN (n % 40) || '.5px' ELSE '600' END AS canon FROM tokens""")
def normalize_value(spark, sf):
    return derive(spark, sf, "tokens").select("id", S.normalise(F.col("token_type"), F.col("value")).alias("canon"))


@query(cte("rules") + """
SELECT id, array_to_string(list_distinct(regexp_extract_all(' ' || array_to_string(token_ids, ' and ast_x_') || ' tok_' || n || ' nottok_1', '\\b(?:tok|ast|sub|agr|tpl|tgr)_[a-z0-9_]+\\b')), ',') AS ids FROM rules""".replace("\\\\b", "\\b").replace("list_distinct(regexp", "list_sort(list_distinct(regexp").replace("+\\b'))", "+\\b')))"))
def id_scan(spark, sf):
    text = F.concat(F.lit(" "), F.array_join("token_ids", " and ast_x_"), F.lit(" tok_"), F.col("n").cast("string"), F.lit(" nottok_1"))
    return derive(spark, sf, "rules").select("id", F.array_join(F.array_sort(S.ids_in(text)), ",").alias("ids"))


@query("""SELECT id, CASE WHEN id LIKE 'tok%' THEN 'token' WHEN id LIKE 'rule%' THEN 'rule' WHEN id LIKE 'sub%' THEN 'subtype' END AS kind FROM (
 SELECT (['tok_', 'rule_', 'sub_', 'zzz_'])[s_suppkey % 4 + 1] || s_suppkey AS id FROM supplier)""")
def kind_from_prefix(spark, sf):
    prefix = F.get(F.array(*map(F.lit, ("tok_", "rule_", "sub_", "zzz_"))), (F.col("s_suppkey") % 4).cast("int"))
    ids = t(spark, sf, "supplier").select(F.concat(prefix, F.col("s_suppkey").cast("string")).alias("id"))
    return ids.withColumn("kind", S.kind_of(F.col("id")))


@query("""SELECT o_orderkey, 'audience=' || o_orderstatus || '|surface=email|campaign=' || o_orderpriority || '|theme=none|tags=' || CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END AS key FROM orders""")
def context_keys(spark, sf):
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return t(spark, sf, "orders").select("o_orderkey", S.context_key(F.col("o_orderstatus"), F.lit("email"), F.col("o_orderpriority"), F.lit("none"), tags).alias("key"))


@query("""SELECT doc_id, source || '_' || lpad((doc_id % 120)::VARCHAR, greatest(2, length((doc_id % 120)::VARCHAR))::INT, '0') AS group_id, source AS name, (doc_id % 120)::INT AS at FROM documents""")
def doc_ref_keys(spark, sf):
    ref = F.concat("source", F.lit("["), (F.col("doc_id") % 120).cast("string"), F.lit("]"))
    return t(spark, sf, "documents").select("doc_id", S.group_of_ref(ref).alias("group_id"), S.ref_order(ref).alias("o")).select("doc_id", "group_id", "o.name", "o.at")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_exists(props, '$.z') AS has_z, 'k' AS path FROM events")
def json_facets(spark, sf):
    v = F.try_parse_json("props")
    rows = t(spark, sf, "events").withColumn("v", v)
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.z", "string").isNotNull().alias("has_z"), F.array_join(F.json_object_keys("props"), ".").alias("path"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 9 - 4 >= 0 THEN '+' ELSE '' END || (o_custkey % 9 - 4) AS delta, printf('%.1f', (o_custkey % 100) / 100.0 * 100) || '%' AS share,
 replace(o_orderpriority || '|x', '|', '\\|') AS cell FROM orders""".replace("\\\\", "\\"))
def formatted(spark, sf):
    return t(spark, sf, "orders").select(
        "o_orderkey", S.signed(F.col("o_custkey") % 9 - 4).alias("delta"), S.percent((F.col("o_custkey") % 100) / 100.0).alias("share"), S.cell(F.concat("o_orderpriority", F.lit("|x"))).alias("cell")
    )


@query("""SELECT page_id, len(regexp_extract_all(html, '<!--(?:[^-]|-[^-])*-->')) AS n_comments, CASE WHEN contains(lower(html), 'nav') THEN 'header' ELSE 'body' END AS role FROM pages""")
def template_roles(spark, sf):
    html = F.col("html")
    return t(spark, sf, "pages").select("page_id", F.size(S.comments(html)).cast("long").alias("n_comments"), F.when(F.lower(html).contains("nav"), "header").otherwise("body").alias("role"))


@query("""SELECT s_suppkey, array_to_string([ 's' || x FOR x IN range(s_suppkey % 5, s_suppkey % 5 + s_suppkey % 3 + 1)], ',') AS stages FROM supplier""")
def stage_range(spark, sf):
    low = F.col("s_suppkey") % 5
    span = F.concat(F.lit("s"), low.cast("string"), F.lit("..s"), (low + F.col("s_suppkey") % 3).cast("string"))
    return t(spark, sf, "supplier").select("s_suppkey", F.array_join(S.stages(span), ",").alias("stages"))


@query("""SELECT doc_id, (('0x' || left(sha1(text), 8))::BIGINT % (20 * 365 * 86400) + 946684800) AS at FROM documents""")
def hash_timestamp(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.hash_time(F.sha1("text")).alias("at"))


@query("""SELECT doc_id, substr(text, 101, 400) AS page, length(text) > 500 AS more FROM documents""")
def chunked_read(spark, sf):
    page, more = S.page_of(F.col("text"), 100, 400)
    return t(spark, sf, "documents").select("doc_id", page.alias("page"), more.alias("more"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all('Use {name} and {' || p_type || '} with {name}, not {1x} {' || p_name || '}', '\\{([a-zA-Z_]\\w*)\\}', 1))), ',') AS names FROM part""".replace("\\\\", "\\"))
def prompt_placeholders(spark, sf):
    text = F.concat(F.lit("Use {name} and {"), "p_type", F.lit("} with {name}, not {1x} {"), "p_name", F.lit("}"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(S.placeholders(text)), ",").alias("names"))


@query("SELECT s_suppkey, 'nation_' || s_nationkey || '.' || lower(replace(s_name, '#', '_')) || '.json' AS file FROM supplier")
def mode_filenames(spark, sf):
    rows = t(spark, sf, "supplier")
    return rows.select("s_suppkey", S.mode_file(F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")), F.col("s_name")).alias("file"))


# ---------------------------------------------------------------- retrieval (I)

_BM25 = """, n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), tf AS (SELECT k, len(w) AS l, term, count(*) AS tf FROM (SELECT k, w, unnest(w) AS term FROM d) GROUP BY k, w, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS i FROM df, n),
idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25::DOUBLE * (SELECT avg(i) FROM raw) ELSE i END AS i FROM raw),
s AS (SELECT k, sum(i * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) * q) AS score FROM tf JOIN idf USING (term) JOIN (VALUES {terms}) v(term, q) USING (term), n GROUP BY k)
SELECT {key}, round(score, 6) AS score FROM (SELECT k AS {key}, score FROM s ORDER BY round(score, 9) DESC, k LIMIT 10) WHERE score > 0"""


@query("WITH d AS (SELECT doc_id AS k, regexp_extract_all(lower(text), '[a-z0-9#]+') AS w FROM documents)" + _BM25.format(terms="('license', 2), ('the', 1), ('mail', 1)", key="doc_id"))
def bm25_topk(spark, sf):
    return I.bm25(t(spark, sf, "documents"), "doc_id", F.col("text"), "License the license mail").withColumn("score", F.round("score", 6))


@query(cte("tokens") + ", d AS (SELECT id AS k, regexp_extract_all(lower(key || ' ' || token_type || ' ' || value), '[a-z0-9#]+') AS w FROM tokens)" + _BM25.format(terms="('color', 1), ('7', 1)", key="id"))
def bm25_tokens(spark, sf):
    return I.bm25(derive(spark, sf, "tokens"), "id", F.concat_ws(" ", "key", "token_type", "value"), "Color 7").withColumn("score", F.round("score", 6))


@query(cte("rules") + """, d AS (SELECT id AS k, regexp_extract_all(lower(rule_text || ' ' || coalesce(summary, '')), '[a-z0-9#]+') AS w FROM rules),
v AS (SELECT query, term, count(*) AS q FROM (SELECT query, unnest(regexp_extract_all(lower(query), '[a-z0-9#]+')) AS term FROM (SELECT DISTINCT rule_class || ' ' || value AS query FROM rules)) GROUP BY query, term),
n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), tf AS (SELECT k, len(w) AS l, term, count(*) AS tf FROM (SELECT k, w, unnest(w) AS term FROM d) GROUP BY k, w, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS i FROM df, n),
idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25::DOUBLE * (SELECT avg(i) FROM raw) ELSE i END AS i FROM raw),
s AS (SELECT query, k, sum(i * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) * q) AS score FROM tf JOIN idf USING (term) JOIN v USING (term), n GROUP BY query, k)
SELECT query, k AS id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, k) AS r FROM s) WHERE r <= 10 AND score > 0""")
def bm25_batch(spark, sf):
    rules = derive(spark, sf, "rules")
    index = Q.build(rules, "id", F.concat_ws(" ", "rule_text", "summary"))
    index = Q.over(cut(index.lists), index.sizes)
    asked = rules.select(F.concat("rule_class", F.lit(" "), "value").alias("query")).distinct()
    found = Q.search(index, asked, "query", F.col("query"))
    return found.select("query", F.col("key").alias("id"), F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 3) AS similarity FROM embeddings),
c AS (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 60) SELECT vec_id, similarity FROM c WHERE label IN (1, 2, 3) ORDER BY similarity DESC, vec_id LIMIT 20""")
def vector_topk(spark, sf):
    rows = t(spark, sf, "embeddings")
    query_vector = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    # one vector
    both = rows.join(F.broadcast(query_vector))
    return I.vector_top(both, "vec_id", "embedding", F.col("q"), F.col("label").isin(1, 2, 3), k=20)


@query("""SELECT doc_id, line_no, left(trim(line, ' '), 200) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
WHERE regexp_matches(line, 'licen[sc]ed? under', 'i') ORDER BY doc_id, line_no LIMIT 80""")
def grep_lines(spark, sf):
    found = I.grep(t(spark, sf, "documents"), "doc_id", F.col("text"), "licen[sc]ed? under")
    return found.withColumn("line_no", F.col("line_no").cast("long"))


@query(cte("rules") + "SELECT id, substr(coalesce(nullif(summary, ''), rule_text), 1, 6000) AS text FROM rules")
def embed_text(spark, sf):
    return derive(spark, sf, "rules").select("id", I.embed_text(F.col("summary"), F.lit(None).cast("string"), F.col("rule_text"), "intent").alias("text"))


@query(cte("verdicts") + "SELECT rule_id, array_to_string(list_sort(list(DISTINCT run)), ',') AS found_by, max(ord) AS best, count(DISTINCT run) AS n FROM verdicts GROUP BY rule_id")
def candidate_union(spark, sf):
    return I.candidate_union(derive(spark, sf, "verdicts"), "rule_id", "run", "ord").withColumn("found_by", F.array_join("found_by", ","))


# -------------------------------------------------------------------- graph (J)

_EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'lives_in' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based_in' FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)"""


def edges(spark, sf):
    links = (("customer", "c", "c_custkey", "n", "c_nationkey", "lives_in"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "based_in"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of"))
    out = None
    for table, a, key, b, target, kind in links:
        rows = t(spark, sf, table).select(F.concat(F.lit(a), F.col(key).cast("string")).alias("k"), F.concat(F.lit(b), F.col(target).cast("string")).alias("v"))
        one = J.edges_of(rows, "k", F.col("v"), kind)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_EDGES} SELECT src AS node, dst AS other, type, 'out' AS direction FROM edges UNION ALL SELECT dst, src, type, 'in' FROM edges")
def adjacency(spark, sf):
    return J.both_ways(edges(spark, sf))


@query(f"""WITH {_EDGES}, b AS (SELECT src AS node, dst AS other, type, 'out' AS direction FROM edges UNION ALL SELECT dst, src, type, 'in' FROM edges),
f AS (SELECT node AS start, node AS "from", other AS "to", type, direction, 1 AS step FROM b WHERE node IN ('s1', 's2', 'r0')), r AS (SELECT DISTINCT start, "to" AS node FROM f WHERE start <> "to")
SELECT * FROM f UNION ALL SELECT start, b.node, other, type, direction, 2 FROM r JOIN b USING (node)""")
def two_hop(spark, sf):
    start = spark.createDataFrame([("s1",), ("s2",), ("r0",)], "node string")
    return J.walk(edges(spark, sf), start, depth=2)


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def degree_counts(spark, sf):
    return J.degrees(edges(spark, sf))


@query(f"WITH {_EDGES} SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT src FROM edges) GROUP BY id")
def dangling_ends(spark, sf):
    e = edges(spark, sf)
    return J.dangling(e, e.select(F.col("src").alias("id")).distinct())


@query(cte("tokens") + """, x AS (SELECT n, value, CASE WHEN n % 7 = 3 THEN -1 WHEN n % 2 = 1 THEN n // 2 END AS r FROM tokens),
w AS (WITH RECURSIVE walk AS (SELECT n AS id, n AS cur, r, value, 0 AS steps FROM x UNION ALL SELECT walk.id, x.n, x.r, x.value, steps + 1 FROM walk JOIN x ON walk.r = x.n) SELECT * FROM walk)
SELECT 'tok_' || id AS id, CASE WHEN r IS NULL THEN value END AS value, CASE WHEN r IS NULL THEN 'ok' ELSE 'missing' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY steps DESC) AS k FROM w) WHERE k = 1""")
def ref_chain(spark, sf):
    return J.resolve_refs(derive(spark, sf, "tokens")).select("id", "value", "status")


@query("""WITH RECURSIVE x AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS ref, p_name AS value FROM part),
walk AS (SELECT id, ref, value, id AS cur, 0 AS steps FROM x UNION ALL SELECT w.id, x.ref, x.value, x.id, steps + 1 FROM walk w JOIN x ON w.ref = x.id)
SELECT id, cur AS "end", value, steps FROM walk WHERE ref IS NULL""")
def ref_chain_recursive(spark, sf):
    rows = t(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey > 0 THEN CAST(p_partkey DIV 2 AS BIGINT) END AS ref", "p_name AS value")
    rows.createOrReplaceTempView("ref_chain_rows")
    return J.resolve_refs_recursive(spark, "ref_chain_rows")


@query(cte("tokens") + """, p AS (SELECT DISTINCT key FROM tokens)
SELECT id, key, CASE WHEN EXISTS (SELECT 1 FROM p WHERE starts_with(p.key, tokens.key || '.')) THEN key || '_value' ELSE key END AS assigned FROM tokens""")
def path_collision(spark, sf):
    return J.assigned_paths(derive(spark, sf, "tokens").select("id", "key"), "key").select("id", "key", "assigned")


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS group_order FROM supplier")
def group_order(spark, sf):
    return J.group_order(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey")


# ------------------------------------------------------- guards and cascade (K)


def guard_rows(spark, sf):
    """Guards from suppliers: two axes, one of them missing for some, one empty for some."""
    return t(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").alias("g"),
        F.map_concat(
            F.when(F.col("s_suppkey") % 3 != 0, F.create_map(F.lit("theme"), F.array(*[F.concat(F.lit("t"), ((F.col("s_suppkey") + k) % 4).cast("string")) for k in (0, 1)]))).otherwise(G.empty()),
            F.when(F.col("s_suppkey") % 5 != 0, F.create_map(F.lit("section"), F.array(F.concat(F.lit("x"), (F.col("s_suppkey") % 2).cast("string"))))).otherwise(G.empty()),
            F.when(F.col("s_suppkey") % 17 == 0, F.create_map(F.lit("never"), F.array().cast("array<string>"))).otherwise(G.empty()),
        ).alias("guard"),
    )


_GUARDS = """g AS (SELECT s_suppkey AS id, s_nationkey AS g, CASE WHEN s_suppkey % 3 <> 0 THEN ['t' || (s_suppkey % 4), 't' || ((s_suppkey + 1) % 4)] END AS theme,
 CASE WHEN s_suppkey % 5 <> 0 THEN ['x' || (s_suppkey % 2)] END AS section, s_suppkey % 17 = 0 AS never FROM supplier)"""


@query(f"""WITH {_GUARDS} SELECT a.id, b.id AS other, NOT a.never AND NOT b.never AND coalesce(list_has_any(a.theme, b.theme), true) AND coalesce(list_has_any(a.section, b.section), true) AS ok
FROM g a JOIN g b ON a.g = b.g AND a.id < b.id""")
def guard_overlap(spark, sf):
    return G.joint(guard_rows(spark, sf), "g", "id", "guard", G.satisfiable, "ok").toDF("id", "other", "ok")


@query(f"""WITH {_GUARDS}, j AS (SELECT a.id, b.id AS other, a.never OR b.never AS dead, CASE WHEN a.theme IS NULL THEN b.theme WHEN b.theme IS NULL THEN a.theme ELSE list_intersect(a.theme, b.theme) END AS theme,
 CASE WHEN a.section IS NULL THEN b.section WHEN b.section IS NULL THEN a.section ELSE list_intersect(a.section, b.section) END AS section FROM g a JOIN g b ON a.g = b.g AND a.id < b.id)
SELECT id, other, array_to_string(list_sort(theme), ',') AS theme, array_to_string(section, ',') AS section FROM j WHERE NOT dead AND coalesce(len(theme) > 0, true) AND coalesce(len(section) > 0, true)""")
def guard_conjunction(spark, sf):
    def named(a, b):
        both = G.conjunction(a, b)
        return F.when(both.isNotNull(), F.struct(*[F.array_join(F.try_element_at(both, F.lit(x)), ",").alias(x) for x in ("theme", "section")]))

    return G.joint(guard_rows(spark, sf), "g", "id", "guard", named, "c").select(F.col("a").alias("id"), F.col("b").alias("other"), "c.theme", "c.section")


@query(f"""WITH {_GUARDS} SELECT id, (list_sort(list_filter(theme, lambda v: v <> 't0')))[1] AS theme, CASE WHEN list_contains(section, 'x1') THEN 'x1' END AS section FROM g
WHERE NOT never AND (theme IS NULL OR len(list_filter(theme, lambda v: v <> 't0')) > 0) AND (section IS NULL OR list_contains(section, 'x1'))""")
def guard_witness(spark, sf):
    domains = F.create_map(F.lit("theme"), F.array(*map(F.lit, ("t1", "t2", "t3"))), F.lit("section"), F.array(F.lit("x1")))
    found = guard_rows(spark, sf).withColumn("w", G.witness(F.col("guard"), domains)).where("w IS NOT NULL")
    return found.select("id", *[F.try_element_at("w", F.lit(x)).alias(x) for x in ("theme", "section")])


@query(f"""WITH {_GUARDS} SELECT id, array_to_string(section, ',') AS section, never FROM g WHERE theme IS NULL OR list_contains(theme, 't1')""")
def partial_eval(spark, sf):
    context = F.create_map(F.lit("theme"), F.lit("t1"))
    left = guard_rows(spark, sf).withColumn("r", G.partial_eval(F.col("guard"), context, F.array().cast("array<string>"))).where("r IS NOT NULL")
    return left.select("id", F.array_join(F.try_element_at("r", F.lit("section")), ",").alias("section"), F.map_contains_key("r", "never").alias("never"))


@query(f"""WITH {_GUARDS} SELECT id, 'unsatisfiable_guard' AS reason FROM g WHERE never OR (theme IS NOT NULL AND NOT list_has_any(theme, ['t1', 't2'])) OR (section IS NOT NULL AND NOT list_contains(section, 'x0'))""")
def dead_entries(spark, sf):
    domains = F.create_map(F.lit("theme"), F.array(F.lit("t1"), F.lit("t2")), F.lit("section"), F.array(F.lit("x0")))
    rows = guard_rows(spark, sf).withColumn("selector", F.lit(None).cast("array<string>"))
    return L.dead(rows, "id", "selector", "guard", domains)


def binding_rows(spark, sf):
    """Bindings of rules: guard by audience and section."""
    rules = derive(spark, sf, "rules")
    guard = F.map_concat(
        F.when(F.col("audience").isNotNull(), F.create_map(F.lit("audience"), F.array("audience"))).otherwise(G.empty()),
        F.when(F.col("n") % 3 == 0, F.create_map(F.lit("section"), F.array(F.concat(F.lit("sec_"), (F.col("n") % 2).cast("string"))))).otherwise(G.empty()),
    )
    return rules.select(
        "element_path", F.col("id").alias("source_id"), F.lit("rule_binding").alias("source_kind"), "value", guard.alias("guard"), "hardness",
        F.lit(0).alias("selector_rank"), "precedence", F.lit("brand").alias("scope"),
    )


_BIND = cte("rules") + """, b AS (SELECT element_path, id AS source_id, value, audience, CASE WHEN n % 3 = 0 THEN 'sec_' || (n % 2) END AS section, hardness, precedence,
 CASE hardness WHEN 'hard_constraint' THEN 3 WHEN 'strong_default' THEN 2 ELSE 1 END AS h, (audience IS NOT NULL)::INT + (n % 3 = 0)::INT AS axes FROM rules)"""


@query(_BIND + """, s AS (SELECT c.ctx AS context_key, b.* FROM b, (VALUES ('patient'), ('hcp')) c(ctx) WHERE audience IS NULL OR audience = ctx),
r AS (SELECT *, row_number() OVER (PARTITION BY context_key, element_path ORDER BY h DESC, axes DESC, precedence DESC, source_id DESC) AS place,
  rank() OVER (PARTITION BY context_key, element_path ORDER BY h DESC, axes DESC, precedence DESC) = 1 AS top FROM s),
x AS (SELECT DISTINCT p.context_key, p.element_path, p.source_id FROM r p JOIN r q ON p.context_key = q.context_key AND p.element_path = q.element_path AND p.top AND q.top AND p.value <> q.value
  AND (p.section IS NULL OR q.section IS NULL OR p.section = q.section)),
t AS (SELECT context_key, element_path, array_to_string(list_sort(list(source_id)), ',') AS tied FROM x GROUP BY ALL),
f AS (SELECT context_key, element_path, count(*) AS candidates FROM r GROUP BY ALL)
SELECT r.context_key, r.element_path, CASE WHEN t.tied IS NULL AND section IS NULL THEN value END AS value, source_id, candidates, t.tied IS NOT NULL AS conflict, coalesce(tied, '') AS tied
FROM r JOIN f USING (context_key, element_path) LEFT JOIN t USING (context_key, element_path) WHERE place = 1""")
def cascade_resolve(spark, sf):
    contexts = spark.createDataFrame([(a, {"audience": a}, []) for a in ("patient", "hcp")], "context_key string, context map<string,string>, tags array<string>")
    found = K.resolve(K.survivors(binding_rows(spark, sf), contexts))
    return found.withColumn("tied", F.array_join("tied", ","))


@query(_BIND + """, s AS (SELECT c.ctx AS k, b.* FROM b, (VALUES ('patient'), ('hcp')) c(ctx) WHERE audience IS NULL OR audience = ctx),
w AS (SELECT k, element_path, source_id FROM (SELECT *, row_number() OVER (PARTITION BY k, element_path ORDER BY h DESC, axes DESC, precedence DESC, source_id DESC) AS place FROM s) WHERE place = 1)
SELECT s.source_id, array_to_string(list_sort(list(DISTINCT w.source_id)), ',') AS blockers FROM s JOIN w USING (k, element_path) WHERE (s.source_id, s.element_path) NOT IN (SELECT source_id, element_path FROM w) GROUP BY s.source_id, s.element_path""")
def shadowed_bindings(spark, sf):
    contexts = spark.createDataFrame([(a, {"audience": a}, []) for a in ("patient", "hcp")], "context_key string, context map<string,string>, tags array<string>")
    rows = K.survivors(binding_rows(spark, sf), contexts)
    return K.shadowed(K.winners(rows), rows).select("source_id", F.array_join("blockers", ",").alias("blockers"))


# Bindings on few paths with guards on two axes of contexts, two others and tags.
_CELL = {
    "element_path": "'path_' || (p_partkey % 61)",
    "source_id": "'rule_' || p_partkey",
    "value": "p_brand",
    "hardness": "CASE WHEN p_size % 5 = 0 THEN 'hard_constraint' WHEN p_size % 5 < 3 THEN 'strong_default' ELSE 'soft_guidance' END",
    "precedence": "p_size % 3",
    "audience": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'hcp' WHEN p_partkey % 4 = 2 THEN 'patient,hcp' ELSE 'nobody' END",
    "theme": "CASE WHEN p_partkey % 7 = 0 THEN 'dark' END",
    "section": "CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'hero,footer' ELSE 'body' END",
    "breakpoint": "CASE WHEN p_partkey % 5 = 0 THEN 'mobile' WHEN p_partkey % 5 = 1 THEN 'desktop,tablet' END",
    "sale": "CASE WHEN p_partkey % 11 = 0 THEN 'present' WHEN p_partkey % 11 = 1 THEN 'absent' END",
    "new": "CASE WHEN p_size % 13 = 0 THEN 'present' END",
}
_CELL_SQL = f"""WITH b AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _CELL.items())} FROM part),
s AS (SELECT *, CASE hardness WHEN 'hard_constraint' THEN 3 WHEN 'strong_default' THEN 2 ELSE 1 END AS h, (audience IS NOT NULL)::INT + (theme IS NOT NULL)::INT + (section IS NOT NULL)::INT + (breakpoint IS NOT NULL)::INT + (sale IS NOT NULL)::INT + (new IS NOT NULL)::INT AS axes FROM b),
places AS (SELECT * FROM (VALUES ('patient'), ('hcp')) a(au), (VALUES ('dark'), ('none')) t(th), (VALUES ('hero'), ('body'), ('footer'), ('banner')) x(se), (VALUES ('mobile'), ('desktop'), ('tablet')) y(br), (VALUES ('absent', 'absent'), ('present', 'absent'), ('present', 'present')) z(sa, ne)),
held AS (SELECT s.*, dense_rank() OVER (ORDER BY element_path, au, th, se, br, sa, ne) AS place FROM s, places WHERE coalesce(list_contains(split(audience, ','), au), true) AND coalesce(theme = th, true)
 AND coalesce(list_contains(split(section, ','), se), true) AND coalesce(list_contains(split(breakpoint, ','), br), true) AND coalesce(sale = sa, true) AND coalesce(new = ne, true)),
ranked AS (SELECT *, rank() OVER (PARTITION BY place ORDER BY h DESC, axes DESC, precedence DESC) AS top, row_number() OVER (PARTITION BY place ORDER BY h DESC, axes DESC, precedence DESC, source_id DESC) AS nth FROM held),
clash AS (SELECT place, count(DISTINCT value) > 1 AS conflict FROM ranked WHERE top = 1 GROUP BY place),
judged AS (SELECT r.*, conflict, CASE WHEN conflict THEN top = 1 ELSE nth = 1 END AS wins FROM ranked r JOIN clash USING (place))"""


def cell_inputs(spark, sf):
    rows = t(spark, sf, "part").selectExpr(*[f"{e} AS {c}" for c, e in _CELL.items()])
    axes = {"audience": "audience", "theme": "theme", "section": "section", "breakpoint": "breakpoint", "sale": "tag:sale", "new": "tag:new"}
    pairs = F.filter(F.array(*[F.struct(F.lit(a).alias("k"), F.split(c, ",").alias("v")) for c, a in axes.items()]), lambda p: p["v"].isNotNull())
    bindings = rows.select(
        "element_path", "source_id", F.lit("rule_binding").alias("source_kind"), "value", F.map_from_entries(pairs).alias("guard"), "hardness",
        F.lit(0).alias("selector_rank"), "precedence", F.lit("brand").alias("scope"),
    )
    known = {"audience": ("patient", "hcp"), "theme": ("dark", "none"), "section": ("hero", "banner"), "breakpoint": ("tablet",)}
    domains = spark.createDataFrame([(a, v) for a, vs in known.items() for v in vs], "axis string, value string")
    combinations = spark.createDataFrame([([],), (["sale"],), (["sale", "new"],)], "tags array<string>")
    bindings = X.of_kinds(bindings)
    return bindings, X.cells(bindings, domains, combinations)


@query(_CELL_SQL + """, per AS (SELECT element_path, place, list_sort(list(source_id)) AS active, list_sort(list(source_id) FILTER (wins)) AS winners, bool_or(conflict) AS conflict FROM judged GROUP BY ALL)
SELECT element_path, len(active) AS candidates, conflict, array_to_string(winners, ',') AS winners FROM (SELECT DISTINCT element_path, active, winners, conflict FROM per)""")
def residual_cells(spark, sf):
    """The sets of bindings that hold together somewhere on a path, and who wins in each."""
    return X.cell_winners(*cell_inputs(spark, sf)).select("element_path", "candidates", "conflict", F.array_join("winners", ",").alias("winners"))


@query(_CELL_SQL + """, live AS (SELECT DISTINCT source_id FROM judged WHERE wins)
SELECT l.element_path, l.source_id, array_to_string(list_sort(list(DISTINCT w.source_id)), ',') AS shadowed_by FROM judged l JOIN judged w ON l.place = w.place AND w.wins WHERE l.source_id NOT IN (SELECT source_id FROM live) GROUP BY ALL""")
def shadowed_cells(spark, sf):
    """Bindings that hold somewhere and win nowhere, over contexts and all that they leave open."""
    return X.never_winning(*cell_inputs(spark, sf)).select("element_path", "source_id", F.array_join("shadowed_by", ",").alias("shadowed_by"))


@query(_BIND + """SELECT x.element_path, x.source_id AS a_id, y.source_id AS b_id, CASE WHEN x.h = 3 AND y.h = 3 THEN 'hard_hard' ELSE 'equal_specificity' END AS kind FROM b x JOIN b y ON x.element_path = y.element_path
 AND x.source_id < y.source_id AND x.value <> y.value AND ((x.h = 3 AND y.h = 3) OR (x.h = y.h AND x.axes = y.axes AND x.precedence = y.precedence))
 AND (x.audience IS NULL OR y.audience IS NULL OR x.audience = y.audience) AND (x.section IS NULL OR y.section IS NULL OR x.section = y.section)""")
def pair_conflicts(spark, sf):
    return L.pair_conflicts(binding_rows(spark, sf).withColumn("spec", K.specificity()))


@query(cte("rules") + """, p AS (SELECT id, CASE WHEN gov_type IS NOT NULL THEN 'governance' WHEN constraint_type IN ('ordering', 'cardinality', 'pairing', 'exclusivity') THEN 'structure' WHEN hardness = 'hard_constraint' THEN 'hard' ELSE 'guidance' END AS bucket,
 CASE WHEN section_types IS NULL THEN ['*'] ELSE list_distinct([CASE WHEN s IN ('sec_1', 'sec_2') THEN s ELSE '*' END FOR s IN section_types]) END AS secs FROM rules WHERE coalesce(constraint_type, '') <> 'binding')
SELECT id, bucket, unnest(secs) AS section FROM p""")
def rule_placement(spark, sf):
    return K.placements(derive(spark, sf, "rules"), ["sec_1", "sec_2"])


@query(cte("rules") + """, s AS (SELECT list_sort(list_distinct(tags)) AS tags FROM rules WHERE tags IS NOT NULL)
SELECT DISTINCT len(tags)::INT AS size, array_to_string(tags, ',') AS tags FROM (SELECT tags FROM s UNION SELECT [x] FROM (SELECT unnest(tags) AS x FROM s) UNION SELECT [])""")
def tag_combinations(spark, sf):
    return K.tag_combinations(derive(spark, sf, "rules"), "tags").withColumn("tags", F.array_join("tags", ","))


@query()
def cascade_sheets(spark, sf):
    """Content-addressed sheets of all contexts; the hash is over our own JSON, so tests check it."""
    contexts = spark.createDataFrame([(a, {"audience": a}, []) for a in ("patient", "hcp", "nobody")], "context_key string, context map<string,string>, tags array<string>")
    sheets, by_context = K.sheets(K.resolve(K.survivors(binding_rows(spark, sf), contexts)))
    return by_context.join(sheets, "sheet_hash").select("context_key", "sheet_hash", F.length("payload").alias("size"))


# -------------------------------------------------------------- consistency (L)


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') < 1 OR count(*) FILTER (l_returnflag = 'R') > 3""")
def layout_cardinality(spark, sf):
    return L.cardinality_violations(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", 1, 3)


@query("""SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'A') AS first_at, min(l_linenumber) FILTER (l_returnflag = 'N') AS then_at FROM lineitem GROUP BY 1
HAVING min(l_linenumber) FILTER (l_returnflag = 'N') < min(l_linenumber) FILTER (l_returnflag = 'A')""")
def layout_ordering(spark, sf):
    return L.ordering_violations(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "A", F.col("l_returnflag") == "N")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND NOT bool_or(l_returnflag = 'R')")
def layout_pairing(spark, sf):
    return L.pairing_violations(t(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 2 GROUP BY 1")
def layout_exclusivity(spark, sf):
    return L.exclusivity_violations(t(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linenumber") <= 2)


@query("""SELECT a.s_nationkey AS token_id, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_suppkey % 2 = b.s_suppkey % 2""")
def intra_token(spark, sf):
    guard = F.create_map(F.lit("theme"), F.array(F.concat(F.lit("t"), (F.col("s_suppkey") % 2).cast("string"))))
    rows = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("token_id"), F.col("s_suppkey").alias("at"), guard.alias("when"), F.col("s_name").alias("value"))
    return L.variant_conflicts(rows)


@query("""WITH v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey % 5 END AS p, c_custkey % 300 AS tr, c_mktsegment AS f FROM customer)
SELECT a.p, a.tr, a.id AS a_id, b.id AS b_id FROM v a JOIN v b ON a.p IS NOT DISTINCT FROM b.p AND a.tr IS NOT DISTINCT FROM b.tr AND a.id < b.id AND a.f <> b.f""")
def verbatim_clash(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") % 5).alias("p"), (F.col("c_custkey") % 300).alias("tr"), F.col("c_mktsegment").alias("f"))
    return L.verbatim_clashes(rows, "id", "p", "tr", "f")


@query("""SELECT a.s_suppkey AS a_id, b.s_suppkey AS b_id, CASE WHEN b.s_name > a.s_name THEN b.s_suppkey ELSE a.s_suppkey END AS winner, greatest(a.s_suppkey % 3, b.s_suppkey % 3) + 1 AS precedence
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def precedence_proposals(spark, sf):
    rows = t(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("place"), (F.col("s_suppkey") % 3).alias("precedence"))
    return L.precedence_proposals(rows, "s_nationkey")


@query()
def layout_cores(spark, sf):
    """Contradictory layout rules of orders: each line is a rule, on sections of its order."""
    number = lambda c: (F.col(c) % 5).cast("int")
    kinds = F.array(*[F.lit(k) for k in ("at_least", "at_most", "before", "requires", "forbids")])
    rules = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("context"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("id"), F.element_at(kinds, (F.col("l_quantity") % 5).cast("int") + 1).alias("kind"),
        F.concat(F.lit("s"), number("l_partkey")).alias("a"), F.concat(F.lit("s"), number("l_suppkey")).alias("b"), (F.col("l_quantity") % 8).cast("int").alias("n"),
    )
    return L.layout_cores(rules)


# --------------------------------------------------------------- extraction (M)


@query("""SELECT doc_id::VARCHAR AS doc_ref, (i - 1)::INT AS ordinal, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def paragraph_units(spark, sf):
    rows = U.paragraphs(t(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")
    return rows.select("doc_ref", "ordinal", "text")


@query()
def segment_units(spark, sf):
    """Gap-free units; tests check that they put the text together again."""
    return U.segment(t(spark, sf, "documents"), "doc_id", "text").select("doc_ref", "ordinal", "start", "end", "kind")


@query("""SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS start, strpos(d.text, b.text) - 1 + length(b.text) AS "end" FROM documents d, benchmark b WHERE contains(d.text, b.text)""")
def quote_align_exact(spark, sf):
    quotes = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = M.exact_quotes(quotes, t(spark, sf, "documents").select("doc_id", F.col("text").alias("body")), "quote", "body")
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query()
def fuzzy_align(spark, sf):
    """Quotes with a slip against the lines they come from."""
    lines = U.paragraphs(t(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_ref", "ordinal")  # a few rows are long
    # 28 characters from any place of the line
    places = F.greatest(F.length("text") - 27, F.lit(1))
    at = (F.pmod(F.xxhash64("doc_ref", "ordinal"), places) + 1).cast("int")
    quote = F.concat(F.substr("text", at, F.lit(10)), F.lit("x"), F.substr("text", at + 10, F.lit(18)))
    return lines.withColumn("a", M.aligned(quote, F.col("text"))).select("doc_ref", "ordinal", "a.start", "a.match", F.round("a.ratio", 3).alias("ratio"))


@query()
def cited_alignment(spark, sf):
    """A quote of each line's end and the next one's beginning; two of three cite both lines, the third only the line before."""
    lines = U.paragraphs(t(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")
    named = lambda n: F.concat("doc_ref", F.lit(":"), n.cast("string"))
    units = lines.withColumn("unit_id", named(F.col("ordinal")))
    after = lines.select("doc_ref", (F.col("ordinal") - 1).alias("ordinal"), F.substring("text", 1, 18).alias("head"))
    both = F.concat(F.substring("text", -18, 18), F.lit("x"), F.coalesce("head", F.lit("")))
    cites = F.when(F.col("ordinal") % 3 == 2, F.array(named(F.col("ordinal") - 1))).otherwise(F.array(named(F.col("ordinal")), named(F.col("ordinal") + 1)))
    quote = F.when(F.col("ordinal") % 3 == 2, F.substring("text", 1, 30)).otherwise(both)
    quotes = lines.join(after, ["doc_ref", "ordinal"], "left").select(named(F.col("ordinal")).alias("quote_id"), quote.alias("quote"), cites.alias("unit_ids"))
    found = M.align_cited(quotes, units)
    return found.select("quote_id", "doc_ref", F.array_join("unit_ids", ",").alias("unit_ids"), "start", "end", "match", F.round("ratio", 3).alias("ratio"))


@query(r"""SELECT doc_id, regexp_matches(text, '#[0-9a-fA-F]{3,8}(?:$|[^\pL\pN_])|(?i)(?:^|[^\pL\pN_])(?:[0-9]+(?:\.[0-9]+)?\s*(?:px|pt|em|rem|%)(?:$|[^\pL\pN_])|[0-9]+\s*:\s*[0-9]+(?:$|[^\pL\pN_])|rgb\s*\(\s*[0-9]{1,3}\s*,\s*[0-9]{1,3}\s*,\s*[0-9]{1,3}\s*\)|(?:font-weight|weight)\s*:?\s*[0-9]{1,4}(?:$|[^\pL\pN_]))') AS has_value,
 regexp_matches(text, '(?i)(?:^|[^\pL\pN_])(?:must|never|always|only|do not|don''t|required|reserved|max(?:imum)?|min(?:imum)?|at least|at most|exactly|prohibited|avoid)(?:$|[^\pL\pN_])') AS has_norm FROM documents""")
def heuristic_labels(spark, sf):
    found = t(spark, sf, "documents").select("doc_id", M.labels(F.lit("sentence"), F.col("text")).alias("l"))
    return found.select("doc_id", F.array_contains("l", "value").alias("has_value"), F.array_contains("l", "normative").alias("has_norm"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'prose,value' WHEN quality = 0 THEN 'noise,prose' ELSE 'prose' END AS labels, toxic = 1 OR quality = 1 AS required FROM labels""")
def label_merge(spark, sf):
    locked = F.when(F.col("toxic") == 1, F.array(F.lit("value"))).when(F.col("quality") == 0, F.array(F.lit("noise"))).otherwise(F.array().cast("array<string>"))
    merged, required = M.merged_labels(F.lit("sentence"), locked, F.array(F.lit("prose")), F.col("quality") == 1)
    return t(spark, sf, "labels").select("doc_id", F.array_join(merged, ",").alias("labels"), required.alias("required"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS claims, count(*) FILTER (l_returnflag = 'R') AS rules FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
SELECT o_orderkey AS unit_id, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'excluded' WHEN coalesce(claims, 0) = 0 THEN 'unclaimed' WHEN rules > 1 AND o_orderpriority = '1-URGENT' THEN 'over_claimed' ELSE 'covered' END AS status
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def coverage_ledger(spark, sf):
    orders = t(spark, sf, "orders")
    labelled = orders.select(F.col("o_orderkey").alias("unit_id"), F.lit(True).alias("required"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("normative"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    claimed = t(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("unit_id"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("entity_id"), F.when(F.col("l_returnflag") == "R", "rule").otherwise("token").alias("kind"))
    excluded = orders.where("o_orderstatus = 'F' AND o_totalprice > 400000").select(F.col("o_orderkey").alias("unit_id"))
    return M.ledger(labelled, claimed, excluded).select("unit_id", "status")


@query("""SELECT l_partkey AS grp, count(DISTINCT l_linenumber) AS runs, 2 * count(DISTINCT l_linenumber) > 7 AS consensus FROM lineitem GROUP BY 1""")
def ensemble_consensus(spark, sf):
    rows = t(spark, sf, "lineitem").withColumnRenamed("l_partkey", "grp")
    return M.consensus(rows, "grp", "l_linenumber", 7)


@query("""WITH v AS (SELECT o_custkey AS g, o_orderstatus AS run, unnest(['p', 'y']) AS field, unnest([CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END, (year(o_orderdate) % 3)::VARCHAR]) AS value FROM orders),
c AS (SELECT g, field, value, count(*) AS n, max((run = 'F')::INT) AS ch FROM v GROUP BY ALL)
SELECT g, field, value, n AS votes, round(n::DOUBLE / total, 9) AS agreement FROM (SELECT *, sum(n) OVER (PARTITION BY g, field) AS total, row_number() OVER (PARTITION BY g, field ORDER BY n DESC, ch DESC, value NULLS FIRST) AS r FROM c) WHERE r = 1""")
def field_votes(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderstatus").alias("run"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p"), (F.year("o_orderdate") % 3).alias("y"))
    return M.field_votes(rows, "g", "run", ["p", "y"], "F").withColumn("agreement", F.round("agreement", 9))


_PATCH = """p AS (SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS op, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS k,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders),
told AS (SELECT p.*, c_custkey IS NOT NULL AS initial, last_value(CASE WHEN op IN ('add', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p LEFT JOIN customer ON c_custkey = k),
judged AS (SELECT *, (op = 'add') <> (CASE WHEN last IS NULL THEN initial ELSE last = 'add' END) AS ok FROM told),
turns AS (SELECT *, max(CASE WHEN op <> 'update' THEN seq END) OVER (PARTITION BY k) AS turn FROM judged WHERE ok),
ends AS (SELECT k, arg_max(op, seq) FILTER (op <> 'update') AS last_op, arg_max(v, seq) FILTER ((turn IS NULL OR seq >= turn) AND v IS NOT NULL AND op <> 'delete') AS new_v FROM turns GROUP BY k),
after AS (SELECT coalesce(c_custkey, k) AS k, CASE WHEN last_op = 'add' THEN new_v ELSE coalesce(new_v, c_acctbal) END AS v FROM customer FULL JOIN ends ON c_custkey = k
 WHERE CASE WHEN last_op IS NULL THEN c_custkey IS NOT NULL ELSE last_op = 'add' END)"""


def patch_inputs(spark, sf):
    state = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    kind = F.col("o_orderkey") % 3
    key = F.when((kind == 0) & (F.col("o_orderkey") % 2 == 0), F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    op = F.when(kind == 0, "add").when(kind == 1, "update").otherwise("delete")
    value = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return state, t(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), op.alias("op"), key.alias("k"), value.alias("v"))


@query(f"WITH {_PATCH} SELECT k, v FROM after")
def patch_apply(spark, sf):
    """Several patches a key, one after another."""
    return M.apply_patches(*patch_inputs(spark, sf), "k", ["v"])[0]


@query(f"WITH {_PATCH} SELECT seq, k, op, CASE WHEN op = 'add' THEN 'exists' ELSE 'missing' END AS reason FROM judged WHERE NOT ok")
def patch_rejects(spark, sf):
    return M.apply_patches(*patch_inputs(spark, sf), "k", ["v"])[1]


@query(f"""WITH {_PATCH}, t AS (SELECT DISTINCT k FROM p) SELECT t.k, c_custkey IS NOT NULL AS was, a.k IS NOT NULL AS is_now, coalesce(c_custkey IS NOT NULL AND a.k IS NOT NULL AND c_acctbal IS NOT DISTINCT FROM a.v, false) AS unchanged
FROM t LEFT JOIN customer ON c_custkey = t.k LEFT JOIN after a ON a.k = t.k""")
def patch_audit(spark, sf):
    """Hashes of patched rows before and after tell what changed."""
    state, patches = patch_inputs(spark, sf)
    found = M.audit(state, M.apply_patches(state, patches, "k", ["v"])[0], patches, "k", ["v"])
    return found.select("k", F.col("before").isNotNull().alias("was"), F.col("after").isNotNull().alias("is_now"), F.coalesce(F.col("before") == F.col("after"), F.lit(False)).alias("unchanged"))


# Orders as a log over the customers and what splits make of them: a customer c, its parts ca and cb, and its neighbour.
_LOG = {
    "seq": "o_orderkey",
    "g": "CAST(floor(o_custkey / 3) AS BIGINT)",
    "op": "CASE WHEN o_orderkey % 40 < 3 THEN 'add' WHEN o_orderkey % 40 BETWEEN 16 AND 20 THEN 'delete' WHEN o_orderkey % 40 BETWEEN 21 AND 23 THEN 'split' "
    "WHEN o_orderkey % 40 BETWEEN 24 AND 27 OR o_orderkey % 40 = 38 THEN 'merge' ELSE 'update' END",
    "kind": "CASE WHEN o_orderkey % 40 = 39 THEN 'x' ELSE 'e' END",
    "tg": "CASE WHEN o_orderkey % 40 < 3 THEN NULL WHEN o_orderkey % 40 IN (11, 12, 13, 18, 23, 29, 31, 33, 35, 37) THEN 'c' || o_custkey || 'a' "
    "WHEN o_orderkey % 40 IN (14, 15, 19) THEN 'c' || o_custkey || 'b' WHEN o_orderkey % 40 = 20 THEN 'c' || o_custkey || 'a,c' || o_custkey || 'b' "
    "WHEN o_orderkey % 40 IN (24, 38) THEN 'c' || o_custkey || ',c' || o_custkey || 'a' WHEN o_orderkey % 40 = 25 THEN 'c' || o_custkey || 'a,c' || o_custkey || 'b,c' || o_custkey "
    "WHEN o_orderkey % 40 = 26 AND o_custkey % 3 <> 2 THEN 'c' || o_custkey || ',c' || (o_custkey + 1) WHEN o_orderkey % 40 = 27 THEN 'c' || o_custkey || 'b,c' || o_custkey || 'a' "
    "ELSE 'c' || o_custkey END",
    "made": "CASE WHEN o_orderkey % 40 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 40 = 1 THEN 'c' || o_custkey || 'a' WHEN o_orderkey % 40 = 2 THEN 'c' || o_custkey || 'b' "
    "WHEN o_orderkey % 40 = 21 THEN 'c' || o_custkey || 'a,c' || o_custkey || 'b' WHEN o_orderkey % 40 = 22 THEN 'c' || o_custkey || ',c' || o_custkey || 'b' "
    "WHEN o_orderkey % 40 = 23 THEN 'c' || o_custkey || ',c' || o_custkey || 'a' WHEN o_orderkey % 40 BETWEEN 3 AND 15 OR o_orderkey % 40 BETWEEN 28 AND 37 OR o_orderkey % 40 = 39 THEN 'x' END",
    "keep": "CASE o_orderkey % 40 WHEN 24 THEN 'c' || o_custkey WHEN 25 THEN 'c' || o_custkey || 'b' WHEN 26 THEN 'c' || (o_custkey + 1) WHEN 27 THEN 'c' || o_custkey || 'a' WHEN 38 THEN 'c' || o_custkey || 'b' END",
    "v": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END",
}
_LOG_SQL = f"""WITH RECURSIVE log AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _LOG.items())} FROM orders),
p AS (SELECT seq, g, op, keep, v, coalesce(split(tg, ','), []) AS tg, list_transform(coalesce(split(made, ','), []), lambda x, i: {{'id': x, 'v': v + i - 1}}) AS made,
 CASE WHEN op = 'merge' AND NOT contains(tg, ',') THEN 'two_targets' WHEN op = 'merge' AND NOT list_contains(split(tg, ','), keep) THEN 'keep' WHEN kind = 'x' THEN 'kind' END AS wrong,
 row_number() OVER (PARTITION BY g ORDER BY seq) AS n FROM log),
run AS (
 SELECT CAST(floor(c_custkey / 3) AS BIGINT) AS g, 0::BIGINT AS n, list({{'id': 'c' || c_custkey, 'v': c_acctbal, 'o': ['c' || c_custkey]}}) AS st, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS reason FROM customer GROUP BY 1
 UNION ALL
 SELECT g, n, CASE WHEN reason IS NOT NULL THEN st
  WHEN op = 'add' THEN list_concat(st, [{{'id': made[1].id, 'v': made[1].v, 'o': []::VARCHAR[]}}])
  WHEN op = 'update' THEN list_transform(st, lambda x: CASE WHEN x.id = tg[1] THEN {{'id': x.id, 'v': coalesce(v, x.v), 'o': x.o}} ELSE x END)
  WHEN op = 'delete' THEN list_filter(st, lambda x: NOT list_contains(tg, x.id))
  WHEN op = 'split' THEN list_concat(list_filter(st, lambda x: x.id <> tg[1]), list_transform(made, lambda m: {{'id': m.id, 'v': m.v, 'o': list_filter(st, lambda x: x.id = tg[1])[1].o}}))
  ELSE list_concat(list_filter(st, lambda x: NOT list_contains(tg, x.id)), [{{'id': keep, 'v': list_filter(list_transform(list_concat([keep], list_filter(tg, lambda z: z <> keep)), lambda y: list_filter(st, lambda x: x.id = y)[1].v), lambda w: w IS NOT NULL)[1],
   'o': list_distinct(flatten(list_transform(list_filter(st, lambda x: list_contains(tg, x.id)), lambda x: x.o)))}}]) END, seq, op, reason
 FROM (SELECT p.g, p.n, st, p.seq, p.op, tg, made, keep, v, CASE WHEN wrong IS NOT NULL THEN wrong WHEN p.op = 'add' THEN CASE WHEN list_contains(list_transform(st, lambda x: x.id), made[1].id) THEN 'exists' END
   WHEN NOT list_has_all(list_transform(st, lambda x: x.id), tg) THEN 'missing'
   WHEN p.op = 'split' AND list_has_any(list_transform(st, lambda x: x.id), list_filter(list_transform(made, lambda m: m.id), lambda x: x <> tg[1])) THEN 'exists' END AS reason
  FROM run JOIN p ON p.g = run.g AND p.n = run.n + 1))"""


def applied_log(spark, sf):
    state = t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.lit("e").alias("kind"), F.col("c_acctbal").alias("v"))
    log = t(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _LOG.items()])
    log = log.selectExpr("seq", "op", "kind", "split(tg, ',') AS targets", "keep", "transform(split(made, ','), (x, i) -> struct(x AS id, v + i AS v)) AS products")
    return state, P.apply_log(state, log)


@query(_LOG_SQL + " SELECT seq, op, CASE WHEN reason IS NULL THEN 'applied' ELSE 'rejected' END AS status, reason FROM run WHERE n > 0")
def patch_log(spark, sf):
    """What became of each patch of a log with splits and merges."""
    return applied_log(spark, sf)[1].audit.select("seq", "op", "status", "reason")


@query(_LOG_SQL + """, last AS (SELECT unnest(st) AS e FROM (SELECT arg_max(st, n) AS st FROM run GROUP BY g)), ways AS (SELECT unnest(e.o) AS id, e.id AS final_id, e.v AS v FROM last)
SELECT 'c' || c_custkey AS id, final_id, round(v, 6) AS v FROM customer LEFT JOIN ways ON id = 'c' || c_custkey""")
def patch_lineage(spark, sf):
    """Which entities each customer has become in the end, with their values; null where nothing of it is left."""
    state, done = applied_log(spark, sf)
    ways = P.lineage(state, done.moves).where("final_id IS NOT NULL").join(done.entities.select(F.col("id").alias("final_id"), F.round("v", 6).alias("v")), "final_id")
    return state.select("id").join(ways, "id", "left").select("id", "final_id", "v")


# Parts as units of 40 blobs, every fifth claimed at first, and replies of three rounds; a quarter of the blobs answers only when escalated.
_GAP = {
    "k": "p_partkey",
    "doc_ref": "'d' || (p_partkey % 40)",
    "unit_id": "'u' || p_partkey",
    "unit_ids": "split('u' || p_partkey || ',u' || (p_partkey + 40), ',')",
    "own": "split('u' || p_partkey, ',')",
    "id": "'e' || p_partkey",
    "old_kind": "CASE WHEN p_partkey % 2 = 0 THEN 'rule' ELSE 'token_primitive' END",
    "round": "CAST(1 + floor(p_partkey / 40) % 3 AS INT)",
    "mode": "CASE WHEN p_partkey % 4 = 0 THEN 'escalate' ELSE 'gap_patch' END",
    "kind": "CASE WHEN p_partkey % 200 = 55 THEN 'asset' WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 'rule' WHEN p_partkey % 5 = 0 OR p_partkey % 4 IN (1, 2) THEN 'token' WHEN p_partkey % 4 = 3 THEN 'asset' ELSE 'rule' END",
    "marker": "CASE WHEN p_partkey % 200 = 17 THEN 'bogus' WHEN p_partkey % 5 = 0 OR p_partkey % 200 = 34 OR (p_partkey % 40) % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'token_primitive' ELSE 'token_semantic' END",
    "value": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END",
    "yields": "split(CASE (p_partkey % 40) % 3 WHEN 0 THEN 'token_primitive' WHEN 1 THEN 'token_primitive,token_semantic' ELSE 'rule' END, ',')",
    "verified": "p_partkey % 11 <> 0",
}


def _gap_round(n: int) -> str:
    """The tables of one round: asked, payload, judged, bad blobs, whole answers, entities, open units, counts, to escalate, go on."""
    b = n - 1
    return f"""a{n} AS (SELECT o.doc_ref, count(*) AS before, CASE WHEN o.doc_ref IN (SELECT doc_ref FROM x{b}) THEN 'escalate' ELSE 'gap_patch' END AS mode FROM o{b} o WHERE (SELECT go FROM g{b}) GROUP BY o.doc_ref),
p{n} AS (SELECT r.*, e.kind AS old FROM r JOIN a{n} a ON r.doc_ref = a.doc_ref AND r.mode = a.mode LEFT JOIN e{b} e ON e.id = r.id WHERE r.round = {n}),
j{n} AS (SELECT *, CASE WHEN kind <> 'token' THEN kind WHEN old IN ('token_primitive', 'token_semantic') THEN old ELSE coalesce(marker, CASE WHEN list_contains(yields, 'token_primitive') AND NOT list_contains(yields, 'token_semantic') THEN 'token_primitive' END) END AS made FROM p{n}),
w{n} AS (SELECT *, CASE WHEN kind = 'token' AND marker NOT IN ('token_primitive', 'token_semantic') THEN 'invalid_kind' WHEN made IS NULL THEN 'kind_missing' WHEN old <> made OR (kind = 'token' AND old <> marker) THEN 'kind_conflict' END AS wrong FROM j{n}),
k{n} AS (SELECT * FROM w{n} WHERE doc_ref NOT IN (SELECT doc_ref FROM w{n} WHERE wrong IS NOT NULL)),
h{n} AS (SELECT DISTINCT doc_ref FROM k{n} WHERE mode = 'escalate' AND doc_ref NOT IN (SELECT doc_ref FROM k{n} WHERE NOT verified)),
e{n} AS (SELECT coalesce(e.id, k.id) AS id, coalesce(e.kind, made) AS kind, coalesce(e.doc_ref, k.doc_ref) AS doc_ref, coalesce(k.value, e.value) AS value, coalesce(k.unit_ids, e.unit_ids) AS unit_ids
 FROM e{b} e FULL JOIN (SELECT * FROM k{n} WHERE verified) k ON e.id = k.id WHERE NOT coalesce(e.kind = 'rule' AND e.doc_ref IN (SELECT doc_ref FROM h{n}) AND e.id NOT IN (SELECT id FROM w{n} WHERE made = 'rule'), false)),
o{n} AS (SELECT unit_id, doc_ref FROM r WHERE required AND unit_id NOT IN (SELECT unnest(unit_ids) FROM e{n})),
c{n} AS (SELECT a.doc_ref, a.mode, a.before, count(o.unit_id) AS after FROM a{n} a LEFT JOIN o{n} o ON o.doc_ref = a.doc_ref GROUP BY ALL),
x{n} AS (SELECT doc_ref FROM c{n} WHERE after >= before AND doc_ref NOT IN ({" UNION ALL ".join(f"SELECT doc_ref FROM a{m} WHERE mode = 'escalate'" for m in range(1, n + 1))})),
g{n} AS (SELECT (SELECT go FROM g{b}) AND EXISTS (FROM o{n}) AND (EXISTS (FROM x{n}) OR EXISTS (SELECT unit_id FROM o{n} EXCEPT SELECT unit_id FROM o{b}) OR EXISTS (SELECT unit_id FROM o{b} EXCEPT SELECT unit_id FROM o{n})) AS go)"""


_GAP_SQL = f"""WITH r AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _GAP.items())}, p_partkey % 3 <> 0 AS required FROM part),
e0 AS (SELECT id, old_kind AS kind, doc_ref, 'old' AS value, own AS unit_ids FROM r WHERE k % 5 = 0), o0 AS (SELECT unit_id, doc_ref FROM r WHERE required AND unit_id NOT IN (SELECT unnest(unit_ids) FROM e0)),
x0 AS (SELECT doc_ref FROM r WHERE false), g0 AS (SELECT true AS go),
{", ".join(_gap_round(n) for n in (1, 2, 3))}"""


def closed_gaps(spark, sf):
    r = t(spark, sf, "part").selectExpr(*[f"{e} AS {c}" for c, e in _GAP.items()], "p_partkey % 3 <> 0 AS required")
    old = r.where("k % 5 = 0").select("id", F.col("old_kind").alias("kind"), "doc_ref", F.lit("old").alias("value"), F.col("own").alias("unit_ids"))
    relations = r.where("k % 10 = 0").select("doc_ref", F.concat(F.lit("r"), F.col("k") % 5).alias("relation"))
    links = r.where("k % 8 = 1").select("round", "doc_ref", "mode", F.concat(F.lit("r"), F.col("k") % 7).alias("relation"))
    return Y.close_gaps(r.select("unit_id", "doc_ref", "required", "yields"), old, relations, r.select("round", "doc_ref", "mode", "id", "kind", "marker", "value", "unit_ids", "verified"), links)


@query(_GAP_SQL + " " + " UNION ALL ".join(f"SELECT {n}::INTEGER AS round, doc_ref, mode, before, after FROM c{n}" for n in (1, 2, 3)))
def gap_rounds(spark, sf):
    """Three rounds over stored replies: what each blob was asked and how many of its units it left open."""
    return closed_gaps(spark, sf).rounds


@query(_GAP_SQL + " " + " UNION ALL ".join(f"SELECT {n}::INTEGER AS round, doc_ref, id, coalesce(wrong, 'unverified') AS reason FROM w{n} WHERE wrong IS NOT NULL OR (NOT verified AND doc_ref IN (SELECT doc_ref FROM k{n}))" for n in (1, 2, 3)))
def gap_rejects(spark, sf):
    return closed_gaps(spark, sf).rejects


@query(_GAP_SQL + " SELECT id, kind, doc_ref, value, array_to_string(unit_ids, ',') AS units FROM e3")
def gap_entities(spark, sf):
    return closed_gaps(spark, sf).entities.select("id", "kind", "doc_ref", "value", F.array_join("unit_ids", ",").alias("units"))


@query("""WITH w AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT c_custkey + 3 AS k FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT k, 'missing' AS problem FROM w WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT DISTINCT k, 'extra' FROM a WHERE k NOT IN (SELECT k FROM w) UNION ALL SELECT k, 'duplicate' FROM a GROUP BY k HAVING count(*) > 1""")
def contract_breaches(spark, sf):
    customers = t(spark, sf, "customer")
    answers = customers.select((F.col("c_custkey") + 3).alias("k")).unionAll(customers.where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    return M.contract_breaches(answers, t(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), "k")


_TRIAGE = """c AS (SELECT DISTINCT event_type AS queue, 'u' || user_id AS key FROM events WHERE value > 40), h AS (SELECT event_type AS queue, 'u' || user_id AS key, CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'waived' END AS status,
 row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS r FROM events WHERE value < 2)"""


def triage_rows(spark, sf):
    events = t(spark, sf, "events").select(F.col("event_type").alias("queue"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "event_id", "value")
    history = events.where("value < 2").select("queue", "key", F.when(F.col("event_id") % 2 == 0, "done").otherwise("waived").alias("status"), F.col("event_id").alias("position"))
    return M.triage(events.where("value > 40").select("queue", "key").distinct(), history)


@query(f"WITH {_TRIAGE} SELECT c.queue, c.key, coalesce(status, 'open') AS status FROM c LEFT JOIN h ON c.queue = h.queue AND c.key = h.key AND r = 1")
def triage_current(spark, sf):
    return triage_rows(spark, sf)[0]


@query(f"WITH {_TRIAGE} SELECT c.queue, c.key, 'open' AS status FROM c WHERE (queue, key) NOT IN (SELECT queue, key FROM h)")
def triage_new(spark, sf):
    return triage_rows(spark, sf)[1]


@query()
def greedy_clusters(spark, sf):
    """Order-dependent clustering of small groups; tests check it."""
    rows = t(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.collect_set(F.col("l_partkey") % 20).alias("units"))
    return M.greedy_clusters(rows, "l_suppkey", "l_linenumber", "units")


# ------------------------------------------------------------------- tokens (N)


@query(cte("tokens") + """, p AS (SELECT DISTINCT key FROM tokens), a AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM p WHERE starts_with(p.key, tokens.key || '.')) THEN key || '_value' ELSE key END AS path FROM tokens)
SELECT a.id, a.path, CASE a.token_type WHEN 'color' THEN 'color' WHEN 'spacing' THEN 'dimension' ELSE 'fontWeight' END AS type,
 CASE WHEN a.ref IS NOT NULL THEN '{' || b.path || '}' WHEN a.token_type = 'color' THEN '#aabb' || (a.n % 10) || (a.n % 10) WHEN a.token_type = 'spacing' THEN (a.n % 40) || '.5px' ELSE '600' END AS value FROM a LEFT JOIN a b ON a.ref = b.id""")
def token_tree(spark, sf):
    return N.leaves(derive(spark, sf, "tokens"))


@query("""SELECT 'theme.t' || (s_suppkey % 4) || '.json' AS mode, s_suppkey AS token_id, s_name AS value FROM supplier WHERE s_suppkey % 3 = 1""")
def token_modes(spark, sf):
    one = F.create_map(F.lit("theme"), F.array(F.concat(F.lit("t"), (F.col("s_suppkey") % 4).cast("string"))))
    two = F.map_concat(one, F.create_map(F.lit("surface"), F.array(F.lit("web"))))
    when = F.when(F.col("s_suppkey") % 3 == 1, one).when(F.col("s_suppkey") % 3 == 2, two).otherwise(G.empty())
    return N.modes(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("token_id"), F.col("s_name").alias("value"), when.alias("when")))


@query("""SELECT coalesce(a.k, b.k) AS path, coalesce('id_' || b.k, 'tok_' || a.k) AS id, coalesce(b.v, a.v) AS value, CASE WHEN b.k IS NULL THEN 'manual' WHEN a.k IS NULL THEN 'lost' ELSE 'canonical' END AS origin
FROM (SELECT s_suppkey::VARCHAR AS k, s_name AS v FROM supplier WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT s_suppkey::VARCHAR AS k, 'kept' AS v FROM supplier WHERE s_suppkey % 3 = 0) b ON a.k = b.k""")
def token_import(spark, sf):
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_name").alias("value"), "s_suppkey")
    canonical = rows.where("s_suppkey % 3 = 0").select("path", F.concat(F.lit("id_"), "path").alias("id"), F.lit("kept").alias("value"))
    return N.imported(rows.where("s_suppkey % 2 = 0").select("path", "value"), canonical)


# ----------------------------------------------- finalising, streaming, breadth


@query(cte("rules") + """, ch AS (SELECT id, n % 2 = 0 AS tgt FROM rules WHERE n % 3 = 0 UNION ALL SELECT 'rule_x', true), ex AS (SELECT id, CASE WHEN n % 4 = 0 THEN ' ' ELSE 'no' END AS reason FROM rules WHERE n % 7 = 0),
must AS (SELECT id FROM rules WHERE section_types IS NULL AND applies_kind IS NULL AND content_sub_type_ids IS NULL AND (hardness = 'hard_constraint' OR coalesce(severity = 'block', false))
 AND (content_types IS NULL OR list_contains(content_types, 'email')) AND (audience IS NULL OR audience = 'patient'))
SELECT 'unknown' AS "check", 'rule_x' AS id UNION ALL SELECT 'contradicted', id FROM ch WHERE id IN (SELECT id FROM ex) UNION ALL SELECT 'no_reason', id FROM ex WHERE trim(reason) = ''
UNION ALL SELECT 'not_excludable', id FROM must WHERE id IN (SELECT id FROM ex)
UNION ALL SELECT 'unaccounted', id FROM rules WHERE (section_types IS NULL OR list_has_any(section_types, ['sec_2']) OR applies_kind = 'position_in_email') AND id NOT IN (SELECT id FROM ch UNION SELECT id FROM must UNION SELECT id FROM ex)""")
def finalize_checks(spark, sf):
    rules = derive(spark, sf, "rules")
    chosen = rules.where("n % 3 = 0").select("id", F.when(F.col("n") % 2 == 0, "targeted").otherwise("email_wide").alias("bucket"))
    chosen = chosen.unionByName(spark.createDataFrame([("rule_x", "targeted")], "id string, bucket string"))
    excluded = rules.where("n % 7 = 0").select("id", F.when(F.col("n") % 4 == 0, " ").otherwise("no").alias("reason"))
    return V.finalize(rules, chosen, excluded, ["sec_2"])


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf):
    return O.window_counts(t(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark, sf):
    return O.latest_per_key(t(spark, sf, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "ts")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    """Engine breadth: a filtered aggregate."""
    rows = t(spark, sf, "lineitem").where("l_shipdate <= DATE'1998-09-02'")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")
def segment_cube(spark, sf):
    """Engine breadth: a cube."""
    joined = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


# --------------------------------------------------- catalogue and its renderings


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def catalogue_first(spark, sf):
    return T.first_per_id(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")[0]


@query(cte("rules", "tokens") + """, k AS (SELECT id, x.tid, x.pos FROM rules r, LATERAL (SELECT unnest(token_ids) AS tid, generate_subscripts(token_ids, 1) AS pos) x WHERE tid IN (SELECT id FROM tokens)),
s AS (SELECT id, array_to_string(list(tid ORDER BY pos), ',') AS token_ids FROM k GROUP BY id)
SELECT r.id, s.token_ids FROM rules r LEFT JOIN s ON r.id = s.id""")
def catalogue_refs(spark, sf):
    rules = derive(spark, sf, "rules").select("id", "token_ids")
    return T.known_refs(rules, "id", "token_ids", derive(spark, sf, "tokens"), "id")[0].withColumn("token_ids", F.array_join("token_ids", ","))


@query(cte("rules", "tokens") + "SELECT id, tid AS ref FROM (SELECT id, unnest(token_ids) AS tid FROM rules) WHERE tid NOT IN (SELECT id FROM tokens)")
def catalogue_dangling(spark, sf):
    return T.known_refs(derive(spark, sf, "rules").select("id", "token_ids"), "id", "token_ids", derive(spark, sf, "tokens"), "id")[1]


@query(cte("tokens") + "SELECT id, CASE WHEN ref IN (SELECT id FROM tokens) THEN ref END AS ref FROM tokens")
def catalogue_cleared(spark, sf):
    tokens = derive(spark, sf, "tokens").select("id", "ref")
    return T.known_ref(tokens, "ref", tokens.select(F.col("id").alias("known_id")), "known_id")


def raw_rules(spark, sf):
    rules = derive(spark, sf, "rules")
    return rules.select(
        "id", F.when(F.col("n") % 5 == 0, F.concat(F.lit("other."), "rule_class")).otherwise(F.concat(F.lit(" "), F.upper("rule_class"))).alias("rule_class"),
        F.when(F.col("n") % 4 == 0, "must").when(F.col("n") % 4 == 1, "?").otherwise(F.col("hardness")).alias("hardness"),
        F.when(F.col("n") % 13 == 0, " ").otherwise(F.col("rule_text")).alias("rule_text"), F.to_json(F.struct("token_ids")).alias("effect"),
    )


_RAW = cte("rules") + """, k AS (SELECT id, CASE WHEN rule_class IN ('small', 'large', 'promo') OR n % 5 = 0 THEN rule_class END AS c, rule_class, n, CASE WHEN n % 4 = 0 THEN 'hard_constraint' WHEN n % 4 = 1 THEN 'soft_guidance' ELSE hardness END AS h, token_ids FROM rules WHERE n % 13 <> 0)"""


@query(_RAW + "SELECT id, c AS rule_class, h AS hardness, array_to_string(list_distinct(token_ids), ',') AS token_ids FROM k".replace("list_distinct(token_ids)", "CASE WHEN token_ids[1] = token_ids[2] THEN token_ids[1:1] ELSE token_ids END"))
def rule_validation(spark, sf):
    rules, _ = T.validated_rules(raw_rules(spark, sf), ["small", "large", "promo"], {"must": "hard_constraint"})
    return rules.select("id", "rule_class", "hardness", F.array_join("token_ids", ",").alias("token_ids"))


@query(_RAW + "SELECT id, 'rule_class' AS field, ' ' || upper(rule_class) AS raw FROM k WHERE c IS NULL UNION ALL SELECT id, 'hardness', '?' FROM k WHERE n % 4 = 1")
def rule_warnings(spark, sf):
    return T.validated_rules(raw_rules(spark, sf), ["small", "large", "promo"], {"must": "hard_constraint"})[1]


@query(cte("rules") + "SELECT id FROM rules WHERE list_contains(section_types, 'sec_2') AND group_id = 'grp_4'")
def template_filter(spark, sf):
    return T.templates(derive(spark, sf, "rules").withColumnRenamed("section_types", "fills_section_types"), "sec_2", "grp_4").select("id")


@query("SELECT event_id FROM events WHERE upper(event_type) = 'CLICK'")
def library_filter(spark, sf):
    return T.library(t(spark, sf, "events").withColumnRenamed("event_type", "type"), "Click").select("event_id")


@query("""SELECT id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS keyword FROM part) JOIN (VALUES ('red', 'warm'), ('hot', 'warm'), ('bolt', 'metal'), ('gear', 'metal')) w(keyword, tag) USING (keyword) GROUP BY id""")
def inherited_tags(spark, sf):
    words = spark.createDataFrame([("red", "warm"), ("hot", "warm"), ("bolt", "metal"), ("gear", "metal")], "keyword string, tag string")
    found = T.inherited_tags(t(spark, sf, "part").withColumnRenamed("p_partkey", "id"), words, "p_name")
    return found.withColumn("tags", F.array_join("tags", ","))


@query("""SELECT o_custkey, coalesce(array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus <> 'F' AND o_orderpriority NOT IN (SELECT o_orderpriority FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F')))), ','), '') AS units FROM orders o GROUP BY 1""")
def dissent_units(spark, sf):
    rows = t(spark, sf, "orders").withColumn("u", F.array("o_orderpriority"))
    return T.dissent(rows, "o_custkey", "o_orderstatus", "u", "F").withColumn("units", F.array_join("units", ","))


@query("SELECT o_orderkey, 'f_' || lpad((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey))::VARCHAR, greatest(4, length((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey))::VARCHAR))::INT, '0') AS finding_id FROM orders")
def sequential_ids(spark, sf):
    return T.numbered(t(spark, sf, "orders"), "f", "o_orderstatus", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "finding_id")


@query("SELECT bool_and(c_acctbal > -2000) AND (SELECT count(*) FROM orders WHERE o_totalprice < 1000) = 0 AS accepted, count(*) FILTER (NOT c_acctbal > -2000) AS failed, (SELECT count(*) FROM orders WHERE o_totalprice < 1000) AS open FROM customer")
def acceptance_gate(spark, sf):
    return T.acceptance(t(spark, sf, "customer").select((F.col("c_acctbal") > -2000).alias("passed")), t(spark, sf, "orders").where("o_totalprice < 1000"))


@query("""WITH w AS (SELECT o_orderstatus, count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS customers, count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE AS urgent FROM orders GROUP BY 1)
SELECT o_orderstatus, metric, value FROM (UNPIVOT w ON n, customers, urgent INTO NAME metric VALUE value)""")
def metric_snapshot(spark, sf):
    measures = {"n": F.count("*"), "customers": F.countDistinct("o_custkey"), "urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT")}
    return T.metrics(t(spark, sf, "orders"), "o_orderstatus", measures)


@query("""SELECT conv_id, string_agg('[' || conv_id || '.' || turn || '] (' || role || ') ' || CASE WHEN role = 'user' THEN 'TARGET' ELSE 'context' END || ' ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY 1""")
def batch_rendering(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.concat_ws(".", "conv_id", "turn").alias("unit_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return T.render_units(rows, "conv_id", "turn", F.col("kind") == "user")


@query(cte("rules") + """
SELECT id, id || ' | sections=' || CASE WHEN section_types IS NULL THEN 'ALL' ELSE array_to_string(section_types, ',') END || ' | hardness=' || hardness || coalesce(' | gov_severity=' || severity, '') || CASE WHEN applies_kind IS NOT NULL THEN ' | conditional' ELSE '' END
 || ' :: ' || left(coalesce(summary, rule_text), 110) AS line FROM rules""")
def coverage_lines(spark, sf):
    return derive(spark, sf, "rules").select("id", T.coverage_line().alias("line"))


@query("SELECT doc_id, floor((sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) - 1) / 120000)::BIGINT AS chunk FROM documents")
def catalogue_chunks(spark, sf):
    return T.chunks(t(spark, sf, "documents"), "source", "doc_id", "text").select("doc_id", "chunk")


@query(cte("rules") + "SELECT id, left(rule_text, 200) AS evidence, CASE WHEN n % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM rules WHERE n % 3 = 0")
def specialist_reports(spark, sf):
    rules = derive(spark, sf, "rules")
    rows = rules.select(F.when(F.col("n") % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), "id")).alias("id"), F.col("rule_text").alias("evidence"), F.when(F.col("n") % 2 == 0, F.lit(0.9)).alias("confidence"))
    return T.reports(rows, rules)[0]


@query(cte("rules") + """SELECT id, 'a' AS shard FROM rules WHERE list_has_any(list_concat(coalesce(tags, []), [rule_class]), ['small', 'red']) UNION ALL SELECT id, 'b' FROM rules WHERE list_has_any(list_concat(coalesce(tags, []), [rule_class]), ['promo'])""")
def class_shards(spark, sf):
    return T.shard(derive(spark, sf, "rules"), {"a": ["small", "red"], "b": ["promo"]})


@query("""SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS found FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1""")
def loose_json(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure, here:\n```json\n"), "props", F.lit("\n``` done"))).otherwise("none {at all")
    return t(spark, sf, "events").select("event_id", T.loose_json_udf(text).alias("found"))


@query("""SELECT o_orderkey, 'Section ' || o_orderkey || chr(10) || 'Headline: ' || o_orderstatus || chr(10) || 'Copy: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Fact: x' ELSE '' END AS text FROM orders""")
def blueprint_render(spark, sf):
    fact = F.when(F.col("o_orderkey") % 2 == 0, F.lit("x"))
    return t(spark, sf, "orders").select("o_orderkey", T.render_section(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), fact).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_orderstatus IN ('F', 'O') THEN 'rejected' ELSE 'open' END AS resolution FROM orders""")
def mechanical_screen(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "fabrication").when(F.col("o_orderstatus") == "O", "distortion").otherwise("other")
    findings = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("target"), kind.alias("kind"), F.lit("open").alias("resolution"))
    return T.screened(findings, t(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("entity_id"))).select("o_orderkey", "resolution")


# ------------------------------------------------- provenance and the ledger's rest


def provenance_rows(spark, sf):
    """A value, its quote and the span it was aligned with, for each line of an order."""
    lines = t(spark, sf, "lineitem")
    canon = F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit("px"))
    said = F.when(F.col("l_linenumber") % 3 == 0, F.lit("none at all")).otherwise(F.concat(F.lit("set to "), F.col("l_quantity").cast("int").cast("string"), F.lit(" px here")))
    return lines.select(
        F.col("l_orderkey").alias("entity_id"), "l_linenumber", F.lit("spacing").alias("kind"), canon.alias("canon"), said.alias("span"),
        F.when(F.col("l_returnflag") == "R", F.lit("other words")).otherwise(said).alias("quote"), (F.col("l_linestatus") == "O").alias("is_ref"),
    )


_STATUS = """s AS (SELECT l_orderkey AS entity_id, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'n/a' WHEN l_linenumber % 3 <> 0 AND l_returnflag <> 'R' THEN 'value_verified' ELSE 'failed' END AS status FROM lineitem)"""


@query(f"WITH {_STATUS} SELECT entity_id, l_linenumber, status FROM s")
def value_verification(spark, sf):
    rows = provenance_rows(spark, sf)
    status = M.value_status(F.col("kind"), F.col("canon"), F.col("span"), F.col("quote"), F.col("is_ref"))
    return rows.select("entity_id", "l_linenumber", status.alias("status"))


@query(f"WITH {_STATUS} SELECT entity_id FROM s WHERE status <> 'n/a' GROUP BY 1 HAVING bool_and(status = 'failed')")
def quarantine(spark, sf):
    rows = value_verification(spark, sf).withColumn("is_concrete", F.lit(True))
    return M.quarantined(rows)


@query(f"WITH {_STATUS} SELECT entity_id FROM s WHERE l_linenumber % 2 = 1 GROUP BY 1 HAVING NOT bool_and(status = 'value_verified')")
def unverified_tokens(spark, sf):
    path = F.when(F.col("l_linenumber") % 4 == 1, "value.default").when(F.col("l_linenumber") % 2 == 1, "variants[0].value").otherwise("notes")
    return M.unverified(value_verification(spark, sf).withColumn("path", path))


@query("""WITH r AS (SELECT l_orderkey AS quote_id, CASE l_returnflag WHEN 'R' THEN 'exact' WHEN 'A' THEN 'normalized' ELSE 'fuzzy' END AS match, CASE l_returnflag WHEN 'N' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS ratio,
 l_linestatus = 'F' AS cited, 'd' || (l_partkey % 7) AS doc_ref, l_suppkey AS start, l_linenumber FROM lineitem),
k AS (SELECT *, CASE match WHEN 'exact' THEN 3 WHEN 'normalized' THEN 2 ELSE 1 END AS rank FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY rank DESC, ratio DESC, cited DESC, doc_ref, start, l_linenumber) AS n, rank() OVER (PARTITION BY quote_id ORDER BY rank DESC, ratio DESC, cited DESC) AS place FROM k)
SELECT quote_id, match, ratio, cited, doc_ref, start, (SELECT count(*) FROM o x WHERE x.quote_id = o.quote_id AND x.place = 1)::BIGINT AS ambiguous FROM o WHERE n = 1""")
def best_alignments(spark, sf):
    match = F.when(F.col("l_returnflag") == "R", "exact").when(F.col("l_returnflag") == "A", "normalized").otherwise("fuzzy")
    rows = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("quote_id"), match.alias("match"), F.when(match == "fuzzy", 0.95).otherwise(1.0).alias("ratio"),
        (F.col("l_linestatus") == "F").alias("cited"), F.concat(F.lit("d"), (F.col("l_partkey") % 7).cast("string")).alias("doc_ref"), F.col("l_suppkey").alias("start"),
    )
    return M.best_alignment(rows, "quote_id")


@query("""WITH u AS (SELECT l_orderkey AS quote_id, 'd' || (l_partkey % 3) AS doc_ref, l_suppkey AS s, l_suppkey + l_quantity::BIGINT AS e FROM lineitem), f AS (SELECT quote_id, min(doc_ref) AS doc_ref FROM u GROUP BY 1)
SELECT quote_id, doc_ref, min(s) AS start, max(e) AS "end" FROM u JOIN f USING (quote_id, doc_ref) GROUP BY ALL""")
def cited_hull(spark, sf):
    units = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("quote_id"), F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("doc_ref"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("end")
    )
    return M.hull(units, "quote_id")


@query("""SELECT l_orderkey AS unit_id, l_partkey AS entity_id, l_returnflag AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 4 <> 0 AND NOT (l_returnflag = 'N' OR (o_orderkey % 2 = 0 AND l_returnflag = 'A'))""")
def soft_mismatches(spark, sf):
    claimed = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("kind"))
    key = F.col("o_orderkey")
    expected = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 2 == 0, F.array(F.lit("N"), F.lit("A"))).otherwise(F.array(F.lit("N")))
    return M.soft_mismatches(claimed, t(spark, sf, "orders").select(key.alias("unit_id"), expected.alias("expected")))


@query("""SELECT o_orderkey AS entity_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')""")
def orphan_entities(spark, sf):
    spans = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.when(F.col("l_returnflag") == "R", "value_verified").otherwise("failed").alias("verification"), F.when(F.col("l_linestatus") == "F", "exact").otherwise("failed").alias("match"))
    return M.orphans(t(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id")), spans)


@query("""WITH k AS (SELECT DISTINCT o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 'hard_hard' WHEN 'O' THEN 'verbatim_clash' ELSE 'dead_entry' END AS kind FROM orders),
l AS (SELECT user_id AS key, arg_max(CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'accepted' END, event_id) AS status FROM events GROUP BY 1)
SELECT k.key, kind FROM k LEFT JOIN l ON k.key = l.key WHERE kind <> 'dead_entry' AND coalesce(status, 'open') = 'open'""")
def open_class_a(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "hard_hard").when(F.col("o_orderstatus") == "O", "verbatim_clash").otherwise("dead_entry")
    triaged = t(spark, sf, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 3 == 0, "open").otherwise("accepted").alias("status"), F.col("event_id").alias("position"))
    return M.open_class_a(t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), kind.alias("kind")), triaged)


@query("""SELECT o_custkey AS grp, min(o_orderpriority) AS ref FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1""")
def group_refs(spark, sf):
    return M.group_refs(t(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("ref")), "grp", "ref")[0]


@query("""SELECT run, 'duplicate_id' AS problem FROM (SELECT o_custkey AS run, CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE o_orderpriority END AS id FROM orders) WHERE trim(id) <> '' GROUP BY run, id HAVING count(*) > 1
UNION SELECT o_custkey, 'blank_id' FROM orders WHERE o_orderkey % 97 = 0""")
def run_problems(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.when(F.col("o_orderkey") % 97 == 0, " ").otherwise(F.col("o_orderpriority")).alias("id"))
    return M.run_problems(rows, "run", "id")


@query("""WITH b AS (SELECT o_orderkey, 'rule_acme_' || lower(o_orderstatus) || '_' || (o_custkey % 50) AS base FROM orders)
SELECT o_orderkey, base || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS minted FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS n FROM b)""")
def minted_rule_ids(spark, sf):
    slug = F.concat_ws("_", F.lower("o_orderstatus"), (F.col("o_custkey") % 50).cast("string"))
    return M.minted_ids(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "acme", slug, ["o_orderkey"]).select("o_orderkey", "minted")


@query("""WITH i AS (SELECT c_custkey AS old, 'r_' || c_custkey AS minted FROM customer WHERE c_custkey % 3 <> 0)
SELECT DISTINCT a.minted AS src, b.minted AS dst, o_orderpriority AS relation FROM orders JOIN i a ON a.old = o_custkey JOIN i b ON b.old = o_orderkey % 1000""")
def mapped_relations(spark, sf):
    ids = t(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("old"), F.concat(F.lit("r_"), F.col("c_custkey").cast("string")).alias("minted"))
    edges = t(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst"), F.col("o_orderpriority").alias("relation"))
    return M.mapped_relations(edges, ids)[0]


@query("""WITH v AS (SELECT o_custkey AS token, o_orderpriority AS g, o_orderstatus AS run, (year(o_orderdate) % 4)::VARCHAR AS value FROM orders), c AS (SELECT token, g, value, count(*) AS n, max((run = 'O')::INT) AS ch FROM v GROUP BY ALL)
SELECT token, g, value, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY token, g ORDER BY n DESC, ch DESC, value) AS r FROM c) WHERE r = 1""")
def merged_variants(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("run"), (F.year("o_orderdate") % 4).cast("string").alias("value"))
    guard = F.create_map(F.lit("theme"), F.array("g"))
    found = M.merged_variants(rows, "token", guard, "run", "value", F.col("run") == "O")
    names = rows.select("g").distinct().select("g", F.substring(F.sha1(F.to_json(guard)), 1, 16).alias("guard_hash"))
    return found.join(names, "guard_hash").select("token", "g", "value", "votes")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS path, o_orderpriority AS canon FROM orders) SELECT x.path, x.canon AS a, y.canon AS b FROM e x JOIN e y ON x.path = y.path AND x.canon < y.canon""")
def canon_conflicts(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("canon"))
    return M.canon_conflicts(rows, "path", "run", "canon", F.col("run") == "F")[1]


@query("""SELECT p_partkey, 'variants[' || (i - 1) || '].value' AS path, w AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)""")
def variant_paths(spark, sf):
    return M.variant_paths(t(spark, sf, "part").withColumn("words", F.split("p_name", " ")), "p_partkey", "words")


@query("""SELECT p_partkey, p_brand AS value, 1::BIGINT AS n FROM part""")
def evidence_strip(spark, sf):
    whole = F.create_map(F.lit("value"), F.col("p_brand"), F.lit("value_evidence"), F.col("p_name"), F.lit("_evidence"), F.col("p_type"))
    left = M.without_evidence(whole)
    return t(spark, sf, "part").select("p_partkey", F.element_at(left, "value").alias("value"), F.size(left).cast("long").alias("n"))


@query("""SELECT 'd' || k AS context, 'hard_hard' AS kind, k AS id FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) UNION SELECT 'd' || c_custkey, 'dead', c_custkey FROM customer WHERE c_custkey % 5 = 0""")
def merged_findings(spark, sf):
    rows = t(spark, sf, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("context"), F.col("c_custkey").alias("id"))
    old = rows.where("id % 5 = 0").withColumn("kind", F.lit("dead")).unionByName(rows.where("id % 3 = 0").withColumn("kind", F.lit("hard_hard")))
    return L.merge_findings(old, rows.where("id % 2 = 0").withColumn("kind", F.lit("hard_hard")), "hard_hard")


@query("""SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 9) AS agreement, CASE WHEN avg((o_orderstatus = 'F')::INT) >= 1 THEN 'high' WHEN avg((o_orderstatus = 'F')::INT) > 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM orders GROUP BY 1""")
def confidence_bucket(spark, sf):
    agreed = t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("agreement"))
    return agreed.select("o_orderpriority", F.round("agreement", 9).alias("agreement"), A.confidence(F.col("agreement")).alias("confidence"))


@query("""SELECT o_orderstatus AS run_id FROM orders GROUP BY 1 ORDER BY avg((o_orderpriority = '1-URGENT')::INT) DESC, count(*) DESC, 1 LIMIT 1""")
def champion_run(spark, sf):
    rates = t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("run_id")).agg(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("rate"), F.count("*").alias("coverage"))
    return M.champion(rates).select("run_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'deferred_human' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'accepted' END AS resolution FROM orders""")
def deferred_findings(spark, sf):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "major").otherwise("minor")
    rows = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("accepted").alias("resolution"), severity.alias("severity"))
    return M.deferred(rows).select("o_orderkey", "resolution")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'campaign' WHEN s_suppkey % 2 = 0 THEN 'brand' ELSE 'org_baseline' END AS scope, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || (s_suppkey % 5) END AS campaign FROM supplier""")
def rule_scopes(spark, sf):
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("campaign:c"), (F.col("s_suppkey") % 5).cast("string"))).otherwise("org")
    scope, campaign = K.scope_of(raw, F.col("s_suppkey") % 2 == 0)
    return t(spark, sf, "supplier").select("s_suppkey", scope.alias("scope"), campaign.alias("campaign"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS left_axes FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 3 = 1""")
def section_projection(spark, sf):
    """Bindings of one section: those for it lose the axis, those for any keep their other axes, those for another go."""
    n = F.col("p_partkey") % 3
    residual = F.when(n == 0, F.create_map(F.lit("section"), F.array(F.lit("hero"), F.lit("body")))).when(n == 1, F.create_map(F.lit("theme"), F.array(F.lit("dark")))).otherwise(F.create_map(F.lit("section"), F.array(F.lit("footer"))))
    rows = K.for_section(t(spark, sf, "part").select("p_partkey", residual.alias("residual")), "hero")
    return rows.select("p_partkey", F.size("residual").alias("left_axes"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '"[^"]+"|''[^'']+''|“[^”]+”|‘[^’]+’'), lambda x: substr(x, 2, length(x) - 2)), lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) >= 8)) > 0 AS has_long_quote FROM documents""")
def long_quotes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.has_long_quote(F.col("text")).alias("has_long_quote"))


@query("""SELECT section, name, regexp_extract(line, '^- ([a-z_]+): (.+)$', 2) AS description FROM (SELECT s_suppkey AS section, 'sec_' || chr((97 + s_suppkey % 26)::INT) AS name, '- sec_' || chr((97 + s_suppkey % 26)::INT) || ': ' || s_name AS line FROM supplier)""")
def vocabulary_lines(spark, sf):
    """Lines ``- name: description`` of a vocabulary."""
    line = F.concat(F.lit("- sec_"), F.chr(97 + F.col("s_suppkey") % 26), F.lit(": "), F.col("s_name"))
    name, description = S.vocabulary_line(line)
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("section"), name.alias("name"), description.alias("description"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def blueprint_sections(spark, sf):
    return B.sections(t(spark, sf, "orders").withColumnRenamed("o_orderpriority", "section_id"), ["5-LOW", "1-URGENT"]).select("o_orderkey")


# ------------------------------------------- ensembles, settings and records, rest

_WALK = """x AS (SELECT n, value, token_type, CASE WHEN n % 7 = 3 THEN -1 WHEN n % 2 = 1 THEN n // 2 END AS r FROM tokens),
w AS (WITH RECURSIVE walk AS (SELECT n AS id, n AS cur, r, value, token_type, 0 AS steps FROM x UNION ALL SELECT walk.id, x.n, x.r, x.value, x.token_type, steps + 1 FROM walk JOIN x ON walk.r = x.n) SELECT * FROM walk),
e AS (SELECT 'tok_' || id AS id, CASE WHEN r IS NULL THEN value END AS value, CASE WHEN r IS NULL THEN token_type END AS token_type, CASE WHEN r IS NULL THEN 'ok' ELSE 'missing' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY steps DESC) AS k FROM w) WHERE k = 1)
"""


@query(cte("tokens") + ", " + _WALK + """SELECT id, CASE token_type WHEN 'color' THEN 'color' WHEN 'spacing' THEN 'dimension' WHEN 'fontweight' THEN 'fontWeight' END AS type, status FROM e""")
def propagated_types(spark, sf):
    """The declared type of each token, through its references."""
    return N.propagated_types(derive(spark, sf, "tokens"), N.declared_type(F.col("token_type")))


@query(cte("rules", "tokens") + ", " + _WALK + """SELECT r.id, x.at - 1 AS at, e.id AS ref_id, e.value, e.status FROM rules r, LATERAL (SELECT unnest(r.token_ids) AS tid, generate_subscripts(r.token_ids, 1) AS at) x JOIN e ON e.id = x.tid""")
def hydrate_resolved(spark, sf):
    rules = derive(spark, sf, "rules").select("id", "token_ids")
    return C.hydrate_resolved(rules, "token_ids", derive(spark, sf, "tokens")).select("id", "at", "ref_id", "value", "status")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 3 AS k, p_size FROM part)
SELECT id, 'color' AS field, '#aabbcc' AS value FROM p WHERE k < 2
UNION ALL SELECT id, unnest(['offsetX', 'offsetY']), p_size || 'px' FROM p WHERE k = 0
UNION ALL SELECT id, 'blur', '{blur.p' || (p_size % 5) || '}' FROM p WHERE k = 0
UNION ALL SELECT id, 'width', p_size || '.5px' FROM p WHERE k = 1
UNION ALL SELECT id, 'style', 'dotted thin' FROM p WHERE k = 1
UNION ALL SELECT id, unnest(['fontFamily', 'fontSize', 'fontWeight', 'lineHeight']), unnest(['Acme Sans,serif', p_size || 'pt', '600', CASE WHEN p_size % 2 = 0 THEN '1.5' ELSE '20px' END]) FROM p WHERE k = 2""")
def composite_tokens(spark, sf):
    """Shadows, borders and typographies of parts, field by field."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    ref = F.concat(F.lit('{"$ref":"b'), (F.col("p_size") % 5).cast("string"), F.lit('"}'))
    shadow = F.concat(F.lit('{"x":"9","offset_x":"'), size, F.lit('","y":"'), size, F.lit(' PX","blur_radius":'), ref, F.lit(',"color":"#ABC"}'))
    border = F.concat(F.lit('{"color":"rgb(170, 187, 204)","width":"'), size, F.lit('.50 px","style":" Dotted  thin"}'))
    height = F.when(F.col("p_size") % 2 == 0, "1.50").otherwise("20 PX")
    type_ = F.concat(F.lit('{"font_family":"\'Acme Sans\', serif","fontSize":"'), size, F.lit('pt","font_weight":"Semi-Bold","line_height":"'), height, F.lit('","note":"x"}'))
    value = F.when(k == 0, shadow).when(k == 1, border).otherwise(type_)
    kind = F.when(k == 0, "shadow").when(k == 1, "border").otherwise("type_scale")
    paths = t(spark, sf, "part").select(F.concat(F.lit("b"), (F.col("p_size") % 5).cast("string")).alias("id"), F.concat(F.lit("blur.p"), (F.col("p_size") % 5).cast("string")).alias("path")).distinct()
    return N.composite_fields(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), kind.alias("token_type"), value.alias("value")), paths)


@query("""WITH r AS (SELECT DISTINCT o_orderstatus AS run, o_custkey AS g, o_orderpriority AS relation FROM orders), n AS (SELECT g, count(DISTINCT run) AS runs FROM r GROUP BY 1)
SELECT r.g AS "group", relation FROM r JOIN n ON r.g = n.g GROUP BY r.g, relation, runs HAVING bool_or(run = 'O') OR 2 * count(*) > runs""")
def relation_handoff(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("run"), F.col("o_custkey").alias("group"), F.col("o_orderpriority").alias("relation"))
    return M.relation_handoff(rows, rows.select("run", "group"), "O")


_EVIDENCE = "SELECT l_orderkey AS entity, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS guard, l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '_evidence' ELSE '' END AS path, list_sort(list(DISTINCT l_suppkey)) AS items FROM lineitem WHERE"


@query(f"""WITH a AS ({_EVIDENCE} l_quantity <= 30 GROUP BY ALL), b AS ({_EVIDENCE} l_quantity > 20 GROUP BY ALL),
m AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.guard, b.guard) AS guard, coalesce(a.path, b.path) AS path, a.items AS x, b.items AS y FROM a FULL JOIN b ON a.entity = b.entity AND a.guard = b.guard AND a.path = b.path)
SELECT entity, guard, path, CASE WHEN path LIKE '%\\_evidence' ESCAPE '\\' THEN list_sort(list_distinct(coalesce(x, []) || coalesce(y, []))) ELSE coalesce(x, y) END AS items FROM m
WHERE x IS NOT NULL OR (entity IN (SELECT entity FROM a) AND (path LIKE '%\\_evidence' ESCAPE '\\' OR NOT EXISTS (SELECT 1 FROM a WHERE a.entity = m.entity AND a.guard = m.guard)))""")
def evidence_trees(spark, sf):
    """Evidence of small quantities with that of large ones."""
    rows = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("guard"),
        F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "_evidence").otherwise("")).alias("path"), "l_suppkey", "l_quantity",
    )
    listed = lambda part: part.groupBy("entity", "guard", "path").agg(F.array_sort(F.collect_set("l_suppkey")).alias("items"))
    return M.merged_evidence(listed(rows.where("l_quantity <= 30")), listed(rows.where("l_quantity > 20")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def selected_units(spark, sf):
    excluded = t(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return M.selected_units(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), excluded, "l_partkey")


@query(cte("rules") + """SELECT unnest(section_types) AS section FROM rules UNION SELECT 'sec_f' || (s_suppkey % 4) FROM supplier UNION SELECT 'sec_h' || (s_nationkey % 3) FROM supplier UNION SELECT lower(r_name) FROM region""")
def section_names(spark, sf):
    fills = F.array(F.concat(F.lit("sec_f"), (F.col("s_suppkey") % 4).cast("string")))
    hosts = F.array(F.concat(F.lit("sec_h"), (F.col("s_nationkey") % 3).cast("string")))
    subtypes = t(spark, sf, "supplier").select(fills.alias("fills"), hosts.alias("hosts"))
    return M.section_names(derive(spark, sf, "rules"), subtypes, t(spark, sf, "region").select(F.lower("r_name").alias("section")))


@query("""WITH r AS (SELECT user_id, event_id, event_id % 4 // 2 AS signature, event_id % 5 AS fingerprint FROM events),
n AS (SELECT *, CASE WHEN lag(signature) OVER w = signature THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM n)
SELECT event_id, CASE WHEN fingerprint = first_value(fingerprint) OVER (PARTITION BY user_id, since ORDER BY event_id) THEN 'pass' ELSE 'fail' END AS status FROM s""")
def determinism(spark, sf):
    runs = t(spark, sf, "events").select("user_id", "event_id", F.floor(F.col("event_id") % 4 / 2).alias("signature"), (F.col("event_id") % 5).alias("fingerprint"))
    return T.determinism(runs, "user_id", "event_id").select("event_id", "status")


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0""")
def cache_hits(spark, sf):
    cache = t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return T.from_cache(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), cache, "o_custkey")[0].select("o_orderkey", "c_name")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def cache_misses(spark, sf):
    cache = t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return T.from_cache(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), cache, "o_custkey")[1].select("o_orderkey")


@query("""SELECT p_name AS name, coalesce(min(p_brand) FILTER (p_size > 45), min(p_type)) AS value, CASE WHEN count(*) FILTER (p_size > 45) > 0 THEN 0 ELSE 1 END AS layer FROM part GROUP BY 1""")
def settings_layers(spark, sf):
    part = t(spark, sf, "part").groupBy(F.col("p_name").alias("name"))
    own = part.agg(F.min(F.when(F.col("p_size") > 45, F.col("p_brand"))).alias("value"))
    return T.settings([own, part.agg(F.min("p_type").alias("value"))])


@query("""SELECT o_custkey, string_agg(n || ' ' || k || CASE WHEN n = 1 THEN '' ELSE 's' END, ', ' ORDER BY k) AS text FROM (SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def summary_texts(spark, sf):
    counts = t(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return T.summary_text(counts, "o_custkey", "o_orderstatus", "n")


@query("""SELECT p_partkey, unnest(['size', 'price.retail', 'price.deep.flag']) AS path, unnest([p_size::DOUBLE, p_retailprice::DOUBLE, (p_size > 20)::INT::DOUBLE]) AS value FROM part""")
def flattened_numbers(spark, sf):
    """Numbers of nested documents by dotted path."""
    deep = F.struct((F.col("p_size") > 20).alias("flag"), F.array("p_size").alias("list"))
    price = F.struct(F.col("p_retailprice").cast("double").alias("retail"), F.col("p_name").alias("name"), deep.alias("deep"))
    document = F.to_json(F.struct(F.col("p_size").alias("size"), price.alias("price")))
    found = t(spark, sf, "part").select("p_partkey", F.explode(T.flattened_numbers(document)).alias("f"))
    return found.select("p_partkey", "f.path", "f.value")


@query("""SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def first_seen(spark, sf):
    """Each language once, with its first place."""
    return D.first_seen(t(spark, sf, "documents"), "lang", "doc_id")


@query(cte("rules") + """SELECT id, (6 + (tags IS NOT NULL)::INT + (summary IS NOT NULL)::INT)::BIGINT AS n FROM (SELECT *, 1 FROM rules)""")
def full_rules(spark, sf):
    """Rules as JSON without nulls, by their number of fields."""
    rows = derive(spark, sf, "rules").select("id", "n", "rule_class", "hardness", "rule_text", "value", "tags", "summary")
    return B.full_json(rows, "id").select("id", F.size(F.json_object_keys("json")).cast("long").alias("n"))


@query("""SELECT n_name AS name, list_sort(list(DISTINCT s_nationkey % 4)) AS brands FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, [] FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def vocabulary_union(spark, sf):
    """The core vocabulary with the brands that use its names."""
    core = t(spark, sf, "nation").select(F.lit("section").alias("domain"), F.col("n_name").alias("name"), F.array().cast("array<bigint>").alias("brands"))
    found = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = found.select(F.lit("section").alias("domain"), F.col("n_name").alias("name"), (F.col("s_nationkey") % 4).cast("bigint").alias("brand"))
    return W.vocabulary(core, found).select("name", "brands")


@query("""SELECT s_suppkey || '[' || (i - 1) || ']' AS doc_ref, w AS text FROM (SELECT s_suppkey, unnest(string_split(s_name, '#')) AS w, generate_subscripts(string_split(s_name, '#'), 1) AS i FROM supplier)""")
def bible_blobs(spark, sf):
    return W.blobs(t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("category"), F.split("s_name", "#").alias("blobs")))


@query()
def markdown_pages(spark, sf):
    """Documents as HTML."""
    return t(spark, sf, "documents").select("doc_id", R.markdown_html(F.col("text")).alias("html"))


@query()
def layout_axioms(spark, sf):
    """Contradictions among the axioms of orders: their sections are suppliers, what lines fill is a supplier's."""
    section = lambda c: F.when(F.col(c) % 7 == 0, "top_matter").when(F.col(c) % 11 == 0, "end_matter").otherwise(F.concat(F.lit("s"), (F.col(c) % 5).cast("string")))
    lines = t(spark, sf, "lineitem").withColumn("context", F.col("l_orderkey").cast("string"))
    position = F.when(F.col("l_returnflag") == "R", "first").when(F.col("l_returnflag") == "A", "last")
    subtypes = lines.select("context", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), position.alias("position"), (F.col("l_linestatus") == "F").alias("locked"), F.array(section("l_suppkey"), section("l_partkey")).alias("fills"))
    return L.layout_cores(L.layout_axioms(lines.select("context", section("l_suppkey").alias("section")), subtypes.distinct()))
