"""Queries over the relational tables: claims, commits, logs, audits, joins, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, text
from ..functions import json as js
from ..operators import claims, lifecycle, ordered, relations, runlog
from .corpus import table


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("owner"), F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("resource"), F.when(F.col("l_linenumber") == 1, "exclusive").otherwise("intent").alias("access"), F.col("l_suppkey").alias("claim"))


_CLAIMS = "c AS (SELECT l_returnflag AS owner, l_orderkey AS group_id, l_partkey AS resource, CASE WHEN l_linenumber = 1 THEN 'exclusive' ELSE 'intent' END AS access, l_suppkey AS claim FROM lineitem)"


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.resource_conflicts(_claims(spark, sf_dir))


CLAIM_CONFLICTS = f"""WITH {_CLAIMS} SELECT a.resource, a.owner AS left_owner, b.owner AS right_owner, count(*) AS pairs FROM c a JOIN c b ON a.resource = b.resource AND a.owner < b.owner
WHERE a.access = 'exclusive' OR b.access = 'exclusive' GROUP BY ALL"""


def first_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.first_conflict(_claims(spark, sf_dir))


FIRST_CONFLICT = f"""WITH {_CLAIMS} SELECT a.resource, a.owner AS left_owner, b.owner AS right_owner, a.group_id AS left_group, b.group_id AS right_group FROM c a JOIN c b ON a.resource = b.resource AND a.owner < b.owner
WHERE a.access = 'exclusive' OR b.access = 'exclusive' ORDER BY 1, 2, 3, 4, 5 LIMIT 1"""


def claim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.claim_summary(_claims(spark, sf_dir).withColumn("ord", F.col("claim")), "ord")


CLAIM_SUMMARY = f"""WITH {_CLAIMS} SELECT resource, count(*) AS claims, CASE WHEN count(DISTINCT access) = 2 THEN 'mixed' WHEN count(*) FILTER (access = 'exclusive') > 1 THEN 'exclusive twice' ELSE '' END AS problem,
arg_min(group_id, struct_pack(a := claim, b := group_id)) AS representative FROM c GROUP BY resource"""


def lock_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _claims(spark, sf_dir).withColumn("resource", F.col("resource") % 7)
    return claims.lock_sets(rows).groupBy("access", "conflict").agg(F.count("*").alias("n"))


LOCK_SETS = f"""WITH {_CLAIMS}, p AS (SELECT group_id, claim, resource % 7 AS resource, max((access = 'exclusive')::INT) AS x FROM c GROUP BY ALL),
g AS (SELECT group_id, resource, CASE WHEN max(x) = 1 THEN 'exclusive' ELSE 'intent' END AS access, count(*) > 1 AND max(x) = 1 AS conflict FROM p GROUP BY ALL) SELECT access, conflict, count(*) AS n FROM g GROUP BY ALL"""


def prefix_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.split("p_type", " ")
    locks = table(spark, sf_dir, "part").select(F.explode(text.stable_prefix_locks(path)).alias("l")).select("l.*")
    return locks.groupBy("resource", "access").agg(F.count("*").alias("n"))


PREFIX_LOCKS = """WITH p AS (SELECT string_split(p_type, ' ') AS w FROM part), x AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM p)
SELECT array_to_string(w[1:i], '/') AS resource, CASE WHEN i = len(w) THEN 'exclusive' ELSE 'intent' END AS access, count(*) AS n FROM x GROUP BY ALL"""


def compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' states are written where they still are what the writer saw; the rest are conflicts."""
    o = table(spark, sf_dir, "orders")
    units = o.select("o_orderkey", F.col("o_orderstatus").alias("value"))
    pending = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.lit("?")).otherwise(F.col("o_orderstatus")).alias("expected"), F.lit("X").alias("value"), F.col("o_orderkey").alias("ordinal"))
    applied, conflicts = lifecycle.compare_and_swap(units, pending, ["o_orderkey"], "value")
    return applied.groupBy(F.col("value").alias("state")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first")).unionByName(conflicts.groupBy(F.lit("conflict").alias("state")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first")))


COMPARE_AND_SWAP = """WITH x AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 4 = 0 AS asked, o_orderkey % 4 = 0 AND (o_custkey % 3 <> 0 OR o_orderstatus = '?') AS hit FROM orders)
SELECT CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS state, count(*) AS n, min(o_orderkey) AS first FROM x GROUP BY 1
UNION ALL SELECT 'conflict', count(*), min(o_orderkey) FROM x WHERE asked AND NOT hit HAVING count(*) > 0"""


def upsert_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rejected = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("old").alias("candidate"))
    changes = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("candidate"))
    out = lifecycle.upsert_where(rejected, changes, o.filter("o_orderstatus = 'O'").select("o_orderkey"), ["o_orderkey"])
    return out.groupBy("candidate").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


UPSERT_PENDING = """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'old' END AS candidate FROM orders)
SELECT candidate, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM x WHERE candidate IS NOT NULL GROUP BY candidate"""


def apply_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    state = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "auto").alias("automatic"), (F.col("c_custkey") % 3 == 0).alias("rejected"), F.lit(None).cast("string").alias("manual"))
    manual = c.filter("c_nationkey < 5").select("c_custkey", F.col("c_mktsegment").alias("text"))
    out = lifecycle.apply_manual(state, manual, ["c_custkey"])
    what = lifecycle.state_of(F.col("manual").isNotNull(), F.col("automatic").isNotNull(), F.col("rejected"))
    return out.groupBy(what.alias("state"), F.coalesce("manual", "automatic", F.lit("")).alias("text")).agg(F.count("*").alias("n"))


APPLY_MANUAL = """SELECT CASE WHEN c_nationkey < 5 OR c_custkey % 2 = 0 THEN 'current' WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'pending' END AS state,
CASE WHEN c_nationkey < 5 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'auto' ELSE '' END AS text, count(*) AS n FROM customer GROUP BY ALL"""


def detached_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, as manual rows whose unit is gone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lifecycle.detached(c, o, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


DETACHED_MANUAL = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1"


def cascade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lifecycle.cascade(table(spark, sf_dir, "lineitem"), parents, ["l_orderkey"]).groupBy("l_linestatus").agg(F.count("*").alias("n"))


CASCADE_ROWS = "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"


def planning_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").select("o_orderkey")
    given = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2 and l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return lifecycle.match_keys(facts, given, ["o_orderkey"]).groupBy("problem").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


PLANNING_INPUTS = """WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0), g AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 7 <> 0 GROUP BY 1),
j AS (SELECT coalesce(e.k, g.k) AS k, CASE WHEN n > 1 THEN 'duplicate' WHEN n IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unknown' END AS problem FROM e FULL JOIN g ON e.k = g.k)
SELECT problem, count(*) AS n, min(k) AS first FROM j WHERE problem IS NOT NULL GROUP BY 1"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return relations.coverage(a, b, "k").groupBy("problem").agg(F.count("*").alias("n"), F.min("k").alias("first"))


COVERAGE = """WITH a AS (SELECT p_partkey AS k FROM part WHERE p_size > 10), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45),
j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' END AS problem FROM a FULL JOIN b ON a.k = b.k)
SELECT problem, count(*) AS n, min(k) AS first FROM j WHERE problem IS NOT NULL GROUP BY 1"""


def ownership_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier")
    expected = n.filter("s_suppkey % 11 <> 0").select("s_suppkey", F.col("s_nationkey").alias("owner"))
    actual = n.filter("s_suppkey % 13 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, None).otherwise(F.col("s_nationkey")).alias("owner"))
    return relations.audit(expected, actual, "s_suppkey", ["owner"])


OWNERSHIP_AUDIT = """WITH x AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 AND s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN 'missing' WHEN s_suppkey % 11 = 0 THEN 'unexpected' WHEN s_suppkey % 5 = 0 THEN 'mismatched' END AS kind FROM supplier)
SELECT kind, count(*) AS n, min(k) AS first FROM x WHERE kind IS NOT NULL GROUP BY 1"""


def member_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' summaries name the first three lines and claim to be complete."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("members"), (F.col("o_orderkey") % 2 == 0).alias("complete"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"))
    out = relations.member_consistency(o, rows, "o_orderkey", "line")
    return out.groupBy("missing", "extra").agg(F.count("*").alias("n"))


MEMBER_CONSISTENCY = """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS m FROM lineitem), c AS (SELECT o_orderkey AS k, 3 - count(m) FILTER (m <= 3) AS missing, CASE WHEN o_orderkey % 2 = 0 THEN count(m) FILTER (m > 3) ELSE 0 END AS extra
FROM orders LEFT JOIN l ON l.k = o_orderkey GROUP BY o_orderkey) SELECT missing, extra, count(*) AS n FROM c WHERE missing > 0 OR extra > 0 GROUP BY ALL"""


def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("group_id"))
    by_nation = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("group:"), "n_nationkey").alias("target"), F.lit("keep").alias("decision"))
    by_row = rows.filter("row_id % 9 = 0").select(F.concat(F.lit("member:"), "row_id").alias("target"), F.lit("translate").alias("decision"))
    return relations.decisions(by_nation.unionByName(by_row), rows).groupBy("decision", "problem").agg(F.count("*").alias("n"))


DECISION_ROWS = """WITH x AS (SELECT c_custkey % 9 = 0 AS m, n_regionkey = 1 AS g FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT CASE WHEN g THEN 'keep' ELSE 'translate' END AS decision, CASE WHEN g AND m THEN 'both' ELSE '' END AS problem, count(*) AS n FROM x WHERE g OR m GROUP BY ALL"""


def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_key"), F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("unit_ordinal"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") * 10 + 3).alias("unit_key"))
    found, unknown = relations.context(asked, index)
    return found.groupBy(F.lit("found").alias("kind")).agg(F.count("*").alias("n"), F.sum("member").alias("members")).unionByName(unknown.groupBy(F.lit("unknown").alias("kind")).agg(F.count("*").alias("n"), F.sum("unit_key").alias("members")))


CONTEXT_LOOKUP = """WITH q AS (SELECT o_orderkey AS o, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) AS there FROM orders)
SELECT 'found' AS kind, count(*) AS n, sum(l_orderkey * 10 + l_linenumber)::BIGINT AS members FROM q JOIN lineitem ON l_orderkey = o WHERE there HAVING count(*) > 0
UNION ALL SELECT 'unknown', count(*), sum(o * 10 + 3)::BIGINT FROM q WHERE NOT there HAVING count(*) > 0"""


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with how many purchases lie within 3 events of them, by user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    kinds = F.col("event_id") % 2 == 0
    near = ordered.nearby(e.filter(kinds).select("user_id", "event_id"), e.filter(~kinds).select("user_id", "event_id"), "user_id", "event_id", 3, "near")
    return near.groupBy("near").agg(F.count("*").alias("n"))


BAND_JOIN = """WITH a AS (SELECT a.event_id, count(b.event_id) AS near FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_id % 2 = 1 AND abs(a.event_id - b.event_id) <= 3 WHERE a.event_id % 2 = 0 GROUP BY 1)
SELECT near, count(*) AS n FROM a GROUP BY 1"""


def run_log_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("sequence", F.col("event_id"))
    return runlog.check_runs(e, "user_id", "sequence", "event_type", "ts").groupBy("problem").agg(F.count("*").alias("n"))


RUN_LOG_CHECKS = """WITH r AS (SELECT user_id, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, count(DISTINCT event_id) AS d FROM events GROUP BY 1)
SELECT CASE WHEN d < n THEN 'repeated sequence' WHEN lo <> 1 OR hi <> n THEN 'gap in sequence' ELSE '' END AS problem, count(*) AS n FROM r GROUP BY 1"""


def phase_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event kinds as phases: from a 'click' to the 'purchase' right after it."""
    e = table(spark, sf_dir, "events")
    d = ordered.paired_durations(e, "user_id", ["ts", "event_id"], "event_type", "ts", "click", "purchase")
    return d.groupBy("user_id").agg(F.count("*").alias("phases"), F.sum("micros").alias("micros"), F.count_if(F.col("micros") < 0).alias("negative"))


PHASE_DURATIONS = """WITH b AS (SELECT user_id, event_type, ts, lag(event_type) OVER w AS was, lag(ts) OVER w AS since FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS phases, sum(epoch_us(ts) - epoch_us(since))::BIGINT AS micros, 0::BIGINT AS negative FROM b WHERE event_type = 'purchase' AND was = 'click' GROUP BY 1"""


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.outcomes(table(spark, sf_dir, "events"), "event_type", "value")


OUTCOME_COUNTS = "SELECT event_type AS outcome, count(*) AS n, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1"


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as spans of part numbers, merged."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct((F.col("l_partkey") % 500).alias("start"), (F.col("l_partkey") % 500 + F.col("l_quantity").cast("long")).alias("end")).alias("s"))
    spans = li.groupBy("l_orderkey").agg(F.collect_list("s").alias("spans"))
    one = spans.select("l_orderkey", intervals.merged(F.col("spans")).alias("m"), intervals.has_overlap(F.col("spans")).alias("overlap"))
    return one.select("l_orderkey", F.size("m").cast("long").alias("islands"), F.aggregate("m", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("covered"), "overlap")


MERGED_INTERVALS = """WITH s AS (SELECT l_orderkey, l_partkey % 500 AS a, l_partkey % 500 + l_quantity::BIGINT AS b FROM lineitem),
o AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT l_orderkey, island, min(a) AS a, max(b) AS b, bool_or(reach IS NOT NULL AND i.a < reach) AS overlap FROM i GROUP BY ALL)
SELECT l_orderkey, count(*) AS islands, sum(b - a)::BIGINT AS covered, bool_or(overlap) AS overlap FROM m GROUP BY 1"""


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties: strict decoding, members in their written order."""
    e = table(spark, sf_dir, "events").select("event_type", "props")
    keys = F.json_object_keys("props")
    return e.select("event_type", F.explode(keys).alias("key"), "props").groupBy("event_type", "key").agg(F.count("*").alias("n"), F.max(js.member_ordinal(F.col("props"), F.col("key"))).cast("long").alias("last_place"), F.count_if(js.strict(F.col("props")).isNull()).alias("bad"))


NESTED_JSON = """WITH k AS (SELECT event_type, json_keys(props) AS ks FROM events), u AS (SELECT event_type, unnest(ks) AS key, unnest(range(0, len(ks))) AS place FROM k)
SELECT event_type, key, count(*) AS n, max(place) AS last_place, 0::BIGINT AS bad FROM u GROUP BY ALL"""


def string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", F.struct("props").alias("nested"))).alias("doc"))
    return js.string_leaves(e, "event_id", "doc").groupBy("path", "layers").agg(F.count("*").alias("n"))


def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordered.first_examples(o, ["o_orderpriority"], ["o_orderkey"]).select("o_orderpriority", "o_orderkey", F.col("example").cast("long").alias("example"))


TOP_EXAMPLES = "SELECT o_orderpriority, o_orderkey, k AS example FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 5"


def plan_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("orders", "customer", "part"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"skein_{t}")
    return spark.sql("SELECT (SELECT count(*) FROM skein_orders) AS orders, (SELECT max(c_custkey) FROM skein_customer) AS last_customer, (SELECT min(p_name) FROM skein_part WHERE p_size = 1) AS first_part")


PLAN_SINGLETONS = "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT max(c_custkey) FROM customer) AS last_customer, (SELECT min(p_name) FROM part WHERE p_size = 1) AS first_part"


def existence_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    late = li.filter("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(late, "s_suppkey", "left_semi").groupBy(F.lit("with").alias("guard")).agg(F.count("*").alias("n")).unionByName(s.join(late, "s_suppkey", "left_anti").groupBy(F.lit("without").alias("guard")).agg(F.count("*").alias("n")))


EXISTENCE_GUARDS = """SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50) THEN 'with' ELSE 'without' END AS guard, count(*) AS n FROM supplier GROUP BY 1"""


def map_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.format_string("Map%03d.json", k)).when(k % 3 == 1, F.format_string("Map%d.json", k)).otherwise(F.format_string("map%03d.json", k))
    n = text.map_number(name)
    return table(spark, sf_dir, "part").agg(F.count(n).alias("maps"), F.sum(n).alias("numbers"), F.max(n).alias("last"))


MAP_NAMES = """WITH x AS (SELECT CASE p_partkey % 3 WHEN 0 THEN nullif(p_partkey, 0) WHEN 1 THEN CASE WHEN p_partkey >= 100 THEN p_partkey END END AS n FROM part) SELECT count(n) AS maps, sum(n)::BIGINT AS numbers, max(n) AS last FROM x"""


QUERIES = {f.__name__: f for f in (claim_conflicts, first_conflict, claim_summary, lock_sets, prefix_locks, compare_and_swap, upsert_pending, apply_manual, detached_manual, cascade_rows, planning_inputs, coverage, ownership_audit, member_consistency, decision_rows, context_lookup, band_join, run_log_checks, phase_durations, outcome_counts, merged_intervals, nested_json, string_leaves, top_examples, plan_singletons, existence_guards, map_names)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
