"""Queries over documents: blocks, units, digests, families, terms, language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, text, validate
from ..operators import blocks, families, lifecycle, ordered, relations, terms
from ..operators.components import connected_components
from . import corpus

#: Terms that overlap one another, in dictionary order.
TERMS = [{"term": "the", "triggers": ["the"]}, {"term": "there", "triggers": ["there", "there is"]}, {"term": "then", "triggers": ["then"]}, {"term": "und", "triggers": ["und", "und die"]}, {"term": "que", "triggers": ["que"]}, {"term": "with", "triggers": ["with a", "with"]}]


def task_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.groups(spark, sf_dir).select("scope", "group_id", blocks.group_size(F.col("kind"), F.transform("lines", lambda x: F.array(x))).alias("size"))
    packed = blocks.pack_blocks(g)
    return packed.groupBy("scope", "block").agg(F.count("*").alias("n_groups"), F.min("ord").alias("first_group"), F.max("ord").alias("last_group"), (F.sum("size") + 12 + F.count("*")).alias("characters")).select("scope", F.col("block").cast("long").alias("block"), "n_groups", "first_group", "last_group", "characters")


_GROUPS = """g0 AS (SELECT coalesce(source, '') AS scope, doc_id AS group_id, coalesce(lang, '') AS kind, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)"""
_UNITS = _GROUPS + """, u0 AS (SELECT scope, group_id, kind, unnest(lines) AS source_text, unnest(range(0, len(lines))) AS ordinal FROM g0)"""
_JSON = "(length({0}) + 2 + length(regexp_replace({0}, '[^\"\\\\\\x08\\x0c\\n\\r\\t]', '', 'g')) + 5 * length(regexp_replace({0}, '[^\\x00-\\x07\\x0b\\x0e-\\x1f]', '', 'g')))"

TASK_BLOCKS = f"""
WITH RECURSIVE {_GROUPS}, l AS (SELECT scope, group_id, kind, len(lines) AS n, unnest(lines) AS line FROM g0),
s AS (SELECT scope, group_id, 8 + {_JSON.format("kind")} + 10 + sum(11 + {_JSON.format("line")}) + any_value(n) - 1 + 2 AS g FROM l GROUP BY scope, group_id, kind),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY group_id) AS i FROM s),
p AS (SELECT scope, i, group_id, g, 0::BIGINT AS block, g + 13 AS cur FROM o WHERE i = 1
      UNION ALL
      SELECT o.scope, o.i, o.group_id, o.g, CASE WHEN p.cur <= 24000 AND p.cur + o.g + 1 <= 24000 THEN p.block ELSE p.block + 1 END,
             CASE WHEN p.cur <= 24000 AND p.cur + o.g + 1 <= 24000 THEN p.cur + o.g + 1 ELSE o.g + 13 END
      FROM p JOIN o ON o.scope = p.scope AND o.i = p.i + 1)
SELECT scope, block, count(*) AS n_groups, min(group_id) AS first_group, max(group_id) AS last_group, (sum(g) + 12 + count(*))::BIGINT AS characters FROM p GROUP BY scope, block
"""


def unit_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = corpus.units(spark, sf_dir)
    return u.groupBy("scope").agg(F.count("*").alias("n_units"), F.sum(text.json_length(F.col("source_text"))).alias("json_characters"), F.count_if(text.structural_blank(F.col("source_text"))).alias("blank_units"))


UNIT_SIZES = f"""WITH {_UNITS} SELECT scope, count(*) AS n_units, sum({_JSON.format("source_text")})::BIGINT AS json_characters,
count(*) FILTER (regexp_full_match(source_text, '[ \\t\\n\\r\\x0b]*')) AS blank_units FROM u0 GROUP BY scope"""


def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = corpus.units(spark, sf_dir)
    name = text.unit_name(F.col("scope"), F.col("group_id") + 1, F.col("ordinal") + 1)
    return u.groupBy("scope").agg(F.count_distinct(name).alias("names"), F.min(name).alias("first_name"), F.max(F.sha2(name, 256)).alias("last_hash"))


UNIT_NAMES = f"""WITH {_UNITS}, n AS (SELECT scope, scope || ':line' || (group_id + 1) || ':unit' || (ordinal + 1) || ':text' AS name FROM u0)
SELECT scope, count(DISTINCT name) AS names, min(name) AS first_name, max(sha256(name)) AS last_hash FROM n GROUP BY scope"""


def group_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.groups(spark, sf_dir)
    digest = F.sha2(F.concat(text.frame(1, F.lit("group-context")), text.frame(2, F.col("kind")), text.frame_all(3, F.col("lines"))), 256)
    return g.select("group_id", digest.alias("digest"))


_FRAME = "unhex('{0:02X}') || unhex(lpad(hex(octet_length(encode({1}))), 16, '0')) || encode({1})"
GROUP_DIGESTS = f"""WITH {_UNITS}, f AS (SELECT group_id, kind, string_agg(hex({_FRAME.format(3, "source_text")}), '' ORDER BY ordinal) AS h FROM u0 GROUP BY group_id, kind)
SELECT group_id, sha256({_FRAME.format(1, "'group-context'")} || {_FRAME.format(2, "kind")} || unhex(h)) AS digest FROM f"""


def scope_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scope's texts: hashed one by one, then the sorted list of (group, hash) is hashed."""
    g = corpus.groups(spark, sf_dir).select("scope", "group_id", F.sha2(F.array_join("lines", "\n"), 256).alias("h"))
    return g.groupBy("scope").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "h"))), lambda x: F.concat(x["group_id"].cast("string"), F.lit(":"), x["h"])), ","), 256).alias("digest"))


SCOPE_DIGESTS = f"WITH {_GROUPS} SELECT scope, sha256(string_agg(group_id || ':' || sha256(array_to_string(lines, chr(10))), ',' ORDER BY group_id)) AS digest FROM g0 GROUP BY scope"


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a state: those of documents labelled good are current, of toxic ones rejected."""
    state = corpus.labelled(spark, sf_dir)
    u = corpus.units(spark, sf_dir).join(state, F.col("group_id") == F.col("doc_id"), "left")
    current = F.when(F.coalesce("manual", F.lit(False)) & (F.col("group_id") % 3 == 0), F.concat(F.col("group_id").cast("string"), F.lit("/"), "source_text"))
    needs = ~text.structural_blank(F.col("source_text")) & current.isNull() & ~F.coalesce("rejected", F.lit(False))
    return u.select("source_text", "kind", (F.col("group_id") * 1_000_000 + F.col("ordinal")).alias("ord"), current.alias("current"), needs.alias("needs"))


_STATE = """s0 AS (SELECT doc_id, max(quality) = 1 AS manual, max(toxic) = 1 AS rejected FROM labels GROUP BY doc_id),
f0 AS (SELECT source_text, kind, group_id * 1000000 + ordinal AS ord, CASE WHEN coalesce(manual, false) AND group_id % 3 = 0 THEN group_id || '/' || source_text END AS current,
 NOT regexp_full_match(source_text, '[ \\t\\n\\r\\x0b]*') AND NOT coalesce(rejected, false) AND NOT (coalesce(manual, false) AND group_id % 3 = 0) AS needs
 FROM u0 LEFT JOIN s0 ON s0.doc_id = u0.group_id)"""


def dedup_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _families(spark, sf_dir)
    f = families.family_summary(u, ["source_text", "kind"], F.col("ord"), "current", "needs")
    return f.select(F.sha2("source_text", 256).alias("text_hash"), "kind", "members", "unresolved", F.col("distinct_current").cast("int").alias("distinct_current"), "seed", "representative")


DEDUP_FAMILIES = f"""WITH {_UNITS}, {_STATE}
SELECT sha256(source_text) AS text_hash, kind, count(*) AS members, count(*) FILTER (needs) AS unresolved, least(count(DISTINCT current), 2)::INT AS distinct_current,
arg_min(current, ord) FILTER (current IS NOT NULL) AS seed, min(ord) FILTER (needs) AS representative FROM f0 GROUP BY source_text, kind"""


def dedup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = families.family_outcomes(_families(spark, sf_dir), ["source_text", "kind"], "ord", "current", "needs")
    return o.groupBy("kind", "outcome").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.count("reused").alias("reused"))


DEDUP_OUTCOMES = f"""WITH {_UNITS}, {_STATE},
m AS (SELECT source_text, kind, count(DISTINCT current) AS d, min(ord) FILTER (needs) AS rep FROM f0 GROUP BY source_text, kind),
o AS (SELECT f0.kind, ord, CASE WHEN current IS NOT NULL THEN 'current' WHEN NOT needs THEN 'context' WHEN d = 1 THEN 'reuse' WHEN ord = rep THEN 'representative' ELSE 'destination' END AS outcome
      FROM f0 JOIN m ON m.source_text = f0.source_text AND m.kind = f0.kind)
SELECT kind, outcome, count(*) AS n, min(ord) AS first, count(*) FILTER (outcome = 'reuse') AS reused FROM o GROUP BY kind, outcome"""


def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids within a document's units, for the first unit of each text in its family."""
    f = families.family_outcomes(_families(spark, sf_dir), ["source_text", "kind"], "ord", "current", "needs")
    u = f.withColumn("block", F.floor(F.col("ord") / 1_000_000))
    return families.block_ids(u, ["block"], "ord", F.col("outcome") == "representative").select("block", "ord", F.col("task_id").cast("long").alias("task_id"))


TASK_IDS = f"""WITH {_UNITS}, {_STATE},
m AS (SELECT source_text, kind, count(DISTINCT current) AS d, min(ord) FILTER (needs) AS rep FROM f0 GROUP BY source_text, kind),
o AS (SELECT ord // 1000000 AS block, ord, (current IS NULL AND needs AND d <> 1 AND ord = rep)::INT AS asks FROM f0 JOIN m ON m.source_text = f0.source_text AND m.kind = f0.kind),
w AS (SELECT *, sum(asks) OVER (PARTITION BY block ORDER BY ord) - 1 AS k, max(asks) OVER (PARTITION BY block) AS asked FROM o)
SELECT block, ord, CASE WHEN asks = 1 THEN k::BIGINT END AS task_id FROM w WHERE asked = 1"""


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = terms.term_rows(corpus.units(spark, sf_dir), ["group_id"], "source_text", TERMS)
    return hits.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("hits"))


_TRIGGERS = ", ".join(f"('{x}', '{t['term']}')" for t in TERMS for x in t["triggers"])
_ALTERNATION = "|".join(sorted((x for t in TERMS for x in t["triggers"]), key=lambda t: (-len(t), t)))
TERM_HITS = f"""WITH {_UNITS}, t(x, term) AS (VALUES {_TRIGGERS}),
h AS (SELECT DISTINCT group_id, unnest(regexp_extract_all(source_text, '{_ALTERNATION}')) AS x FROM u0)
SELECT group_id, string_agg(DISTINCT term, ',' ORDER BY term) AS hits FROM h JOIN t USING (x) GROUP BY group_id"""


def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = corpus.units(spark, sf_dir)
    counted = u.select("kind", *[terms.occurrences(F.col("source_text"), t).alias(t) for t in ("anan", "thth", "enen", "esas")])
    sums = counted.groupBy("kind").agg(*[F.sum(t).alias(t) for t in ("anan", "thth", "enen", "esas")])
    return sums.unpivot("kind", ["anan", "thth", "enen", "esas"], "term", "occurrences")


TERM_OCCURRENCES = f"""WITH {_UNITS}, t(term) AS (VALUES ('anan'), ('thth'), ('enen'), ('esas'))
SELECT kind, term, sum(CASE WHEN contains(source_text, term) THEN len(list_filter(range(1, length(source_text)::BIGINT + 1), lambda i: substr(source_text, i, 4) = term)) ELSE 0 END)::BIGINT AS occurrences FROM u0, t GROUP BY kind, term"""


def term_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corpus.table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("candidate"))
    words = corpus.units(spark, sf_dir).select(F.explode(F.split("source_text", " ")).alias("candidate")).groupBy("candidate").agg(F.count("*").alias("n"))
    listed = names.unionByName(words.filter("n <= 2 and candidate rlike '^[a-z]{9}$'").select("candidate")).unionByName(words.filter("n > 200").select("candidate"))
    return terms.review(listed, words).groupBy("verdict").agg(F.count("*").alias("n"), F.min("candidate").alias("first"))


TERM_REVIEW = f"""WITH {_UNITS}, w AS (SELECT x AS candidate, count(*) AS n FROM (SELECT unnest(string_split(source_text, ' ')) AS x FROM u0) GROUP BY x),
c AS (SELECT split_part(p_name, ' ', 1) AS candidate FROM part UNION ALL SELECT candidate FROM w WHERE n <= 2 AND regexp_full_match(candidate, '[a-z]{{9}}') UNION ALL SELECT candidate FROM w WHERE n > 200),
k AS (SELECT candidate, count(*) AS named FROM c GROUP BY candidate),
v AS (SELECT k.candidate, CASE WHEN named > 1 THEN 'duplicate' WHEN coalesce(n, 0) = 0 THEN 'not_found' WHEN n = 1 THEN 'single' ELSE 'accepted' END AS verdict FROM k LEFT JOIN w ON w.candidate = k.candidate)
SELECT verdict, count(*) AS n, min(candidate) AS first FROM v GROUP BY verdict"""


def english_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Behind a generator the runs are computed once.
    u = corpus.units(spark, sf_dir).select("kind", F.explode(F.array(language.english_runs(F.col("source_text")))).alias("runs"))
    runs = F.col("runs")
    return u.groupBy("kind").agg(
        F.count_if(language.admitted(runs, 3, 12)).alias("admitted"),
        F.sum(F.size(runs)).cast("long").alias("runs"),
        F.max(F.array_max(F.transform(runs, F.size))).cast("long").alias("longest_run"),
    )


_CUT = "[^\\x09-\\x0D\\x20-\\x2F\\x3A-\\x7EA-Za-z]+"
ENGLISH_ADMISSION = f"""WITH {_UNITS},
r AS (SELECT kind, list_filter(list_transform(string_split_regex(source_text, '{_CUT}'), lambda p: regexp_extract_all(p, '[A-Za-z]+')), lambda w: len(w) > 0) AS runs FROM u0)
SELECT kind, count(*) FILTER (len(list_filter(runs, lambda w: len(w) >= 3 AND length(array_to_string(w, '')) >= 12)) > 0) AS admitted, sum(len(runs))::BIGINT AS runs,
max(list_max(list_transform(runs, lambda w: len(w))))::BIGINT AS longest_run FROM r GROUP BY kind"""


def copied_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as targets, documents' lines as sources: joined on a shared run of words of the least length, checked in full."""
    least = 4
    nothing = F.array().cast("array<string>")
    grams = lambda runs: F.array_distinct(F.flatten(F.transform(runs, lambda w: F.when(F.size(w) >= least, F.transform(F.sequence(F.lit(1), F.size(w) - least + 1), lambda i: F.lower(F.array_join(F.slice(w, i, F.lit(least)), " ")))).otherwise(nothing))))
    target = corpus.table(spark, sf_dir, "benchmark").select("item_id", language.english_runs(F.col("text")).alias("t_runs"))
    source = corpus.groups(spark, sf_dir).filter("kind = 'en'").select("group_id", F.flatten(F.transform("lines", lambda line: language.english_runs(line))).alias("s_runs"))
    t = target.select("item_id", F.explode(grams(F.col("t_runs"))).alias("gram"))
    s = source.select("group_id", F.explode(grams(F.col("s_runs"))).alias("gram"))
    met = s.join(t, "gram").select("group_id", "item_id").distinct().join(target, "item_id").join(source, "group_id")
    found = F.filter(F.transform("t_runs", lambda r: language.copied_fragment(r, F.col("s_runs"), least, 12)), lambda x: x.isNotNull())
    return met.select("group_id", "item_id", F.get(found, F.lit(0)).alias("fragment")).filter("fragment is not null")


def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "lang")
    tag = F.element_at(F.array(F.upper("lang"), F.concat(F.upper("lang"), F.lit("-latn-de")), F.concat("lang", F.lit("-x")), F.concat("lang", F.lit("_bad"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.groupBy(text.language_tag(tag).alias("tag")).agg(F.count("*").alias("n"))


LANGUAGE_TAGS = """WITH t AS (SELECT CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '-Latn-DE' WHEN 2 THEN lang || '-x' END AS tag FROM documents) SELECT tag, count(*) AS n FROM t GROUP BY tag"""


def candidate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates made from each text's lines by its id: unchanged, a line less, with a line feed, with a mark, emptied, filled."""
    g = corpus.groups(spark, sf_dir).withColumn("lines", F.concat("lines", F.array(F.lit(" "))))
    case = F.col("group_id") % 6
    candidate = (
        F.when(case == 0, F.slice("lines", F.lit(1), F.size("lines") - 1)).when(case == 1, F.transform("lines", lambda x: F.concat(x, F.lit("\n"))))
        .when(case == 2, F.transform("lines", lambda x: F.concat(x, F.lit("﻿")))).when(case == 3, F.transform("lines", lambda x: F.when(x.isNotNull(), "x")))
        .when(case == 4, F.transform("lines", lambda x: F.when(x.isNotNull(), ""))).otherwise(F.col("lines"))
    )
    verdict = validate.candidate_violation(F.col("lines"), candidate, F.col("group_id") % 2 == 0)
    return g.groupBy(case.cast("int").alias("edit"), F.coalesce(verdict, F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


CANDIDATE_CHECKS = """SELECT (doc_id % 6)::INT AS edit, CASE doc_id % 6 WHEN 0 THEN 'line_count' WHEN 1 THEN 'ok' WHEN 2 THEN 'byte_order_mark' WHEN 3 THEN 'ok' WHEN 4 THEN 'slot_emptied' ELSE 'ok' END AS verdict, count(*) AS n FROM documents GROUP BY ALL"""


def group_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as groups: turns are unit ids, and defects are put in by id."""
    c = corpus.table(spark, sf_dir, "conversations")
    text_ = F.when(F.col("conv_id") % 7 == 1, F.concat("text", F.lit("\r"))).otherwise(F.col("text"))
    unit = F.struct(F.when((F.col("conv_id") % 5 == 2) & (F.col("turn") > 1), "1").otherwise(F.col("turn").cast("string")).alias("id"), text_.alias("text"))
    g = c.groupBy("conv_id").agg(F.collect_list(unit).alias("units")).select(F.when(F.col("conv_id") % 11 == 3, "").otherwise(F.col("conv_id").cast("string")).alias("group_id"), F.lit("chat").alias("kind"), "units")
    return validate.group_violations(g).groupBy("violation").agg(F.count("*").alias("n"))


GROUP_CHECKS = """WITH u AS (SELECT conv_id, CASE WHEN conv_id % 5 = 2 AND turn > 1 THEN '1' ELSE turn::VARCHAR END AS id FROM conversations),
g AS (SELECT conv_id, count(*) > count(DISTINCT id) AS repeated FROM u GROUP BY conv_id),
v AS (SELECT 'empty group id' AS violation FROM g WHERE conv_id % 11 = 3 UNION ALL SELECT 'repeated unit id' FROM g WHERE repeated UNION ALL SELECT 'forbidden character' FROM g WHERE conv_id % 7 = 1)
SELECT violation, count(*) AS n FROM v GROUP BY violation"""


def repeated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "conversations").select(F.concat(F.lit("r"), F.col("conv_id") % 40).alias("group_id"), F.col("role").alias("path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line"))
    out = validate.repeated_groups(c)
    return out.select("group_id", F.col("first.path").alias("path1"), F.col("first.line").alias("line1"), F.col("second.path").alias("path2"), F.col("second.line").alias("line2"))


REPEATED_GROUPS = """WITH o AS (SELECT 'r' || (conv_id % 40) AS group_id, role AS path, conv_id * 1000 + turn AS line FROM conversations),
d AS (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY path, line) AS k FROM o)
SELECT DISTINCT a.group_id, a.path AS path1, a.line AS line1, b.path AS path2, b.line AS line2 FROM d a JOIN d b ON a.group_id = b.group_id AND a.k = 1 AND b.k = 2"""


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a snapshot with known edits: dropped, retexted, of another kind, reordered, ids renamed."""
    now = corpus.groups(spark, sf_dir)
    ids = lambda prefix: F.transform("lines", lambda x, i: F.concat(F.lit(prefix), i.cast("string")))
    after = now.filter("group_id % 10 != 1").select("group_id", "kind", ids("u").alias("unit_ids"), F.col("lines").alias("texts"))
    k = F.col("group_id") % 10
    before = now.filter("group_id % 10 != 0").select(
        "group_id",
        F.when(k == 2, "other").otherwise(F.col("kind")).alias("kind"),
        F.when(k == 3, ids("v")).when(k == 4, F.reverse(ids("u"))).otherwise(ids("u")).alias("unit_ids"),
        F.when(k == 5, F.transform("lines", lambda x: F.concat(x, F.lit("!")))).otherwise(F.col("lines")).alias("texts"),
    )
    return lifecycle.reconcile(before, after).groupBy("change").agg(F.count("*").alias("n"), F.sum("renamed_units").alias("renamed_units"))


RECONCILE = f"""WITH {_GROUPS}, c AS (SELECT group_id % 10 AS k, len(lines) AS n FROM g0),
x AS (SELECT CASE WHEN k = 0 THEN 'new' WHEN k = 1 THEN 'gone' WHEN k IN (2, 5) THEN 'cleared' WHEN k = 4 AND n > 1 THEN 'cleared' ELSE 'kept' END AS change, CASE WHEN k = 3 THEN n ELSE 0 END AS r FROM c)
SELECT change, count(*) AS n, sum(r)::BIGINT AS renamed_units FROM x GROUP BY change"""


def natural_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.groups(spark, sf_dir)
    files = g.select(F.col("scope").alias("path")).distinct()
    u = corpus.units(spark, sf_dir).select("group_id", F.col("ordinal").alias("unit_id"), "source_text")
    state = corpus.labelled(spark, sf_dir)
    manual = state.filter("manual").select(F.col("doc_id").alias("group_id"), F.lit(0).alias("unit_id"), F.lit("m").alias("manual_text"))
    rejected = state.filter("rejected").select(F.col("doc_id").alias("group_id"), F.lit(1).alias("unit_id"), F.lit("r").alias("candidate"))
    s = lifecycle.natural_snapshot(files, g.select(F.col("scope").alias("path"), "group_id"), u, manual, rejected)
    what = lifecycle.state_of(F.col("manual_text").isNotNull(), F.lit(False), F.col("candidate").isNotNull())
    return s.groupBy("path", what.alias("state")).agg(F.count("*").alias("n"), F.min(F.struct("group_id", "unit_id")).alias("f")).select("path", "state", "n", F.col("f.group_id").alias("first_group"), F.col("f.unit_id").cast("long").alias("first_unit"))


NATURAL_SNAPSHOT = f"""WITH {_UNITS}, s0 AS (SELECT doc_id, max(quality) = 1 AS manual, max(toxic) = 1 AS rejected FROM labels GROUP BY doc_id),
x AS (SELECT scope AS path, group_id, ordinal, CASE WHEN manual AND ordinal = 0 THEN 'current' WHEN rejected AND ordinal = 1 THEN 'rejected' ELSE 'pending' END AS state FROM u0 LEFT JOIN s0 ON s0.doc_id = group_id),
r AS (SELECT *, row_number() OVER (PARTITION BY path, state ORDER BY group_id, ordinal) AS k FROM x)
SELECT path, state, count(*) AS n, max(group_id) FILTER (k = 1) AS first_group, max(ordinal) FILTER (k = 1) AS first_unit FROM r GROUP BY path, state"""


def line_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which line of a text each term stands on."""
    hit = terms.term_rows(corpus.units(spark, sf_dir), ["kind", "ordinal"], "source_text", TERMS)
    return hit.groupBy("kind", "term").agg(F.min("ordinal").cast("long").alias("first_line"), F.count("*").alias("lines"))


LINE_DOMAINS = f"""WITH {_UNITS}, t(x, term) AS (VALUES {_TRIGGERS}),
h AS (SELECT DISTINCT group_id, ordinal, kind, term FROM (SELECT group_id, ordinal, kind, unnest(regexp_extract_all(source_text, '{_ALTERNATION}')) AS x FROM u0) JOIN t USING (x))
SELECT kind, term, min(ordinal) AS first_line, count(*) AS lines FROM h GROUP BY kind, term"""


def packing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.groups(spark, sf_dir).select("scope", "group_id", "kind", F.length(F.array_join("lines", "\n")).alias("size"))
    runs = ordered.scope_runs(g, ["scope"], "group_id", "kind")
    return runs.groupBy("scope").agg(F.count("*").alias("groups"), F.sum("size").alias("total"), F.max("size").cast("long").alias("largest"), F.count_if(F.col("size") > 8000).alias("oversized"), (F.max("run") + 1).cast("long").alias("kind_runs"))


PACKING_EVIDENCE = f"""WITH {_GROUPS}, z AS (SELECT scope, group_id, kind, length(array_to_string(lines, chr(10))) AS size, lag(kind) OVER (PARTITION BY scope ORDER BY group_id) AS was FROM g0)
SELECT scope, count(*) AS groups, sum(size)::BIGINT AS total, max(size)::BIGINT AS largest, count(*) FILTER (size > 8000) AS oversized, 1 + count(*) FILTER (was IS NOT NULL AND was <> kind) AS kind_runs FROM z GROUP BY scope"""


def related_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts related by two shared words of their names and the same size, as components."""
    p = corpus.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.split("p_name", " ")).alias("w"))
    tokens = p.select("p_partkey", F.concat_ws("|", F.col("p_size").cast("string"), "w").alias("t"))
    links = relations.related_links(tokens, "p_partkey", "t", 2)
    found = connected_components(links)
    return found.groupBy("component").agg(F.count("*").alias("members"), F.max("node").alias("last"))


RELATED_COMPONENTS = """WITH RECURSIVE t AS (SELECT DISTINCT p_partkey AS k, p_size || '|' || w AS t FROM (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS w FROM part)),
ok AS (SELECT t FROM t GROUP BY t HAVING count(*) BETWEEN 2 AND 1000),
e AS (SELECT a.k AS u, b.k AS v FROM t a JOIN t b ON a.t = b.t JOIN ok ON ok.t = a.t WHERE a.k <> b.k GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT DISTINCT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node),
m AS (SELECT node, min(c) AS component FROM r GROUP BY node)
SELECT component, count(*) AS members, max(node) AS last FROM m GROUP BY component"""


def scope_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that don't stand together among each source's documents."""
    g = corpus.groups(spark, sf_dir).select("scope", "group_id", "kind")
    return ordered.split_scopes(ordered.scope_runs(g, ["scope"], "group_id", "kind"), ["scope"], "kind")


SCOPE_FRAGMENTS = f"""WITH {_GROUPS}, z AS (SELECT scope, group_id, kind, lag(kind) OVER (PARTITION BY scope ORDER BY group_id) AS was FROM g0),
r AS (SELECT *, sum(CASE WHEN was IS NOT NULL AND was <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY group_id) AS run FROM z)
SELECT scope, kind, count(DISTINCT run) AS runs FROM r GROUP BY scope, kind HAVING count(DISTINCT run) > 1"""


QUERIES = {f.__name__: f for f in (task_blocks, unit_sizes, unit_names, group_digests, scope_digests, dedup_families, dedup_outcomes, task_ids, term_hits, term_occurrences, term_review, english_admission, copied_fragments, language_tags, candidate_checks, group_checks, repeated_groups, reconcile, natural_snapshot, line_domains, packing_evidence, related_components, scope_fragments)}
ORACLES = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
