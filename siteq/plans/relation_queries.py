"""Queries of groups L and M and of the integrity check: curriculum relations from the star schema, progress logs from events."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from siteq.operators import progress as P
from siteq.operators import relations as L
from siteq.operators import tables as T
from siteq.plans import audit_queries as AQ
from siteq.sources.shared import kept, shared_dir, table
from siteq.streaming import results as R

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Relations as SQL that both engines read.
UNITS = "SELECT n_nationkey AS unit_id, n_name AS unit_name FROM nation"
PROGRAMS = "SELECT s_suppkey AS program_id, s_name AS program_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS unit_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 2020 + s_suppkey % 4 END AS curriculum_year FROM supplier"
COURSES = "SELECT p_partkey AS course_id, p_name AS course_name, CAST(p_size AS DECIMAL(6,2)) / 2 AS ects, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 100 END AS owner, p_partkey % 3 = 0 AS has_text FROM part"
PLAN = "SELECT DISTINCT l_suppkey AS program_id, l_partkey AS course_id, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 2020 + l_partkey % 4 END AS plan_year, 1 + l_partkey % 8 AS semester, CASE WHEN l_partkey % 3 = 0 THEN 'Zorunlu' WHEN l_partkey % 3 = 1 THEN 'zorunlu ders' ELSE 'secmeli' END AS kind FROM lineitem"
CONTRIBUTIONS = "SELECT l_partkey AS course_id, l_linenumber AS no, max(CASE WHEN l_quantity > 48 THEN NULL ELSE CAST(l_quantity AS INT) % 6 END) AS level FROM lineitem GROUP BY l_partkey, l_linenumber"
OUTCOMES = "SELECT s_suppkey AS program_id, no, s_suppkey * 100 + no AS outcome_id FROM supplier, (SELECT 1 AS no UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 5) o"
WITH = f"WITH units AS ({UNITS}), programs AS ({PROGRAMS}), courses AS ({COURSES}), plan AS ({PLAN}), contributions AS ({CONTRIBUTIONS}), outcomes AS ({OUTCOMES})"


def rel(spark, d, sql):
    """A Spark relation of one of the SELECTs above, over the driver's tables."""
    for t in ("nation", "supplier", "part", "lineitem", "orders", "customer", "events", "pages"):
        if f" {t}" in sql:
            sql = sql.replace(f"FROM {t}", f"FROM parquet.`{d}/{t}.parquet`")
    return spark.sql(sql)


OLD = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size, p_partkey % 9 AS owner FROM part WHERE p_partkey % 2 = 0"
NEW = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'new ' || p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'B' END AS brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size + 1 END AS size, p_partkey % 11 AS owner FROM part WHERE p_partkey % 3 = 0"


@query("l1_merge_coalesce", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.size, o.size) AS size FROM o FULL JOIN n ON o.id = n.id")
def _(spark, d):
    return L.merge_coalesce(rel(spark, d, OLD), rel(spark, d, NEW), ["id"], ["name", "size"])


@query("l2_merge_policy", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, CASE WHEN n.id IS NOT NULL THEN n.brand ELSE o.brand END AS brand, coalesce(o.owner, n.owner) AS owner FROM o FULL JOIN n ON o.id = n.id")
def _(spark, d):
    return L.merge_policy(rel(spark, d, OLD), rel(spark, d, NEW), ["id"], {"name": "coalesce", "brand": "new", "owner": "first"})


@query("l3_merge_array_union", "WITH o AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN ['lisans'] ELSE ['yukseklisans', 'lisans'] END AS levels FROM nation WHERE n_nationkey < 20), n AS (SELECT id, list(value ORDER BY seq) AS v FROM (SELECT DISTINCT s_nationkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN 'doktora' ELSE 'lisans' END AS value, 1 AS seq FROM supplier) GROUP BY id) SELECT coalesce(o.id, n.id) AS id, array_to_string(list_concat(coalesce(levels, []), list_filter(coalesce(v, []), lambda x: NOT list_contains(coalesce(levels, []), x))), ',') AS levels FROM o FULL JOIN n ON o.id = n.id")
def _(spark, d):
    old = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("lisans"))).otherwise(F.array(F.lit("yukseklisans"), F.lit("lisans"))).alias("levels"))
    new = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.when(F.col("s_nationkey") % 3 == 0, "doktora").otherwise("lisans").alias("value"), F.col("s_suppkey").alias("seq"))
    return L.merge_array_union(old, new, "id", "levels").select("id", F.array_join("levels", ",").alias("levels"))


WRITES = "SELECT l_suppkey AS program_id, l_partkey % 20 AS no, CASE WHEN l_quantity < 8 THEN NULL ELSE 't' || l_orderkey || '-' || l_linenumber END AS text, CASE l_shipmode WHEN 0 THEN 'about_text' WHEN 1 THEN 'course_matrix' ELSE 'outcomes_page' END AS source, l_shipmode + 1 AS prio, CAST(l_orderkey AS BIGINT) * 100000000 + l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS seq FROM (SELECT *, l_orderkey % 3 AS l_shipmode FROM lineitem) x"


@query("l4_merge_priority", f"WITH w AS ({WRITES}), b AS (SELECT program_id, no, arg_max(text, (prio, seq)) AS text, arg_max(source, (prio, seq)) AS source FROM w WHERE text IS NOT NULL GROUP BY ALL), f AS (SELECT program_id, no, arg_min(source, seq) AS first FROM w GROUP BY ALL) SELECT f.program_id, f.no, b.text, coalesce(b.source, f.first) AS source FROM f LEFT JOIN b ON b.program_id = f.program_id AND b.no = f.no")
def _(spark, d):
    return L.merge_priority(rel(spark, d, WRITES), ["program_id", "no"])


GUESSES = "SELECT s_suppkey AS program_id, o.no, CASE WHEN (s_suppkey + o.no) % 2 = 0 THEN 'about_text' ELSE 'course_matrix' END AS source FROM supplier, (SELECT 1 AS no UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) o"
OFFICIAL = "SELECT s_suppkey AS program_id, o.no FROM supplier, (SELECT 1 AS no UNION ALL SELECT 2 UNION ALL SELECT 5) o WHERE s_suppkey % 3 <> 0"


@query("l5_purge_guesses", f"WITH g AS ({GUESSES}), f AS ({OFFICIAL}) SELECT * FROM g WHERE NOT (source = 'about_text' AND program_id IN (SELECT program_id FROM f) AND (program_id, no) NOT IN (SELECT (program_id, no) FROM f))")
def _(spark, d):
    return L.purge_guesses(rel(spark, d, GUESSES), rel(spark, d, OFFICIAL))


OLD_PLAN = "SELECT s_suppkey % 20 AS program_id, s_suppkey AS course_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 4 END AS plan_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 2020 + s_suppkey % 2 END AS plan_year FROM supplier"
NEW_PLAN = "SELECT s_suppkey % 20 AS program_id, 100000 + s_suppkey AS course_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 1 END AS plan_id, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 2021 END AS plan_year FROM supplier WHERE s_suppkey <= 12"


@query("l6_replace_plan", f"WITH o AS ({OLD_PLAN}), n AS ({NEW_PLAN}) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.program_id = o.program_id AND (o.plan_id = n.plan_id OR ((o.plan_id IS NULL OR n.plan_id IS NULL) AND o.plan_year IS NOT DISTINCT FROM n.plan_year))) UNION ALL SELECT * FROM n")
def _(spark, d):
    return L.replace_plan(rel(spark, d, OLD_PLAN), rel(spark, d, NEW_PLAN))


PLANS = "SELECT l_suppkey AS program_id, CASE WHEN l_quantity < 4 THEN NULL ELSE CAST(2000 + l_partkey % 25 AS INT) END AS plan_year, l_linenumber = 2 AS archived, CAST(l_orderkey AS BIGINT) * 100000000 + l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS seq FROM lineitem WHERE l_orderkey % 3 = 0 OR l_linenumber = 2"
CURRENT = "SELECT s_suppkey AS program_id, CAST(s_nationkey AS INT) AS curriculum_year FROM supplier"


@query("l6_curriculum_years", f"WITH p AS ({CURRENT}), n AS ({PLANS}), y AS (SELECT program_id, arg_max(plan_year, seq) AS y FROM n WHERE plan_year IS NOT NULL AND NOT archived GROUP BY 1) SELECT program_id, coalesce(y, curriculum_year) AS curriculum_year FROM p LEFT JOIN y USING (program_id)")
def _(spark, d):
    return L.curriculum_years(rel(spark, d, CURRENT), rel(spark, d, PLANS))


CHILD_OLD = "SELECT l_partkey AS course_id, l_linenumber AS ordinal, l_orderkey AS topic FROM lineitem"
CHILD_NEW = "SELECT l_partkey AS course_id, l_linenumber AS ordinal, -l_orderkey AS topic FROM lineitem WHERE l_partkey % 5 = 0 AND l_linenumber = 1"


@query("l7_replace_children", f"WITH o AS ({CHILD_OLD}), n AS ({CHILD_NEW}) SELECT * FROM o WHERE course_id % 5 <> 0 OR course_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT * FROM n")
def _(spark, d):
    written = rel(spark, d, "SELECT p_partkey AS course_id FROM part WHERE p_partkey % 5 = 0")
    return L.replace_children(rel(spark, d, CHILD_OLD), rel(spark, d, CHILD_NEW), "course_id", written)


OWNED = "SELECT p_partkey AS course_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 + p_partkey % 10 END AS owner FROM part"


@query("l8_link_contributions", f"{WITH}, owners AS ({OWNED}) SELECT c.course_id, c.no, c.level, o.outcome_id IS NOT NULL AS known FROM contributions c JOIN owners w ON w.course_id = c.course_id AND owner IS NOT NULL LEFT JOIN outcomes o ON o.program_id = w.owner AND o.no = c.no WHERE level IS NOT NULL")
def _(spark, d):
    outcomes, owners = rel(spark, d, OUTCOMES), rel(spark, d, OWNED)
    linked, created = L.link_contributions(rel(spark, d, CONTRIBUTIONS), owners, outcomes.where("program_id > 0"))
    named = created.withColumn("known", F.lit(False)).unionByName(outcomes.withColumn("known", F.lit(True)))
    return linked.join(named.select("outcome_id", "no", "known"), "outcome_id").select("course_id", "no", "level", "known")


@query("l8_created_outcomes", f"{WITH}, owners AS ({OWNED}) SELECT DISTINCT w.owner AS program_id, c.no FROM contributions c JOIN owners w ON w.course_id = c.course_id AND owner IS NOT NULL WHERE level IS NOT NULL AND (w.owner, c.no) NOT IN (SELECT (program_id, no) FROM outcomes)")
def _(spark, d):
    return L.link_contributions(rel(spark, d, CONTRIBUTIONS), rel(spark, d, OWNED), rel(spark, d, OUTCOMES))[1].select("program_id", "no")


VIEW = "SELECT unit_name, plan.program_id, program_name, plan_year, plan_year IS NOT DISTINCT FROM curriculum_year AS is_current, semester, plan.course_id, course_name, ects, kind FROM plan JOIN programs ON programs.program_id = plan.program_id JOIN courses ON courses.course_id = plan.course_id LEFT JOIN units ON units.unit_id = programs.unit_id"


def view(spark, d):
    return L.v_curriculum(rel(spark, d, UNITS), rel(spark, d, PROGRAMS), rel(spark, d, PLAN).drop("kind"), rel(spark, d, COURSES))


@query("l9_v_curriculum", f"{WITH}, v AS ({VIEW}) SELECT unit_name, program_id, program_name, plan_year, is_current, semester, course_id, course_name, CAST(ects AS DOUBLE) AS ects FROM v")
def _(spark, d):
    return view(spark, d).withColumn("ects", F.col("ects").cast("double"))


@query("l10_v_course_outcome_matrix", f"{WITH}, owners AS ({OWNED}) SELECT program_name, course_name, o.no, level FROM contributions c JOIN owners w ON w.course_id = c.course_id JOIN outcomes o ON o.program_id = w.owner AND o.no = c.no JOIN courses p ON p.course_id = c.course_id JOIN programs g ON g.program_id = o.program_id WHERE level IS NOT NULL")
def _(spark, d):
    outcomes = rel(spark, d, OUTCOMES)
    linked, _ = L.link_contributions(rel(spark, d, CONTRIBUTIONS), rel(spark, d, OWNED), outcomes)
    return L.v_course_outcome_matrix(rel(spark, d, COURSES), linked, outcomes, rel(spark, d, PROGRAMS))


CELLS = "SELECT l_partkey AS course_id, l_linenumber AS lo_no, 1 + l_suppkey % 5 AS po_no, max(CAST(l_quantity AS INT) % 6) AS level FROM lineitem GROUP BY l_partkey, l_linenumber, 1 + l_suppkey % 5"
LOS = "SELECT p_partkey AS course_id, n.lo_no, p_name || n.lo_no AS lo_text FROM part, (SELECT 1 AS lo_no UNION ALL SELECT 2 UNION ALL SELECT 4) n WHERE p_partkey % 3 <> 0"


@query("l11_v_course_lo_po_matrix", f"WITH c AS ({CELLS}), o AS ({LOS}) SELECT c.course_id, c.lo_no, lo_text, po_no, level FROM c LEFT JOIN o ON o.course_id = c.course_id AND o.lo_no = c.lo_no")
def _(spark, d):
    return L.v_course_lo_po_matrix(rel(spark, d, CELLS), rel(spark, d, LOS))


@query("l12_current_plan", f"{WITH}, v AS ({VIEW}) SELECT semester, course_id, course_name FROM v WHERE is_current AND program_id = 7 ORDER BY semester, course_id")
def _(spark, d):
    return view(spark, d).where("is_current AND program_id = 7").select("semester", "course_id", "course_name").orderBy("semester", "course_id")


@query("l13_lo_po", f"WITH c AS ({CELLS}) SELECT lo_no, po_no, level FROM c WHERE course_id = 11 ORDER BY lo_no, po_no")
def _(spark, d):
    return rel(spark, d, CELLS).where("course_id = 11").select("lo_no", "po_no", "level").orderBy("lo_no", "po_no")


@query("l13_lo_po_wide", f"WITH c AS ({CELLS}) SELECT course_id, lo_no, " + ", ".join(f'max(level) FILTER (WHERE po_no = {k}) AS "{k}"' for k in range(1, 6)) + " FROM c GROUP BY course_id, lo_no")
def _(spark, d):
    return L.lo_po_wide(rel(spark, d, CELLS), [1, 2, 3, 4, 5])


@query("l14_program_ects", f"{WITH}, v AS ({VIEW}) SELECT program_id, CAST(sum(ects) AS DOUBLE) AS ects FROM v WHERE is_current AND kind ILIKE 'zorunlu%' GROUP BY program_id")
def _(spark, d):
    kinds = rel(spark, d, PLAN).select("program_id", "course_id", "kind")
    return L.program_ects(view(spark, d).join(kinds, ["program_id", "course_id"]), F.col("kind")).withColumn("ects", F.col("ects").cast("double"))


@query("l15_weekly_topics", "SELECT l_linenumber AS week, l_orderkey AS topic FROM lineitem WHERE l_partkey = 5 ORDER BY week, topic")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_partkey = 5").select(F.col("l_linenumber").alias("week"), F.col("l_orderkey").alias("topic")).orderBy("week", "topic")


@query("l15_unit_intros", "SELECT n_name AS name, left(n_name || ' hakkında', 12) AS intro FROM nation ORDER BY name")
def _(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.left(F.concat("n_name", F.lit(" hakkında")), F.lit(12)).alias("intro")).orderBy("name")


@query("l16_table_counts", f"{WITH} SELECT 'units' AS name, count(*) AS n FROM units UNION ALL SELECT 'programs', count(*) FROM programs UNION ALL SELECT 'courses', count(*) FROM courses UNION ALL SELECT 'plan', count(*) FROM plan")
def _(spark, d):
    return L.table_counts({n: rel(spark, d, s) for n, s in (("units", UNITS), ("programs", PROGRAMS), ("courses", COURSES), ("plan", PLAN))})


@query("l17_backfill_plan_year", f"{WITH} SELECT p.program_id, p.course_id, coalesce(CASE WHEN p.course_id % 2 = 0 THEN plan_year END, curriculum_year) AS plan_year FROM plan p LEFT JOIN programs g ON g.program_id = p.program_id")
def _(spark, d):
    plan = rel(spark, d, PLAN).withColumn("plan_year", F.when(F.col("course_id") % 2 == 0, F.col("plan_year")))
    return L.backfill(plan, rel(spark, d, PROGRAMS), "program_id", "plan_year", "curriculum_year").select("program_id", "course_id", "plan_year")


@query("l18_backfill_empty", "SELECT p_partkey AS course_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def _(spark, d):
    details = F.when(F.col("p_partkey") % 3 == 0, F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("Kayıt Yok..."), F.lit("Kayıt Yok")))).otherwise(F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit("metin"))))
    courses, line = table(spark, d, "part").select(F.col("p_partkey").alias("course_id"), details.alias("details")), table(spark, d, "lineitem").withColumnRenamed("l_partkey", "course_id")
    return L.backfill_empty(courses, [line.where("l_quantity > 49"), line.where("l_discount > 0.09")])


@query("l19_stale_courses", "SELECT o_orderkey AS course_id FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey % 3 <> 0)")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("course_id"), F.col("o_orderdate").alias("written_at"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("owner"))
    return L.stale_courses(rows, F.lit("1996-01-01").cast("timestamp"))


ENTRIES = "SELECT l_suppkey AS program_id, l_partkey AS course_id, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 'C' || l_partkey % 40 END AS code, 2020 + l_partkey % 3 AS plan_year, (l_suppkey + l_partkey) % 4 <> 0 AS in_pool, l_partkey % 50 = 1 AS is_group, CAST(l_orderkey AS BIGINT) * 100000000 + l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS seq FROM lineitem WHERE l_quantity < 6"
POOL = "k AS (SELECT DISTINCT course_id, CASE WHEN coalesce(code, '') <> '' THEN plan_year || '|' || code ELSE 'id:' || course_id END AS k FROM e0 WHERE in_pool AND course_id NOT IN (SELECT course_id FROM e0 WHERE NOT in_pool)), copies AS (SELECT k.course_id, m.source AS detail_source_id FROM k JOIN (SELECT k, min(course_id) AS source FROM k GROUP BY k) m ON m.k = k.k WHERE k.course_id <> m.source)"


@query("l20_share_pool", f"WITH e0 AS ({ENTRIES}), {POOL} SELECT DISTINCT * FROM copies")
def _(spark, d):
    return L.share_pool(rel(spark, d, ENTRIES))


CONTENT = "SELECT p_partkey AS course_id, p_brand AS department, p_name AS objective, p_size AS ects FROM part"
CHILD = "SELECT l_partkey AS course_id, l_orderkey AS ordinal, l_suppkey AS text, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS id FROM lineitem WHERE l_linenumber = {0}"


def copied(spark, d):
    details = F.map_from_arrays(F.array(F.lit("Bölümü / Programı"), F.lit("Dil")), F.array("department", "objective"))
    children = {name: rel(spark, d, CHILD.format(k)) for k, name in enumerate((*L.COPIED, *L.OWN), 1)}
    courses = rel(spark, d, CONTENT).withColumn("details", F.when(F.col("course_id") % 7 != 0, details))
    return L.copy_content(courses, children, L.share_pool(rel(spark, d, ENTRIES)), ["department", "objective", "details"])


@query("l20_copied_courses", f"WITH e0 AS ({ENTRIES}), {POOL}, c AS ({CONTENT}) SELECT c.course_id, CASE WHEN s.course_id IS NULL THEN c.department END AS department, coalesce(s.objective, c.objective) AS objective, c.ects, CASE WHEN s.course_id IS NULL THEN CASE WHEN c.course_id % 7 <> 0 THEN 2 END WHEN s.course_id % 7 <> 0 THEN 1 END AS n_details, x.detail_source_id FROM c LEFT JOIN (SELECT DISTINCT * FROM copies) x ON x.course_id = c.course_id LEFT JOIN c s ON s.course_id = x.detail_source_id")
def _(spark, d):
    return copied(spark, d)[0].select("course_id", "department", "objective", "ects", F.when(F.col("details").isNotNull(), F.size("details")).alias("n_details"), "detail_source_id")


@query("l20_copied_children", f"WITH e0 AS ({ENTRIES}), {POOL}, x AS (SELECT DISTINCT * FROM copies), kids AS (SELECT l_partkey AS course_id, l_orderkey AS ordinal, l_suppkey AS text, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS id, (['learning_outcomes', 'weekly_topics', 'resources', 'assessments', 'workloads', 'contributions', 'outcome_matrix'])[l_linenumber] AS name FROM lineitem) SELECT name, course_id, ordinal, text, id FROM kids WHERE course_id NOT IN (SELECT course_id FROM x) UNION ALL SELECT name, x.course_id, ordinal, text, NULL FROM kids JOIN x ON x.detail_source_id = kids.course_id WHERE name NOT IN ('contributions', 'outcome_matrix')")
def _(spark, d):
    rows = [t.select(F.lit(name).alias("name"), "course_id", "ordinal", "text", "id") for name, t in copied(spark, d)[1].items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("l21_detail_plan", f"WITH e AS ({ENTRIES}), e0 AS (SELECT * FROM e WHERE NOT is_group), {POOL} SELECT course_id, arg_min(program_id, seq) AS owner FROM e0 WHERE course_id NOT IN (SELECT course_id FROM copies) GROUP BY course_id")
def _(spark, d):
    return L.detail_plan(rel(spark, d, ENTRIES), "shared")


OPTIONS = "SELECT o_custkey AS program_id, o_orderkey AS plan_id, 2000 + o_orderkey % 25 AS year, o_orderkey % 6 = 0 AS selected, o_custkey * 10 AS current_id FROM orders"


@query("l22_older_years", f"WITH o AS ({OPTIONS}), r AS (SELECT program_id, plan_id, year, row_number() OVER (PARTITION BY program_id ORDER BY year DESC, plan_id DESC) AS rank FROM o WHERE NOT selected AND plan_id <> current_id) SELECT * FROM r WHERE rank <= 2")
def _(spark, d):
    return L.older_years(rel(spark, d, OPTIONS), 3)


CHOICES = "SELECT o_custkey AS program_id, o_orderkey AS plan_id, CAST(2000 + o_orderkey % 25 AS INT) AS year, -o_orderkey AS pos FROM orders"
WANTED = "SELECT c_custkey AS program_id, CASE c_custkey % 3 WHEN 0 THEN CAST((SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS VARCHAR(20)) WHEN 1 THEN CAST(2000 + c_custkey % 25 AS VARCHAR(20)) ELSE 'none' END AS want FROM customer"


@query("l22_find_plan", f"WITH o AS ({CHOICES}), w AS ({WANTED}), j AS (SELECT w.program_id, want, plan_id, year, pos, CASE WHEN CAST(plan_id AS VARCHAR) = want THEN 0 WHEN year = TRY_CAST(want AS INT) THEN 1 END AS rank FROM w LEFT JOIN o ON o.program_id = w.program_id) SELECT program_id, want, arg_min(plan_id, (rank, pos)) FILTER (WHERE rank IS NOT NULL) AS plan_id, arg_min(year, (rank, pos)) FILTER (WHERE rank IS NOT NULL) AS year FROM j GROUP BY program_id, want")
def _(spark, d):
    return L.find_plan(rel(spark, d, CHOICES), rel(spark, d, WANTED))


@query("l23_merge_subpages", "SELECT p_partkey AS course_id, 'zorunlu' AS kind FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'alan' ELSE 'secmeli' END FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 = 0")
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("course_id"))
    return L.merge_subpages(part.where("course_id % 2 = 0").withColumn("kind", F.lit("zorunlu")), part.where("course_id % 5 = 0").withColumn("kind", F.when(F.col("course_id") % 3 == 0, "alan").when(F.col("course_id") % 7 == 0, "")))


REFS = "SELECT o_custkey AS program_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 25 END AS unit_id, o_orderkey % 10 AS page_unit, 'n' || o_orderkey AS name, o_orderkey AS seq FROM orders"


@query("l24_program_refs", f"WITH r AS ({REFS}) SELECT program_id, arg_min(coalesce(unit_id, page_unit), seq) AS unit_id, arg_min(name, seq) AS name FROM r GROUP BY program_id")
def _(spark, d):
    return L.program_refs(rel(spark, d, REFS))


@query("l25_correct_unit_names", "SELECT n_nationkey AS unit_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Birim ' || n_nationkey ELSE n_name END AS name FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    plans = n.select(F.col("n_nationkey").alias("unit_id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" Birim "), "n_nationkey")).when(F.col("n_nationkey") % 3 == 1, " ").alias("header_unit"))
    return L.correct_unit_names(n.select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name")), plans)


HOST = AQ.part("url", 2)
SITE = f"regexp_replace(regexp_replace(regexp_replace(lower({HOST}), '^(obs|www)[.]', ''), '([.](edu|com|org))?[.]tr$', ''), '[^a-z0-9]+', '_', 'g')"


@query("l26_site_key", f"SELECT page_id, {SITE} AS site FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", L.site_key(F.col("url")).alias("site"))


@query("l26_site_conflicts", f"SELECT {SITE} AS site, count(DISTINCT lower({HOST})) AS n_hosts FROM (SELECT regexp_replace(url, '//blog[.]', '//www.') AS url FROM pages UNION ALL SELECT regexp_replace(url, '//blog[.]', '//obs.') FROM pages) GROUP BY 1 HAVING count(DISTINCT lower({HOST})) > 1")
def _(spark, d):
    p = table(spark, d, "pages")
    return L.site_conflicts(p.select(F.regexp_replace("url", "//blog[.]", "//www.").alias("url")).union(p.select(F.regexp_replace("url", "//blog[.]", "//obs."))))


@query("l27_run_summary", "WITH e AS (SELECT o_custkey AS run_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS run_id, coalesce(n, 0) AS n_errors, CASE WHEN c_custkey % 9 = 0 THEN 'interrupted' WHEN coalesce(n, 0) > 0 THEN 'partial' ELSE 'ok' END AS status FROM customer LEFT JOIN e ON e.run_id = c_custkey")
def _(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 9 != 0, F.lit(1)).alias("ended_at"))
    return L.run_summary(runs, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("run_id")))


@query("l28_typed_json", """SELECT '{"type":"unit","data":{"id":' || n_nationkey || ',"name":"' || n_name || '"}}' AS value FROM nation UNION ALL SELECT '{"type":"region","data":{"id":' || r_regionkey || '}}' FROM region""")
def _(spark, d):
    return L.to_typed_json({"unit": table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "region": table(spark, d, "region").select(F.col("r_regionkey").alias("id"))})


@query("k16_table_integrity", f"{WITH} SELECT 'course_without_plan' AS \"check\", count(*) AS n FROM courses WHERE course_id NOT IN (SELECT course_id FROM plan) UNION ALL SELECT 'plan_without_course', count(*) FROM plan WHERE course_id NOT IN (SELECT course_id FROM courses) UNION ALL SELECT 'plan_without_program', count(*) FROM plan WHERE program_id NOT IN (SELECT program_id FROM programs) UNION ALL SELECT 'repeated_plan_row', count(*) FROM (SELECT 1 FROM plan GROUP BY program_id, course_id HAVING count(*) > 1) UNION ALL SELECT 'level_out_of_range', count(*) FROM contributions WHERE level NOT BETWEEN 0 AND 5")
def _(spark, d):
    return L.table_integrity(rel(spark, d, PLAN), rel(spark, d, COURSES), rel(spark, d, PROGRAMS), rel(spark, d, CONTRIBUTIONS))


# ---------------------------------------------------------------- M

LINE = """CASE event_id % 9 WHEN 0 THEN '  [' || event_id % 50 || '/2000] PASS x' WHEN 1 THEN '    ' || event_id % 300 || '/900 (3 kırık)' WHEN 2 THEN '    ' || event_id % 400 || ' sayfa | kuyruk ' || user_id || ' | ok'
WHEN 3 THEN 'x biten=' || event_id % 30 || ' toplam=442' WHEN 4 THEN 'Tarih 2026/10/05' WHEN 5 THEN '[5/0] bozuk' WHEN 6 THEN 'level=ERROR x' WHEN 7 THEN '[3/10] ERROR y' ELSE 'ValueError: bad' END"""


def lines(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(LINE).alias("line"))


@query("m1_progress", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN event_id % 50 WHEN 1 THEN event_id % 300 WHEN 2 THEN event_id % 400 WHEN 3 THEN event_id % 30 WHEN 7 THEN 3 END AS done, CASE event_id % 9 WHEN 0 THEN 2000 WHEN 1 THEN 900 WHEN 2 THEN event_id % 400 + user_id WHEN 3 THEN 442 WHEN 7 THEN 10 END AS total FROM events")
def _(spark, d):
    return lines(spark, d).select("event_id", P.progress(F.col("line")).alias("p")).select("event_id", "p.done", "p.total")


@query("m2_problem", "SELECT event_id, CASE event_id % 9 WHEN 6 THEN 'hata' WHEN 8 THEN 'hata' WHEN 7 THEN 'uyari' END AS problem FROM events")
def _(spark, d):
    return lines(spark, d).select("event_id", P.problem(F.col("line")).alias("problem"))


OBS = "SELECT user_id AS run_id, event_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS t, CAST(event_id % 997 AS DOUBLE) / 1024 AS ratio, event_type = 'error' AS skip FROM events"


def observations(spark, d):
    ts = F.col("ts").cast("timestamp").cast("long").cast("double")
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", ts.alias("t"), ((F.col("event_id") % 997).cast("double") / 1024).alias("ratio"), (F.col("event_type") == "error").alias("skip"))


@query("m3_monotone", f"WITH o AS ({OBS}) SELECT run_id, event_id, max(ratio) OVER (PARTITION BY run_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS top FROM o")
def _(spark, d):
    return P.monotone(observations(spark, d), "run_id", ["t", "event_id"]).select("run_id", "event_id", "top")


ONE = f"o AS (SELECT run_id, t, max(ratio) AS ratio, bool_or(skip) AS skip FROM ({OBS}) x GROUP BY run_id, t)"
ETA = f"""WITH {ONE}, a AS (SELECT *, max(ratio) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS top FROM o), b AS (SELECT *, CASE WHEN skip THEN 0 ELSE top - coalesce(lag(top) OVER (PARTITION BY run_id ORDER BY t), 0) END AS gain FROM a),
w AS (SELECT *, sum(gain) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS worked FROM b),
x AS (SELECT w.*, (SELECT max(v.t) FROM w v WHERE v.run_id = w.run_id AND v.t <= w.t - 200000) AS t0, (SELECT min(v.t) FROM w v WHERE v.run_id = w.run_id) AS t1 FROM w)
SELECT x.run_id, x.t, round(CASE WHEN x.t - y.t >= 5 AND x.worked - y.worked > 0 THEN (1 - x.top) * (x.t - y.t) / (x.worked - y.worked) END, 3) AS remaining FROM x JOIN w y ON y.run_id = x.run_id AND y.t = coalesce(x.t0, x.t1)"""


@query("m4_eta", ETA)
def _(spark, d):
    rows = observations(spark, d).groupBy("run_id", "t").agg(F.max("ratio").alias("ratio"), F.bool_or("skip").alias("skip"))
    return P.eta(rows, "run_id", "t", 200_000).select("run_id", "t", F.round("remaining", 3).alias("remaining"))


def event_files(spark, d, end=None):
    """The events written as JSON lines in files that each hold rows of any time, some of them twice, and a last file with an end mark some time after the rest."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    rows = observations(spark, d).withColumn("ts", F.col("t").cast("timestamp")).select("run_id", "event_id", "ts", "ratio", "skip")
    rows.unionByName(rows.where("event_id % 10 = 3")).repartition(4, F.col("event_id") % 11).write.json(path)
    if end:
        rows.agg((F.max("ts") + F.expr(f"INTERVAL {end}")).alias("ts")).select(F.lit(-1).cast("long").alias("run_id"), F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(0.0).alias("ratio"), F.lit(False).alias("skip")).write.mode("append").json(path)
    return path


STREAM = Ty.StructType([Ty.StructField("run_id", Ty.LongType()), Ty.StructField("event_id", Ty.LongType()), Ty.StructField("ts", Ty.TimestampType()), Ty.StructField("ratio", Ty.DoubleType()), Ty.StructField("skip", Ty.BooleanType())])


@query("m5_eta_stream", ETA.replace("SELECT x.run_id, x.t, round", "SELECT x.run_id, x.t AS ts, round"))
def _(spark, d):
    rows = R.log_stream(spark, event_files(spark, d, "401 DAYS"), STREAM, files_a_batch=2)
    out, check = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("eta", "check"))
    R.eta_stream(rows, 200_000, "400 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run_id long, ts double, remaining double").parquet(out).withColumn("remaining", F.round("remaining", 3))


@query("m6_results_stream", "SELECT user_id AS run_id, count(*) AS n_events FROM events GROUP BY user_id")
def _(spark, d):
    out, check = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("latest", "check"))
    R.latest_per_key(R.log_stream(spark, event_files(spark, d), STREAM, files_a_batch=2), "event_id", ["ts"], out, check).awaitTermination()
    return R.latest_table(spark, out, "event_id", ["ts"], STREAM).groupBy("run_id").agg(F.count("*").alias("n_events"))


@query("m6_latest_per_run", f"WITH o AS ({OBS}) SELECT run_id, arg_max(event_id, (t, event_id)) AS event_id, arg_max(ratio, (t, event_id)) AS ratio FROM o GROUP BY run_id")
def _(spark, d):
    """The last event of each run, in several batches, and all of them once more by a query that starts anew."""
    path, out = event_files(spark, d), f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    for n in (1, 3):
        R.latest_per_key(R.log_stream(spark, path, STREAM, files_a_batch=n), "run_id", ["ts", "event_id"], out, f"{shared_dir(spark)}/check-{uuid.uuid4().hex}").awaitTermination()
    return R.latest_table(spark, out, "run_id", ["ts", "event_id"], STREAM).select("run_id", "event_id", "ratio")


@query("m7_kpis", f"WITH {AQ.AUDITED}, {AQ.BROKEN}, {AQ.VISUAL} SELECT (SELECT count(*) FROM pages) AS map_size, (SELECT count(DISTINCT url) FROM pages WHERE page_id % 3 > 0) AS tested, (SELECT count(*) FROM pages WHERE page_id % 3 > 0 AND {AQ.STATUS} >= 400) AS broken_pages, (SELECT count(*) FROM broken) AS broken_links, (SELECT count(*) FROM audited WHERE flag <> 'erisilebilir') AS problem_documents, (SELECT count(*) FROM vis) AS visual_defects, (SELECT count(*) FROM vis WHERE type = 'overlap') AS certain_findings, (SELECT count(DISTINCT url) FROM pages WHERE page_id % 3 > 0) / (SELECT count(*) FROM pages) AS coverage")
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("status", AQ.status())
    defects = AQ.A.visual_rows(AQ.visual(spark, d))
    return P.kpis(pages, pages.where("page_id % 3 > 0"), AQ.broken(spark, d), AQ.A.audit_documents(AQ.refs(spark, d)).where("flag <> 'erisilebilir'"), defects, defects.where("type = 'overlap'"))


@query("m10_stage_status", "WITH c AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'arbiter' END AS role, CASE WHEN s_suppkey = 4 THEN 1 ELSE 0 END AS untried, 0 AS quota, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS failed FROM supplier) SELECT role, NOT bool_or(untried > 0 OR quota > 0 OR (role = 'arbiter' AND failed > 0)) AS complete FROM c GROUP BY role")
def _(spark, d):
    s = F.col("s_suppkey")
    return P.stage_status(table(spark, d, "supplier").select(F.when(s % 2 == 0, "first").otherwise("arbiter").alias("role"), F.when(s == 4, 1).otherwise(0).alias("untried"), F.lit(0).alias("quota"), F.when(s % 3 == 0, 2).otherwise(0).alias("failed")))


@query("m12_linear_eta", "SELECT user_id AS run_id, max(event_id % 40) AS done, max(event_id % 90) AS total, max(event_id) AS elapsed, count(*) FILTER (WHERE event_type = 'error') AS errors, round(CASE WHEN max(event_id % 40) > 0 THEN max(event_id) / max(event_id % 40) END * (max(event_id % 90) - max(event_id % 40)), 4) AS remaining FROM events GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 40).alias("done"), (F.col("event_id") % 90).alias("total"), F.col("event_id").alias("elapsed"), (F.col("event_type") == "error").cast("long").alias("errors"))
    return P.linear_eta(rows).withColumn("remaining", F.round("remaining", 4))


_ = (T, kept)
