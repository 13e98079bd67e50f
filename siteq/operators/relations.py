"""Curriculum relations: merges, views and queries (L). Old and new tables go in, the merged table comes out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.functions import urls as U
from siteq.operators.text import norm


def merge_policy(old: DataFrame, new: DataFrame, key: list[str], policy: dict[str, str]) -> DataFrame:
    """Upsert of one row a key. Policy of a column: coalesce (new unless null), new (even null), first (old unless null)."""
    o, n = old.alias("o"), new.withColumn("_there", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    there = F.col("n._there").isNotNull()
    pick = {"coalesce": lambda c: F.coalesce(f"n.{c}", f"o.{c}"), "new": lambda c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")), "first": lambda c: F.coalesce(f"o.{c}", f"n.{c}")}
    return joined.select(*(F.when(there, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in key), *(pick[p](c).alias(c) for c, p in policy.items()))


def merge_coalesce(old: DataFrame, new: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    return merge_policy(old, new, key, dict.fromkeys(cols, "coalesce"))


def merge_array_union(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """Old arrays with the new single values appended once each, in the order of `seq`. Takes key, col (array); key, value, seq."""
    added = new.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])).alias("_new"))
    return old.join(added, key, "full_outer").select(key, F.array_union(F.coalesce(col, F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))).alias(col))


def merge_priority(writes: DataFrame, key: list[str]) -> DataFrame:
    """Last text of the best source for each key: takes text, source, prio and seq. A null text changes neither text nor source."""
    rank = F.struct(F.col("text").isNotNull().cast("int"), "prio", "seq")
    return writes.groupBy(*key).agg(F.max_by(F.struct("text", "source"), F.when(F.col("text").isNotNull(), rank)).alias("best"), F.min_by("source", "seq").alias("first")).select(*key, F.col("best.text").alias("text"), F.coalesce("best.source", "first").alias("source"))


def purge_guesses(outcomes: DataFrame, official: DataFrame) -> DataFrame:
    """Outcomes without the about_text items whose number isn't on the program's official list; programs without a list stay."""
    listed = official.select("program_id").distinct()
    guesses = outcomes.where("source = 'about_text'").join(listed, "program_id", "left_semi").join(official.select("program_id", "no"), ["program_id", "no"], "left_anti")
    return outcomes.join(guesses.select("program_id", "no", "source"), ["program_id", "no", "source"], "left_anti")


def replace_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old plan rows without those of a replaced plan, and the new rows. A plan is replaced by id, or, where the old row or the new plan has none, by its year (null equals null)."""
    plans = new.select("program_id", "plan_id", "plan_year").distinct().alias("p")
    by_id = old.join(plans.select("program_id", "plan_id"), ["program_id", "plan_id"], "left_anti").alias("o")
    same = (F.col("o.program_id") == F.col("p.program_id")) & F.col("o.plan_year").eqNullSafe(F.col("p.plan_year")) & (F.col("o.plan_id").isNull() | F.col("p.plan_id").isNull())
    return by_id.join(plans, same, "left_anti").select(*old.columns).unionByName(new)


def curriculum_years(programs: DataFrame, plans: DataFrame) -> DataFrame:
    """programs with curriculum_year from the last plan (program_id, plan_year, archived, seq) that has a year and is not archived; without one it stays."""
    last = plans.where("plan_year IS NOT NULL AND NOT coalesce(archived, false)").groupBy("program_id").agg(F.max_by("plan_year", "seq").alias("_y"))
    return programs.join(last, "program_id", "left").withColumn("curriculum_year", F.coalesce("_y", "curriculum_year")).select(*programs.columns)


def replace_children(old: DataFrame, new: DataFrame, key: str, written: DataFrame) -> DataFrame:
    """Child rows of rewritten parents replaced by the new ones, even by none."""
    return old.join(written.select(key).distinct(), key, "left_anti").unionByName(new)


def link_contributions(contributions: DataFrame, owners: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, created): contributions with a level joined to the owner's outcome by number; outcomes that are missing are created."""
    rows = contributions.where("level IS NOT NULL").join(owners.where("owner IS NOT NULL"), "course_id")
    want = rows.select(F.col("owner").alias("program_id"), "no").distinct()
    created = want.join(outcomes.select("program_id", "no"), ["program_id", "no"], "left_anti").withColumn("outcome_id", F.xxhash64("program_id", "no"))
    every = outcomes.select("program_id", "no", "outcome_id").unionByName(created)
    return rows.join(every, (rows["owner"] == every["program_id"]) & (rows["no"] == every["no"])).select("course_id", "outcome_id", "level"), created


def v_curriculum(units: DataFrame, programs: DataFrame, plan: DataFrame, courses: DataFrame) -> DataFrame:
    """Plan rows with unit, program and course; is_current compares plan years, null with null."""
    return (
        plan.join(programs, "program_id").join(courses, "course_id").join(units, "unit_id", "left")
        .select("unit_name", "program_id", "program_name", "plan_year", F.col("plan_year").eqNullSafe(F.col("curriculum_year")).alias("is_current"), "semester", "course_id", "course_name", "ects")
    )


def v_course_outcome_matrix(courses: DataFrame, contributions: DataFrame, outcomes: DataFrame, programs: DataFrame) -> DataFrame:
    return contributions.join(outcomes, "outcome_id").join(courses, "course_id").join(programs, "program_id").select("program_name", "course_name", "no", "level")


def v_course_lo_po_matrix(cells: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cells with the text of their learning outcome, where there is one."""
    return cells.join(outcomes, ["course_id", "lo_no"], "left").select("course_id", "lo_no", "lo_text", "po_no", "level")


def lo_po_wide(cells: DataFrame, numbers: list[int]) -> DataFrame:
    """One row a learning outcome, one column a program outcome."""
    return cells.groupBy("course_id", "lo_no").agg(*(F.max(F.when(F.col("po_no") == k, F.col("level"))).alias(str(k)) for k in numbers))


def program_ects(view: DataFrame, kind: Column) -> DataFrame:
    """Total ECTS of the obligatory courses of each current plan."""
    return view.where(F.col("is_current") & kind.ilike("zorunlu%")).groupBy("program_id").agg(F.sum("ects").alias("ects"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()))


def backfill(child: DataFrame, parent: DataFrame, key: str, col: str, parent_col: str) -> DataFrame:
    """child.col from the parent where it is null."""
    return child.join(parent.select(key, F.col(parent_col).alias("_p")), key, "left").withColumn(col, F.coalesce(col, "_p")).drop("_p")


def backfill_empty(courses: DataFrame, children: list[DataFrame]) -> DataFrame:
    """Courses to mark empty: all details say that there is no record, and no child table has a row."""
    blank = courses.where(F.forall(F.map_values("details"), lambda v: v.startswith("Kayıt Yok")))
    return reduce(lambda df, c: df.join(c.select("course_id"), "course_id", "left_anti"), children, blank).select("course_id")


def stale_courses(courses: DataFrame, since: Column) -> DataFrame:
    """Courses to fetch: not written since then, or without an owner."""
    fresh = courses.where((F.col("written_at") >= since) & F.col("owner").isNotNull()).select("course_id")
    return courses.join(fresh, "course_id", "left_anti").select("course_id")


def share_pool(entries: DataFrame) -> DataFrame:
    """Copies of elective courses with the course whose content they take: the smallest id of the same plan year and code."""
    key = F.when(F.coalesce("code", F.lit("")) != "", F.concat_ws("|", F.coalesce(F.col("plan_year").cast("string"), F.lit("")), "code")).otherwise(F.concat(F.lit("id:"), "course_id"))
    direct = entries.where(~F.col("in_pool")).select("course_id").distinct()
    pool = entries.where("in_pool").join(direct, "course_id", "left_anti").select("course_id", key.alias("k")).distinct()
    lead = pool.groupBy("k").agg(F.min("course_id").alias("source_id"))
    return pool.join(lead, "k").where("course_id <> source_id").select("course_id", F.col("source_id").alias("detail_source_id")).distinct()


# Child tables whose rows a copy takes and those that stay a course's own, and the folded detail that is left out.
COPIED, OWN = ("learning_outcomes", "weekly_topics", "resources", "assessments", "workloads"), ("contributions", "outcome_matrix")
OWN_DETAIL = "bolumu / programi"


def copy_content(courses: DataFrame, children: dict[str, DataFrame], shared: DataFrame, fields: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(courses, children) after the copies of share_pool (course_id, detail_source_id) have taken the content of their sources (L20).

    A copy's fields become its source's, but for department, which goes, and the detail of the department; what it had in child tables is replaced: by its source's rows
    in COPIED, under its own course_id and with their ordinals, by none in OWN. Columns `id` of children are dropped where rows are new, for the table gives them. Courses
    that are no copy, and copies whose source is missing, stay.
    """
    sources = courses.select(F.col("course_id").alias("detail_source_id"), F.struct(*fields).alias("_s"))
    taken = shared.select("course_id", "detail_source_id").join(sources, "detail_source_id")
    value = lambda c: F.lit(None).cast(courses.schema[c].dataType) if c == "department" else F.map_filter("_s.details", lambda k, v: norm(k) != OWN_DETAIL) if c == "details" else F.col(f"_s.{c}")
    rows = courses.drop("detail_source_id").join(taken, "course_id", "left")
    out = rows.select(*(F.when(F.col("_s").isNotNull(), value(c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in courses.columns if c != "detail_source_id"), "detail_source_id")
    copies = taken.select("course_id", "detail_source_id")
    tables = {}
    for name in (*COPIED, *OWN):
        if name not in children:
            continue
        child = children[name]
        own = child.join(copies.select("course_id"), "course_id", "left_anti").select(*child.columns)
        if name in COPIED:
            more = child.withColumnRenamed("course_id", "detail_source_id").join(copies, "detail_source_id").drop("detail_source_id", "id")
            own = own.unionByName(more, allowMissingColumns=True)
        tables[name] = own
    return out, tables


def detail_plan(entries: DataFrame, mode: str) -> DataFrame:
    """(course_id, owner) to fetch: direct rows always, pool rows by mode off, shared (one a code) or all; the first entry's program owns a course."""
    rows = entries.where("NOT is_group")
    if mode == "off":
        rows = rows.where(~F.col("in_pool"))
    if mode == "shared":
        rows = rows.join(share_pool(rows).select("course_id"), "course_id", "left_anti")
    return rows.groupBy("course_id").agg(F.min_by("program_id", "seq").alias("owner"))


def older_years(options: DataFrame, n: int) -> DataFrame:
    """The n - 1 newest plans of each program that are neither selected nor current: all below 0, none for 0 and 1."""
    rows = options.where(~F.col("selected") & (F.col("plan_id") != F.col("current_id")))
    w = Window.partitionBy("program_id").orderBy(F.desc("year"), F.desc("plan_id"))
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return (ranked.where(F.col("rank") <= n - 1) if n >= 0 else ranked).select("program_id", "plan_id", "year", "rank")


def find_plan(options: DataFrame, wanted: DataFrame) -> DataFrame:
    """(program_id, want, plan_id, year) for each wanted plan (program_id, want): the first option (program_id, plan_id, year, pos) whose id is the text wanted, else the first of that year; null without one."""
    o = options.select("program_id", F.col("plan_id").cast("string").alias("_id"), "plan_id", "year", "pos")
    rows = wanted.join(o, "program_id", "left")
    rank = F.when(F.col("_id") == F.col("want"), 0).when(F.when(F.col("want").rlike("^[+-]?[0-9]+$"), F.col("want").try_cast("int")) == F.col("year"), 1)
    best = F.min_by(F.struct("plan_id", "year"), F.when(rank.isNotNull(), F.struct(rank, "pos"))).alias("x")
    return rows.groupBy("program_id", "want").agg(best).select("program_id", "want", "x.plan_id", "x.year")


def merge_subpages(main: DataFrame, sub: DataFrame) -> DataFrame:
    """Entries of linked pages whose course isn't there yet, with the default type secmeli."""
    more = sub.join(main.select("course_id"), "course_id", "left_anti").withColumn("kind", F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit("secmeli")))
    return main.unionByName(more)


def program_refs(found: DataFrame) -> DataFrame:
    """Programs once each, by first discovery; a missing unit is that of the page."""
    return found.groupBy("program_id").agg(F.min_by(F.struct(F.coalesce("unit_id", "page_unit").alias("unit_id"), "name"), "seq").alias("r")).select("program_id", "r.unit_id", "r.name")


def correct_unit_names(units: DataFrame, plans: DataFrame) -> DataFrame:
    """Unit names replaced by the plan header's where that is not empty."""
    return units.join(plans, "unit_id", "left").select("unit_id", F.coalesce(F.nullif(F.trim("header_unit"), F.lit("")), F.col("name")).alias("name"))


def site_key(url: Column, home: str | None = None) -> Column:
    """The site's name from its host: known prefixes and suffixes off, other characters to _, public for the home site's host."""
    host = F.lower(U.authority(url))
    bare = F.regexp_replace(F.regexp_replace(host, "^(obs|www)[.]", ""), "([.](edu|com|org))?[.]tr$", "")
    name = F.regexp_replace(bare, "[^a-z0-9]+", "_")
    return F.when(host == (home or "").lower(), "public").when(name.rlike("^[0-9]"), F.concat(F.lit("s_"), name)).otherwise(name)


def site_conflicts(urls: DataFrame) -> DataFrame:
    """Keys that several hosts map to."""
    return urls.groupBy(site_key(F.col("url")).alias("site")).agg(F.count_distinct(F.lower(U.authority(F.col("url")))).alias("n_hosts")).where("n_hosts > 1")


def run_summary(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Runs with their error counts and status: interrupted without an end, partial with errors, else ok."""
    n = errors.groupBy("run_id").agg(F.count("*").alias("n"))
    rows = runs.join(n, "run_id", "left").withColumn("n_errors", F.coalesce("n", F.lit(0)))
    return rows.select("run_id", "n_errors", F.when(F.col("ended_at").isNull(), "interrupted").when(F.col("n_errors") > 0, "partial").otherwise("ok").alias("status"))


def to_typed_json(tables: dict[str, DataFrame]) -> DataFrame:
    """One column of lines {"type": ..., "data": ...}, for write.text."""
    lines = (t.select(F.to_json(F.struct(F.lit(name).alias("type"), F.struct("*").alias("data"))).alias("value")) for name, t in tables.items())
    return reduce(DataFrame.unionByName, lines)


def table_integrity(plan: DataFrame, courses: DataFrame, programs: DataFrame, contributions: DataFrame) -> DataFrame:
    """(check, n) of broken rules: courses outside every plan, orphans, repeated keys, levels outside 0 to 5."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    parts = [
        one("course_without_plan", courses.join(plan, "course_id", "left_anti")), one("plan_without_course", plan.join(courses, "course_id", "left_anti")),
        one("plan_without_program", plan.join(programs, "program_id", "left_anti")), one("repeated_plan_row", plan.groupBy("program_id", "course_id").count().where("count > 1")),
        one("level_out_of_range", contributions.where("level NOT BETWEEN 0 AND 5")),
    ]
    return reduce(DataFrame.unionByName, parts)
