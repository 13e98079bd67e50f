"""Curriculum pages as column logic over leaf tables (K6, K8-K15, K17, K18): tables are (page_id, idx, label, title, rows, refs, classes).

Each operator passes over its tables once, and folds each cell once (`folded`). `course_tables` keeps a page's tables with their sections for all
readers of a course page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteq.functions.urls import any_of
from siteq.operators.pages import numbered_items
from siteq.operators.tables import computed
from siteq.operators.text import FOLD, clean, clean_lines, first_float, first_int, norm, ordinal_no, split_tul
from siteq.sources.shared import kept

# Words of folded labels and the field that they mean; the first rule that fits counts.
PROGRAM_FIELDS = (
    ("program icerig", "content"), ("koordinator", "ects_coordinator"), ("baskan", "head"), ("tarihce", "history"), ("kazanilan derece", "degree"), ("kabul kosul", "admission"),
    ("ust kademe", "progression"), ("mezuniyet kosul", "graduation"), ("yeterlilik kosul", "graduation"), ("istihdam", "employment"), ("olcme", "assessment"),
)
COURSE_FIELDS = (
    ("ogretim sekli", "teaching_mode"), ("ogrenim tur", "delivery_mode"), ("dersin tur", "type"), ("dili", "language"), ("duzey", "level"), ("bolum", "department"), ("amac", "objective"), ("icerig", "content"),
    ("on kosul", "prerequisites"), ("on sart", "prerequisites"), ("koordinator", "coordinator"), ("yardimci", "assistants"), ("veren", "instructors"), ("ogretim eleman", "instructors"),
)
# Words of help texts that aren't names of units, and the longest name.
HELP = ("basiniz", "tiklayiniz", "seciniz", "listelemek", "click", "select")
LONGEST_UNIT = 80
# Sections of a course page in the order in which they are tried, and the words that each is known by (groups of which one each has to come up).
SECTIONS = (
    ("matrix", (("program",), ("cikti", "yeterlil", "katki", "iliski"))),
    ("learning_outcomes", (("ogrenme cikti", "kazanim"),)),
    ("weekly", (("haftalik", "konular", "ders akisi"),)),
    ("workload", (("is yuku", "isyuku", "akts hesap"),)),
    ("assessment", (("degerlendirme",),)),
    ("resources", (("kaynak",),)),
    ("details", (("detay",),)),
)
SUMMARY, CODE, ECTS = ("akts", "ects"), ("kod", "code"), ("akts", "ects")
OUTCOME_HEADINGS = ("program ogrenme ciktilari", "program ciktilari", "program yeterlilikleri", "(poc)")


def field_of(label: Column, rules) -> Column:
    """The field of the first rule whose word is in the folded label, else null."""
    folded = norm(label)
    return reduce(lambda c, r: c.when(folded.contains(r[0]), r[1]), rules, F.when(F.lit(False), ""))


def labelled_fields(kv: DataFrame, rules) -> DataFrame:
    """(page_id, fields, other): key/value rows as a map of known fields, first value first, and a map of the rest. Takes page_id, seq, key, value."""
    rows = kv.withColumn("field", field_of(F.col("key"), rules)).withColumn("name", F.coalesce("field", "key"))
    first = rows.groupBy("page_id", "name", F.col("field").isNotNull().alias("known")).agg(F.min_by("value", "seq").alias("value"))
    pick = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(c, F.struct("name", "value")))))
    return first.groupBy("page_id").agg(pick(F.col("known")).alias("fields"), pick(~F.col("known")).alias("other"))


def outcomes_from_text(texts: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, no, description): numbered items after the last heading that announces outcomes."""
    texts, folded = computed(texts, _folded=F.lower(F.translate(text, *FOLD))), F.col("_folded")
    last = lambda h: F.when(folded.contains(h), F.length(folded) - F.length(F.substring_index(folded, h, -1)) - len(h) + 1)
    at = F.greatest(*(F.coalesce(last(h), F.lit(0)) for h in OUTCOME_HEADINGS))
    rows = computed(texts, _at=at).where("_at > 0").withColumn("_tail", F.substring(F.col(text), F.col("_at"), F.length(text)))
    return rows.select(key, F.posexplode(numbered_items(F.col("_tail"))).alias("k", "description")).select(key, (F.col("k") + 1).alias("no"), "description")


def table_rows(tables: DataFrame, *more: str) -> DataFrame:
    """(page_id, idx, label, more, row, texts, is_header): the cells' texts of each row, and whether all are header cells."""
    rows = tables.select("page_id", "idx", "label", *more, F.posexplode("rows").alias("row", "_c"))
    head = (F.size("_c") > 0) & F.forall("_c", lambda c: c["header"])
    return rows.select("page_id", "idx", "label", *more, "row", F.transform("_c", lambda c: c["text"]).alias("texts"), head.alias("is_header"))


def _has(h: Column, words) -> Column:
    return any_of(h.contains(w) for w in words)


def fold_cells(tables: DataFrame) -> DataFrame:
    """Adds folded, the folded texts of the cells by row."""
    return tables if "folded" in tables.columns else computed(tables, folded=F.transform("rows", lambda r: F.transform(r, lambda c: norm(c["text"]))))


def with_header(tables: DataFrame, words) -> DataFrame:
    """Adds header_row, the first of the first four rows with a cell that holds one of the words (-1 without), and header, its folded cells."""
    hit = lambda i: F.coalesce(F.exists(F.get("folded", i), lambda c: _has(c, words)), F.lit(False))
    at = F.coalesce(*(F.when(hit(F.lit(i)), F.lit(i)) for i in range(4)), F.lit(-1))
    cells = F.coalesce(F.get("folded", F.col("header_row")), F.array().cast("array<string>"))
    return computed(computed(fold_cells(tables), header_row=at), header=cells)


def _column(*tests) -> Column:
    """Place of the first header cell that a test fits, else -1."""
    fits = F.transform("header", lambda h: any_of(t(h) for t in tests))
    return (F.array_position(fits, True) - 1).cast("int")


def _named(*words, without: tuple = ()):
    return lambda h: _has(h, words) & ~_has(h, without) if without else _has(h, words)


def _cell(place: Column) -> Column:
    """Text of a row's cell, null outside of it."""
    return F.when(place >= 0, F.get("texts", place))


def parse_outcomes(tables: DataFrame) -> DataFrame:
    """(page_id, no, description) of the table with the most rows of a number and a text; the first one on a tie."""
    t = F.col("texts")
    rows = table_rows(tables).where(F.size(t) >= 2).select("page_id", "idx", "row", ordinal_no(t[0]).alias("no"), clean(t[1]).alias("description")).where("no IS NOT NULL AND description <> ''")
    best = rows.groupBy("page_id", "idx").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.max_by("idx", F.struct("n", -F.col("idx"))).alias("idx"))
    return rows.join(best, ["page_id", "idx"]).select("page_id", "no", "description")


def course_sections(tables: DataFrame) -> DataFrame:
    """Adds section to each table: the page's first one with a summary's header, else the first section whose words its label and title hold.

    Tables of two columns with a key that starts with dersin are details, too; other tables are unknown, or null without any text.
    """
    headed = computed(with_header(tables, SUMMARY), _name=norm(F.concat_ws(" ", "label", "title")))
    could = (F.col("header_row") >= 0) & F.exists("header", lambda h: _has(h, CODE))
    first = F.min(F.when(could, F.col("idx"))).over(Window.partitionBy("page_id"))  # a page's tables
    rule = F.when(could & (F.col("idx") == F.col("_first")), "summary")
    for section, groups in SECTIONS:
        rule = rule.when(reduce(lambda x, y: x & y, (_has(F.col("_name"), g) for g in groups)), section)
    pairs = (F.array_max(F.transform("rows", F.size)) == 2) & F.exists("folded", lambda r: (F.size(r) == 2) & r[0].startswith("dersin"))
    text = F.exists("rows", lambda r: F.exists(r, lambda c: c["text"] != ""))
    return computed(headed.withColumn("_first", first), section=rule.when(pairs, "details").when(text, "unknown")).drop("header_row", "header", "_name", "_first")


def course_tables(tables: DataFrame) -> DataFrame:
    """course_sections, written to the shared folder: what all readers of a course page take, so that pages are read and routed once."""
    return kept(course_sections(tables))


def _routed(tables: DataFrame) -> DataFrame:
    return tables if "section" in tables.columns else course_sections(tables)


def _rows_of(tables: DataFrame, section: str, words=()) -> DataFrame:
    some = _routed(tables).where(F.col("section") == section)
    return table_rows(with_header(some, words) if words else some, *(("header_row", "header") if words else ()))


def _ordered(rows: DataFrame, *cols) -> DataFrame:
    """Numbers a page's rows in the order of the page."""
    w = Window.partitionBy("page_id").orderBy("idx", "row")
    return rows.withColumn("ordinal", F.row_number().over(w)).select("page_id", "ordinal", *cols)


def _rest(start: int, between: str) -> Column:
    return F.array_join(F.filter(F.transform(F.slice("texts", start + 1, F.greatest(F.size("texts") - start, F.lit(0))), clean), lambda x: x != ""), between)


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def table_text() -> Column:
    """A table's filled cells, a line for each row that has one."""
    line = lambda r: F.array_join(F.filter(F.transform(r, lambda c: c["text"]), lambda x: x != ""), " | ")
    return F.array_join(F.filter(F.transform("rows", line), lambda x: x != ""), "\n")


def _total(c: Column) -> Column:
    return norm(c).startswith("toplam") | norm(c).startswith("total")


def course_summary(tables: DataFrame) -> DataFrame:
    """(page_id, semester, code, name, theory, practice, credit, ects) of the row below the summary's header."""
    rows = _rows_of(tables, "summary", SUMMARY).where("row = header_row + 1")
    hours = split_tul(_cell(_column(lambda h: h.startswith("t+u"))))
    pick = lambda *words, **kw: _cell(_column(_named(*words, **kw)))
    return rows.select(
        "page_id", first_int(pick("yariyil", "semester", "donem")).alias("semester"), clean(pick(*CODE)).alias("code"), clean(pick("adi", "name", "title", without=("kod",))).alias("name"),
        hours["t"].alias("theory"), hours["u"].alias("practice"), first_float(pick("kredi", "credit")).alias("credit"), first_float(pick(*ECTS)).alias("ects"),
    )


def course_details(tables: DataFrame) -> DataFrame:
    """(page_id, key, value): pairs of the details tables, the cells of the summary by their heads, and the text of unknown tables."""
    found = with_header(_routed(tables), SUMMARY)
    entry = lambda row, at, key, value: F.struct(row.cast("int").alias("row"), at.cast("int").alias("at"), key.alias("key"), value.alias("value"))
    text = lambda r, k: F.get(r, k)["text"]
    places = lambda r: F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0)), F.lit(2))
    pairs = F.flatten(F.transform("rows", lambda r, i: F.transform(places(r), lambda k: entry(i, k, clean(text(r, k)), text(r, k + 1)))))
    pairs = F.filter(pairs, lambda e: (e["key"] != "") & e["value"].isNotNull())
    zipped = F.arrays_zip(F.get("rows", F.col("header_row")).alias("h"), F.get("rows", F.col("header_row") + 1).alias("v"))
    heads = F.filter(F.transform(zipped, lambda x, k: entry(F.lit(-1), k, clean(x["h"]["text"]), clean(x["v"]["text"]))), lambda e: (e["key"] != "") & (e["value"] != ""))
    name = F.when(_filled(F.col("title")), F.col("title")).when(_filled(F.col("label")), F.col("label")).otherwise(F.concat(F.lit("tablo_"), F.col("idx").cast("string")))
    other = F.array(entry(F.lit(0), F.lit(0), F.concat(F.lit("tablo: "), name), table_text()))
    entries = F.when(F.col("section") == "details", pairs).when(F.col("section") == "summary", heads).when(F.col("section") == "unknown", other)
    return found.select("page_id", "idx", F.inline(entries)).groupBy("page_id", "key").agg(F.max_by("value", F.struct("idx", "row", "at")).alias("value"))


def learning_outcomes(tables: DataFrame) -> DataFrame:
    """(page_id, ordinal, no, description, extra): rows of a number and a text, with what follows."""
    rows = _rows_of(tables, "learning_outcomes").withColumn("no", ordinal_no(F.get("texts", F.lit(0)))).where((F.size("texts") >= 2) & F.col("no").isNotNull() & _filled(F.get("texts", F.lit(1))))
    return _ordered(rows, "no", clean(F.get("texts", F.lit(1))).alias("description"), F.array_join(F.slice("texts", 3, F.greatest(F.size("texts") - 2, F.lit(0))), " | ").alias("extra"))


def weekly_topics(tables: DataFrame) -> DataFrame:
    """(page_id, ordinal, week, topic, preparation, documents): rows with a week; without columns of their own, preparation is what follows the topic."""
    prep, doc = _column(_named("hazirlik", "preparation")), _column(_named("dokuman", "document"))
    rows = _rows_of(tables, "weekly", ("hafta", "konu", "week", "topic")).withColumn("week", first_int(F.get("texts", F.lit(0)))).where(~F.col("is_header") & (F.size("texts") >= 2) & F.col("week").isNotNull())
    own = (prep >= 0) | (doc >= 0)
    rows = rows.withColumns({"topic": clean(F.get("texts", F.lit(1))), "preparation": F.when(own, F.coalesce(clean(_cell(prep)), F.lit(""))).otherwise(_rest(2, " | ")), "documents": F.when(own, F.coalesce(clean(_cell(doc)), F.lit(""))).otherwise("")})
    return _ordered(rows.where("topic <> '' OR preparation <> '' OR documents <> ''"), "week", "topic", "preparation", "documents")


def _activities(tables: DataFrame, section: str, words) -> DataFrame:
    """Rows below the header (all rows without one) with an activity that is no total."""
    first = F.get("texts", F.lit(0))
    rows = _rows_of(tables, section, words).where((F.col("row") > F.col("header_row")) & (F.size("texts") >= 2) & _filled(first))
    return rows.where(~_total(first)).withColumn("activity", clean(first))


def assessments(tables: DataFrame) -> DataFrame:
    """(page_id, ordinal, activity, count, percentage): activities with a number; without a column of shares the last cell counts."""
    rows = _activities(tables, "assessment", ("katki", "yuzde", "%", "sayi", "adet"))
    share = _column(_named("katki", "yuzde", "%", "agirlik"))
    rows = rows.withColumns({"count": first_int(_cell(_column(_named("sayi", "adet")))), "percentage": first_float(F.when(share >= 0, _cell(share)).otherwise(F.element_at("texts", -1)))})
    return _ordered(rows.where("count IS NOT NULL OR percentage IS NOT NULL"), "activity", "count", "percentage")


def workloads(tables: DataFrame) -> DataFrame:
    """(page_id, ordinal, activity, count, hours, total): activities with a number."""
    rows = _activities(tables, "workload", ("sure", "sayi", "toplam", "saat"))
    number = lambda *words: first_float(_cell(_column(_named(*words))))
    rows = rows.withColumns({"count": number("sayi", "adet"), "hours": number("sure", "saat"), "total": number("toplam")})
    return _ordered(rows.where("count IS NOT NULL OR hours IS NOT NULL OR total IS NOT NULL"), "activity", "count", "hours", "total")


def resources(tables: DataFrame) -> DataFrame:
    """(page_id, ordinal, kind, content): a single cell is content without a kind."""
    rows = _rows_of(tables, "resources").where(~F.col("is_header") & (F.size("texts") > 0))
    one = F.size("texts") == 1
    content = F.when(one, F.get("texts", F.lit(0))).otherwise(F.array_join(F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))), "\n"))
    rows = rows.withColumns({"kind": F.when(~one, clean(F.get("texts", F.lit(0)))), "content": content})
    return _ordered(rows.where(F.trim(F.replace("content", F.lit("\n"), F.lit(""))) != ""), "kind", "content")


# Fixed value: heads such as PÇ1.
OUTCOME_HEAD = r"^p[a-z.]{0,4}\s*([0-9]{1,2})$"


def _wide(tables: DataFrame) -> DataFrame:
    """Adds wide_row, the first of the first four rows with two cells or more such as PÇ1, or null, and wide, the numbers of its cells."""
    number = lambda c: F.regexp_extract(c, OUTCOME_HEAD, 1).try_cast("int")
    row = lambda i: F.coalesce(F.transform(F.get("folded", F.lit(i)), number), F.array().cast("array<int>"))
    several = lambda i: F.size(F.filter(row(i), lambda n: n.isNotNull())) >= 2
    at = F.coalesce(*(F.when(several(i), F.lit(i)) for i in range(4)))
    return computed(computed(fold_cells(tables), wide_row=at), wide=F.transform(F.get("folded", F.col("wide_row")), number))


def matrix_cells(tables: DataFrame) -> DataFrame:
    """(page_id, idx, row, lo_no, po_no, level): cells below wide headers, aligned to the right where a row is longer or shorter than its header.

    lo_no is null for rows that do not start with a number, and for rows shorter than the header.
    """
    rows = table_rows(_wide(tables).where("wide_row IS NOT NULL"), "wide_row", "wide").where("row > wide_row")
    shift = F.size("texts") - F.size("wide")
    lo = F.when((shift >= 0) & (F.size("texts") > 0), ordinal_no(F.get("texts", F.lit(0))))
    cells = rows.select("page_id", "idx", "row", lo.alias("lo_no"), shift.alias("shift"), "texts", F.posexplode("wide").alias("col", "po_no")).where("po_no IS NOT NULL")
    level = first_int(_cell(F.col("col") + F.col("shift")))
    return cells.withColumn("level", level).where("level <= 5").select("page_id", "idx", "row", "lo_no", "po_no", "level")


def course_matrix(tables: DataFrame) -> DataFrame:
    """(page_id, idx, po_no, description, level) of matrix tables in three layouts; a level may be null.

    Wide headers such as PÇ1: the highest level of all rows. Columns headed 0 to 5, three at least: the highest that is marked. Else
    the last filled cell of a numbered row.
    """
    t = F.col("texts")
    found = with_header(_wide(tables), ("katki", "duzey", "no", "cikti", "1", "5"))
    rows = table_rows(found, "header_row", "header", "wide_row", "wide")
    # key: the row of a contribution, -1 where all rows of a table add to one
    entry = lambda key, po, text, level: F.struct(key.cast("int").alias("key"), po.alias("po_no"), text.alias("description"), level.cast("int").alias("level"))
    shift = F.size(t) - F.size("wide")
    none = F.lit(None).cast("int")
    heads = F.transform("wide", lambda n: entry(F.lit(-1), n, F.lit(""), none))
    most = lambda level: F.when(level <= 5, level)
    cells = F.transform("wide", lambda n, k: entry(F.lit(-1), n, F.lit(""), most(first_int(_cell(k + shift)))))
    mark = lambda h: F.when(h.rlike("^[0-5]$"), h.cast("int"))
    marks = F.transform("header", mark)
    marked = F.size(F.filter(marks, lambda m: m.isNotNull())) >= 3
    of_marks = F.array_max(F.transform(marks, lambda m, k: F.when(m.isNotNull() & (F.trim(F.coalesce(F.get(t, k), F.lit(""))) != ""), m)))
    # from the right: the first cell that is a level, unless a filled cell that is none comes before it
    ends = F.reverse(F.slice(F.transform(t, lambda x, k: F.struct(most(ordinal_no(x)).alias("level"), ((x != "") & (k > 1)).alias("stops"))), 2, F.size(t) - 1))
    last = F.get(F.filter(ends, lambda e: e["level"].isNotNull() | e["stops"]), F.lit(0))["level"]
    level = F.when(marked, of_marks).otherwise(last)
    text = (ordinal_no(F.get(t, F.lit(1))).isNull() | (F.size(t) > 2)) & F.get(marks, F.lit(1)).isNull()
    described = F.when(text & ~(~marked & level.isNotNull() & (F.size(t) == 2)), clean(F.get(t, F.lit(1)))).otherwise("")
    own = F.array(entry(F.col("row"), ordinal_no(F.get(t, F.lit(0))), described, level))
    entries = F.when(F.col("row") == F.col("wide_row"), heads).when(F.col("row") > F.col("wide_row"), cells).when(F.col("wide_row").isNull() & (F.col("row") > F.col("header_row")) & (F.size(t) >= 2), own)
    found = rows.select("page_id", "idx", F.inline(F.filter(entries, lambda e: e["po_no"].isNotNull())))
    return found.groupBy("page_id", "idx", "key", "po_no").agg(F.max("description").alias("description"), F.max("level").alias("level")).drop("key")


# What a row of a plan leads to, a semester's heading, pages of the site.
COURSE_ID = r"""(?i)(?:curCourse=|prolizOpenCourseDetails\(\s*['"]?)([0-9]+)"""
GROUP_ID = r"""(?i)toggleRow\(\s*this\s*,\s*['"]?([0-9]+)"""
GROUP_ROW = r"(?i)\bcollapse_([0-9]+)\b"
SEMESTER = r"([0-9]{1,2})\s*\.?\s*(?:yariyil|donem|semester|yy)"
PAGE_LINK = r"""(?i)([\w./-]+\.aspx(?:\?[^'"\s)]*)?)"""


def _first_id(texts: Column, pattern: str) -> Column:
    """The number of the first of the texts that fits."""
    return F.get(F.filter(F.transform(texts, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""), F.lit(0)).try_cast("long")


def _course_type(text: Column) -> Column:
    n = norm(text)
    return F.when(n == "", "").when(n.startswith("z") | n.startswith("c"), "zorunlu").when(n.startswith("s") | n.startswith("e"), "secmeli").otherwise(clean(text))


def _plan_rows(tables: DataFrame) -> DataFrame:
    """The rows of plan tables with what each leads to, and the semester that the last heading before them names (K10)."""
    semester = lambda text: F.regexp_extract(norm(text), SEMESTER, 1).try_cast("int")
    named = with_header(tables, (*ECTS, *CODE)).withColumn("_head", F.concat_ws(" ", "label", "title"))
    # a table's heading is its row -1; of tables that are no plan nothing else counts
    lines = F.concat(F.array(F.array().cast("array<struct<text: string, colspan: int, header: boolean>>")), "rows")
    rows = named.select("page_id", "idx", "header_row", "header", "refs", "classes", "_head", F.posexplode(lines).alias("row", "_c")).withColumn("row", F.col("row") - 1)
    rows = rows.where("row < 0 OR header_row >= 0").withColumn("texts", F.transform("_c", lambda c: c["text"])).drop("_c")
    rows = rows.withColumns({"refs": F.get("refs", F.col("row")), "class": F.coalesce(F.get("classes", F.col("row")), F.lit(""))})
    course, group = _first_id(F.col("refs"), COURSE_ID), _first_id(F.col("refs"), GROUP_ID)
    rows = rows.withColumn("below", (F.col("row") >= 0) & (F.col("row") > F.col("header_row")))
    rows = rows.withColumn("id", F.when(F.col("below"), F.coalesce(F.when(course != 0, course), F.when(group != 0, group)))).withColumn("is_group", F.coalesce(course, F.lit(0)) == 0)
    rows = rows.withColumn("says", F.when(F.col("row") < 0, semester(F.col("_head"))).when(F.col("id").isNull(), semester(F.array_join("texts", " "))))
    before = Window.partitionBy("page_id").orderBy("idx", "row").rowsBetween(Window.unboundedPreceding, 0)  # the rows of a page
    return rows.withColumn("semester", F.last("says", ignorenulls=True).over(before)).where("row >= 0")


def plan_entries(tables: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, ordinal, course_id, semester, code, name, type, theory, practice, lab, credit, ects, delivery, is_group, group_count, group_id) (K10).

    A course comes once, where it stands first; a missing semester is filled from its next row that has one. With pages (page_id, linked: see
    `linked_courses`), courses that are only linked outside of tables follow, without any fields.
    """
    pick = lambda *words, **kw: _cell(_column(_named(*words, **kw)))
    exact = lambda x: _cell(_column(lambda h: h == x))
    hours_at = _column(lambda h: h.startswith("t+u"))
    hours = split_tul(_cell(hours_at))
    name = _cell(_column(lambda h: (_has(h, ("adi", "name", "title")) | h.startswith("ders")) & ~h.contains("kod")))
    kind = _cell(_column(lambda h: (h == "z/s") | (h == "c/e") | _has(h, ("tur", "zorunlu", "secmeli", "type"))))
    group_row = F.regexp_extract("class", GROUP_ROW, 1).try_cast("long")
    text = lambda c: F.coalesce(clean(c), F.lit(""))
    plain = _course_type(F.coalesce(kind, F.lit("")))
    rows = _plan_rows(tables).where("id IS NOT NULL").select(
        "page_id", "idx", "row", F.col("id").alias("course_id"), "semester", text(pick(*CODE)).alias("code"), text(name).alias("name"),
        F.when((plain == "") & group_row.isNotNull(), "secmeli").otherwise(plain).alias("type"),
        F.when(hours_at >= 0, hours["t"]).otherwise(first_int(exact("t"))).alias("theory"), F.when(hours_at >= 0, hours["u"]).otherwise(first_int(exact("u"))).alias("practice"), hours["l"].alias("lab"),
        first_float(pick("kredi", "credit")).alias("credit"), first_float(pick(*ECTS)).alias("ects"), text(pick("ogretim sekli", "delivery")).alias("delivery"),
        "is_group", F.when(F.col("is_group"), first_int(pick("grup", "group"))).alias("group_count"), group_row.alias("group_id"),
    )
    at = F.struct("idx", "row")
    fields = [c for c in rows.columns if c not in ("page_id", "idx", "row", "course_id", "semester")]
    rows = rows.select("page_id", "course_id", at.alias("at"), "semester", F.struct(*fields).alias("x"))
    if pages is not None:
        linked = pages.select("page_id", F.posexplode("linked").alias("k", "c")).select("page_id", F.col("c").try_cast("long").alias("course_id"), F.struct(F.lit(1 << 30).alias("idx"), F.col("k").alias("row")).alias("at")).where("course_id <> 0")
        rows = rows.unionByName(linked, allowMissingColumns=True)
    once = rows.groupBy("page_id", "course_id").agg(F.min("at").alias("at"), F.min_by("x", "at").alias("x"), F.min_by("semester", F.when(F.col("semester") > 0, F.col("at"))).alias("semester"))
    return once.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).alias("ordinal"), "course_id", "semester", *(F.col(f"x.{c}").alias(c) for c in fields))


def linked_courses(html: Column) -> Column:
    """Numbers of all courses that a page's text links, in its order."""
    return F.regexp_extract_all(html, F.lit(COURSE_ID), F.lit(1))


def plan_links(tables: DataFrame) -> DataFrame:
    """(page_id, link): other pages that the rows of plan tables lead to, such as pools of electives."""
    rows = _plan_rows(tables).where("below AND id IS NULL AND says IS NULL")
    links = rows.select("page_id", F.explode(F.flatten(F.transform("refs", lambda r: F.regexp_extract_all(r, F.lit(PAGE_LINK), F.lit(1))))).alias("link"))
    small = F.lower("link")
    return links.where(~small.contains("progcoursedetails") & ~small.startswith("index.aspx")).distinct()


# The element that names unit and program, and the field of plan years.
PLAN_HEAD, YEAR_FIELD = "lblProgInfoDers", "cmbYillar"


def plan_years(parsed: DataFrame) -> DataFrame:
    """(page_id, value, year, label, selected): the options of the field of plan years that have a value and a year after 1900 (K11)."""
    rows = parsed.select("page_id", F.inline("options")).where(F.lower("field") == YEAR_FIELD.lower()).withColumn("year", first_int(F.col("label")))
    return rows.where("value <> '' AND year > 1900").select("page_id", "value", "year", clean(F.col("label")).alias("label"), "selected")


def plan_head(parsed: DataFrame) -> DataFrame:
    """(page_id, unit_name, program_name, year, plan_id): the heading unit / program - Dersler and the selected plan (K11).

    Without a selected plan the year is that of the first other selected option after 1900.
    """
    span = F.get(F.filter("spans", lambda s: F.lower(s["id"]) == PLAN_HEAD.lower()), F.lit(0))["text"]
    head = F.regexp_replace(clean(span), r"(?i)\s*-\s*(?:dersler|courses)\s*$", "")
    at = F.instr(head, F.lit(" / "))
    chosen = F.filter("options", lambda o: o["selected"] & (first_int(o["label"]) > 1900))
    last = F.try_element_at(F.filter(chosen, lambda o: (F.lower(o["field"]) == YEAR_FIELD.lower()) & (o["value"] != "")), F.lit(-1))
    other = F.get(F.filter(chosen, lambda o: F.lower(o["field"]) != YEAR_FIELD.lower()), F.lit(0))
    return parsed.select(
        "page_id", F.when(at > 0, clean(F.substring(head, F.lit(1), at - 1))).alias("unit_name"), F.when(at > 0, clean(F.substring(head, at + 3, F.length(head)))).otherwise(head).alias("program_name"),
        first_int(F.coalesce(last["label"], other["label"])).alias("year"), last["value"].alias("plan_id"),
    )


def mark_empty(courses: DataFrame) -> DataFrame:
    """Adds empty and drops placeholders from details: no code, name or list, and every detail says that there is no record."""
    blank = lambda v: norm(v).startswith("kayit yok")
    bare = (F.coalesce("code", F.lit("")) == "") & (F.coalesce("name", F.lit("")) == "") & (F.col("n_rows") == 0)
    values = F.map_values("details")
    empty = bare & F.exists(values, blank) & F.forall(values, lambda v: blank(v) | (norm(v) == ""))
    return courses.withColumn("empty", empty).withColumn("details", F.when(bare, F.map_filter("details", lambda k, v: ~blank(v))).otherwise(F.col("details")))


def unit_about(header: Column, content: Column) -> Column:
    """(name, about) of a unit page's header and text; the placeholder name is dropped."""
    name = F.trim(F.regexp_replace(clean(header), "Bilgi Paketi Tanımları$", ""))
    return F.struct(F.when(norm(name) != "fakulte", name).alias("name"), content.alias("about"))


# The elements that hold a unit page's heading and text; words of the heading of a program page, and of its table of figures and their fields.
UNIT_HEADER, UNIT_CONTENT = "lblheader", "lblcontent"
PROGRAM_HEADING, FIGURES = ("program", "bilgi"), (("dili", "language"), ("azami", "max_duration_years"), ("suresi", "duration_years"), ("kontenjan", "quota"), ("staj", "internship"))


def unit_about_pages(parsed: DataFrame) -> DataFrame:
    """(page_id, name, about) of unit pages, parsed with their spans: the last heading element and the lines of the last content element; null without."""
    last = lambda name: F.try_element_at(F.filter("spans", lambda s: F.lower(s["id"]) == name), F.lit(-1))["text"]
    u = unit_about(F.coalesce(last(UNIT_HEADER), F.lit("")), clean_lines(last(UNIT_CONTENT)))
    return parsed.select("page_id", u.alias("u")).select("page_id", F.nullif("u.name", F.lit("")).alias("name"), "u.about")


def program_pages(tables: DataFrame) -> DataFrame:
    """(page_id, name, language, duration_years, max_duration_years, quota, internship, fields, info, sections) of program pages (K6).

    name is that of the first table whose label or title speaks of program information, up to ` - `. A table of two columns with a duration or a language gives
    info; every other table with text is a section under its title or label. Figures and fields are read by the first rule that fits a key or a heading; of what
    comes twice the last counts. A page without tables has no row.
    """
    folded = fold_cells(tables).withColumn("_name", norm(F.concat_ws(" ", "label", "title"))).withColumn("_text", table_text())
    none = F.array().cast("array<struct<kind: string, key: string, value: string, row: int>>")
    entry = lambda kind, key, value, row: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), row.cast("int").alias("row"))
    rule = lambda text, rules: reduce(lambda c, r: c.when(text.contains(r[0]), r[1]), rules, F.when(F.lit(False), ""))
    figure = (F.array_max(F.transform("rows", F.size)) == 2) & F.exists("folded", lambda r: (F.size(r) == 2) & (r[0] != "") & (r[0].contains("suresi") | (r[0] == "dili")))
    pairs = F.filter(F.transform("rows", lambda r, k: F.struct(clean(F.get(r, F.lit(0))["text"]).alias("key"), F.get(r, F.lit(1))["text"].alias("value"), k.alias("row"))), lambda p: (p["key"] != "") & p["value"].isNotNull())
    info = F.concat(F.transform(pairs, lambda p: entry("info", p["key"], p["value"], p["row"])), F.filter(F.transform(pairs, lambda p: entry("figure", rule(norm(p["key"]), FIGURES), p["value"], p["row"])), lambda e: e["key"].isNotNull()))
    title = F.when(_filled(F.col("title")), F.col("title")).otherwise(F.coalesce("label", F.lit("")))
    label = F.when(title != "", title).otherwise(F.concat(F.lit("tablo_"), F.col("idx").cast("string")))
    field = rule(norm(label), PROGRAM_FIELDS)
    section = F.when(F.col("_text") != "", F.concat(F.array(entry("section", label, F.col("_text"), F.lit(0))), F.when(field.isNotNull(), F.array(entry("field", field, F.col("_text"), F.lit(0)))).otherwise(none)))
    name = clean(F.substring_index(title, " - ", 1))
    named = F.when(reduce(lambda x, y: x & y, (F.col("_name").contains(w) for w in PROGRAM_HEADING)) & (name != ""), name)
    rows = folded.select("page_id", "idx", named.alias("named"), F.coalesce(F.when(figure, info).otherwise(section), none).alias("e"))
    # of the names the first counts
    names = F.when(F.col("named").isNotNull(), F.array(entry("name", F.lit("name"), F.col("named"), -1 * F.col("idx")))).otherwise(none)
    rows = rows.select("page_id", F.col("idx").alias("_i"), F.inline(F.concat("e", names))).withColumn("_i", F.when(F.col("kind") == "name", F.col("row")).otherwise(F.col("_i")))
    pages = rows.groupBy("page_id", "kind", "key").agg(F.max_by("value", F.struct("_i", "row")).alias("value"))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "value")))))
    wide = pages.groupBy("page_id").agg(*(of(k).alias(k) for k in ("name", "figure", "field", "info", "section")))
    x = F.col("figure")
    return wide.select("page_id", F.col("name")["name"].alias("name"), x["language"].alias("language"), first_int(x["duration_years"]).alias("duration_years"), first_int(x["max_duration_years"]).alias("max_duration_years"), x["quota"].alias("quota"), x["internship"].alias("internship"), F.col("field").alias("fields"), "info", F.col("section").alias("sections"))


def unit_selection(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(programs, units) of unit selection pages, once each by page and id.

    programs: page_id, id, unit_id, name, unit_name, pos; the unit is that of the program's own link, else that of the last heading or unit link before it.
    units: page_id, id, name, url, pos. What lies inside a program, a unit link or a heading that names a unit isn't read again. Without a unit its columns are null.
    """
    whole = lambda digits: F.nullif(digits.try_cast("long"), F.lit(0))
    number = lambda refs, name: whole(F.regexp_extract(F.array_join(refs, " "), rf"(?i){name}=([0-9]+)", 1))
    m = computed(parsed.select("page_id", F.inline("marks")).withColumnRenamed("text", "_raw"), text=clean(F.col("_raw")))
    m = computed(m, sunit=number("refs", "curSunit"), _unit=number("refs", "curUnit"), folded=norm(F.col("text")))
    sunit, unit, deep_unit = F.col("sunit"), F.col("_unit"), whole(F.col("deep_unit"))
    named = (F.col("text") != "") & (F.length("text") <= LONGEST_UNIT) & ~any_of(F.col("folded").contains(w) for w in HELP)
    m = computed(m, heads=F.col("heading") & (F.col("tag") != "th") & deep_unit.isNotNull() & named & whole(F.col("deep_program")).isNull())
    heads = F.col("heads")
    link = F.regexp_extract(F.array_join("refs", " "), r"""([^\s"'<>]+\.aspx[^\s"'<>]*)""", 1)
    kind = F.when(heads, "head").when(sunit.isNotNull(), "program").when(unit.isNotNull() & (F.col("text") != ""), "unit").when(F.col("heading") & named & ~F.col("links"), "plain").when(F.col("tag") == "optgroup", "group")
    name = F.when(F.col("kind") == "group", clean(F.col("label"))).otherwise(F.col("text"))
    rows = computed(m, kind=kind).select("page_id", "pos", "last", "label", "text", "kind", "sunit", F.when(heads, deep_unit).otherwise(unit).alias("unit"), F.when(~heads & (link != ""), link).alias("url"))
    w = Window.partitionBy("page_id").orderBy("pos")
    inside = F.max(F.when(F.col("kind").isin("head", "program", "unit"), F.col("last"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    read = rows.where("kind IS NOT NULL").withColumn("inside", inside).where("inside IS NULL OR inside < pos")
    heading = F.when(F.col("kind") != "program", F.struct(name.alias("name"), F.when(F.col("kind").isin("head", "unit"), F.col("unit")).alias("unit")))
    read = read.withColumn("under", F.last(heading, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    programs = read.where("kind = 'program'").groupBy("page_id", F.col("sunit").alias("id")).agg(
        F.min_by(F.coalesce("unit", "under.unit"), "pos").alias("unit_id"), F.coalesce(F.min_by("text", F.when(F.col("text") != "", F.col("pos"))), F.lit("")).alias("name"),
        F.min_by("under.name", "pos").alias("unit_name"), F.min("pos").alias("pos"),
    )
    units = read.where("kind IN ('head', 'unit')").groupBy("page_id", F.col("unit").alias("id")).agg(F.min_by("text", "pos").alias("name"), F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos"))
    return programs, units
