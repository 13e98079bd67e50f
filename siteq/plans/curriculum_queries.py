"""Queries of group K on curriculum pages made from the part table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from siteq.operators import curriculum as K
from siteq.operators import pages as G
from siteq.sources.shared import kept, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(label: str, *rows: str) -> str:
    """SQL text of a labelled table; cells are SQL expressions between single bars, those of a first row that starts with # are heads."""
    out = [f"'<p>{label}</p><table>'"]
    for row in rows:
        tag = "th" if row.startswith("#") else "td"
        out.append("'<tr>' || " + " || ".join(f"'<{tag}>' || CAST({c.strip()} AS VARCHAR(99)) || '</{tag}>'" for c in row.lstrip("#").split(" | ")) + " || '</tr>'")
    return " || ".join([*out, "'</table>'"])


K3 = "p_partkey % 3"
NUMBERED = _table("Program yeterlilikleri ile ilişki", "#'Sıra' | 'Yeterlilik' | 'Düzey'", "1 | 'Kurar' | p_partkey % 6", "2 | 'Ölçer' | ''")
MARKED = _table("Program yeterlilikleri ile ilişki", "#'Sıra' | 'Yeterlilik' | '0' | '1' | '2' | '3'", "1 | 'Çizer' | '' | '+' | '' | '+'", "2 | 'Yazar' | '' | '' | '' | ''")
WIDE = _table("Program yeterlilikleri ile ilişki", "#'PY 1' | 'PY 2' | 'PY 3' | 'PY 4'", "'Ö1' | p_partkey % 6 | '-' | 2 | 4", "'Ö2' | 1 | '' | 5 | ''")
HTML = " || ".join([
    _table("Ders", "#'Yarıyıl' | 'Ders Kodu' | 'Ders Adı' | 'T+U' | 'Kredi' | 'AKTS'", "p_partkey % 8 + 1 | 'MK' || p_partkey | p_name | p_partkey % 4 || '+' || p_partkey % 3 | '2,5' | p_size"),
    _table("Genel bilgi", "'Dersin Dili :' | 'dil' || p_partkey", "'AMACI' | 'amaç'", "'Renk' | p_brand"),
    f"CASE {K3} WHEN 0 THEN {NUMBERED} WHEN 1 THEN {MARKED} ELSE {WIDE} END",
    _table("Öğrenme çıktıları", "#'No' | 'Çıktı' | 'Yöntem'", "'Ö1' | 'okur ' || p_size | 'ödev'", "'2.' | '' | 'x'", "'Ö3' | 'anlatır' | 'sunum'"),
    _table("Haftalık akış", "#'Hafta' | 'Konu' | 'Ön hazırlık' | 'Doküman'", "1 | 'konu ' || p_size | 'oku' | ''", "2 | '' | '' | ''", "'3.' | 'kapanış' | '' | 'dosya'"),
    _table("AKTS hesaplama", "#'Etkinlik' | 'Sayısı' | 'Süresi' | 'Toplam'", "'Rapor' | p_partkey % 5 | '1,5' | 9", "'Yok' | '-' | '-' | ''", "'TOPLAM' | 1 | 2 | 3"),
    _table("Değerlendirme", "#'Çalışma' | 'Adet' | 'Katkı %'", "'Sözlü' | 2 | p_partkey % 60", "'Boş' | '' | ''", "'Toplam' | '' | 100"),
    _table("Kaynaklar", "'Kitap' | p_type", "'yalnız ' || p_partkey"),
    _table("Notlar", "'not' | p_partkey | ''"),
])


def stored(spark, d, html):
    """Pages, dealt out before their HTML is made: a small file of parts is one task's, and pages are a hundred times as large."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, d, "part").repartition(n).select(F.col("p_partkey").alias("page_id"), F.lit("https://x.example/").alias("url"), F.expr(html).alias("html"))


def parsed(spark, d, html, *want):
    return G.parse_pages(stored(spark, d, html), *want)


def tables(spark, d, html=HTML):
    return G.html_tables(parsed(spark, d, html, "tables"))


@query("k6_labelled_fields", "SELECT p_partkey AS page_id, 'dil' || p_partkey AS language, 'amaç' AS objective, p_brand AS other FROM part")
def _(spark, d):
    kv = G.table_kv(tables(spark, d).where("idx = 1")).withColumn("seq", F.col("idx"))
    f = K.labelled_fields(kv, K.COURSE_FIELDS)
    return f.select("page_id", F.col("fields")["language"].alias("language"), F.col("fields")["objective"].alias("objective"), F.col("other")["Renk"].alias("other"))


TEXT = "'Program Çıktıları 1. Önceki 2. Daha önceki. PROGRAM ÖĞRENME ÇIKTILARI: 1. Modeller ' || p_partkey || ' 2. Sınama' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' 3. Sunar' END"


@query("k8_outcomes_from_text", "SELECT p_partkey, 1 AS no, 'Modeller ' || p_partkey AS description FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 2, 'Sınama' FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 3, 'Sunar' FROM part WHERE p_partkey % 2 = 1")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.expr(TEXT)).otherwise("1. a 2. b").alias("content"))
    return K.outcomes_from_text(rows, "p_partkey")


TWO = " || ".join([
    _table("a", "1 | 'tek ' || p_size", "2 | 'çift'", "'x' | 'atla'"),
    "CASE WHEN p_partkey % 2 = 0 THEN " + _table("b", "'P1' | 'ilk'", "'P2' | 'orta'", "'P3' | p_brand") + " ELSE " + _table("b", "'P1' | 'ilk'", "'P2' | 'orta'") + " END",
])


@query("k9_parse_outcomes", "SELECT p_partkey AS page_id, n AS no, CASE WHEN p_partkey % 2 = 0 THEN CASE n WHEN 1 THEN 'ilk' WHEN 2 THEN 'orta' ELSE p_brand END ELSE CASE n WHEN 1 THEN 'tek ' || p_size ELSE 'çift' END END AS description FROM part, (SELECT unnest([1, 2, 3]) AS n) WHERE n < 3 OR p_partkey % 2 = 0")
def _(spark, d):
    return K.parse_outcomes(tables(spark, d, TWO))


NAMES = "['summary', 'details', 'matrix', 'learning_outcomes', 'weekly', 'workload', 'assessment', 'resources', 'unknown']"


@query("k12_course_sections", f"SELECT p_partkey AS page_id, i AS idx, {NAMES}[i + 1] AS section FROM part, (SELECT CAST(unnest(range(9)) AS INTEGER) AS i)")
def _(spark, d):
    return K.course_sections(tables(spark, d)).select("page_id", "idx", "section")


@query("k12_course_summary", "SELECT p_partkey AS page_id, p_partkey % 8 + 1 AS semester, 'MK' || p_partkey AS code, p_name AS name, p_partkey % 4 AS theory, p_partkey % 3 AS practice, CAST(2.5 AS DOUBLE) AS credit, CAST(p_size AS DOUBLE) AS ects FROM part")
def _(spark, d):
    return K.course_summary(tables(spark, d))


@query("k12_course_details", """SELECT p_partkey AS page_id, unnest(['Dersin Dili :', 'AMACI', 'Renk', 'Yarıyıl', 'Ders Kodu', 'Ders Adı', 'T+U', 'Kredi', 'AKTS', 'tablo: Notlar']) AS key,
    unnest(['dil' || p_partkey, 'amaç', p_brand, CAST(p_partkey % 8 + 1 AS VARCHAR), 'MK' || p_partkey, p_name, p_partkey % 4 || '+' || p_partkey % 3, '2,5', CAST(p_size AS VARCHAR), 'not | ' || p_partkey]) AS value FROM part""")
def _(spark, d):
    return K.course_details(tables(spark, d))


@query("k13_learning_outcomes", "SELECT p_partkey AS page_id, 1 AS ordinal, 1 AS no, 'okur ' || p_size AS description, 'ödev' AS extra FROM part UNION ALL SELECT p_partkey, 2, 3, 'anlatır', 'sunum' FROM part")
def _(spark, d):
    return K.learning_outcomes(tables(spark, d))


@query("k13_weekly_rows", "SELECT p_partkey AS page_id, 1 AS ordinal, 1 AS week, 'konu ' || p_size AS topic, 'oku' AS preparation, '' AS documents FROM part UNION ALL SELECT p_partkey, 2, 3, 'kapanış', '', 'dosya' FROM part")
def _(spark, d):
    return K.weekly_topics(tables(spark, d))


@query("k13_workloads", "SELECT p_partkey AS page_id, 1 AS ordinal, 'Rapor' AS activity, CAST(p_partkey % 5 AS DOUBLE) AS count, CAST(1.5 AS DOUBLE) AS hours, CAST(9 AS DOUBLE) AS total FROM part")
def _(spark, d):
    return K.workloads(tables(spark, d))


@query("k13_assessments", "SELECT p_partkey AS page_id, 1 AS ordinal, 'Sözlü' AS activity, 2 AS count, CAST(p_partkey % 60 AS DOUBLE) AS percentage FROM part")
def _(spark, d):
    return K.assessments(tables(spark, d))


@query("k13_resources", "SELECT p_partkey AS page_id, 1 AS ordinal, 'Kitap' AS kind, p_type AS content FROM part UNION ALL SELECT p_partkey, 2, NULL, 'yalnız ' || p_partkey FROM part")
def _(spark, d):
    return K.resources(tables(spark, d))


@query("k14_course_matrix", f"""SELECT p_partkey AS page_id, n AS po_no, CASE WHEN {K3} = 2 THEN '' ELSE (CASE {K3} WHEN 0 THEN ['Kurar', 'Ölçer'] ELSE ['Çizer', 'Yazar'] END)[n] END AS description,
    CASE {K3} WHEN 0 THEN CASE n WHEN 1 THEN p_partkey % 6 END WHEN 1 THEN CASE n WHEN 1 THEN 3 END ELSE CASE n WHEN 1 THEN greatest(p_partkey % 6, 1) WHEN 3 THEN 5 WHEN 4 THEN 4 END END AS level
    FROM part, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n < 3 OR {K3} = 2""")
def _(spark, d):
    return K.course_matrix(tables(spark, d).where("idx = 2")).drop("idx")


@query("k14_matrix_cells", f"SELECT p_partkey AS page_id, unnest([1, 1, 1, 2, 2]) AS lo_no, unnest([1, 3, 4, 1, 3]) AS po_no, unnest([p_partkey % 6, 2, 4, 1, 5]) AS level FROM part WHERE {K3} = 2")
def _(spark, d):
    return K.matrix_cells(tables(spark, d).where("idx = 2")).select("page_id", "lo_no", "po_no", "level")


def _plan_row(attributes: str, *cells: str) -> str:
    return f"'<tr {attributes}>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"


PLAN = " || ".join([
    "'<p>3. Yarıyıl</p><table><tr><th>Kodu</th><th>Ders Adı</th><th>Z/S</th><th>T+U</th><th>Kredi</th><th>AKTS</th><th>Grup Ders Adedi</th></tr>'",
    _plan_row("onclick=\"prolizOpenCourseDetails(' || (100000 + p_partkey) || ')\"", "'AB' || p_partkey", "p_name", "'Zorunlu'", "p_partkey % 5 || '+1+2'", "'3,5'", "p_size", "''"),
    _plan_row("onclick=\"toggleRow(this, ''' || (900000 + p_partkey) || ''')\"", "'GR'", "'Seçenekler'", "'S'", "''", "''", "'6'", "'2 ders'"),
    _plan_row("class=\"x collapse_' || (900000 + p_partkey) || '\"", "'HV'", "'<a href=\"progCourseDetails.aspx?curCourse=' || (500000 + p_partkey) || '\">Havuz</a>'", "''", "'2+0'", "'2'", "'4'", "''"),
    _plan_row("", "'4. YARIYIL dersleri'"),
    _plan_row("onclick=\"prolizOpenCourseDetails(' || (700000 + p_partkey) || ')\"", "'CD'", "'Son'", "'E'", "'0+2'", "''", "'5'", "''"),
    _plan_row("onclick=\"prolizOpenCourseDetails(' || (100000 + p_partkey) || ')\"", "'again'", "'again'", "''", "''", "''", "''", "''"),
    _plan_row("", "'<a href=\"havuz.aspx?no=' || p_partkey || '\">liste</a>'"),
    "'</table><a href=\"progCourseDetails.aspx?curCourse=' || (800000 + p_partkey) || '\">kayıp</a>'",
])


@query("k10_plan_entries", """SELECT p_partkey AS page_id, n AS ordinal, ([100000, 900000, 500000, 700000, 800000])[n] + p_partkey AS course_id, ([3, 3, 3, 4, NULL])[n] AS semester,
    (['AB' || p_partkey, 'GR', 'HV', 'CD', NULL])[n] AS code, ([p_name, 'Seçenekler', 'Havuz', 'Son', NULL])[n] AS name, (['zorunlu', 'secmeli', 'secmeli', 'secmeli', NULL])[n] AS type,
    ([p_partkey % 5, NULL, 2, 0, NULL])[n] AS theory, ([1, NULL, 0, 2, NULL])[n] AS practice, ([2, NULL, NULL, NULL, NULL])[n] AS lab, CAST(([3.5, NULL, 2.0, NULL, NULL])[n] AS DOUBLE) AS credit,
    CAST(([p_size, 6, 4, 5, NULL])[n] AS DOUBLE) AS ects, ([false, true, false, false, NULL])[n] AS is_group, CASE n WHEN 2 THEN 2 END AS group_count, CASE n WHEN 3 THEN 900000 + p_partkey END AS group_id
    FROM part, (SELECT unnest([1, 2, 3, 4, 5]) AS n)""")
def _(spark, d):
    pages = stored(spark, d, PLAN).withColumn("linked", K.linked_courses(F.col("html")))
    pages = kept(G.parse_pages(pages, "tables", carry=("linked",)))  # read once for both
    return K.plan_entries(G.html_tables(pages), pages).drop("delivery")


@query("k10_plan_links", "SELECT p_partkey AS page_id, 'havuz.aspx?no=' || p_partkey AS link FROM part")
def _(spark, d):
    return K.plan_links(tables(spark, d, PLAN))


HEAD = """'<span id="lblProgInfoDers">Birim ' || p_size || ' / Bölüm - ' || p_partkey || ' - Dersler</span><select name="dil"><option selected>2031</option></select><select name="cmbYillar"><option value="">2017</option><option value="a' || p_partkey || '">2018 plan</option><option value="b' || p_partkey || '"' || CASE WHEN p_partkey % 2 = 0 THEN ' selected' ELSE '' END || '>' || (2019 + p_partkey % 4) || '</option><option value="c">yok</option></select>'"""


@query("k11_plan_head", "SELECT p_partkey AS page_id, 'Birim ' || p_size AS unit_name, 'Bölüm - ' || p_partkey AS program_name, CASE WHEN p_partkey % 2 = 0 THEN 2019 + p_partkey % 4 ELSE 2031 END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'b' || p_partkey END AS plan_id FROM part")
def _(spark, d):
    return K.plan_head(parsed(spark, d, HEAD, "spans", "options"))


@query("k11_plan_years", "SELECT p_partkey AS page_id, 'a' || p_partkey AS value, 2018 AS year, '2018 plan' AS label, false AS selected FROM part UNION ALL SELECT p_partkey, 'b' || p_partkey, 2019 + p_partkey % 4, CAST(2019 + p_partkey % 4 AS VARCHAR), p_partkey % 2 = 0 FROM part")
def _(spark, d):
    return K.plan_years(parsed(spark, d, HEAD, "options"))


@query("k13_course_rows", f"""SELECT p_partkey AS page_id, unnest(['details', 'matrix', 'learning_outcomes', 'weekly', 'workload', 'assessment', 'resources']) AS section,
    unnest([10, CASE WHEN {K3} = 2 THEN 4 ELSE 2 END, 2, 2, 1, 1, 2]) AS n FROM part""")
def _(spark, d):
    """All sections of a course page from tables that are kept once."""
    t = K.course_tables(tables(spark, d))
    read = {"details": K.course_details(t), "matrix": K.course_matrix(t.where("section = 'matrix'")), "learning_outcomes": K.learning_outcomes(t), "weekly": K.weekly_topics(t), "workload": K.workloads(t), "assessment": K.assessments(t), "resources": K.resources(t)}
    rows = [df.groupBy("page_id").agg(F.lit(name).alias("section"), F.count("*").alias("n")) for name, df in read.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).select("page_id", "section", "n")


PROGRAM = " || ".join([
    "'<h2>Program Bilgileri</h2><table><tr><td colspan=\"2\">' || p_name || ' - Genel Bilgi Programı</td></tr><tr><td>Eğitim Süresi</td><td>' || (2 + p_partkey % 4) || ' yıl</td></tr><tr><td>Azami Süresi</td><td>7 yıl</td></tr>'",
    "'<tr><td>Dili</td><td>dil' || p_size || '</td></tr><tr><td>Kontenjan </td><td>' || p_partkey || '</td></tr><tr><td>Zorunlu Staj</td><td>' || CASE WHEN p_partkey % 2 = 0 THEN 'var' ELSE 'yok' END || '</td></tr></table>'",
    _table("Tarihçe", "p_brand", "'' | 'son' | ''"), _table("Mezuniyet Koşulları", "'eski'"), _table("Yeterlilik Koşulları", "'kural ' || p_partkey"), _table("Diğer", "'x' | 'y'"), "'<table><tr><td>adsız</td></tr></table><table><tr><td></td></tr></table>'",
])


@query("k6_program_pages", """SELECT p_partkey AS page_id, p_name AS name, 'dil' || p_size AS language, 2 + p_partkey % 4 AS duration_years, 7 AS max_duration_years, CAST(p_partkey AS VARCHAR) AS quota,
    CASE WHEN p_partkey % 2 = 0 THEN 'var' ELSE 'yok' END AS internship, p_brand || chr(10) || 'son' AS history, 'kural ' || p_partkey AS graduation, 5 AS n_info, 'Diğer:x | y;Mezuniyet Koşulları:eski;Tarihçe:' || p_brand || chr(10) || 'son;Yeterlilik Koşulları:kural ' || p_partkey || ';tablo_5:adsız' AS sections FROM part""")
def _(spark, d):
    f = F.col("fields")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("sections")), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    return K.program_pages(tables(spark, d, PROGRAM)).select("page_id", "name", "language", "duration_years", "max_duration_years", "quota", "internship", f["history"].alias("history"), f["graduation"].alias("graduation"), F.size("info").alias("n_info"), listed.alias("sections"))


ABOUT = """'<span id="menu"><span id="lblHeader">' || CASE WHEN p_partkey % 3 = 0 THEN 'Fakülte' ELSE p_name || ' <i>Birimi</i>' END || ' Bilgi Paketi Tanımları</span></span><span id="lblContent"><p>İlk   ' || p_brand || '</p><div>ikinci <span>satır</span></div><br></span>'"""


@query("k18_unit_about_pages", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 > 0 THEN p_name || ' Birimi' END AS name, 'İlk ' || p_brand || chr(10) || 'ikinci satır' AS about FROM part")
def _(spark, d):
    return K.unit_about_pages(parsed(spark, d, ABOUT, "spans"))


@query("k15_mark_empty", "SELECT p_partkey, p_partkey % 4 = 0 AS empty, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 1 END AS n_details FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 4
    none = lambda v: F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(v)))
    rows = table(spark, d, "part").select("p_partkey", F.when(k == 1, "K1").alias("code"), F.lit(None).cast("string").alias("name"), F.when(k == 2, 3).otherwise(0).alias("n_rows"), F.when(k == 3, none("dolu")).otherwise(none("Kayıt Yok...")).alias("details"))
    return K.mark_empty(rows).select("p_partkey", "empty", F.size("details").alias("n_details"))


@query("k18_unit_about", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name, 'metin' AS about FROM nation")
def _(spark, d):
    head = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("Fakülte"), F.lit(" Bilgi Paketi Tanımları"))
    return table(spark, d, "nation").select("n_nationkey", K.unit_about(head, F.lit("metin")).alias("u")).select("n_nationkey", "u.name", "u.about")


UNITS = """'<head><title>curUnit=1</title></head><div class="panel-heading">Listelemek için artıya basınız</div><a href="a.aspx?curUnit=5&curSunit=' || (90000 + p_partkey) || '">Yönetim</a><h5 class="panel-title"><a href="#x">Fakülte ' || p_partkey || '</a><a href="tanitim.aspx?curUnit=' || (10 + p_partkey) || '"><i></i></a></h5>'
|| '<div><a href="a.aspx?curSunit=' || (80000 + p_partkey) || '">Bölüm <b>A</b></a><a href="a.aspx?curUnit=7&curSunit=' || (70000 + p_partkey) || '"></a><a href="a.aspx?curSunit=' || (70000 + p_partkey) || '">Bölüm B</a></div><strong>Enstitü</strong><a onclick="ac(curSunit=' || (60000 + p_partkey) || ')">Anabilim</a>'
|| '<a href="okul.aspx?curUnit=9">Okul</a><select><optgroup label="Yüksekokul"><option value="curSunit=' || (50000 + p_partkey) || '">Program seçiniz<option value="curSunit=' || (40000 + p_partkey) || '">' || p_brand || '</optgroup></select>'"""


@query("k17_programs", """SELECT p_partkey AS page_id, 90000 + p_partkey AS id, 5 AS unit_id, 'Yönetim' AS name, NULL AS unit_name FROM part UNION ALL SELECT p_partkey, 80000 + p_partkey, 10 + p_partkey, 'Bölüm A', 'Fakülte ' || p_partkey FROM part
    UNION ALL SELECT p_partkey, 70000 + p_partkey, 7, 'Bölüm B', 'Fakülte ' || p_partkey FROM part UNION ALL SELECT p_partkey, 60000 + p_partkey, NULL, 'Anabilim', 'Enstitü' FROM part
    UNION ALL SELECT p_partkey, 50000 + p_partkey, NULL, 'Program seçiniz', 'Yüksekokul' FROM part UNION ALL SELECT p_partkey, 40000 + p_partkey, NULL, p_brand, 'Yüksekokul' FROM part""")
def _(spark, d):
    return K.unit_selection(parsed(spark, d, UNITS, "marks"))[0].drop("pos")


@query("k17_units", "SELECT p_partkey AS page_id, 10 + p_partkey AS id, 'Fakülte ' || p_partkey AS name, NULL AS url FROM part UNION ALL SELECT p_partkey, 9, 'Okul', 'okul.aspx?curUnit=9' FROM part")
def _(spark, d):
    return K.unit_selection(parsed(spark, d, UNITS, "marks"))[1].drop("pos")
