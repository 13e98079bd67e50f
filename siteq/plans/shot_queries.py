"""Queries of groups E, G, I, J and of text columns: shots, texts and findings from the driver's tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siteq.operators import shots as S
from siteq.operators import text as X
from siteq.operators import verify as V
from siteq.plans import review_queries as RQ
from siteq.sources import images as I
from siteq.sources.shared import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SHOTS = """shots AS (SELECT doc_id AS pos, doc_id // 2 AS page, CASE WHEN doc_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, n_chars % 5 + 100 AS width, n_chars AS height, CASE WHEN doc_id % 17 = 0 THEN 3.0 ELSE 40.0 END AS std,
CASE WHEN doc_id % 41 = 0 THEN 'broken' END AS error, md5(text) AS look FROM documents)"""
STATS = """w AS (SELECT device, width, count(*) AS n, min(pos) AS first FROM shots WHERE error IS NULL GROUP BY ALL), stats AS (SELECT s.device, median(height) AS median_height, count(*) AS n, any_value(m.mode_width) AS mode_width FROM shots s JOIN (SELECT device, arg_max(width, (n, -first)) AS mode_width FROM w GROUP BY device) m ON m.device = s.device WHERE error IS NULL GROUP BY s.device)"""
FLAGS = """flagged AS (SELECT s.*, CASE WHEN error IS NOT NULL THEN ['BOZUK_DOSYA'] ELSE list_filter([CASE WHEN width > mode_width THEN 'TASMA(+' || (width - mode_width) || 'px)' WHEN width < mode_width THEN 'DAR(-' || (mode_width - width) || 'px)' END,
CASE WHEN std < 4 THEN 'BOS_SAYFA' END, CASE WHEN height < median_height * 0.3 THEN 'COK_KISA' END, CASE WHEN height > median_height * 5 THEN 'COK_UZUN' END], lambda x: x IS NOT NULL) END AS flags FROM shots s LEFT JOIN stats t ON t.device = s.device)"""


def shots(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("pos"), F.expr("doc_id div 2").alias("page"), F.when(k % 2 == 0, "desktop").otherwise("mobile").alias("device"), (F.col("n_chars") % 5 + 100).alias("width"), F.col("n_chars").alias("height"),
        F.when(k % 17 == 0, 3.0).otherwise(40.0).alias("std"), F.when(k % 41 == 0, "broken").alias("error"), F.md5(F.col("text").cast("binary")).alias("look"),
    )


def flagged(spark, d):
    return S.shot_flags(shots(spark, d), S.device_stats(shots(spark, d)))


GRID = "SELECT vec_id, list_concat(embedding, embedding[1:8]) AS v FROM embeddings"
BITS = "array_to_string([CASE WHEN v[(i // 8) * 9 + i % 8 + 1] > v[(i // 8) * 9 + i % 8 + 2] THEN '1' ELSE '0' END for i in range(64)], '')"


def hashes(spark, d):
    """Hashes of grids of the 64 values of each vector and its first eight again."""
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("template"), S.dhash(F.concat("embedding", F.slice("embedding", 1, 8))).alias("hash"))


def png(pixels: np.ndarray, colour: int) -> bytes:
    """A PNG file of grey pixels, as colour type 0, 2 or 6; the rows take all five filters in turn."""
    h, w = pixels.shape
    x = np.repeat(pixels[:, :, None], {0: 1, 2: 3, 6: 4}[colour], axis=2).astype(np.int16)
    left, up, corner = np.pad(x, ((0, 0), (1, 0), (0, 0)))[:, :-1], np.pad(x, ((1, 0), (0, 0), (0, 0)))[:-1], np.pad(x, ((1, 0), (1, 0), (0, 0)))[:-1, :-1]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    guesses = (0 * x, left, up, (left + up) >> 1, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)))
    rows = b"".join(bytes([r % 5]) + ((x[r] - guesses[r % 5][r]) & 255).astype(np.uint8).tobytes() for r in range(h))
    chunk = lambda kind, data: len(data).to_bytes(4) + kind + data + zlib.crc32(kind + data).to_bytes(4)
    return I.START + chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + bytes([8, colour, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pictures(spark, d):
    """(path, content): a picture of 17 x 16 for each vector; of some the file is cut short."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grey = np.clip(np.floor(128 + 300 * np.resize(np.array(v, float), 272)), 0, 255).astype(np.uint8)
                body = png(grey.reshape(16, 17), (0, 2, 6)[k % 3])
                files.append(body[:-20] if k % 37 == 5 else body)
            yield pa.record_batch({"path": batch.column(0).cast(pa.string()), "content": pa.array(files, pa.binary())})

    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(rows, "path string, content binary")


def _weight(n: int, to: int) -> str:
    """SQL of the weights of a triangle filter, in parts of 2^22."""
    return f"SELECT i, x, CAST(floor(0.5 + w / sum(w) OVER (PARTITION BY i) * 4194304) AS BIGINT) AS k FROM (SELECT i, x, greatest(0.0, 1 - abs(x + 0.5 - (i + 0.5) * ({n}.0 / {to})) / ({n}.0 / {to}))::DOUBLE AS w FROM range({to}) a(i), range({n}) b(x)) WHERE w > 0"


def _hash(source: str, width: int) -> str:
    """SQL of a hash in hexadecimal of (vec_id, r, c, p)."""
    bits = f"SELECT vec_id, r * {width - 1} + c AS spot, CASE WHEN p > lead(p) OVER (PARTITION BY vec_id, r ORDER BY c) THEN 1 ELSE 0 END AS b, c FROM {source}"
    nibbles = f"SELECT vec_id, spot // 4 AS n, sum(b * (8 >> (spot % 4)::INT)) AS x FROM ({bits}) WHERE c < {width - 1} GROUP BY ALL"
    return f"SELECT vec_id, string_agg(substr('0123456789abcdef', x::INT + 1, 1), '' ORDER BY n) AS h FROM ({nibbles}) GROUP BY vec_id"


IMAGES_SQL = f"""WITH px AS (SELECT vec_id, r, c, greatest(0, least(255, floor(128 + 300 * CAST(embedding[((r * 17 + c) % 64 + 1)::INT] AS DOUBLE))))::BIGINT AS p FROM embeddings, range(16) a(r), range(17) b(c)),
wx AS ({_weight(17, 9)}), wy AS ({_weight(16, 8)}),
across AS (SELECT vec_id, r, i AS c, least(255, (sum(k * p)::BIGINT + 2097152) >> 22) AS p FROM px JOIN wx ON c = x GROUP BY vec_id, r, i),
down AS (SELECT vec_id, i AS r, c, least(255, (sum(k * p)::BIGINT + 2097152) >> 22) AS p FROM across JOIN wy ON r = x GROUP BY vec_id, i, c),
h64 AS ({_hash("down", 9)}), h256 AS ({_hash("px", 17)}), s AS (SELECT vec_id, round(stddev_pop(p), 2) AS std FROM px GROUP BY vec_id)
SELECT vec_id::VARCHAR AS path, CASE WHEN bad THEN 0 ELSE 17 END::BIGINT AS width, CASE WHEN bad THEN 0 ELSE 16 END::BIGINT AS height, CASE WHEN bad THEN 0 ELSE std END AS std, CASE WHEN bad THEN '' ELSE h64.h END AS dh64, CASE WHEN bad THEN '' ELSE h256.h END AS dh256,
CASE WHEN bad THEN 'the file ends early' ELSE '' END AS error FROM (SELECT vec_id, vec_id % 37 = 5 AS bad FROM embeddings) JOIN s USING (vec_id) JOIN h64 USING (vec_id) JOIN h256 USING (vec_id)"""


@query("e1_measure_images", IMAGES_SQL)
def _(spark, d):
    return I.measure_images(pictures(spark, d)).drop("bytes")


@query("e2_dhash", f"SELECT vec_id, {BITS} AS bits FROM ({GRID})")
def _(spark, d):
    return hashes(spark, d).select("vec_id", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


WIDE = "array_to_string([CASE WHEN v[((i // 16) * 17 + i % 16) % 64 + 1] > v[((i // 16) * 17 + i % 16 + 1) % 64 + 1] THEN '1' ELSE '0' END for i in range(256)], '')"


@query("e2_dhash_256", f"SELECT vec_id, {WIDE} AS bits FROM (SELECT vec_id, embedding AS v FROM embeddings)")
def _(spark, d):
    grid = F.slice(F.flatten(F.array_repeat("embedding", 5)), 1, 17 * 16)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(S.dhash(grid, 17, 16), lambda w: F.lpad(F.bin(w), 64, "0")), "").alias("bits"))


@query("e3_parse_shot_name", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'tr-a' || doc_id || '-0123abcd' WHEN 1 THEN 'x' || doc_id ELSE 'y' || doc_id END AS page, CASE doc_id % 3 WHEN 0 THEN 'tr-a' || doc_id WHEN 1 THEN 'x' || doc_id ELSE 'y' || doc_id END AS slug, CASE doc_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE '?' END AS device FROM documents")
def _(spark, d):
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("tr-a"), k, F.lit("-0123abcd__mobile.png"))).when(k % 3 == 1, F.concat(F.lit("x"), k, F.lit("__desktop.png"))).otherwise(F.concat(F.lit("y"), k, F.lit(".png")))
    return table(spark, d, "documents").select("doc_id", S.parse_shot_name(name).alias("n")).select("doc_id", "n.page", "n.slug", "n.device")


SLUG = "CASE p_partkey % 6 WHEN 0 THEN 'anasayfa' WHEN 1 THEN 'tr-haber-n-' || p_partkey WHEN 2 THEN 'tr-birim' WHEN 3 THEN 'en-akademik-' || repeat('x', 50 + p_partkey % 9) ELSE 'tr-bolum-' || p_partkey || '-w' || p_partkey % 25 END"
NAMED = f"s AS (SELECT p_partkey, {SLUG} AS slug FROM part), named AS (SELECT *, length(slug) >= (SELECT max(length(slug)) FROM s) - 1 AND (SELECT max(length(slug)) FROM s) > 60 AS truncated FROM s), words AS (SELECT list_last(string_split(slug, '-')) AS word, count(*) AS n FROM named WHERE NOT truncated AND NOT regexp_matches(slug, '-n-[0-9]+$') GROUP BY 1 HAVING count(*) >= 10)"


def named(spark, d):
    return S.truncated_names(table(spark, d, "part").select("p_partkey", F.expr(SLUG).alias("slug")))


@query("e4_truncated_names", f"WITH {NAMED} SELECT p_partkey, truncated FROM named")
def _(spark, d):
    return named(spark, d).select("p_partkey", "truncated")


@query("e5_page_type_vocab", f"WITH {NAMED} SELECT word, n FROM words")
def _(spark, d):
    return S.page_type_vocab(named(spark, d))


TEMPLATE = "CASE WHEN t[1] NOT IN ('tr', 'en') THEN slug WHEN regexp_matches(slug, '-n-[0-9]+$') THEN t[1] || '/' || t[2] || '/[detay]' WHEN truncated THEN NULL WHEN len(t) <= 2 THEN t[1] || '/' || t[2] ELSE t[1] || '/' || t[2] || '/' || CASE WHEN t[len(t)] IN (SELECT word FROM words) THEN t[len(t)] ELSE '[diger]' END END"


@query("e6_shot_template", f"WITH {NAMED} SELECT p_partkey, {TEMPLATE} AS template FROM (SELECT *, string_split(slug, '-') AS t FROM named)")
def _(spark, d):
    rows = named(spark, d)
    return S.shot_template(rows, S.page_type_vocab(rows)).select("p_partkey", "template")


@query("e7_device_stats", f"WITH {SHOTS}, {STATS} SELECT device, median_height, n, mode_width FROM stats")
def _(spark, d):
    return S.device_stats(shots(spark, d))


@query("e8_shot_flags", f"WITH {SHOTS}, {STATS}, {FLAGS} SELECT pos, array_to_string(flags, ',') AS flags FROM flagged")
def _(spark, d):
    return flagged(spark, d).select("pos", F.array_join("flags", ",").alias("flags"))


@query("e9_missing_pairs", f"WITH {SHOTS}, p AS (SELECT CASE WHEN pos % 5 = 0 THEN -pos ELSE page END AS page, list(DISTINCT device) AS have FROM shots GROUP BY 1) SELECT page, CASE WHEN list_contains(have, 'desktop') THEN 'mobile' ELSE 'desktop' END AS missing FROM p WHERE len(have) = 1")
def _(spark, d):
    return S.missing_pairs(shots(spark, d).withColumn("page", F.when(F.col("pos") % 5 == 0, -F.col("pos")).otherwise(F.col("page"))))


@query("e10_same_look", f"WITH {SHOTS}, {STATS}, {FLAGS} SELECT device, look, count(*) AS n_images, count(DISTINCT page) AS n_pages FROM (SELECT device, substr(look, 1, 2) AS look, page, flags FROM flagged) WHERE NOT list_contains(flags, 'BOS_SAYFA') GROUP BY device, look HAVING count(DISTINCT page) >= 3")
def _(spark, d):
    return S.same_look(flagged(spark, d).withColumn("look", F.substring("look", 1, 2)))


@query("e10_same_look_flags", f"WITH {SHOTS}, {STATS}, {FLAGS}, x AS (SELECT pos, device, page, flags, substr(look, 1, 2) AS look FROM flagged), g AS (SELECT device, look, count(*) AS n FROM x WHERE NOT list_contains(flags, 'BOS_SAYFA') GROUP BY ALL HAVING count(DISTINCT page) >= 3) SELECT pos, array_to_string(CASE WHEN g.n IS NOT NULL AND NOT list_contains(flags, 'BOS_SAYFA') THEN list_append(flags, 'AYNI_GORUNUM(' || g.n || ')') ELSE flags END, ',') AS flags FROM x LEFT JOIN g ON g.device = x.device AND g.look = x.look")
def _(spark, d):
    return S.same_look_flags(flagged(spark, d).withColumn("look", F.substring("look", 1, 2))).select("pos", F.array_join("flags", ",").alias("flags"))


@query("e11_hamming", "SELECT s_suppkey, bit_count(xor(s_suppkey, CAST(s_nationkey * 77 AS BIGINT))) AS bits FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.hamming(F.col("s_suppkey"), (F.col("s_nationkey") * 77).cast("long")).alias("bits"))


def clusters(spark, d):
    return S.greedy_clusters(hashes(spark, d).select("template", F.col("vec_id").alias("id"), "hash", (F.col("vec_id") % 50).alias("height")), 26)


@query("e12_greedy_clusters")
def _(spark, d):
    return clusters(spark, d).select("template", "id", "cluster")


@query("e13_assign_nearest")
def _(spark, d):
    c = clusters(spark, d)
    lost = hashes(spark, d).select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), F.col("template").cast("int") % 3).alias("section"), "hash")
    return S.assign_nearest(lost, S.cluster_centres(c).select(F.concat(F.lit("s"), F.col("template").cast("int") % 3).alias("section"), "template", "centre"), 26)


@query("e14_propagate_template", "WITH s AS (SELECT doc_id, doc_id // 2 AS page, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 't' || doc_id % 9 END AS template FROM documents) SELECT a.doc_id, coalesce(a.template, (SELECT min(b.template) FROM s b WHERE b.page = a.page AND b.doc_id % 2 = 0), 'x/[kesik]') AS final FROM s a")
def _(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 2").alias("page"), F.when(k % 2 == 0, "desktop").otherwise("mobile").alias("device"), F.when((k % 2 == 0) & (k % 3 > 0), F.concat(F.lit("t"), k % 9)).alias("template"), F.lit("x").alias("section"))
    return S.propagate_template(rows, "desktop").select("doc_id", "final")


@query("e15_shot_representatives", "WITH c AS (SELECT 't' || o_custkey % 30 AS template, o_orderkey % 7 AS cluster, o_orderkey AS id, o_custkey % 500 AS height FROM orders), s AS (SELECT *, count(*) OVER (PARTITION BY template, cluster) AS size, row_number() OVER (PARTITION BY template, cluster ORDER BY height, id) - 1 AS k FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY size DESC, cluster) AS rank FROM s WHERE k = size // 2) SELECT template, cluster, id, size FROM r WHERE (size >= 5 AND rank <= 3) OR rank = 1")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("t"), F.col("o_custkey") % 30).alias("template"), (F.col("o_orderkey") % 7).alias("cluster"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 500).alias("height"))
    return S.shot_representatives(rows)


FLAGGED = f"{SHOTS}, {STATS}, {FLAGS}, m AS (SELECT pos AS id, page, 't' || page % 12 AS template, device, width, height, flags FROM flagged), cl AS (SELECT template, height % 4 AS cluster, id, height, page FROM m WHERE NOT list_contains(flags, 'BOS_SAYFA'))"
CHOSEN = """sz AS (SELECT *, count(*) OVER (PARTITION BY template, cluster) AS size, row_number() OVER (PARTITION BY template, cluster ORDER BY height, id) - 1 AS k FROM cl), rk AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY size DESC, cluster) AS rank FROM sz WHERE k = size // 2),
ov AS (SELECT template, arg_min(page, (-width, id)) AS page, count(*) AS k FROM m WHERE len(list_filter(flags, lambda f: starts_with(f, 'TASMA'))) > 0 GROUP BY template),
pk AS (SELECT template, page, rank, 'görsel küme ' || rank || ' (' || size || ' sayfa)' AS reason FROM rk WHERE (size >= 5 AND rank <= 3) OR rank = 1 UNION ALL SELECT template, page, 1000000, 'en çok taşan sayfa (' || k || ' taşma)' FROM ov),
ch AS (SELECT template, page, arg_min(reason, rank) AS reason FROM pk GROUP BY ALL)"""


def members(spark, d):
    shots = flagged(spark, d).select(F.col("pos").alias("id"), "page", F.concat(F.lit("t"), F.col("page") % 12).alias("template"), "device", "width", "height", "flags")
    clusters = shots.where(~F.array_contains("flags", "BOS_SAYFA")).select("template", (F.col("height") % 4).alias("cluster"), "id", "height")
    return shots, clusters


@query("e15_chosen_shots", f"WITH {FLAGGED}, {CHOSEN} SELECT ch.template, ch.page, reason, m.device, m.id, n_pages FROM ch JOIN (SELECT template, count(DISTINCT page) AS n_pages FROM m GROUP BY template) g ON g.template = ch.template JOIN m ON m.page = ch.page")
def _(spark, d):
    return S.chosen_shots(*members(spark, d))


@query("e16_template_groups", f"WITH {FLAGGED}, {CHOSEN} SELECT template, count(DISTINCT page) AS n_pages, count(*) FILTER (WHERE len(flags) > 0) AS n_flagged, min(page) AS sample, (SELECT count(DISTINCT cluster) FROM cl WHERE cl.template = m.template) AS n_clusters, (SELECT count(DISTINCT page) FROM ch WHERE ch.template = m.template) AS n_chosen FROM m GROUP BY template")
def _(spark, d):
    shots, clusters = members(spark, d)
    return S.template_summary(shots, clusters, S.chosen_shots(shots, clusters))


@query("e16_template_summary", f"WITH {SHOTS}, {STATS}, {FLAGS} SELECT 't' || page % 12 AS template, count(DISTINCT page) AS n_pages, count(*) FILTER (WHERE len(flags) > 0) AS n_flagged, min(page) AS sample FROM flagged GROUP BY 1")
def _(spark, d):
    return S.template_summary(flagged(spark, d).withColumn("template", F.concat(F.lit("t"), F.col("page") % 12)))


@query("e17_flag_counts", f"WITH {SHOTS}, {STATS}, {FLAGS} SELECT device, split_part(f, '(', 1) AS flag, count(*) AS n FROM (SELECT device, unnest(flags) AS f FROM flagged) GROUP BY ALL")
def _(spark, d):
    return S.flag_counts(flagged(spark, d))


@query("e18_scan_totals", f"WITH {SHOTS}, {STATS}, {FLAGS} SELECT count(*) AS images, count(DISTINCT page) AS pages, count(*) FILTER (WHERE error IS NOT NULL) AS broken, 100.0 * count(*) FILTER (WHERE len(flags) > 0) / count(*) AS flagged_pct FROM flagged")
def _(spark, d):
    return flagged(spark, d).agg(F.count("*").alias("images"), F.count_distinct("page").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("broken"), (F.count_if(F.size("flags") > 0) * 100.0 / F.count("*")).cast("double").alias("flagged_pct"))


SCAN = "sc AS (SELECT doc_id // 2 AS page, 't' || (doc_id // 2) % 150 AS template, n_chars % 6 = 0 AS truncated, CASE WHEN n_chars % 4 = 0 THEN 'gorsel(3)' ELSE 'url' END AS how, n_chars % 5 = 0 AS chosen FROM documents), pt AS (SELECT template, count(DISTINCT page) AS p FROM sc GROUP BY template)"


@query("e18_scan_report", f"WITH {SCAN} SELECT count(*) AS images, count(DISTINCT page) AS pages, (SELECT count(*) FROM pt) AS templates, (SELECT count(*) FROM pt WHERE p = 1) AS single_page, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE truncated AND starts_with(how, 'gorsel')) AS by_look, 100.0 * count(*) FILTER (WHERE chosen) / count(*) AS chosen_pct FROM sc")
def _(spark, d):
    k, n = F.expr("doc_id div 2"), F.col("n_chars")
    rows = table(spark, d, "documents").select(k.alias("page"), F.concat(F.lit("t"), k % 150).alias("template"), (n % 6 == 0).alias("truncated"), F.when(n % 4 == 0, "gorsel(3)").otherwise("url").alias("how"), (n % 5 == 0).alias("chosen"))
    return S.scan_totals(rows)


# ---------------------------------------------------------------- G, K1, K5, K20

DAMAGED = "CASE doc_id % 6 WHEN 0 THEN replace(text, 'e', '?') WHEN 1 THEN replace(text, ' ', '&nbsp;') WHEN 2 THEN replace(text, 'a', '�') WHEN 3 THEN replace(text, 'i', 'Ä±') WHEN 4 THEN replace(text, 'o', '<b>') ELSE text END"
HITS = f"dmg AS (SELECT doc_id, lang, {DAMAGED} AS t FROM documents), hit AS (SELECT doc_id, lang, 'html_kodu' AS pattern, len(regexp_extract_all(t, '&(?:#[0-9]{{2,5}}|#x[0-9a-fA-F]{{2,4}}|amp|quot|lt|gt|nbsp|apos);')) AS n FROM dmg UNION ALL SELECT doc_id, lang, 'yer_tutucu', length(t) - length(replace(t, '�', '')) FROM dmg UNION ALL SELECT doc_id, lang, 'html_etiketi', len(regexp_extract_all(t, '<b>')) FROM dmg)"


def damaged(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.expr(DAMAGED).alias("text"))


def hits(spark, d):
    return X.text_patterns(damaged(spark, d), "doc_id")


@query("g1_text_patterns", f"WITH {HITS} SELECT doc_id, pattern, n FROM hit WHERE n > 0")
def _(spark, d):
    return hits(spark, d).where("pattern IN ('html_kodu', 'yer_tutucu', 'html_etiketi')")


@query("g2_question_marks")
def _(spark, d):
    return hits(spark, d).where("pattern IN ('soru_isareti', 'mojibake')")


CONTEXTS = f"""WITH {HITS}, parts AS (SELECT doc_id, unnest(string_split(t, '�')) AS p, generate_subscripts(string_split(t, '�'), 1) AS k FROM dmg),
    pos AS (SELECT doc_id, k, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) + k - 1 AS BIGINT) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM parts),
    ctx AS (SELECT doc_id, k, trim(replace(substr(t, greatest(s - 25, 0) + 1, s + 26 - greatest(s - 25, 0)), chr(10), ' ')) AS c FROM pos JOIN dmg USING (doc_id) WHERE k < n),
    one AS (SELECT doc_id, c, min(k) AS k FROM ctx GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM one)
    SELECT doc_id, string_agg(c, '|' ORDER BY k) AS samples FROM r WHERE rn <= 3 GROUP BY doc_id"""


@query("g3_text_pattern_samples", CONTEXTS)
def _(spark, d):
    return X.text_pattern_samples(damaged(spark, d), "doc_id", "yer_tutucu").select("doc_id", F.array_join("samples", "|").alias("samples"))


@query("g4_pattern_by_lang", f"WITH {HITS} SELECT pattern, lang, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_hits FROM hit WHERE n > 0 GROUP BY ALL")
def _(spark, d):
    langs = table(spark, d, "documents").select("doc_id", "lang")
    return X.pattern_by_lang(hits(spark, d).where("pattern IN ('html_kodu', 'yer_tutucu', 'html_etiketi')").join(langs, "doc_id"))


@query("g5_text_report", f"WITH {HITS}, sm AS (SELECT * FROM hit WHERE n > 0) SELECT d.doc_id, coalesce(pattern, '') AS pattern, coalesce(n, 0) AS n FROM documents d LEFT JOIN sm s ON s.doc_id = d.doc_id")
def _(spark, d):
    return X.text_report(table(spark, d, "documents"), hits(spark, d).where("pattern IN ('html_kodu', 'yer_tutucu', 'html_etiketi')"), "doc_id")


@query("k1_norm", "SELECT doc_id, md5(trim(regexp_replace(lower(translate(text, 'ıIİîÎşŞğĞüÜûÛöÖçÇâÂ', 'iiiiissgguuuuooccaa')), '\\s+', ' ', 'g'))) AS norm, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.norm(F.col("text")).cast("binary")).alias("norm"), F.md5(X.clean(F.col("text")).cast("binary")).alias("clean"))


CELL = "CASE p_partkey % 6 WHEN 0 THEN 'PÇ' || p_partkey % 20 WHEN 1 THEN p_partkey % 90 || '.' WHEN 2 THEN '%' || p_partkey % 100 || ',5' WHEN 3 THEN p_partkey % 7 || '+' || p_partkey % 3 WHEN 4 THEN '3+2+' || p_partkey % 4 ELSE 'yok' END"


@query("k5_scalars", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey % 20 WHEN 1 THEN p_partkey % 90 WHEN 2 THEN p_partkey % 100 WHEN 3 THEN p_partkey % 7 WHEN 4 THEN 3 END AS first_int, CASE p_partkey % 6 WHEN 0 THEN p_partkey % 20 WHEN 1 THEN p_partkey % 90 WHEN 2 THEN p_partkey % 100 + 0.5 WHEN 3 THEN p_partkey % 7 WHEN 4 THEN 3 END::DOUBLE AS first_float, CASE p_partkey % 6 WHEN 0 THEN p_partkey % 20 WHEN 1 THEN p_partkey % 90 END AS ordinal, CASE p_partkey % 6 WHEN 3 THEN p_partkey % 7 WHEN 4 THEN 3 END AS t, CASE p_partkey % 6 WHEN 3 THEN p_partkey % 3 WHEN 4 THEN 2 END AS u, CASE WHEN p_partkey % 6 = 4 THEN p_partkey % 4 END AS l FROM part")
def _(spark, d):
    c = F.col("cell")
    return table(spark, d, "part").select("p_partkey", F.expr(CELL).alias("cell")).select("p_partkey", X.first_int(c).alias("first_int"), X.first_float(c).alias("first_float"), X.ordinal_no(c).alias("ordinal"), X.split_tul(c).alias("s")).select("p_partkey", "first_int", "first_float", "ordinal", "s.t", "s.u", "s.l")


@query("k20_extract_ids", "SELECT p_partkey, 'curUnit' AS kind, CAST(p_size AS VARCHAR) AS id FROM part UNION ALL SELECT p_partkey, 'curCourse', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'aspx', 'a' || p_partkey || '.aspx?curUnit=' || p_size FROM part")
def _(spark, d):
    text = F.concat(F.lit("x a"), "p_partkey", F.lit(".aspx?curUnit="), "p_size", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" curcourse="), "p_partkey")).otherwise(" y"))
    return X.extract_ids(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey")


# ---------------------------------------------------------------- I, J

PENDING = "SELECT l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 4 WHEN 0 THEN 'metin' WHEN 1 THEN 'http' ELSE 'ai' END AS source, CASE l_suppkey % 4 WHEN 0 THEN 'overflow' WHEN 1 THEN 'overlap' WHEN 2 THEN 'missing_data' ELSE 'yer_tutucu' END AS type, 'u' || l_orderkey % 500 AS url, CASE WHEN l_partkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, CASE WHEN l_linenumber > 2 THEN CAST(l_partkey % 900 AS INT) END AS y0, CASE WHEN l_linenumber > 2 THEN CAST(l_partkey % 900 AS INT) + 100 END AS y1 FROM lineitem"
MEASURED = "SELECT 'u' || k AS url, dv AS device, CASE WHEN k % 9 = 0 THEN 404 ELSE 200 END AS http_status, k % 2 = 0 AS scrolls, k, CASE WHEN k % 3 = 0 THEN 'icerik_tasmasi' WHEN k % 3 = 1 THEN 'ust_uste_binme' END AS kind, CAST(k * 3 AS INT) AS y, CASE WHEN k % 4 = 2 THEN CAST(k * 2 AS INT) END AS wy FROM (SELECT DISTINCT o_orderkey % 500 AS k FROM orders WHERE o_orderkey % 500 < 450) a, (SELECT 'desktop' AS dv UNION ALL SELECT 'mobile') b"
VERIFIED = f"""p AS ({PENDING}), m AS ({MEASURED}), j AS (SELECT p.*, m.http_status, m.scrolls, m.kind, m.y, m.wy, m.url IS NOT NULL AS seen, CASE p.type WHEN 'overflow' THEN 'icerik_tasmasi' WHEN 'overlap' THEN 'ust_uste_binme' END AS want FROM p LEFT JOIN m ON m.url = p.url AND m.device = p.device),
v AS (SELECT *, coalesce(kind = want, false) AS mine, coalesce(kind = want, false) AND (y0 IS NULL OR y BETWEEN y0 - 200 AND y1 + 200) AS near, wy IS NOT NULL AND (y0 IS NULL OR wy BETWEEN y0 - 200 AND y1 + 200) AS wide FROM j),
ver AS (SELECT *, CASE WHEN source = 'metin' THEN CASE WHEN type = 'yer_tutucu' AND CAST(substr(url, 2) AS INT) % 2 = 0 THEN 'DOGRULANDI' ELSE 'GORULMEDI' END WHEN NOT seen THEN 'ACILAMADI' WHEN source = 'http' THEN CASE WHEN http_status = 200 THEN 'GORULMEDI' ELSE 'DOGRULANDI' END
WHEN want IS NULL THEN 'ELLE' WHEN want = 'icerik_tasmasi' AND NOT scrolls THEN 'GORULMEDI' WHEN want = 'icerik_tasmasi' AND NOT near THEN CASE WHEN wide THEN 'DOGRULANDI' WHEN mine THEN 'GORULMEDI' ELSE 'ELLE' END WHEN near THEN 'DOGRULANDI' ELSE 'GORULMEDI' END AS verdict FROM v)"""


def rel(spark, d, sql):
    for t in ("orders", "lineitem"):
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{d}/{t}.parquet`")
    return spark.sql(sql)


def verified(spark, d, text_check=True):
    m = rel(spark, d, MEASURED).withColumn("defects", F.when(F.col("kind").isNotNull(), F.array(F.struct(F.col("kind").alias("type"), F.col("y").alias("y")))).otherwise(F.array().cast("array<struct<type: string, y: int>>"))).withColumn("widest", F.when(F.col("wy").isNotNull(), F.struct(F.col("wy").alias("y")))).drop("kind", "y", "k", "wy")
    again = rel(spark, d, PENDING).select("url").distinct().where("CAST(substr(url, 2) AS INT) % 2 = 0").withColumn("pattern", F.lit("yer_tutucu"))
    return V.verify_findings(rel(spark, d, PENDING), m, again if text_check else None)


@query("i1_collect_findings", f"WITH {RQ.REC}, p AS ({PENDING}) SELECT source, type, CAST(count(*) AS BIGINT) AS n, count(device) AS with_device FROM (SELECT source, type, device FROM p UNION ALL SELECT 'kod', 'overflow', NULL FROM orders) GROUP BY ALL")
def _(spark, d):
    code = table(spark, d, "orders").select(F.lit("kod").alias("source"), F.lit("overflow").alias("type"))
    return V.collect_findings(rel(spark, d, PENDING).select("source", "type", "device"), code).groupBy("source", "type").agg(F.count("*").alias("n"), F.count("device").alias("with_device"))


@query("i2_certain_findings", f"WITH {RQ.REC} SELECT file, slice, type, substr(arg_min(sample, seq), 1, 200) AS evidence FROM found GROUP BY ALL HAVING count(DISTINCT model) >= 2")
def _(spark, d):
    return V.certain_findings(RQ.found(spark, d))


def finding_pages(spark, d):
    from siteq.functions.urls import safe_name

    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("real"))
    rows = pages.select("page_id", F.when(F.col("page_id") % 4 == 0, F.col("real")).alias("url"), F.when(F.col("page_id") % 4 == 3, "lost").otherwise(safe_name(F.col("real"))).alias("page"))
    return V.resolve_finding_urls(rows, pages.select(F.col("real").alias("url")))


@query("i3_resolve_finding_urls", "SELECT page_id, url FROM pages WHERE page_id % 4 <> 3")
def _(spark, d):
    return finding_pages(spark, d)[0].select("page_id", "url")


@query("i3_unresolved", "SELECT count(*) AS unresolved FROM pages WHERE page_id % 4 = 3")
def _(spark, d):
    return finding_pages(spark, d)[1]


@query("i4_verify_findings", f"WITH {VERIFIED} SELECT seq, source, type, verdict FROM ver")
def _(spark, d):
    return verified(spark, d).select("seq", "source", "type", "verdict")


CAUSES = """(SELECT CASE WHEN l_partkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, l_returnflag AS type, '#s' || l_suppkey % 30 AS selector, 'u' || l_orderkey % 500 AS url, l_quantity AS px,
    CASE WHEN l_linenumber > 2 THEN 'metin ' || l_partkey ELSE '' END AS text, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""
ROOTS = f"SELECT device, type, selector, count(DISTINCT url) AS n_pages, max(px) AS max_px, min(url) AS example, arg_min(text, seq) FILTER (WHERE text <> '') AS text FROM {CAUSES} c GROUP BY ALL"


@query("i5_root_causes", ROOTS)
def _(spark, d):
    return V.root_causes(rel(spark, d, f"SELECT * FROM {CAUSES} c"))


@query("j7_remaining_causes", f"{ROOTS} ORDER BY n_pages DESC, device, type, selector LIMIT 15")
def _(spark, d):
    return V.remaining_causes(rel(spark, d, f"SELECT * FROM {CAUSES} c"))


@query("i4_without_text_check", f"WITH {VERIFIED} SELECT seq, CASE WHEN source = 'metin' THEN 'ELLE' ELSE verdict END AS verdict FROM ver")
def _(spark, d):
    return verified(spark, d, False).select("seq", "verdict")


@query("i6_verdict_crosstab", f"WITH {VERIFIED} SELECT source, type, " + ", ".join(f'count(*) FILTER (WHERE verdict = \'{v}\') AS "{v}"' for v in V.VERDICTS) + ", count(*) AS total FROM ver GROUP BY GROUPING SETS ((source, type), ())")
def _(spark, d):
    return V.verdict_crosstab(verified(spark, d))


@query("i7_scroll_counts", f"WITH {VERIFIED} SELECT source, count(*) FILTER (WHERE scrolls) AS evet, count(*) FILTER (WHERE NOT scrolls) AS hayir FROM ver WHERE scrolls IS NOT NULL GROUP BY source")
def _(spark, d):
    return V.scroll_counts(verified(spark, d))


ID = "substr(md5(source || '|' || type || '|' || device || '|' || url || '|' || coalesce(CAST(y0 AS VARCHAR), '')), 1, 12)"


def identified(spark, d):
    return verified(spark, d).withColumn("id", V.finding_id(*map(F.col, ("source", "type", "device", "url", "y0"))))


@query("j1_finding_id", f"WITH {VERIFIED} SELECT seq, {ID} AS id FROM ver")
def _(spark, d):
    return identified(spark, d).select("seq", "id")


@query("j2_label_sample")
def _(spark, d):
    return V.label_sample(identified(spark, d))


LABELS = f"items AS (SELECT DISTINCT {ID} AS id, CASE verdict WHEN 'ELLE' THEN 'elle' ELSE 'ornek' END AS grp, source, type FROM ver WHERE verdict IN ('ELLE', 'DOGRULANDI') AND source <> 'http'), lab AS (SELECT DISTINCT id, CASE WHEN ascii(substr(id, 1, 1)) % 4 = 0 THEN 'yanlis' WHEN ascii(substr(id, 1, 1)) % 4 = 1 THEN 'emin_degil' ELSE 'gercek' END AS label FROM items)"


def labelled(spark, d):
    items = identified(spark, d).where("verdict IN ('ELLE', 'DOGRULANDI') AND source <> 'http'").select("id", F.when(F.col("verdict") == "ELLE", "elle").otherwise("ornek").alias("grp"), "source", "type").distinct()
    c = F.ascii(F.substring("id", 1, 1)) % 4
    return items, items.select("id", F.when(c == 0, "yanlis").when(c == 1, "emin_degil").otherwise("gercek").alias("label")).distinct()


@query("j3_label_precision", f"WITH {VERIFIED}, {LABELS}, jj AS (SELECT i.*, label FROM items i JOIN lab l ON l.id = i.id), c AS (SELECT grp, source, type, count(*) FILTER (WHERE label = 'gercek') AS \"real\", count(*) FILTER (WHERE label = 'yanlis') AS \"false\", count(*) FILTER (WHERE label = 'emin_degil') AS unsure FROM jj GROUP BY ALL UNION ALL SELECT 'ornek', '', '', count(*) FILTER (WHERE label = 'gercek'), count(*) FILTER (WHERE label = 'yanlis'), count(*) FILTER (WHERE label = 'emin_degil') FROM jj WHERE grp = 'ornek') SELECT *, CASE WHEN \"real\" + \"false\" > 0 THEN \"real\" / (\"real\" + \"false\") END AS rate FROM c")
def _(spark, d):
    return V.label_precision(*labelled(spark, d))


@query("j4_attach_labels", f"WITH {VERIFIED}, {LABELS} SELECT v.seq, v.id, label FROM (SELECT seq, {ID} AS id FROM ver) v LEFT JOIN lab l ON l.id = v.id")
def _(spark, d):
    return V.attach_labels(identified(spark, d).select("seq", "id"), labelled(spark, d)[1])


SCROLL = "SELECT 'u' || o_orderkey AS url, CASE WHEN o_custkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, o_orderkey % 3 = 0 AS scrolls, 1000 + o_custkey % 90 AS scroll, 1024 AS client FROM orders"
AFTER = "SELECT 'u' || o_orderkey AS url, CASE WHEN o_custkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device, o_orderkey % 4 = 0 AS scrolls, 1000 + o_custkey % 70 AS scroll, 1024 AS client FROM orders WHERE o_orderkey % 11 > 0"
STATES = f"b AS ({SCROLL}), a AS ({AFTER}), st AS (SELECT b.url, b.device, CASE WHEN b.scrolls AND NOT a.scrolls THEN 'DUZELDI' WHEN b.scrolls THEN 'KALDI' ELSE 'YENI_BOZULDU' END AS state, greatest(0, b.scroll - b.client) AS px_before, greatest(0, a.scroll - a.client) AS px_after FROM b JOIN a ON a.url = b.url AND a.device = b.device WHERE b.scrolls OR a.scrolls)"


@query("j5_scrolling_pages", f"SELECT DISTINCT url FROM ({SCROLL}) x WHERE scrolls")
def _(spark, d):
    return V.scrolling_pages(rel(spark, d, SCROLL))


@query("j6_before_after", f"WITH {STATES} SELECT * FROM st")
def _(spark, d):
    return V.before_after(rel(spark, d, SCROLL), rel(spark, d, AFTER))


@query("j7_fix_summary", f"WITH {STATES}, s AS (SELECT device, count(*) FILTER (WHERE state = 'DUZELDI') AS fixed, count(*) FILTER (WHERE state = 'KALDI') AS left_over, count(*) FILTER (WHERE state = 'YENI_BOZULDU') AS new_broken FROM st GROUP BY device) SELECT *, fixed / (fixed + left_over) AS rate FROM s")
def _(spark, d):
    return V.fix_summary(V.before_after(rel(spark, d, SCROLL), rel(spark, d, AFTER)))


ELEMENTS = "SELECT CASE WHEN l_suppkey % 40 = 0 THEN 'body' ELSE '.c' || l_suppkey % 40 END AS selector, CASE l_suppkey % 5 WHEN 0 THEN 'tablo' WHEN 1 THEN 'metin' WHEN 2 THEN 'gomulu' WHEN 3 THEN 'onbicimli' ELSE 'kutu' END AS kind, l_quantity > 49.5 AS nowrap, l_discount > 0.099 AS flex, 'u' || l_orderkey % 700 AS url FROM lineitem"
BODY = "CASE kind WHEN 'tablo' THEN 'display: block; max-width: 100%; overflow-x: auto' WHEN 'onbicimli' THEN 'max-width: 100%; overflow-x: auto' WHEN 'metin' THEN 'overflow-wrap: anywhere' || CASE WHEN nowrap THEN '; white-space: normal' ELSE '' END || CASE WHEN flex THEN '; min-width: 0' ELSE '' END ELSE 'max-width: 100%; box-sizing: border-box' END"


@query("j8_fix_rules", f"WITH e AS ({ELEMENTS}), r AS (SELECT selector, kind, bool_or(nowrap) AS nowrap, bool_or(flex) AS flex, count(DISTINCT url) AS n_pages FROM e WHERE selector <> 'body' GROUP BY ALL) SELECT *, {BODY} AS body FROM r")
def _(spark, d):
    return V.fix_rules(rel(spark, d, ELEMENTS))


RULES = "SELECT '.c' || o_orderkey AS selector, CASE WHEN o_orderkey % 2 = 0 THEN 'metin' ELSE 'kutu' END AS kind, o_orderkey % 3 = 0 AS nowrap, false AS flex, o_orderkey % 7 = 0 AS important FROM orders WHERE o_orderkey % 5 < 3"
DERIVED = "SELECT '.c' || o_orderkey AS selector, CASE WHEN o_orderkey % 4 = 0 THEN 'metin' ELSE 'kutu' END AS kind, o_orderkey % 6 = 0 AS nowrap, o_orderkey % 8 = 0 AS flex FROM orders WHERE o_orderkey % 5 > 1"


@query("j9_update_rules", f"WITH o AS ({RULES}), n AS ({DERIVED}), j AS (SELECT coalesce(o.selector, n.selector) AS selector, o.kind AS ok, n.kind AS nk, coalesce(o.nowrap, false) AS onw, coalesce(n.nowrap, false) AS nnw, coalesce(o.flex, false) AS ofl, coalesce(n.flex, false) AS nfl, o.important FROM o FULL JOIN n ON o.selector = n.selector) SELECT selector, coalesce(nk, ok) AS kind, onw OR nnw AS nowrap, ofl OR nfl AS flex, CASE WHEN ok IS NULL OR coalesce(ok <> nk, false) THEN false WHEN nk IS NOT NULL AND NOT ((nnw AND NOT onw) OR (nfl AND NOT ofl)) THEN true ELSE important END AS important FROM j")
def _(spark, d):
    return V.update_rules(rel(spark, d, RULES), rel(spark, d, DERIVED))


@query("j10_drop_ineffective", f"WITH e AS ({ELEMENTS}) SELECT DISTINCT selector FROM e WHERE CAST(substr(url, 2) AS INT) < 6")
def _(spark, d):
    return V.drop_ineffective(rel(spark, d, ELEMENTS), rel(spark, d, ELEMENTS).where("CAST(substr(url, 2) AS INT) < 6"))


@query("j11_round_table", f"WITH b AS ({SCROLL}), r AS (SELECT url, device, scrolls, 1 AS round FROM ({AFTER}) x UNION ALL SELECT url, device, false, 2 FROM ({AFTER}) y) SELECT round, r.device, count(*) AS measured, count(*) FILTER (WHERE r.scrolls) AS scrolling, count(*) FILTER (WHERE b.scrolls AND NOT r.scrolls) AS fixed, count(*) FILTER (WHERE NOT b.scrolls AND r.scrolls) AS new_broken FROM r JOIN b ON b.url = r.url AND b.device = r.device GROUP BY ALL")
def _(spark, d):
    a = rel(spark, d, AFTER).select("url", "device", "scrolls")
    rounds = a.withColumn("round", F.lit(1)).union(a.withColumns({"scrolls": F.lit(False), "round": F.lit(2)}))
    return V.round_table(rounds, rel(spark, d, SCROLL))
