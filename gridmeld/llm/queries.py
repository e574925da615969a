"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, quality
from .common import held_out
from .decontaminate import contaminated
from .extract import extract
from .licenses import scan_licenses
from .lines import line_dedup
from .mixing import mix_plan
from .neardup import near_duplicates
from .neighbours import nearest
from .periodic import find_runs
from .pii import KINDS, find_pii
from .spelling import spelling_variants, tokens, vocabulary, without_letter
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    base = listed(F.filter("pii", lambda x: x["base"]))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, items.select("item_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    return quality.score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_chars=40, min_docs=5).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _repeated(doc_id: Column, text: Column) -> Column:
    """The text as op11 has it: where crc32(doc_id) says so, its words from a place on
    repeat a stretch of them; a null id changes nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    # each name stands for a value that is worked out once
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), lambda w: F.when(F.size(w) > 0, changed(w)))
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(F.get(words, F.lit(0)), text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeated(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs, min_words=24, min_repeats=3)
    more = lambda x, b: b["length"].isNull() | (x["length"] * b["period"] > b["length"] * x["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, x: F.when(more(x, b), x).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.expr("1000L * best.length div best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.char_length("token") >= 5)
    h = F.coalesce(F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("token"))), F.lit(1))
    changed = F.when(h % 97 == 0, without_letter(F.col("token"), (h % F.char_length("token")).cast("int"))).otherwise(F.col("token"))
    return spelling_variants(vocabulary(found.select(changed.alias("token")), min_chars=5, min_count=3))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licenses", lambda x: x["kind"] == "base")
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = lambda f: f(F.transform(base, lambda x: x["start"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), starts(F.array_min).alias("first_word"), starts(F.array_max).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("licenses")).alias("labels"), "score",
        F.array_join(F.transform("expressions", lambda x: F.concat(x["expression"], F.lit(" -> "), x["obligation"])), "; ").alias("expressions"),
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_license_scans": op13_license_scans,
}

_STRIP = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The table of crc32 by its rule, as the list t.t.
_CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    """crc32 of a text of letters up to U+00FF, by the table t.t."""
    each = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (CAST(unicode(c) AS BIGINT) >> 6), 128 + (CAST(unicode(c) AS BIGINT) & 63)] END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {each}), lambda c, b: xor(c >> 8, t.t[xor(c, b) % 256 + 1])), 4294967295)"


ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        m AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
            CASE WHEN m.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN m.first <> page_id THEN m.first END AS refers_to
        FROM p LEFT JOIN m ON p.html = m.html AND p.n >= 1000""",
    "op6_mixing": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY source),
        w AS (
            SELECT *, CAST(CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS lim FROM s),
        v AS (
            SELECT a.source, a.lim / a.weight AS fill,
                (SELECT sum(source_size) FROM w) * CAST(1.5 AS DOUBLE) - coalesce(sum(b.lim), 0) AS rest,
                (SELECT sum(weight) FROM w) - coalesce(sum(b.weight), 0) AS open
            FROM w a LEFT JOIN w b ON (b.lim / b.weight, b.k) < (a.lim / a.weight, a.k) GROUP BY ALL),
        lv AS (SELECT arg_min(rest / open, fill) AS level FROM v WHERE fill > rest / open),
        t AS (
            SELECT w.source, source_size, CASE WHEN level IS NULL OR lim / weight <= level THEN lim ELSE level * weight END AS target,
                CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
            FROM w CROSS JOIN lv),
        r AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(size * (floor(u + rate * k) - floor(u + rate * (k - 1))) AS BIGINT) AS taken FROM r""",
    "op9_near_duplicates": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        g AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id,
            w.doc_id = least(w.doc_id, coalesce(c.least, w.doc_id)) AS kept
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id""",
    "op10_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
            FROM documents),
        k AS (
            SELECT *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (
            SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        f AS (
            SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op11_periodic_runs": f"""
        WITH {_CRC_TABLE},
        d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, t),
        m AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
        x AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
            FROM m),
        v AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM x),
        g AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 16], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM x WHERE n >= 24)),
        c AS (SELECT DISTINCT a.doc_id, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i WHERE 3 * (b.i - a.i) <= a.n),
        e AS (
            SELECT c.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY c.doc_id, q ORDER BY a.i) AS k
            FROM c JOIN v a ON a.doc_id = c.doc_id JOIN v b ON b.doc_id = a.doc_id AND b.i = a.i + q AND b.word = a.word),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY doc_id, q, k),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM r),
        l AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
                max(start) FILTER (WHERE place = 1) AS start, max(length) FILTER (WHERE place = 1) AS length, max(period) FILTER (WHERE place = 1) AS period
            FROM o GROUP BY doc_id),
        z AS (SELECT DISTINCT v.doc_id, v.i FROM v JOIN r ON r.doc_id = v.doc_id AND v.i >= r.start + r.period AND v.i < r.start + r.length),
        k AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS kept FROM v ANTI JOIN z ON z.doc_id = v.doc_id AND z.i = v.i GROUP BY v.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
            sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        k AS (
            SELECT doc_id, translate(w, {_UPPER}) AS w, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL),
        h AS (SELECT w, n, {_crc("doc_id || ':' || w")} AS h FROM k, t),
        c AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        s AS (SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
        p AS (
            SELECT x.word, y.word AS near FROM s x JOIN s y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT s.word, v.word FROM s JOIN v ON v.word = s.a || s.b
            UNION SELECT v.word, s.word FROM s JOIN v ON v.word = s.a || s.b),
        o AS (SELECT p.word, near, v.n, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) AS place, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN v ON v.word = p.near),
        f AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.n >= 2 * v.n THEN near END AS form, CASE WHEN o.n >= 2 * v.n THEN o.n END AS form_n
            FROM v LEFT JOIN o ON o.word = v.word AND place = 1),
        r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL""",
}
