"""Queries of the text functions and of structural ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import segment
from ..sources import paged
from . import base
from .base import SQL_CHUNKS, sql_fold, sql_words, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.fold("text").alias("folded"))


@query(f"SELECT doc_id, {sql_fold('text', True)} AS folded FROM documents")
def fold_drop_digits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.fold("text", True).alias("folded"))


_JUNKED = "(SELECT doc_id, CAST(n - 1 AS INT) AS line_no, CASE WHEN (doc_id + n) % 7 = 0 THEN 'ЖшЩ ' || line WHEN (doc_id + n) % 11 = 0 THEN 'ṣḍ ' || line ELSE line END AS line FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
_SQL_RATIO = "CASE WHEN len(regexp_replace(line, '\\s+', '', 'g')) = 0 THEN 0.0 ELSE len(regexp_replace(regexp_replace(line, '\\s+', '', 'g'), '[\\x{0000}-\\x{024F}\\x{0600}-\\x{06FF}ʾʿ‘’“”—–…·]', '', 'g')) / CAST(len(regexp_replace(line, '\\s+', '', 'g')) AS DOUBLE) END"


def _junked(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.col("doc_id") + F.col("line_no") + 1
    line = F.when(n % 7 == 0, F.concat(F.lit("ЖшЩ "), "line")).when(n % 11 == 0, F.concat(F.lit("ṣḍ "), "line")).otherwise(F.col("line"))
    return lines.select("doc_id", "line_no", line.alias("line"))


@query(f"SELECT doc_id, line_no, round({_SQL_RATIO}, 6) AS ratio FROM {_JUNKED}")
def junk_ratio_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _junked(spark, sf).select("doc_id", "line_no", F.round(text.junk_ratio("line"), 6).alias("ratio"))


@query(f"SELECT doc_id, line_no, line FROM {_JUNKED} WHERE {_SQL_RATIO} < 0.30")
def strip_junk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _junked(spark, sf).filter(text.junk_ratio("line") < rules.JUNK_LINE)


@query("SELECT page_id, trim(regexp_replace(regexp_replace(chr(57345) || '  ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(7), '[\\x{E000}-\\x{F8FF}\\x{0000}-\\x{0008}\\x{000B}-\\x{001F}\\x{007F}-\\x{009F}\\x{FFF0}-\\x{FFFF}]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages")
def display_titles(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("\x07"))
    return table(spark, sf, "pages").select("page_id", text.display_title(raw).alias("title"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    f"SELECT page_id, slug, printf('%03d-%s%s', page_id % 160, slug, CASE WHEN page_id % 3 + 1 > 1 THEN printf('-p%d', page_id % 3) ELSE '' END) AS chunk_id FROM (SELECT page_id, left(regexp_replace(regexp_replace({sql_fold(_TITLE, True)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM pages)"
)
def slugs_and_ids(spark: SparkSession, sf: str) -> DataFrame:
    titled = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.col("page_id") % 160).cast("int").alias("page"), (F.col("page_id") % 3).cast("int").alias("part"))
    return titled.select("page_id", text.slugify("title").alias("slug"), text.chunk_id(F.col("page"), F.col("title"), F.col("part"), F.col("part") + 1).alias("chunk_id"))


_ALIAS_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in base.ALIASES.items())


@query(f"""
WITH q AS (SELECT item_id, {sql_fold("text")} AS folded FROM benchmark), t AS (SELECT item_id, folded, string_split(folded, ' ') AS ts FROM q),
x AS (SELECT item_id, unnest(generate_series(1, len(ts))) AS i, unnest(ts) AS w, ts FROM t), a(w, target) AS (VALUES {_ALIAS_ROWS}),
e AS (SELECT item_id, target, min(i) AS i FROM x JOIN a USING (w) WHERE NOT list_contains(ts, target) GROUP BY ALL)
SELECT t.item_id, t.folded || coalesce(' ' || (SELECT string_agg(target, ' ' ORDER BY i) FROM e WHERE e.item_id = t.item_id), '') AS expanded FROM t
""")
def alias_expand(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", text.expand_aliases("text", base.ALIASES).alias("expanded"))


_LINES = "(SELECT doc_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) AS INT) AS k, line FROM (SELECT doc_id, n, trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS line FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE line <> '')"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, CAST(k // 4 + 1 AS INT) AS page, line FROM {_LINES} WHERE NOT (k % 4 = 0 AND line = CAST(k // 4 + 1 AS VARCHAR)) AND {_SQL_RATIO} < 0.30")
def line_stream(spark: SparkSession, sf: str) -> DataFrame:
    return paged.line_stream(paged.text_lines(table(spark, sf, "documents"), 4))


@query("SELECT doc_id, CAST(doc_id % 5 AS INT) AS page_idx FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def verify_page_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Every third page has another number first, every seventh is blank."""
    page = (F.col("doc_id") % 5).cast("int")
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("  \n ")).when(F.col("doc_id") % 3 == 0, F.concat((page + 2).cast("string"), F.lit("\n"), F.col("text"))).otherwise(F.concat((page + 1).cast("string"), F.lit("\n"), F.col("text")))
    pages = table(spark, sf, "documents").select("doc_id", page.alias("page_idx"), body.alias("text"))
    return paged.verify_page_offset(pages, paged.page_lines(pages))


@query(f"""
WITH l AS (SELECT doc_id, k // 8 AS page_idx, k % 8 AS line_no, CASE WHEN k % 3 = 2 THEN CAST(k % 997 AS VARCHAR) WHEN k % 8 = 1 THEN 'Contents' ELSE line END AS line FROM {_LINES}),
u AS (SELECT *, regexp_matches(line, '^\\d{{1,3}}$') AS num FROM l WHERE NOT (line_no = 0 AND regexp_matches(line, '^\\d{{1,3}}$')) AND lower(line) <> 'contents'),
i AS (SELECT *, coalesce(sum(CAST(num AS INT)) OVER (PARTITION BY doc_id, page_idx ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM u),
g AS (SELECT doc_id, page_idx, island, string_agg(CASE WHEN NOT num THEN line END, ' ' ORDER BY line_no) AS title, max(CASE WHEN num THEN CAST(line AS INT) END) AS printed FROM i GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, island) - 1 AS INT) AS ord, title, printed FROM g WHERE title IS NOT NULL AND printed IS NOT NULL
""")
def toc_islands(spark: SparkSession, sf: str) -> DataFrame:
    lines = paged.text_lines(table(spark, sf, "documents")).withColumnRenamed("line_no", "k")
    said = F.when(F.col("k") % 3 == 2, (F.col("k") % 997).cast("string")).when(F.col("k") % 8 == 1, F.lit("Contents")).otherwise(F.col("line"))
    return paged.parse_toc(lines.select("doc_id", F.floor(F.col("k") / 8).cast("int").alias("page_idx"), (F.col("k") % 8).cast("int").alias("line_no"), said.alias("line")))


def _stream_and_entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines by pages of 4; every third line is an entry, every ninth of those one that no line matches."""
    stream = paged.text_stream(table(spark, sf, "documents"), 4)
    titles = stream.filter("pos % 3 = 0").select("doc_id", (F.col("pos") / 3).cast("int").alias("ord"), F.when(F.col("pos") % 27 == 6, F.lit("zzz no such heading here")).otherwise(F.concat(F.left("line", F.lit(40)), F.lit(" 7"))).alias("title"), F.col("page").alias("printed"))
    return stream, titles


_ENTRIES = f"""
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, CAST(k // 4 + 1 AS INT) AS page, line FROM {_LINES} WHERE NOT (k % 4 = 0 AND line = CAST(k // 4 + 1 AS VARCHAR)) AND {_SQL_RATIO} < 0.30),
en AS (SELECT doc_id, CAST(pos // 3 AS INT) AS ord, CASE WHEN pos % 27 = 6 THEN 'zzz no such heading here' ELSE left(line, 40) || ' 7' END AS title, page AS printed FROM s WHERE pos % 3 = 0),
sf AS (SELECT doc_id, pos, page, {sql_fold("line", True)} AS fl FROM s), ef AS (SELECT doc_id, ord, title, printed, {sql_fold("title", True)} AS ft FROM en),
m AS (SELECT doc_id, ord, pos FROM sf JOIN ef USING (doc_id) WHERE fl <> '' AND ft <> '' AND (starts_with(fl, ft) OR starts_with(ft, fl) OR (len(string_split(ft, ' ')) >= 3 AND starts_with(fl, array_to_string(string_split(ft, ' ')[1:3], ' ')) AND abs(len(fl) - len(ft)) <= 12))),
r AS (SELECT doc_id, -1 AS ord, CAST(-1 AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT doc_id FROM en)
  UNION ALL SELECT r.doc_id, r.ord + 1, coalesce(n.pos, r.cur), n.pos FROM r JOIN en e ON e.doc_id = r.doc_id AND e.ord = r.ord + 1
  LEFT JOIN LATERAL (SELECT min(m.pos) AS pos FROM m WHERE m.doc_id = r.doc_id AND m.ord = r.ord + 1 AND m.pos > r.cur) n ON true)
"""


@query(f"WITH RECURSIVE {_ENTRIES} SELECT r.doc_id, r.ord, en.title, r.hit AS pos, sf.page FROM r JOIN en USING (doc_id, ord) LEFT JOIN sf ON sf.doc_id = r.doc_id AND sf.pos = r.hit WHERE r.ord >= 0")
def locate_headings(spark: SparkSession, sf: str) -> DataFrame:
    located, unlocated = segment.locate_headings(*_stream_and_entries(spark, sf))
    none = unlocated.withColumn("pos", F.lit(None).cast("long")).withColumn("page", F.lit(None).cast("int"))
    return located.unionByName(none).select("doc_id", "ord", "title", "pos", "page")


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches({sql_fold('section')}, '{p}') THEN '{label}'" for p, label in base.CATEGORIES) + " ELSE 'general' END"


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, {_CATEGORY} AS category FROM c")
def classify_sections(spark: SparkSession, sf: str) -> DataFrame:
    return base.chunks(spark, sf).select("chunk_id", text.classify_category("section", base.CATEGORIES).alias("category"))


@query(f"WITH {SQL_CHUNKS}, r(lo, hi, name) AS (VALUES {', '.join(map(str, rules.COLLECTIONS))}) SELECT chunk_id, coalesce(name, CASE WHEN page_start < 6 THEN 'front-matter' ELSE 'back-matter' END) AS kitab FROM c LEFT JOIN r ON page_start BETWEEN lo AND hi")
def assign_collection_range(spark: SparkSession, sf: str) -> DataFrame:
    return base.chunks(spark, sf).select("chunk_id", text.assign_collection("page_start").alias("kitab"))


@query(f"WITH {SQL_CHUNKS}, g AS (SELECT {sql_fold('section')} AS t, 'g' || CAST(min(doc_id) % 5 AS VARCHAR) AS group_id FROM c WHERE doc_id % 4 = 0 GROUP BY 1) SELECT chunk_id, group_id FROM c LEFT JOIN g ON g.t = {sql_fold('section')}")
def groups_left_join(spark: SparkSession, sf: str) -> DataFrame:
    titled = base.chunks(spark, sf).withColumn("t", text.fold("section"))
    groups = titled.filter("doc_id % 4 = 0").groupBy("t").agg(F.concat(F.lit("g"), (F.min("doc_id") % 5).cast("string")).alias("group_id"))
    return titled.join(groups, "t", "left").select("chunk_id", "group_id")


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, k, line FROM {_LINES}),
p AS (SELECT doc_id, k, len(line) + 1 AS size, 0 AS part FROM l WHERE k = 0
  UNION ALL SELECT l.doc_id, l.k, CASE WHEN p.size + len(l.line) > 2500 THEN len(l.line) + 1 ELSE p.size + len(l.line) + 1 END, CASE WHEN p.size + len(l.line) > 2500 THEN p.part + 1 ELSE p.part END FROM p JOIN l ON l.doc_id = p.doc_id AND l.k = p.k + 1)
SELECT p.doc_id, CAST(part AS INT) AS part, CAST(max(max(part)) OVER (PARTITION BY p.doc_id) + 1 AS INT) AS n_parts, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY p.k)) AS body_sha FROM p JOIN l USING (doc_id, k) GROUP BY p.doc_id, part
""")
def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    lines = paged.text_lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").cast("long").alias("pos"), F.lit(1).alias("page"), "line")
    parts = segment.split_sections(lines, ["doc_id"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return parts.groupBy("doc_id", "part", "n_parts").agg(F.count("*").alias("n_lines"), F.sha2(body.cast("binary"), 256).alias("body_sha"))


_SECTION_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches({sql_fold('title')}, '{p}') THEN '{label}'" for p, label in rules.CATEGORIES) + f" ELSE '{rules.NO_CATEGORY}' END"
_SECTION_COLLECTION = "CASE " + " ".join(f"WHEN start_page BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in rules.COLLECTIONS) + f" WHEN start_page < {rules.COLLECTIONS[0][0]} THEN '{rules.BEFORE_COLLECTIONS}' ELSE '{rules.AFTER_COLLECTIONS}' END"


@query(f"""WITH RECURSIVE {_ENTRIES},
loc AS (SELECT r.doc_id, r.ord, en.title, r.hit AS pos, sf.page AS start_page FROM r JOIN en USING (doc_id, ord) JOIN sf ON sf.doc_id = r.doc_id AND sf.pos = r.hit WHERE r.ord >= 0),
sl AS MATERIALIZED (SELECT s.doc_id, s.pos, s.page, s.line, l.ord, l.title, l.start_page, row_number() OVER (PARTITION BY s.doc_id, l.ord ORDER BY s.pos) - 1 AS k FROM s ASOF JOIN loc l ON s.doc_id = l.doc_id AND s.pos >= l.pos),
pt AS (SELECT doc_id, ord, k, len(line) + 1 AS size, 0 AS part FROM sl WHERE k = 0
  UNION ALL SELECT x.doc_id, x.ord, x.k, CASE WHEN pt.size + len(x.line) > {rules.CHUNK_CHARS} THEN len(x.line) + 1 ELSE pt.size + len(x.line) + 1 END, CASE WHEN pt.size + len(x.line) > {rules.CHUNK_CHARS} THEN pt.part + 1 ELSE pt.part END FROM pt JOIN sl x ON x.doc_id = pt.doc_id AND x.ord = pt.ord AND x.k = pt.k + 1),
bd AS (SELECT sl.doc_id, sl.ord, title, start_page, part, min(page) AS page_start, max(page) AS page_end, string_agg(line, chr(10) ORDER BY pos) AS body FROM sl JOIN pt USING (doc_id, ord, k) GROUP BY ALL),
gr AS (SELECT {sql_fold('title')} AS t, 'g' || CAST(min(doc_id) % 5 AS VARCHAR) AS group_id, CASE WHEN min(doc_id) % 2 = 0 THEN 'affirmative' ELSE 'negative' END AS polarity FROM loc WHERE ord % 4 = 0 GROUP BY 1),
ck AS (SELECT *, CASE WHEN part = 0 THEN body ELSE title || chr(10) || body END AS raw, max(part) OVER (PARTITION BY doc_id, ord) + 1 AS n_parts, row_number() OVER (ORDER BY doc_id, ord, part) - 1 AS ordinal, left(regexp_replace(regexp_replace({sql_fold('title', True)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM bd)
SELECT printf('%03d-%s%s', start_page, slug, CASE WHEN n_parts > 1 THEN printf('-p%d', part) ELSE '' END) AS chunk_id, doc_id, {_SECTION_COLLECTION} AS collection, title AS section, {_SECTION_CATEGORY} AS category, group_id, polarity, page_start, page_end, CAST(part AS INT) AS part, CAST(n_parts AS INT) AS n_parts, ordinal, sha256(raw) AS raw_sha, sha256({sql_fold('raw')}) AS folded_sha
FROM ck LEFT JOIN gr ON gr.t = {sql_fold('title')}""")
def build_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table of the located sections; every fourth title of a document names a group."""
    stream, entries = _stream_and_entries(spark, sf)
    located, _ = segment.locate_headings(stream, entries)
    named = located.filter("ord % 4 = 0").select(text.fold("title").alias("title_folded"), "doc_id").groupBy("title_folded").agg(F.min("doc_id").alias("d"))
    groups = named.select("title_folded", F.concat(F.lit("g"), (F.col("d") % 5).cast("string")).alias("group_id"), F.when(F.col("d") % 2 == 0, "affirmative").otherwise("negative").alias("polarity"))
    rows = segment.build_chunks(stream, located, groups)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("chunk_id", "doc_id", "collection", "section", "category", "group_id", "polarity", "page_start", "page_end", "part", "n_parts", "ordinal", digest("text_raw").alias("raw_sha"), digest("text_folded").alias("folded_sha"))


@query("SELECT source AS collection, lang AS category, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang))")
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return segment.corpus_profile(table(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("lang").alias("category")))


@query(f"WITH {SQL_CHUNKS} SELECT collection AS group_id, count(*) AS n, min(page_start) AS first_page, max(page_end) AS last_page, count_if(toxic = 0) AS affirmative, count_if(toxic = 1) AS negative FROM c JOIN labels USING (doc_id) GROUP BY 1")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, "affirmative").when(F.col("toxic") == 1, "negative").alias("polarity"))
    return segment.group_summary(base.chunks(spark, sf).withColumnRenamed("collection", "group_id").join(labels, "doc_id"))


@query("SELECT source AS title_folded, source AS group_id, CAST(p AS VARCHAR) AS polarity FROM (SELECT DISTINCT source FROM documents), (VALUES (0), (1), (2)) v(p) EXCEPT SELECT source, source, CAST(toxic AS VARCHAR) FROM documents JOIN labels USING (doc_id)")
def missing_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Declared (source, polarity) members that no labelled document carries; a third polarity is declared that none has."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("section"), F.col("source").alias("group_id"))
    declared = docs.select(F.col("section").alias("title_folded"), "group_id").distinct().select("title_folded", "group_id", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("polarity"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("polarity")), "doc_id")
    return segment.missing_group_members(rows, declared)


@query(f"WITH w AS (SELECT doc_id, {sql_words('text', rules.LABEL_STOP_WORDS)} AS ws FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(ws)), ' ') AS terms FROM w")
def content_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.content_terms("text")), " ").alias("terms"))


def sql_stem(w: str) -> str:
    cut = "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') AND len({w}) - {len(s)} >= 4 THEN left({w}, len({w}) - {len(s)})" for s in rules.SUFFIXES) + f" ELSE {w} END"
    return f"left(regexp_replace({cut}, 'e+$', ''), 5)"


@query(f"WITH w AS (SELECT doc_id, {sql_words('text', rules.STOP_WORDS)} AS ws FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(ws, lambda w: {sql_stem('w')}))), ' ') AS words FROM w")
def content_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.content_words("text")), " ").alias("words"))


@query(f"SELECT DISTINCT w AS word, {sql_stem('w')} AS stem FROM (SELECT unnest(regexp_extract_all({sql_fold('text')}, '[a-z]+')) AS w FROM conversations)")
def stem_words(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(text.fold("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"))
