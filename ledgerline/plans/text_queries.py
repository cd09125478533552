"""Catalog: text search, inventories, correspondence, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import joins as J
from ledgerline.sources.tables import fragments, numbered_lines, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NEEDLES = ["the", "token", "password", "idiot", "zzzz"]


@query("""
SELECT needle, lang, CAST(sum(len(regexp_extract_all(lower(text), needle))) AS BIGINT) AS hits, CAST(count_if(contains(lower(text), needle)) AS BIGINT) AS documents, needle='the' AS control
FROM documents, (SELECT unnest(['the','token','password','idiot','zzzz']) AS needle) GROUP BY ALL
""")
def term_hits_with_controls(spark, d):
    """Needles (a positive control among them) are a few literals, so each text is scanned once for all."""
    low = F.lower("text")
    hits = F.explode(F.array(*[F.struct(F.lit(n).alias("needle"), F.regexp_count(low, F.lit(n)).alias("hits")) for n in _NEEDLES]))
    g = table(spark, d, "documents").select("lang", hits.alias("h")).groupBy(F.col("h.needle").alias("needle"), "lang")
    return g.agg(F.sum("h.hits").alias("hits"), F.count_if(F.col("h.hits") > 0).alias("documents")).withColumn("control", F.col("needle") == "the")


@query("""
SELECT w AS token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]*tion[a-z]*')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY w
""")
def token_sweep(spark, d):
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]*tion[a-z]*"), F.lit(0)))
    return table(spark, d, "documents").select(tokens.alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, CASE WHEN contains(lower(html),'<script') THEN 'code' ELSE 'word' END AS family, CASE WHEN contains(lower(html),'<script') THEN '<script' WHEN contains(lower(html),'<!--') THEN '<!--' ELSE 'login' END AS needle
FROM pages WHERE contains(lower(html),'<script') OR contains(lower(html),'<!--') OR contains(lower(html),'login')
""")
def needle_scan(spark, d):
    needles = [("code", "<script"), ("word", "<!--"), ("word", "login")]
    first = F.coalesce(*[F.when(F.lower("html").contains(n), F.struct(F.lit(f).alias("family"), F.lit(n).alias("needle"))) for f, n in needles])
    return table(spark, d, "pages").select("page_id", first.alias("hit")).where("hit is not null").select("page_id", "hit.family", "hit.needle")


@query("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text),'[a-z]{4,}')) AS ws FROM documents),
b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text),'[a-z]{4,}')) AS ws FROM benchmark),
a1 AS (SELECT doc_id, len(ws) AS na, unnest(ws) AS x FROM w), b1 AS (SELECT item_id, len(ws) AS nb, unnest(ws) AS x FROM b),
p AS (SELECT item_id, doc_id, CAST(count(*) AS BIGINT) AS shared, count(*)/CAST(min(least(na,nb)) AS DOUBLE) AS ov FROM b1 JOIN a1 USING (x) GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ov DESC, item_id) AS n, lead(ov) OVER (PARTITION BY doc_id ORDER BY ov DESC, item_id) AS nx FROM p)
SELECT doc_id, item_id, shared, round(ov,6) AS overlap FROM r WHERE n=1 AND ov>=0.7 AND ov-coalesce(nx,0)>=0.15
""")
def page_correspondence(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    docs, items = (table(spark, d, t).select(k, words.alias("words")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    pairs = J.overlaps(docs, "doc_id", items, "item_id", "words", 0.7 - 0.15)
    return J.best_match(pairs, "doc_id", "item_id", "overlap", 0.7, 0.15).select("doc_id", "item_id", "shared", F.round("overlap", 6).alias("overlap"))


@query("""
SELECT fragment, CAST(count(*) AS BIGINT) AS pages, array_to_string(list(CAST(page_id AS VARCHAR) ORDER BY page_id),',') AS page_list
FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html,'<a href="([^"]*)"',1))) AS fragment FROM pages) GROUP BY fragment
""")
def fragment_inventory(spark, d):
    f = fragments(table(spark, d, "pages"), "page_id", "html", '<a href="([^"]*)"')
    ids = F.transform(F.array_sort(F.collect_set("page_id")), lambda x: x.cast("string"))
    return f.groupBy("fragment").agg(F.count("*").alias("pages"), F.array_join(ids, ",").alias("page_list"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(replace(lower(regexp_replace(text,'<[^>]+>','','g')),'&amp;','and'),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') AS slug,
 replace(replace(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&#x27;') AS escaped FROM documents
""")
def slug_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"), X.escape_html(F.col("text")).alias("escaped"))


@query()
def markdown_render(spark, d):
    from ledgerline.functions.markdown import markdown_html, with_heading_ids

    html = table(spark, d, "documents").select("doc_id", markdown_html("text").alias("html"))
    return html.select("doc_id", with_heading_ids(F.col("html")).alias("html"))


@query(r"""
WITH x AS (SELECT doc_id, chr(32) || text || 'e' || chr(769) || ' ' || chr(8220) || 'q' || chr(8221) AS t FROM documents)
SELECT doc_id, regexp_replace(replace(replace(trim(nfc_normalize(t), chr(32)||chr(9)||chr(10)||chr(13)),chr(8220),'"'),chr(8221),'"'),'[ \t\n\r]+',' ','g') AS text,
 CAST(len(string_split(trim(t),'.')) AS BIGINT) AS parts, starts_with(trim(t),'The') AS the FROM x
""")
def normalize_text(spark, d):
    t = F.concat(F.lit(" "), "text", F.lit("é “q”"))
    x = table(spark, d, "documents").where("text is not null").select("doc_id", t.alias("t"))
    return x.select("doc_id", X.squeeze(X.straight_quotes(X.strip(X.nfc("t")))).alias("text"), F.size(F.split(F.trim("t"), r"\.", -1)).cast("long").alias("parts"), F.trim("t").startswith("The").alias("the"))


@query(r"""
WITH r AS (SELECT doc_id, 'see D' || (doc_id % 7) || ', xD3 and D' || (doc_id % 13) || '.' AS t FROM documents),
w AS (SELECT doc_id, unnest(string_split(t,' ')) AS w, generate_subscripts(string_split(t,' '),1) AS i FROM r),
l AS (SELECT doc_id, i, CASE WHEN regexp_matches(w,'^D[0-9]+[,.]?$') AND TRY_CAST(regexp_extract(w,'^D([0-9]+)',1) AS BIGINT) IN (SELECT doc_id FROM labels) THEN regexp_replace(w,'^(D[0-9]+)','<a href="#\1">\1</a>') ELSE w END AS w FROM w)
SELECT doc_id, string_agg(w,' ' ORDER BY i) AS linked FROM l GROUP BY doc_id
""")
def link_known_ids(spark, d):
    """Marks become links only where the table has the id: the few that stand in a text are looked up, the table is not copied."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("see D"), (F.col("doc_id") % 7).cast("string"), F.lit(", xD3 and D"), (F.col("doc_id") % 13).cast("string"), F.lit(".")).alias("t"))
    found = docs.select("doc_id", "t", F.explode_outer(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?<![#\w/-])D(\d+)\b"), F.lit(1)))).alias("mark")).withColumn("id", F.col("mark").cast("long"))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    found = found.join(known.withColumn("is", F.lit(True)), "id", "left").groupBy("doc_id", "t").agg(F.collect_list(F.when(F.col("is"), F.col("mark"))).alias("marks"))
    # one pattern of the known marks of the text
    pattern = F.concat(F.lit(r"(?<![#\w/-])(D(?:"), F.array_join("marks", "|"), F.lit(r"))\b"))
    return found.select("doc_id", F.when(F.size("marks") > 0, F.regexp_replace("t", pattern, F.lit('<a href="#$1">$1</a>'))).otherwise(F.col("t")).alias("linked"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(ls) AS value, generate_subscripts(ls,1) AS line FROM l)
SELECT doc_id, CAST(line AS BIGINT) AS line, value FROM e WHERE trim(value)<>'' AND NOT starts_with(value,'#')
""")
def numbered_lines_of_documents(spark, d):
    return numbered_lines(table(spark, d, "documents"), "text", "doc_id").select("doc_id", F.col("line").cast("long").alias("line"), "value")


@query()
def greedy_overlap_dedupe(spark, d):
    """Line sets of documents with one first line, longest first: one that shares 30 % of its lines with a kept one goes.

    Groups are split by the first line; a group's documents stand in one task as line hashes."""
    from ledgerline.operators.greedy import overlap_dedupe

    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)))
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.xxhash64(F.substring_index("text", "\n", 1)).alias("head"), lines.alias("points"))
    return overlap_dedupe(x, "head", "doc_id", "points", 0.3)
