"""Catalog: mandatory and corroborated matches, full reference checks, schemas, keys, text lines and small columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import joins as J
from ledgerline.operators import validate as V
from ledgerline.sources import sinks
from ledgerline.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n, min(p_name) AS p_name, min(s_name) AS s_name FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1,2")
def mandatory_match(spark, d):
    """Every line must have its part and its supplier: a miss ends the query with the key that lacks one."""
    li = J.mandatory(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    li = J.mandatory(li, "l_suppkey", table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("p_name").alias("p_name"), F.min("s_name").alias("s_name"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS entity_key, check_id, message FROM (
 SELECT l_orderkey, l_linenumber, 'unique' AS check_id, 'occurs ' || CAST(count(*) AS VARCHAR) AS message FROM lineitem GROUP BY 1,2 HAVING count(*)>1
 UNION ALL SELECT l_orderkey, l_linenumber, 'page', 'price per piece ' || CAST(CAST(round(l_extendedprice/l_quantity) AS BIGINT) AS VARCHAR) FROM lineitem JOIN part ON p_partkey=l_partkey WHERE round(l_extendedprice/l_quantity)<>round(p_retailprice)
 UNION ALL SELECT l_orderkey, l_linenumber, 'loc', 'nation ' || CAST(s_nationkey AS VARCHAR) FROM lineitem JOIN supplier ON s_suppkey=l_suppkey JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey WHERE l_returnflag='R' AND s_nationkey<>c_nationkey
 UNION ALL SELECT l_orderkey, l_linenumber, 'claim', 'unknown order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
""")
def evidence_check(spark, d):
    """Evidence (line items) against its claims: unique keys, known orders, a field that must always agree (the price per
    piece) and one that must agree where it is given (the nation, of returned lines)."""
    li = table(spark, d, "lineitem").withColumn("entity", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.round("p_retailprice").alias("page"))
    paged = li.join(part, "l_partkey").withColumn("own", F.round(F.col("l_extendedprice") / F.col("l_quantity")))
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("own"))
    buyer = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("loc")), "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "loc")
    placed = li.join(nation, "l_suppkey").join(buyer, "l_orderkey").withColumn("given", F.when(F.col("l_returnflag") == "R", F.col("own")))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = li.join(orders, "l_orderkey", "left_anti")
    found = V.union(
        V.unique(li, "unique", "entity"),
        V.agrees(paged, "page", "entity", "own", "page", F.concat(F.lit("price per piece "), F.col("own").cast("long").cast("string"))),
        V.agrees(placed, "loc", "entity", "given", "loc", F.concat(F.lit("nation "), F.col("own").cast("string"))),
        V.violations(lost, "claim", "entity", F.lit(True), "unknown order"),
    )
    return found.select("entity_key", "check_id", "message")


@query("""
WITH o AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS a FROM orders GROUP BY 1), s AS (SELECT o_custkey, list(DISTINCT l_returnflag || '-' || l_linestatus) AS b FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a,[]),coalesce(b,[])))),'; ') AS ids, CAST(len(list_distinct(list_concat(coalesce(a,[]),coalesce(b,[])))) AS BIGINT) AS n
FROM customer LEFT JOIN o ON o.o_custkey=c_custkey LEFT JOIN s ON s.o_custkey=c_custkey
""")
def list_union(spark, d):
    """Two lists of a record as one, without repeats, joined with "; "; a missing list is empty."""
    o = table(spark, d, "orders")
    key = F.col("o_custkey").alias("c_custkey")
    a = o.groupBy(key).agg(F.collect_set("o_orderpriority").alias("a"))  # a few values at most
    b = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(key).agg(F.collect_set(F.concat_ws("-", "l_returnflag", "l_linestatus")).alias("b"))
    c = table(spark, d, "customer").select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    none = F.expr("cast(array() as array<string>)")
    both = F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none)))
    return c.select("c_custkey", F.array_join(both, "; ").alias("ids"), F.size(both).cast("long").alias("n"))


@query("""
WITH l AS (SELECT l_orderkey, bool_or(l_returnflag NOT IN ('A','N')) AS flag, bool_or(l_tax=0) AS tax, bool_or(l_quantity<>floor(l_quantity)) AS qty FROM lineitem GROUP BY 1),
o AS (SELECT * FROM orders LEFT JOIN l ON l_orderkey=o_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS entity_key, m AS message FROM (
 SELECT o_orderkey, '$.status: enum' AS m FROM o WHERE o_orderstatus NOT IN ('F','O') UNION ALL SELECT o_orderkey, '$.priority: pattern' FROM o WHERE NOT regexp_matches(o_orderpriority,'^[1-4]-')
 UNION ALL SELECT o_orderkey, '$: required lines' FROM o WHERE l_orderkey IS NULL UNION ALL SELECT o_orderkey, '$.lines[].flag: pattern' FROM o WHERE flag
 UNION ALL SELECT o_orderkey, '$.lines[]: required tax' FROM o WHERE tax UNION ALL SELECT o_orderkey, '$.lines[].qty: type' FROM o WHERE qty)
""")
def schema_recursion(spark, d):
    """Orders with their lines as JSON documents, against a schema with definitions, nested items and required members."""
    line = F.struct(F.col("l_returnflag").alias("flag"), F.when(F.col("l_quantity") == F.floor("l_quantity"), F.col("l_quantity").cast("long").cast("string")).otherwise(F.to_json(F.struct("l_quantity"))).try_cast("long").alias("qty"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))  # the lines of one order
    o = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    o = o.select("o_orderkey", F.to_json(F.struct(F.lit("order").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "lines")).alias("doc"))
    schema = {
        "type": "object", "required": ["kind", "status", "lines"],
        "properties": {"kind": {"const": "order"}, "status": {"enum": ["F", "O"]}, "priority": {"type": "string", "pattern": "^[1-4]-"}, "lines": {"type": "array", "items": {"$ref": "#/definitions/line"}}},
        "definitions": {"line": {"type": "object", "required": ["tax"], "properties": {"flag": {"$ref": "#/definitions/flag"}, "qty": {"type": "integer"}, "tax": {"type": "number"}}}, "flag": {"type": "string", "pattern": "^[AN]$"}},
    }
    return V.schema_violations(o, "o_orderkey", "doc", schema).select("entity_key", "message")


@query("""
SELECT c_custkey, printf('%+.2f', c_acctbal) AS signed, format('{:,}', CAST(floor(c_acctbal) AS BIGINT)) AS thousands FROM customer
""")
def number_text(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.signed(F.col("c_acctbal"), 2).alias("signed"), F.format_number(F.floor("c_acctbal"), 0).alias("thousands"))


@query("""
SELECT vec_id, round(r*cos(radians(t)),6)+0 AS x, round(r*sin(radians(t)),6)+0 AS y FROM (SELECT vec_id, CAST(label AS DOUBLE)+1 AS r, CAST(vec_id*37%360 AS DOUBLE) AS t FROM embeddings)
""")
def polar_to_xy(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", (F.col("label") + 1.0).alias("r"), F.radians((F.col("vec_id") * 37 % 360).cast("double")).alias("t"))
    return p.select("vec_id", (F.round(F.col("r") * F.cos("t"), 6) + 0).alias("x"), (F.round(F.col("r") * F.sin("t"), 6) + 0).alias("y"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url,'[?#].*$',''),'^[a-z]+://[^/]+/?',''),'/$','') AS path_key, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) AS host FROM pages
""")
def path_key(spark, d):
    """The part of an address below its root, without query, fragment and closing slash."""
    plain = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]+/?", "")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(plain, "/$", "").alias("path_key"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query("SELECT l_orderkey || '.' || l_linenumber || l_returnflag AS number, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def position_sigil(spark, d):
    """A derived key: position and sigil."""
    number = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    return table(spark, d, "lineitem").groupBy(number.alias("number")).agg(F.count("*").alias("n"))


@query(r"""
WITH u AS (SELECT DISTINCT regexp_extract(url,'^[a-z]+://([^/?#]+)',1) AS host, replace(replace(regexp_replace(url,'[?#].*$',''),'&','&amp;'),'<','&lt;') AS loc FROM pages)
SELECT host, CAST(count(*) AS BIGINT) AS urls, '<urlset>' || string_agg('<url><loc>' || loc || '</loc></url>', '' ORDER BY loc) || '</urlset>' AS sitemap FROM u GROUP BY host
""")
def sitemap(spark, d):
    """One site map a host; a host's addresses meet in one row, as the file they make."""
    loc = X.escape_html(F.regexp_replace("url", "[?#].*$", ""), quote=False)
    u = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), loc.alias("loc")).distinct()
    entries = F.array_join(F.array_sort(F.collect_list("loc")), "</loc></url><url><loc>")
    return u.groupBy("host").agg(F.count("*").alias("urls"), F.concat(F.lit("<urlset><url><loc>"), entries, F.lit("</loc></url></urlset>")).alias("sitemap"))


@query("""
WITH l AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS list FROM orders GROUP BY 1)
SELECT c_custkey, c_custkey || chr(9) || c_name || chr(9) || c_mktsegment || chr(9) || coalesce(list,'') AS line FROM customer LEFT JOIN l ON o_custkey=c_custkey
""")
def plain_tsv_lines(spark, d):
    """Unquoted lines with a list cell joined by "; "; a cell with a tab or line end would end the query."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("list"))
    c = table(spark, d, "customer").join(lists, F.col("o_custkey") == F.col("c_custkey"), "left")
    cells = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.col("list")]
    return c.select("c_custkey", sinks.tsv_line([sinks.clean(x) for x in cells], quote=False).alias("line"))


@query("""
SELECT n_nationkey, '{' || chr(10) || ' "n_name": "' || n_name || '",' || chr(10) || ' "n_nationkey": ' || n_nationkey || ',' || chr(10) || ' "n_regionkey": ' || n_regionkey || chr(10) || '}' AS pretty, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS compact FROM nation
""")
def json_lines(spark, d):
    """Records as JSON: one member a line with sorted keys, and compact in column order."""
    n = table(spark, d, "nation")
    return n.select("n_nationkey", sinks.json_pretty(["n_nationkey", "n_name", "n_regionkey"]).alias("pretty"), sinks.json_text(["n_nationkey", "n_name"]).alias("compact"))


@query(r"""
SELECT conv_id, turn, upper(l) AS label FROM (SELECT conv_id, turn, trim(unnest(string_split(text,' '))) AS l FROM conversations) WHERE length(l) BETWEEN 2 AND 20 AND regexp_matches(l,'^[A-Za-z]+$')
""")
def short_labels(spark, d):
    """Nested turns and words, flattened: stripped, upper-cased, of 2 to 20 letters."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.split("text", " ", -1).alias("words"))).alias("turns"))  # the turns of one conversation
    w = g.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", F.explode("t.words").alias("w")).select("conv_id", "turn", F.trim("w").alias("l"))
    return w.where(F.length("l").between(2, 20) & F.col("l").rlike("^[A-Za-z]+$")).select("conv_id", "turn", F.upper("l").alias("label"))


@query("""
WITH p AS (SELECT vec_id, 60*sqrt(embedding[1]::DOUBLE*embedding[1]+embedding[2]::DOUBLE*embedding[2]) AS dist FROM embeddings), r AS (SELECT DISTINCT label, label*9.0 AS r_nom FROM embeddings)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(dist-r_nom),5)+0 AS mean_off FROM p JOIN r ON abs(dist-r_nom)<7 GROUP BY 1
""")
def annulus_join(spark, d):
    """Points within 7 of a nominal radius."""
    e = table(spark, d, "embeddings")
    x, y = (F.col("embedding")[i].cast("double") for i in (0, 1))
    p = e.select((60 * F.sqrt(x * x + y * y)).alias("dist"))
    r = e.select("label").distinct().withColumn("r_nom", F.col("label") * 9.0)
    got = J.band_join(p, "dist", r, "r_nom", 7.0, F.abs(F.col("dist") - F.col("r_nom")) < 7)
    return got.groupBy("label").agg(F.count("*").alias("n"), (F.round(F.avg(F.col("dist") - F.col("r_nom")), 5) + 0).alias("mean_off"))


@query("""
WITH e AS (SELECT event_id, user_id, value*7.3 - floor(value*7.3/360)*360 AS t, 120+value*5 AS r FROM events), c AS (SELECT event_id, t, r, CAST(k AS INTEGER) AS k, abs(r-(118+(t+360*k)*0.2)) AS dr FROM e, range(0,8) x(k) WHERE r>118 AND r<770),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dr, k) AS n FROM c WHERE dr<=70)
SELECT event_id, k AS turn, round(dr,6) AS miss FROM b WHERE n=1
""")
def turn_choice(spark, d):
    """Each point's turn of a spiral: of eight the nearest in radius, 70 away at most; the first of equals."""
    t = F.col("value") * 7.3
    e = table(spark, d, "events").select("event_id", (t - F.floor(t / 360) * 360).alias("t"), (120 + F.col("value") * 5).alias("r")).where("r > 118 and r < 770")
    tries = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(F.abs(F.col("r") - (118 + (F.col("t") + 360 * k) * 0.2)).alias("dr"), k.alias("k")))
    return e.select("event_id", F.array_min(tries).alias("b")).where("b.dr <= 70").select("event_id", F.col("b.k").alias("turn"), F.round("b.dr", 6).alias("miss"))


@query("""
SELECT p_partkey, round(least(70,greatest(36,0.1*p_retailprice)),4) AS hub, round(length(p_name)*p_size*0.56,4) AS width, printf('M %.1f %.1f A %.1f %.1f 0 %d 1 %.1f %.1f', 0.0, p_size*1.0, floor(p_retailprice)/2, floor(p_retailprice)/2, CASE WHEN p_size>25 THEN 1 ELSE 0 END, floor(p_retailprice), p_size*1.0) AS arc FROM part
""")
def label_geometry(spark, d):
    """A hub's radius between bounds, a text's width by its letters, and an arc as a path."""
    wide, size = F.floor("p_retailprice").cast("double"), F.col("p_size").cast("double")
    arc = F.format_string("M %.1f %.1f A %.1f %.1f 0 %d 1 %.1f %.1f", F.lit(0.0), size, wide / 2, wide / 2, (F.col("p_size") > 25).cast("int"), wide, size)
    hub = F.least(F.lit(70.0), F.greatest(F.lit(36.0), 0.1 * F.col("p_retailprice")))
    return table(spark, d, "part").select("p_partkey", F.round(hub, 4).alias("hub"), F.round(F.length("p_name") * size * 0.56, 4).alias("width"), arc.alias("arc"))


@query(r"""
WITH t AS (SELECT page_id, regexp_extract_all(html,'<([a-z][a-z0-9]*)',1) AS l FROM pages)
SELECT page_id, array_to_string([x FOR x, i IN l IF list_position(l,x)=i],'|') AS tags, CAST(len(list_distinct(l)) AS BIGINT) AS n FROM t
""")
def tag_inventory(spark, d):
    """Distinct tags of a page in order of their first place, and how many."""
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.array_join(tags, "|").alias("tags"), F.size(tags).cast("long").alias("n"))


@query("""
SELECT lang, source, CASE WHEN count(*)>50 THEN 'Source ' || source || ' (' || lang || '), ' || count(*) || ' texts.' WHEN count(*)>1 THEN source || ': ' || count(*) || ' texts' ELSE source || ': one text' END AS notice FROM documents GROUP BY lang, source
""")
def notice_text(spark, d):
    n = F.count("*").cast("string")
    g = table(spark, d, "documents").groupBy("lang", "source").agg(n.alias("n"))
    many = F.concat(F.lit("Source "), "source", F.lit(" ("), "lang", F.lit("), "), "n", F.lit(" texts."))
    text = F.when(F.col("n").cast("long") > 50, many).when(F.col("n").cast("long") > 1, F.concat("source", F.lit(": "), "n", F.lit(" texts"))).otherwise(F.concat("source", F.lit(": one text")))
    return g.select("lang", "source", text.alias("notice"))


@query("""
WITH a AS (SELECT CAST(floor((degrees(atan2(y,x))-floor(degrees(atan2(y,x))/360)*360)/5) AS BIGINT) AS angle, v FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings))
SELECT angle, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN v>0.05 THEN 1.0 ELSE 0.0 END),6) AS occupancy FROM a GROUP BY 1
""")
def angle_occupancy(spark, d):
    """Share of inked cells in each column of angles."""
    x, y, v = (F.col("embedding")[i].cast("double") for i in range(3))
    angle = F.floor(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)) / 5).cast("long")
    return table(spark, d, "embeddings").groupBy(angle.alias("angle")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(v > 0.05, 1.0).otherwise(0.0)), 6).alias("occupancy"))
