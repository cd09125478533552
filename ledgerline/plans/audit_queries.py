"""Catalog: audits, validators, reconciliation, manifests (with the SQL that must give the same rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import audit as A
from ledgerline.operators import validate as V
from ledgerline.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FIELDS = ["name", "brand", "kind", "size"]


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("size"))


def _plain(field, value):
    return F.when(field == "name", X.squeeze(X.strip(value))).otherwise(value)


@query(r"""
WITH ds AS (SELECT p_partkey, unnest(['name','brand','kind','size']) AS field, unnest([p_name,p_brand,p_type,CAST(p_size AS VARCHAR)]) AS value FROM part),
a AS (SELECT p_partkey, field, CASE WHEN field='name' AND p_partkey%97=0 THEN regexp_replace(value,' ','  ') ELSE value END AS ra FROM ds WHERE p_partkey%89<>0),
b AS (SELECT p_partkey, field, CASE WHEN field='brand' AND p_partkey%83=0 THEN lower(value) ELSE value END AS rb FROM ds),
n AS (SELECT ds.field, CASE WHEN ds.field='name' THEN regexp_replace(trim(ds.value),'\s+',' ','g') ELSE ds.value END AS v,
  CASE WHEN ds.field='name' THEN regexp_replace(trim(ra),'\s+',' ','g') ELSE ra END AS va,
  CASE WHEN ds.field='name' THEN regexp_replace(trim(rb),'\s+',' ','g') ELSE rb END AS vb
  FROM ds LEFT JOIN a USING (p_partkey, field) LEFT JOIN b USING (p_partkey, field)),
c AS (SELECT field, CASE WHEN va IS NULL THEN 'missing' WHEN va=v THEN 'agree' ELSE 'differ' END AS ca, CASE WHEN vb IS NULL THEN 'missing' WHEN vb=v THEN 'agree' ELSE 'differ' END AS cb FROM n)
SELECT field, CASE WHEN ca='agree' AND cb='agree' THEN 'agreed' ELSE 'disagreement' END AS class, ca AS verdict_a, cb AS verdict_b, CAST(count(*) AS BIGINT) AS cells FROM c GROUP BY ALL
""")
def cell_audit(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    k = F.col("p_partkey")
    a = p.where(k % 89 != 0).withColumn("name", F.when(k % 97 == 0, F.regexp_replace("name", "^([^ ]*) ", "$1  ")).otherwise(F.col("name")))
    b = p.withColumn("brand", F.when(k % 83 == 0, F.lower("brand")).otherwise(F.col("brand")))
    out = A.audit(*(A.cells(x, ["p_partkey"], _FIELDS) for x in (p, a, b)), ["p_partkey"], _plain, lambda f, r: F.expr("cast(array() as array<string>)"))
    return out.groupBy("field", "class", "verdict_a", "verdict_b").agg(F.count("*").alias("cells"))


@query(r"""
WITH r AS (SELECT p_partkey, p_brand AS v, CASE WHEN p_partkey%79=0 THEN 'Brand[uncertain:' || substr(p_brand,6) || '|#99]' ELSE p_brand END AS read FROM part),
s AS (SELECT *, CASE WHEN read=v THEN 'agree' WHEN read LIKE '%[uncertain:%' AND v IN ('Brand' || split_part(split_part(split_part(read,'[uncertain:',2),']',1),'|',1), 'Brand' || split_part(split_part(split_part(read,'[uncertain:',2),']',1),'|',2)) THEN 'agree-uncertain' ELSE 'differ' END AS verdict FROM r)
SELECT verdict, CAST(count(*) AS BIGINT) AS cells, CAST(min(p_partkey) AS BIGINT) AS first_key FROM s GROUP BY verdict
""")
def uncertain_reading_audit(spark, d):
    p = table(spark, d, "part")
    read = F.when(F.col("p_partkey") % 79 == 0, F.concat(F.lit("Brand[uncertain:"), F.expr("substring(p_brand, 6)"), F.lit("|#99]"))).otherwise(F.col("p_brand"))
    p = p.select("p_partkey", "p_brand", read.alias("read"))
    v = X.compare(F.col("p_brand"), F.col("read"), X.uncertain_alternatives(F.col("read")))
    return p.select("p_partkey", v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("cells"), F.min("p_partkey").alias("first_key"))


@query(r"""
WITH adj AS (SELECT c_custkey, c_mktsegment AS resolution FROM customer WHERE c_custkey%3=0)
SELECT coalesce(a.resolution,'uncertain') AS resolution, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice),2) AS total FROM orders o LEFT JOIN adj a ON o.o_custkey=a.c_custkey GROUP BY 1
""")
def left_default_adjudication(spark, d):
    adj = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("resolution"), F.lit("").alias("reason"))
    return A.adjudicate(table(spark, d, "orders"), adj, "o_custkey").groupBy("resolution").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_name, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AS found FROM nation")
def semi_found_flag(spark, d):
    seen = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "nation").join(seen, "n_nationkey", "left").select("n_name", F.coalesce("hit", F.lit(False)).alias("found"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def anti_unlabelled_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""
SELECT coalesce(l.k,o.k) AS key, CASE WHEN o.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) l FULL JOIN (SELECT o_orderkey AS k FROM orders) o ON l.k=o.k WHERE l.k IS NULL OR o.k IS NULL
""")
def orphan_both_ways(spark, d):
    return V.both_ways(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), "key")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def verbatim_containment(spark, d):
    from ledgerline.operators.joins import contained_in

    return contained_in(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text")


@query("SELECT sha256(text) AS sha256, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*)>1")
def duplicate_keys(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return g.where("n > 1")


@query("SELECT doc_id, sha256(text) AS sha256, substr(sha256(text),1,12) AS short, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def content_manifest(spark, d):
    h = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, d, "documents").select("doc_id", h.alias("sha256"), F.substring(h, 1, 12).alias("short"), F.octet_length("text").cast("long").alias("bytes"))


@query("""
WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(length(text) ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(unnest(range(1, len(roles)+1)) AS BIGINT) AS place, unnest(roles) AS role, CAST(unnest(sizes) AS BIGINT) AS size FROM g WHERE len(roles)=len(sizes)
""")
def zip_list_check(spark, d):
    # conversations is keyed by conv_id; turns of one conversation are few, and each list has one entry a turn
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("size"))))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("r"))
    g = g.select("conv_id", F.transform("r", lambda x: x.role).alias("roles"), F.transform("r", lambda x: x["size"]).alias("sizes")).where(F.size("roles") == F.size("sizes"))
    return g.select("conv_id", F.posexplode(F.arrays_zip("roles", "sizes")).alias("place", "z")).select("conv_id", (F.col("place") + 1).cast("long").alias("place"), F.col("z.roles").alias("role"), F.col("z.sizes").alias("size"))


@query("""
SELECT 'event_type' AS check_id, CAST(event_id AS VARCHAR) AS entity_key, 'error' AS severity, 'event_type=' || event_type AS message FROM events WHERE event_type NOT IN ('click','view','purchase')
UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR), 'error', 'o_orderstatus=' || o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F','O')
UNION ALL SELECT 'priority', CAST(o_orderkey AS VARCHAR), 'warning', 'urgent order without value' FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice < 5000
""")
def domain_violations(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    return V.union(
        V.in_domain(e, "event_type", "event_id", "event_type", ["click", "view", "purchase"]),
        V.in_domain(o, "status", "o_orderkey", "o_orderstatus", ["F", "O"]),
        V.violations(o, "priority", "o_orderkey", F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") < 5000), "urgent order without value", "warning"),
    )


@query("""
SELECT event_id, CASE WHEN k IS NULL THEN 'required' WHEN NOT regexp_matches(k,'^-?[0-9]+$') THEN 'type' WHEN CAST(k AS BIGINT) < 10 THEN 'minimum' WHEN CAST(k AS BIGINT) > 90 THEN 'maximum' END AS problem
FROM (SELECT event_id, json_extract_string(props,'$.k') AS k FROM events) WHERE k IS NULL OR NOT regexp_matches(k,'^-?[0-9]+$') OR CAST(k AS BIGINT) NOT BETWEEN 10 AND 90
""")
def schema_subset_check(spark, d):
    v = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", V.json_violations(v, "integer", 10, 90).alias("problem")).where("problem is not null")


@query("""
SELECT lang, CAST(count(*) AS BIGINT) AS class_size, CAST(count_if(quality=1) AS BIGINT) AS hits, CAST(count_if(quality=0) AS BIGINT) AS misses, count_if(quality=1)+count_if(quality=0)=count(*) AS holds
FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def invariant_base_rate(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang")
    g = g.agg(F.count("*").alias("class_size"), F.count_if(F.col("quality") == 1).alias("hits"), F.count_if(F.col("quality") == 0).alias("misses"))
    return g.withColumn("holds", F.col("hits") + F.col("misses") == F.col("class_size"))


@query("""
WITH c AS (SELECT l_orderkey, CASE WHEN l_returnflag='N' THEN 'confirmed' WHEN l_returnflag='R' THEN 'refuted' ELSE 'unfalsifiable' END AS status, l_linestatus='F' AS novel, l_quantity<2 AS undecided FROM lineitem),
g AS (SELECT l_orderkey, count_if(novel) AS n, count(*) AS a, count_if(novel AND status='confirmed') AS ny, count_if(status='confirmed') AS ay, count_if(novel AND status='refuted') AS nn, count_if(status='refuted') AS an, count_if(novel AND undecided) AS nu, count_if(undecided) AS au FROM c GROUP BY 1),
p AS (SELECT l_orderkey, n>0 AS isn, CASE WHEN n>0 THEN n ELSE a END AS s, CASE WHEN n>0 THEN ny ELSE ay END AS y, CASE WHEN n>0 THEN nn ELSE an END AS r, CASE WHEN n>0 THEN nu ELSE au END AS u FROM g)
SELECT l_orderkey, CASE WHEN u>0 THEN 'undetermined' WHEN y=s THEN 'confirmed' WHEN y>0 THEN 'partially confirmed' WHEN r>0 THEN 'refuted' ELSE 'unfalsifiable' END AS verdict, CASE WHEN isn THEN 'novel' ELSE 'period-standard' END AS novelty FROM p
""")
def verdict_rollup(spark, d):
    status = F.when(F.col("l_returnflag") == "N", "confirmed").when(F.col("l_returnflag") == "R", "refuted").otherwise("unfalsifiable")
    c = table(spark, d, "lineitem").select("l_orderkey", status.alias("status"), (F.col("l_linestatus") == "F").alias("novel"), (F.col("l_quantity") < 2).alias("undecided"))
    return A.verdicts(c, "l_orderkey")


_RECON = """
WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))*(1-CAST(l_discount AS DECIMAL(4,2)))) AS lines FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS ours, lines FROM orders LEFT JOIN s ON l_orderkey=o_orderkey),
r AS (SELECT o_orderkey, CAST(ours-lines AS DOUBLE) AS delta, CAST(round(ours-lines,3) AS DOUBLE) AS shown, CASE WHEN lines<>0 THEN round(CAST(ours-lines AS DOUBLE)/CAST(lines AS DOUBLE)*100,2) END AS pct FROM j),
k AS (SELECT o_orderkey, shown AS delta, pct, CASE WHEN delta IS NULL THEN 'nonexistent' WHEN abs(pct)<=50 THEN 'matched' WHEN delta<0 THEN 'misplaced' ELSE 'renamed' END AS classification FROM r)
"""


def _reconciled(spark, d):
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(net).alias("lines"))
    j = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("ours")).join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    j = j.withColumn("d", (F.col("ours") - F.col("lines")).cast("double")).withColumn("pct", F.when(F.col("lines") != 0, F.round(F.col("d") / F.col("lines").cast("double") * 100, 2)))
    kind = F.when(F.col("d").isNull(), "nonexistent").when(F.abs("pct") <= 50, "matched").when(F.col("d") < 0, "misplaced").otherwise("renamed")
    return j.select("o_orderkey", F.round(F.col("ours") - F.col("lines"), 3).cast("double").alias("delta"), "pct", kind.alias("classification"))


@query(_RECON + "SELECT * FROM k")
def reconcile_totals(spark, d):
    return _reconciled(spark, d)


@query(_RECON + "SELECT classification, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1")
def class_tally(spark, d):
    return _reconciled(spark, d).groupBy("classification").agg(F.count("*").alias("n"))


@query(_RECON + "SELECT classification, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(pct*pct)),4) AS rms_pct, round(max(abs(pct)),4) AS max_pct FROM k WHERE pct IS NOT NULL GROUP BY 1")
def tolerance_rms(spark, d):
    g = _reconciled(spark, d).where("pct is not null").groupBy("classification")
    return g.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("pct") * F.col("pct"))), 4).alias("rms_pct"), F.round(F.max(F.abs("pct")), 4).alias("max_pct"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS ordinal, CAST(n_nationkey AS VARCHAR) || chr(9) || CASE WHEN contains(n_name,'"') OR contains(n_name,chr(9)) THEN '"' || replace(n_name,'"','""') || '"' ELSE n_name END || chr(9) || CAST(n_regionkey AS VARCHAR) || chr(13) || chr(10) AS line FROM nation""")
def publish_tsv(spark, d):
    from ledgerline.sources.sinks import tsv_line

    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("ordinal"), tsv_line([F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string")], "\r\n").alias("line"))


@query("""
WITH b AS (SELECT o_custkey, max(o_orderdate) AS built FROM orders WHERE o_orderkey%4<>0 GROUP BY 1)
SELECT o.o_custkey AS custkey, CASE WHEN built IS NULL THEN 'missing' ELSE 'stale' END AS state FROM (SELECT o_custkey, max(o_orderdate) AS source FROM orders GROUP BY 1) o LEFT JOIN b USING (o_custkey) WHERE built IS NULL OR source > built
""")
def incremental_stale(spark, d):
    from ledgerline.streaming.incremental import stale

    o = table(spark, d, "orders")
    src = o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_orderdate").alias("modified"))
    built = o.where("o_orderkey % 4 != 0").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_orderdate").alias("modified"))
    return stale(src, built, "custkey")


@query("""
WITH a AS (SELECT DISTINCT upper(n_name) AS x FROM nation WHERE n_nationkey%2=0), b AS (SELECT DISTINCT upper(n_name) AS x FROM nation WHERE n_nationkey%3=0),
c AS (SELECT c_custkey, CASE WHEN c_custkey%10=0 THEN '' ELSE lower(n_name) END AS label FROM customer JOIN nation ON n_nationkey=c_nationkey)
SELECT class, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN label='' THEN 'agreed' WHEN upper(label) IN (SELECT x FROM a) AND upper(label) IN (SELECT x FROM b) AND c_custkey%77<>0 THEN 'agreed' WHEN c_custkey%77=0 THEN 'disagreement' ELSE 'chart-illegible' END AS class FROM c) GROUP BY class
""")
def chart_witness_audit(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.lower("n_name")).alias("label"))
    decided = c.where("c_custkey % 77 = 0").select("c_custkey")
    seen = lambda k: n.where(F.col("n_nationkey") % k == 0).select(F.upper("n_name").alias("x"))
    return A.label_audit(c, "c_custkey", "label", seen(2), seen(3), decided).groupBy("class").agg(F.count("*").alias("n"))


@query("""
SELECT 'priority' AS check_id, CAST(o_orderkey AS VARCHAR) AS entity_key, 'error' AS severity, 'o_orderpriority=' || o_orderpriority AS message FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW')
UNION ALL SELECT 'date', CAST(o_orderkey AS VARCHAR), 'error', 'missing checked_date' FROM orders WHERE o_orderkey%101=0
UNION ALL SELECT 'count', 'orders', 'error', 'rows ' || count(*) || ' declared ' || (count(*) + 1) FROM orders
""")
def dataset_validate(spark, d):
    o = table(spark, d, "orders").withColumn("checked_date", F.when(F.col("o_orderkey") % 101 != 0, F.col("o_orderdate")))
    n = o.agg(F.count("*").alias("rows")).withColumn("declared", F.col("rows") + 1)
    return V.union(
        V.in_domain(o, "priority", "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]),
        V.required(o, "date", "o_orderkey", ["checked_date"]),
        V.violations(n, "count", F.lit("orders"), F.col("rows") != F.col("declared"), F.concat(F.lit("rows "), F.col("rows").cast("string"), F.lit(" declared "), F.col("declared").cast("string"))),
    )


@query("""
WITH m AS (SELECT doc_id, CASE WHEN doc_id%13=0 THEN 'tampered' ELSE sha256(text) END AS listed, CASE WHEN doc_id%17=0 THEN 2 ELSE 1 END AS copies FROM documents WHERE doc_id%11<>0
  UNION ALL SELECT -doc_id, 'none', 1 FROM documents WHERE doc_id%19=0 AND doc_id>0)
SELECT 'unlisted' AS check_id, CAST(d.doc_id AS VARCHAR) AS entity_key, 'error' AS severity, 'left_only' AS message FROM documents d ANTI JOIN m USING (doc_id)
UNION ALL SELECT 'orphan', CAST(m.doc_id AS VARCHAR), 'error', 'right_only' FROM m ANTI JOIN documents d USING (doc_id)
UNION ALL SELECT 'hash', CAST(d.doc_id AS VARCHAR), 'error', 'hash differs' FROM documents d JOIN m USING (doc_id) WHERE listed<>sha256(text)
UNION ALL SELECT 'unique', CAST(doc_id AS VARCHAR), 'error', 'occurs 2' FROM m WHERE copies=2
""")
def manifest_check(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    k = F.col("doc_id")
    listed = docs.where(k % 11 != 0).select("doc_id", F.when(k % 13 == 0, "tampered").otherwise(F.col("sha256")).alias("listed"), F.when(k % 17 == 0, 2).otherwise(1).alias("copies"))
    listed = listed.union(docs.where((k % 19 == 0) & (k > 0)).select((-k).alias("doc_id"), F.lit("none"), F.lit(1)))
    listed = listed.select("doc_id", "listed", F.explode(F.sequence(F.lit(1), "copies")).alias("_c")).drop("_c")
    sides = V.both_ways(docs, listed, "doc_id")
    pair = docs.join(listed.distinct(), "doc_id")
    return V.union(
        V.violations(sides, "unlisted", "doc_id", F.col("side") == "left_only", F.col("side")),
        V.violations(sides, "orphan", "doc_id", F.col("side") == "right_only", F.col("side")),
        V.violations(pair, "hash", "doc_id", F.col("sha256") != F.col("listed"), "hash differs"),
        V.unique(listed, "unique", "doc_id"),
    )


@query("""
WITH c AS (SELECT c_custkey, c_name, c_mktsegment FROM customer),
e AS (SELECT o_orderkey, CASE WHEN o_orderkey%50=0 THEN o_custkey+1000000 ELSE o_custkey END AS ck, CASE WHEN o_orderkey%70=0 THEN 'zzz' ELSE 'Customer' END AS quote, o_orderstatus AS verdict FROM orders),
l AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)
SELECT 'reference' AS check_id, CAST(o_orderkey AS VARCHAR) AS entity_key, 'error' AS severity, 'unknown c_custkey ' || ck AS message FROM e ANTI JOIN c ON ck=c_custkey
UNION ALL SELECT 'quote', CAST(o_orderkey AS VARCHAR), 'error', 'not a verbatim substring' FROM e JOIN c ON ck=c_custkey WHERE NOT contains(c_name, quote)
UNION ALL SELECT 'evidence', CAST(o_orderkey AS VARCHAR), 'error', 'no modern source' FROM e LEFT JOIN l ON l_orderkey=o_orderkey WHERE verdict<>'O' AND n IS NULL
UNION ALL SELECT 'base_rate', CAST(o_orderkey AS VARCHAR), 'error', 'hits + misses != size' FROM e JOIN l ON l_orderkey=o_orderkey WHERE (n // 2) * 2 <> n AND o_orderkey%9=0
""")
def entry_validate(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey")
    e = o.select("o_orderkey", F.when(k % 50 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("c_custkey"), F.when(k % 70 == 0, "zzz").otherwise("Customer").alias("quote"), F.col("o_orderstatus").alias("verdict"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    got = e.join(n, "o_orderkey", "left")
    cited = e.join(c.select("c_custkey", "c_name"), "c_custkey")
    return V.union(
        V.refers(e, "reference", "o_orderkey", "c_custkey", c, "c_custkey"),
        V.violations(cited, "quote", "o_orderkey", ~F.col("c_name").contains(F.col("quote")), "not a verbatim substring"),
        V.violations(got, "evidence", "o_orderkey", (F.col("verdict") != "O") & F.col("n").isNull(), "no modern source"),
        V.violations(got.where("n is not null"), "base_rate", "o_orderkey", (F.expr("n div 2") * 2 != F.col("n")) & (k % 9 == 0), "hits + misses != size"),
    )


@query("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS row, 'o' || conv_id || '.r' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '.' || role AS key, coalesce(text,'') AS text FROM conversations
""")
def flatten_nested(spark, d):
    from ledgerline.sources.tables import flatten

    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("rows")).select(F.array(F.struct("conv_id", "rows")).alias("groups"))
    flat = flatten(nested, "groups", "rows", "conv_id", ["role", "text"])
    return flat.select("conv_id", F.col("row").cast("long").alias("row"), F.format_string("o%d.r%d.%s", "conv_id", "row", "role").alias("key"), "text")


@query("""
WITH r AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY 1)
SELECT 1 AS family, conv_id, array_to_string(roles,',') AS roles FROM r WHERE NOT list_has_all(['user','assistant'], roles)
UNION ALL SELECT 2, conv_id, array_to_string(roles,',') FROM r WHERE list_has_all(['user','assistant'], roles)
""")
def array_subset_rule(spark, d):
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    extra = F.size(F.array_except("roles", F.array(F.lit("user"), F.lit("assistant"))))
    shape = lambda k, df: df.select(F.lit(k).alias("family"), "conv_id", F.array_join("roles", ",").alias("roles"))
    return shape(1, r.where(extra > 0)).unionByName(shape(2, r.where(extra == 0)))


@query("""
SELECT role, CAST(count_if(text<>'' AND NOT starts_with(text,'The')) AS BIGINT) AS substantive, CAST(count(*) AS BIGINT) AS notes FROM conversations GROUP BY role
""")
def note_filter(spark, d):
    note = (F.col("text") != "") & ~F.col("text").startswith("The")
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(note).alias("substantive"), F.count("*").alias("notes"))


@query("""
WITH x AS (SELECT doc_id, sha256(text) AS h, CAST(strlen(text) AS BIGINT) AS b FROM documents)
SELECT doc_id, doc_id || chr(9) || h || chr(9) || b AS tsv, '| `' || doc_id || '` | `' || substr(h,1,12) || '` | ' || b || ' |' AS markdown FROM x
""")
def render_manifest(spark, d):
    from ledgerline.sources.sinks import markdown_row, tsv_line

    x = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.octet_length("text").cast("string").alias("b"))
    key = F.col("doc_id").cast("string")
    return x.select("doc_id", tsv_line([key, F.col("h"), F.col("b")]).alias("tsv"), markdown_row([F.concat(F.lit("`"), key, F.lit("`")), F.concat(F.lit("`"), F.substring("h", 1, 12), F.lit("`")), F.col("b")]).alias("markdown"))


@query("""
WITH p AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey%7=0 THEN '[' || (o_orderkey - CASE WHEN o_orderkey < 500 THEN 18 ELSE 20 END) || ']' WHEN o_orderkey%11=0 THEN 'none' ELSE CAST(o_orderkey - CASE WHEN o_orderkey < 500 THEN 18 ELSE 20 END AS VARCHAR) END AS label FROM orders),
f AS (SELECT i, TRY_CAST(regexp_extract(label,'^\\[?([0-9]+)\\]?$',1) AS BIGINT) AS page FROM p),
g AS (SELECT i, page, i-page AS off FROM f WHERE page IS NOT NULL),
s AS (SELECT *, CASE WHEN off IS DISTINCT FROM lag(off) OVER (ORDER BY i) THEN 1 ELSE 0 END AS b FROM g),
t AS (SELECT *, sum(b) OVER (ORDER BY i) AS seg FROM s)
SELECT CAST(seg AS BIGINT) AS segment, off AS page_offset, min(i) AS first_index, max(i) AS last_index, CAST(count(*) AS BIGINT) AS pages FROM t GROUP BY seg, off
""".replace("\\\\", "\\"))
def offset_segments(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    page = (k - F.when(k < 500, 18).otherwise(20)).cast("string")
    label = F.when(k % 7 == 0, F.concat(F.lit("["), page, F.lit("]"))).when(k % 11 == 0, "none").otherwise(page)
    g = o.select(k.alias("i"), X.folio(label).alias("page")).where("page is not null").withColumn("off", F.col("i") - F.col("page"))
    from ledgerline.operators.series import numbered_islands

    t = numbered_islands(g, [], ["i"], F.expr("i div 100000"), lambda w: F.lag("off").over(w).isNull() | (F.lag("off").over(w) != F.col("off")), "segment")
    return t.groupBy("segment", F.col("off").alias("page_offset")).agg(F.min("i").alias("first_index"), F.max("i").alias("last_index"), F.count("*").alias("pages"))


@query("SELECT doc_id, md5('sample-42' || doc_id) AS h FROM documents WHERE lang='en' ORDER BY h, doc_id LIMIT 10")
def hash_sample(spark, d):
    x = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.md5(F.concat(F.lit("sample-42"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    return x.orderBy("h", "doc_id").limit(10)
