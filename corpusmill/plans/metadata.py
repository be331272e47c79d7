"""Queries over metadata: document and user lists, tags, audit trail, sessions, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import listing as L
from ..sources.tables import table
from .registry import query

#: How the columns of the metadata tables come from the driver's tables.
DOCS_SQL = """(SELECT doc_id, source AS kb_id, lang, n_chars, text,
  CASE doc_id % 6 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'parsed' WHEN 2 THEN 'ingested' WHEN 3 THEN 'failed' WHEN 4 THEN 'pending_confirm' ELSE 'ingested' END AS status,
  doc_id % 7 = 0 AS deleted FROM documents)"""


def documents(spark, sf_dir):
    """Documents with a base, a status and a trash flag."""
    d = table(spark, sf_dir, "documents")
    status = F.element_at(F.array(*map(F.lit, ["uploaded", "parsed", "ingested", "failed", "pending_confirm", "ingested"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select("doc_id", F.col("source").alias("kb_id"), "lang", "n_chars", "text", status.alias("status"), (F.col("doc_id") % 7 == 0).alias("deleted"))


@query(f"SELECT doc_id, kb_id, status, n_chars FROM {DOCS_SQL} WHERE kb_id = 'src1' AND NOT deleted")
def doc_list(spark, sf_dir):
    return documents(spark, sf_dir).where((F.col("kb_id") == "src1") & ~F.col("deleted")).select("doc_id", "kb_id", "status", "n_chars")


@query(f"SELECT doc_id, status FROM {DOCS_SQL} WHERE status IN ('failed', 'pending_confirm') UNION ALL SELECT doc_id, status FROM {DOCS_SQL} WHERE status IN ('uploaded', 'parsed')")
def doc_status_groups(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "status")
    return d.where(L.in_status(F.col("status"), "failed")).unionByName(d.where(L.in_status(F.col("status"), "unparsed")))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'feed')")
def page_keyword(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(L.has_keyword(F.col("url"), "FEED")).select("page_id", "url")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS department FROM customer WHERE c_nationkey % 5 = 0 OR c_nationkey = 7")
def users_in_scope(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("department"))
    return users.where(L.in_department(F.col("department"), L.UNASSIGNED) | L.in_department(F.col("department"), "7"))


@query("""SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'
AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)""")
def audit_filter(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("%HIGH%") & F.col("o_orderdate").between(F.lit("1994-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")))
    return o.join(users, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE NOT starts_with(strftime(o_orderdate, '%Y-%m-%d'), '1995-03')")
def audit_without_month(spark, sf_dir):
    # a range on the column itself reaches the scan; a prefix of its text would not
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((day < F.lit("1995-03-01").cast("timestamp")) | (day >= F.lit("1995-04-01").cast("timestamp"))).select("o_orderkey")


TAGS_SQL = "(SELECT p_partkey, string_split(p_type, ' ') AS tags FROM part)"


@query("SELECT p_partkey FROM part WHERE list_has_all(string_split(p_type, ' '), string_split((SELECT min(p_type) FROM part), ' ')[1:1])")
def tags_all_of(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    first = parts.agg(F.min("p_type")).first()[0]
    return parts.where(L.has_tags(F.split("p_type", " "), [(first or "").split(" ")[0]])).select("p_partkey")


@query(f"SELECT tag, count(*) AS used FROM (SELECT unnest(tags) AS tag FROM {TAGS_SQL}) GROUP BY tag")
def tag_counts(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("used"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: trim(x)), '|') AS raw_tags, len(list_distinct(list_filter(string_split(p_name, ' '), lambda x: trim(x) <> '' AND length(trim(x)) <= 20))) AS n_tags FROM part")
def tags_cleaned(spark, sf_dir):
    tags = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(tags, lambda t: F.trim(t)), "|").alias("raw_tags"), F.size(L.clean_tags(tags)).cast("long").alias("n_tags"))


@query("SELECT c_custkey, c_name, n_name AS department_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def users_with_departments(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("department_name"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left").select("c_custkey", "c_name", "department_name")


@query(f"""SELECT doc_id, coalesce(k.kb_name, d.kb_id) AS kb_name, coalesce(k.department, '') AS department FROM {DOCS_SQL} d
LEFT JOIN (SELECT DISTINCT source AS kb_id, 'Base ' || source AS kb_name, CASE WHEN source < 'src15' THEN 'north' ELSE 'south' END AS department FROM documents WHERE source <> 'src3') k ON d.kb_id = k.kb_id""")
def docs_with_bases(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "kb_id")
    bases = d.where("kb_id <> 'src3'").select("kb_id").distinct().select("kb_id", F.concat(F.lit("Base "), F.col("kb_id")).alias("kb_name"), F.when(F.col("kb_id") < "src15", "north").otherwise("south").alias("department"))
    return d.join(bases, "kb_id", "left").select("doc_id", F.coalesce("kb_name", "kb_id").alias("kb_name"), F.coalesce("department", F.lit("")).alias("department"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (1, 2, 3, 5, 8)")
def sessions_visible(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(L.visible(F.col("conv_id"), [1, 2, 3, 5, 8])).select("conv_id").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def orders_page(spark, sf_dir):
    return L.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 50)


@query(f"SELECT kb_id, count(*) FILTER (NOT deleted) AS docs, coalesce(sum(n_chars) FILTER (NOT deleted AND status = 'ingested'), 0)::BIGINT AS chars FROM {DOCS_SQL} GROUP BY kb_id")
def docs_per_base(spark, sf_dir):
    live = ~F.col("deleted")
    return documents(spark, sf_dir).groupBy("kb_id").agg(F.count_if(live).alias("docs"), F.coalesce(F.sum(F.when(live & (F.col("status") == "ingested"), F.col("n_chars"))), F.lit(0)).cast("long").alias("chars"))


@query(f"""SELECT (SELECT count(DISTINCT kb_id) FROM {DOCS_SQL}) AS bases, (SELECT count(*) FROM {DOCS_SQL} WHERE NOT deleted) AS docs,
(SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM conversations) AS messages""")
def system_stats(spark, sf_dir):
    d = documents(spark, sf_dir).agg(F.count_distinct("kb_id").alias("bases"), F.count_if(~F.col("deleted")).alias("docs"))
    c = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("sessions"), F.count("*").alias("messages"))
    return d.join(F.broadcast(c))  # one row each


@query(f"""SELECT CASE WHEN kb_id < 'src15' THEN 'north' ELSE 'south' END AS department, kb_id, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM {DOCS_SQL} WHERE NOT deleted GROUP BY ALL""")
def docs_grouped(spark, sf_dir):
    d = documents(spark, sf_dir).where("NOT deleted").withColumn("department", F.when(F.col("kb_id") < "src15", "north").otherwise("south"))
    return d.groupBy("department", "kb_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""WITH d AS (SELECT doc_id, source || '-' || lang AS stem, doc_id % 3 = 0 AS held, (doc_id // 3) % 4 AS k FROM documents), taken AS (SELECT DISTINCT stem, k FROM d WHERE held),
fresh AS (SELECT doc_id, stem, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS n FROM d WHERE NOT held), most AS (SELECT stem, max(n) + 4 AS m FROM fresh GROUP BY stem),
free AS (SELECT f.stem, f.k, row_number() OVER (PARTITION BY f.stem ORDER BY f.k) AS n FROM (SELECT stem, unnest(range(0, m)) AS k FROM most) f LEFT JOIN taken t ON t.stem = f.stem AND t.k = f.k WHERE t.k IS NULL)
SELECT doc_id, fresh.stem || CASE WHEN free.k > 0 THEN '(' || free.k || ')' ELSE '' END || '.md' AS file_name FROM fresh JOIN free USING (stem, n)""")
def file_names(spark, sf_dir):
    """New documents get names that neither their base nor another new one holds: a(1).md, where that is held a(2).md, and so on."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("stem"), F.expr("(doc_id div 3) % 4").alias("k"))
    held = d.where("doc_id % 3 = 0").select(F.concat("stem", F.when(F.col("k") > 0, F.concat(F.lit("("), F.col("k").cast("string"), F.lit(")"))).otherwise(""), F.lit(".md")).alias("name"))
    return L.free_names(d.where("doc_id % 3 <> 0").select("doc_id", F.concat("stem", F.lit(".md")).alias("name")), held, "doc_id").select("doc_id", F.col("name").alias("file_name"))


@query(f"SELECT kb_id, name, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, kb_id, lang || '-' || (n_chars % 50) || '.md' AS name FROM {DOCS_SQL} WHERE NOT deleted) GROUP BY kb_id, name HAVING count(*) > 1")
def same_names(spark, sf_dir):
    """Documents of a base that bear the same name."""
    d = documents(spark, sf_dir).where("NOT deleted").select("doc_id", "kb_id", F.concat("lang", F.lit("-"), (F.col("n_chars") % 50).cast("string"), F.lit(".md")).alias("name"))
    return d.groupBy("kb_id", "name").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT text_key, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, md5(text) AS text_key FROM documents) GROUP BY text_key HAVING count(*) > 1")
def same_documents(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_key"))
    return keys.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"""SELECT d.doc_id, d.status, CASE WHEN d.doc_id % 11 = 0 THEN 'failed' ELSE d.status END AS new_status FROM {DOCS_SQL} d WHERE NOT deleted""")
def recovered_states(spark, sf_dir):
    """After a restart, documents still in work become failed."""
    stuck = F.col("doc_id") % 11 == 0
    return documents(spark, sf_dir).where("NOT deleted").select("doc_id", "status", F.when(stuck, "failed").otherwise(F.col("status")).alias("new_status"))


@query(f"SELECT doc_id, kb_id FROM {DOCS_SQL} WHERE kb_id NOT IN (SELECT kb_id FROM {DOCS_SQL} GROUP BY kb_id HAVING count(*) FILTER (status = 'failed') > 9)")
def purge_cascade(spark, sf_dir):
    """What stays when bases with more than nine failed documents are deleted with all they hold."""
    d = documents(spark, sf_dir).select("doc_id", "kb_id", "status")
    gone = d.groupBy("kb_id").agg(F.count_if(F.col("status") == "failed").alias("failed")).where("failed > 9")
    return d.join(gone, "kb_id", "left_anti").select("doc_id", "kb_id")


@query("""SELECT n_nationkey, count(c_custkey) AS users, 'referenced' AS problem FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
UNION ALL SELECT n_nationkey, 0 AS users, 'no users' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def department_violations(spark, sf_dir):
    """Departments that may not be deleted since users refer to them, and those without any."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    users = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("users"))
    return n.join(users, "n_nationkey", "left").select("n_nationkey", F.coalesce("users", F.lit(0)).alias("users"), F.when(F.col("users").isNull(), "no users").otherwise("referenced").alias("problem"))


@query("""SELECT c_custkey, CASE WHEN length(c_name) > 8 THEN c_name[1:4] || '****' || right(c_name, 4) WHEN c_name = '' THEN '' ELSE '****' END AS masked,
CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || (c_custkey % 200) ELSE 'peer' END AS ip FROM customer""")
def masked_keys(spark, sf_dir):
    forwarded = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" 10.0.0."), (F.col("c_custkey") % 200).cast("string"), F.lit(", 10.1.1.1")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.masked_key(F.col("c_name")).alias("masked"), T.client_ip(forwarded, F.lit("peer")).alias("ip"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_chars FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), F.length(T.escaped_html(F.col("html"))).cast("long").alias("escaped_chars"))


@query()
def page_bodies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_body(F.col("html")).alias("body"))
