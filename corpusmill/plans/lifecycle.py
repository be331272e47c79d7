"""Queries of access, ingestion, rebuild, renaming and upkeep, and of what prompts are made of."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import sign_histogram
from ..operators import alignment as A
from ..operators import chunking as C
from ..operators import lifecycle as X
from ..operators import listing as L
from ..operators import prompts as P
from ..sources.tables import table
from .metadata import DOCS_SQL, documents
from .registry import query


@query("""SELECT c_custkey, s_suppkey, role = 'super_admin' OR c_nationkey = s_nationkey AS reads, role = 'super_admin' OR (role = 'dept_admin' AND c_nationkey = s_nationkey) AS manages
FROM (SELECT *, CASE WHEN c_custkey % 97 = 0 THEN 'super_admin' WHEN c_custkey % 5 = 0 THEN 'dept_admin' ELSE 'user' END AS role FROM customer) JOIN supplier ON s_suppkey = c_custkey % 10 + 1""")
def access_rights(spark, sf_dir):
    """What each user may do with a base: suppliers stand for bases, nations for departments."""
    role = F.when(F.col("c_custkey") % 97 == 0, "super_admin").when(F.col("c_custkey") % 5 == 0, "dept_admin").otherwise("user")
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("department"), role.alias("role"), (F.col("c_custkey") % 10 + 1).alias("s_suppkey"))
    bases = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("base"))
    both = users.join(bases, "s_suppkey")
    rights = [f(F.col("base"), F.col("role"), F.col("department")) for f in (X.readable, X.manageable)]
    return both.select("c_custkey", "s_suppkey", rights[0].alias("reads"), rights[1].alias("manages"))


_RENAME_SQL = f"""(SELECT doc_id, kb_id, doc_id || '.md' AS name, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'new ' || doc_id % 40 WHEN 2 THEN doc_id || '.txt' WHEN 3 THEN doc_id || '.MD' WHEN 4 THEN (doc_id + 30) || '.md' ELSE 'same' END AS wanted FROM {DOCS_SQL})"""


@query(f"""WITH n AS (SELECT doc_id, kb_id, wanted, CASE WHEN doc_id % 6 IN (1, 5) THEN wanted || '.md' WHEN wanted = '' THEN '.md' ELSE wanted END AS new_name FROM {_RENAME_SQL}),
o AS (SELECT n.*, EXISTS (SELECT 1 FROM {_RENAME_SQL} d WHERE d.kb_id = n.kb_id AND d.name = n.new_name AND d.doc_id <> n.doc_id) AS taken, min(doc_id) OVER (PARTITION BY kb_id, new_name) AS f FROM n)
SELECT doc_id, new_name, CASE WHEN wanted = '' THEN 'empty' WHEN doc_id % 6 = 2 THEN 'other extension' WHEN taken OR f < doc_id THEN 'taken' END AS problem FROM o""")
def renamings(spark, sf_dir):
    n, text = F.col("doc_id"), F.col("doc_id").cast("string")
    d = documents(spark, sf_dir).select("doc_id", "kb_id", F.concat(text, F.lit(".md")).alias("name"))
    wanted = F.when(n % 6 == 0, "").when(n % 6 == 1, F.concat(F.lit(" new "), (n % 40).cast("string"))).when(n % 6 == 2, F.concat(text, F.lit(".txt"))).when(n % 6 == 3, F.concat(text, F.lit(".MD"))).when(n % 6 == 4, F.concat((n + 30).cast("string"), F.lit(".md"))).otherwise("same")
    return X.renamed(d, d.select("doc_id", wanted.alias("wanted")))


@query(r"""SELECT d.doc_id, CASE WHEN e IS NULL THEN 'ingested' ELSE 'failed' END AS status, e AS error, n AS chunks FROM (
SELECT doc_id, CASE WHEN trim(text) = '' OR text IS NULL THEN 'no text' WHEN n = 0 THEN 'no chunks' END AS e, n FROM (SELECT doc_id, text, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '\S'))) AS n FROM documents)) d""")
def ingestion_report(spark, sf_dir):
    """Every document through chunking and embedding, its lines as chunks."""
    chunk = lambda d: C.chunked(d, "doc_id", "text", partial(C.regex_spans, pattern=r"\n+"))
    d = documents(spark, sf_dir).select("doc_id", "kb_id", "text")
    return X.ingested(d, chunk, sign_histogram, 64)[1]


@query(f"SELECT doc_id, 1::BIGINT AS done, CASE WHEN false THEN '' END AS error FROM {DOCS_SQL} WHERE status = 'ingested' AND (doc_id % 4 <> 1 OR doc_id % 8 = 1 AND text <> '') UNION ALL SELECT doc_id, 0, 'no text' FROM {DOCS_SQL} WHERE status = 'ingested' AND doc_id % 4 = 1 AND NOT (doc_id % 8 = 1 AND text <> '')")
def rebuild_report(spark, sf_dir):
    """Vectors made anew from the old ones' texts, else from chunks; some documents have neither."""
    d = documents(spark, sf_dir)
    vectors = d.where("doc_id % 4 <> 1").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    chunks = d.where("doc_id % 8 = 1").select("doc_id", F.lit(0).alias("chunk_index"), "text", F.lit("about").alias("context"))
    return X.rebuilt(vectors, chunks, d.select("doc_id", "status"), sign_histogram)[1]


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 14 DAY")
def retained_log(spark, sf_dir):
    """Log entries of the last fourteen days."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    last = e.agg(F.max("day").alias("_last"))  # one row
    return X.retained(e.join(F.broadcast(last)), "day", F.col("_last"), 14).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("SELECT conv_id AS dataset_id, CASE WHEN turn > 2 THEN turn - 1 ELSE turn END AS idx, CASE WHEN turn = 1 THEN 'changed' ELSE role END AS question FROM conversations WHERE turn <> 2 UNION ALL SELECT conv_id, count(*) FILTER (turn <> 2), 'added' FROM conversations GROUP BY conv_id")
def dataset_changes(spark, sf_dir):
    """Datasets whose second sample is changed, whose third is gone and that got one more."""
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dataset_id"), F.col("turn").alias("idx"), F.col("role").alias("question"))
    more = s.select("dataset_id").distinct().select("dataset_id", F.lit("added").alias("question"), F.lit(0).alias("n"))
    changed = X.without_sample(X.changed_sample(s, 1, {"question": F.lit("changed")}), 2)
    return X.with_sample(changed, more).select("dataset_id", "idx", "question")


@query("""SELECT id, name, department_id FROM (SELECT *, row_number() OVER (PARTITION BY department_id, name ORDER BY id) AS r FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS name, p_size % 5 AS department_id FROM part))
WHERE r = 1 AND name <> '' AND (department_id, name) NOT IN (SELECT s_suppkey % 5, 'Brand#' || (s_suppkey % 60) FROM supplier)""")
def migrated_bases(spark, sf_dir):
    """Bases of an old store that the table has not yet, each name of a department once."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.col("p_brand")).alias("name"), (F.col("p_size") % 5).cast("long").alias("department_id"))
    have = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).cast("long").alias("department_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("name"))
    return X.migrated(old, have).select("id", "name", "department_id")


@query("""WITH l AS (SELECT doc_id AS line, doc_id % 6 AS k, lang FROM documents), g AS (SELECT line FROM l WHERE k IN (2, 3, 4) ORDER BY line LIMIT 1 OFFSET 99)
SELECT line, CASE WHEN k IN (2, 3, 4) THEN 'q' || line END AS question, CASE WHEN k IN (2, 3, 4) THEN lang END AS ground_truth, CASE k WHEN 1 THEN 'no answer ' || line WHEN 5 THEN 'only' END AS problem FROM l WHERE k <> 0 AND line <= coalesce((SELECT line FROM g), 1e18)""")
def text_samples(spark, sf_dir):
    """Evaluation samples from lines of text; a report of at most a hundred, as the operator reads them."""
    n, q = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    value = F.when(n == 0, F.concat(F.lit("# note "), q)).when(n == 1, F.concat(F.lit("no answer "), q)).when(n == 5, F.lit("only\t")).otherwise(F.concat(F.lit("q"), q, F.lit("\t "), F.col("lang"), F.lit("\r")))
    return X.samples_of_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), value.alias("value")))


@query("""SELECT user_id, event_id, turn >= 5 + last OR gap >= 1800 OR last = 0 AS allowed FROM (SELECT user_id, event_id, row_number() OVER w AS turn, (row_number() OVER w) // 7 * 7 AS last, epoch(ts) - epoch(coalesce(lag(ts) OVER w, ts)) AS gap FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def extraction_gate(spark, sf_dir):
    """When a user's profile may be extracted again: rounds since the last seventh, and the time since the round before."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.date_trunc("second", "ts").alias("ts"))
    e = e.withColumns({"turn": F.row_number().over(w), "before": F.lag("ts").over(w)})
    return e.select("user_id", "event_id", X.may_extract(F.col("turn"), F.floor(F.col("turn") / 7) * 7, F.col("ts"), F.col("before")).alias("allowed"))


@query("SELECT o_orderkey AS task_id, CASE WHEN len(s) > 0 THEN floor(list_sum(s) / len(s) * (6 - len(s)))::INTEGER END AS seconds_left FROM (SELECT o_orderkey, list_transform(range(0, o_orderkey % 6), lambda i: (o_custkey % 50 + i) / 2.0) AS s FROM orders)")
def evaluation_eta(spark, sf_dir):
    """The time that is left of evaluations with some of six metrics done."""
    done = F.when(F.col("o_orderkey") % 6 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 6 - 1), lambda i: (F.col("o_custkey") % 50 + i) / 2.0)).otherwise(F.array().cast("array<double>"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), X.seconds_left(done, F.lit(6)).alias("seconds_left"))


_SOURCES_SQL = """(SELECT conv_id AS query_id, turn + 1 AS rank, 'doc ' || turn AS document_name, text, CASE WHEN turn % 3 = 1 THEN 'parent of ' || text ELSE '' END AS parent_text, CASE WHEN turn % 2 = 0 THEN 'on ' || role END AS context FROM conversations)"""


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, CASE WHEN parent_text <> '' THEN parent_text ELSE text END AS whole FROM {_SOURCES_SQL}),
r AS (SELECT query_id, string_agg('[引用 ' || n || ']（来源：' || document_name || '）' || chr(10) || CASE WHEN context <> '' THEN '【上下文】' || context || chr(10) ELSE '' END || substring(whole, 1, 6000), chr(10) || chr(10) ORDER BY n) AS refs FROM s GROUP BY query_id)
SELECT query_id, CASE query_id % 3 WHEN 0 THEN refs WHEN 1 THEN 'Use ' || refs || ' for u' || query_id ELSE 'Be brief.' || chr(10) || chr(10) || '回答中引用资料时，请在句末以 [n] 标注对应的引用编号。' || chr(10) || 'u' || query_id || chr(10) || chr(10) || '[引用]' || chr(10) || refs END AS system FROM r""".replace("WHEN 0 THEN refs", "WHEN 0 THEN 'u' || query_id || chr(10) || chr(10) || refs"))
def system_texts(spark, sf_dir):
    """The system text of each conversation, its turns as sources."""
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.concat(F.lit("doc "), F.col("turn").cast("string")).alias("document_name"), F.lit(0).alias("doc_id"), "text",
                 F.when(F.col("turn") % 3 == 1, F.concat(F.lit("parent of "), "text")).otherwise("").alias("parent_text"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("on "), "role")).alias("context"))
    template = F.when(F.col("query_id") % 3 == 0, " ").when(F.col("query_id") % 3 == 1, "Use {refs} for {memory}").otherwise("Be brief.")
    memory = F.concat(F.lit("u"), F.col("query_id").cast("string"))
    return P.reference_texts(s).select("query_id", P.system_text(template, F.col("refs"), F.col("knowledge"), memory).alias("system"))


@query("""WITH t AS (SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || role || '：' || substring(trim(text), 1, 2000), chr(10) ORDER BY turn) AS l, count(*) AS k FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, trim('answer ' || conv_id || chr(10) || chr(10) || '引用来源：' || chr(10) || l) AS t FROM t) SELECT conv_id, CASE WHEN length(t) > 1000 THEN substring(t, 1, 988) || '……（结果过长，已截断）' ELSE t END AS result FROM r""")
def result_texts(spark, sf_dir):
    """An answer with its sources as one text of at most a thousand signs."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("document_name"), "text"))).alias("s"))
    return c.select("conv_id", P.result_text(F.concat(F.lit("answer "), F.col("conv_id").cast("string")), F.col("s"), most=1000).alias("result"))


@query("SELECT doc_id, CASE WHEN n_chars * 20 >= 10000 THEN ((n_chars * 20 + 500) // 1000 // 10) || '.' || ((n_chars * 20 + 500) // 1000 % 10) || ' 万字' ELSE (n_chars * 20) || ' 字' END AS label, substring(CASE WHEN doc_id % 2 = 0 THEN '【上下文】in ' || lang || chr(10) || text ELSE text END, 1, 8000) AS embedded, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'common' END AS setting FROM documents")
def small_labels(spark, sf_dir):
    """Size labels, texts to embed and merged settings of documents."""
    d = table(spark, sf_dir, "documents")
    context, own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" in "), "lang")), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" ")
    return d.select("doc_id", T.chinese_count(F.col("n_chars") * 20).alias("label"), T.embedding_text(context, F.col("text")).alias("embedded"), T.merged_setting(own, F.lit("common")).alias("setting"))


@query("""WITH s AS (SELECT conv_id, string_agg(role || '：' || rtrim(substring(text, 1, 200)), chr(10) ORDER BY turn) AS sources, list_distinct(flatten(list(CASE WHEN turn % 2 = 0 THEN ['/api/files/images/' || turn || '.png'] ELSE [] END))) AS i FROM conversations GROUP BY conv_id)
SELECT conv_id AS query_id, 'answer ' || conv_id AS answer, sources, array_to_string(list_sort(i), ' ') AS images FROM s""")
def external_answers(spark, sf_dir):
    """What callers from outside get of each conversation, its turns as sources with images."""
    c = table(spark, sf_dir, "conversations")
    image = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ![x](/api/files/images/"), F.col("turn").cast("string"), F.lit(".png)"))).otherwise("")
    s = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("document_name"), F.concat(F.rpad("text", 200, " "), F.substring("text", 201, 1 << 30), image).alias("text"), F.lit("").alias("parent_text"))
    answers = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("answer", F.concat(F.lit("answer "), F.col("query_id").cast("string")))
    found = P.external_results(answers, s, most_source=200)
    line = lambda x: F.concat(x["document_name"], F.lit("："), F.rtrim(x["text"]))
    return found.select("query_id", "answer", F.array_join(F.transform("sources", line), "\n").alias("sources"), F.array_join(F.array_sort("images"), " ").alias("images"))


@query("SELECT o_orderkey AS task_id, o_orderstatus AS status, c_name AS kb_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def evaluation_tasks(spark, sf_dir):
    """Evaluations with what is known here of who started them."""
    own = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("kb_name"))
    return table(spark, sf_dir, "orders").join(own, "o_custkey", "left").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), "kb_name")


@query(r"""WITH l AS (SELECT doc_id, p, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(p, '\S'))
SELECT doc_id, n::INTEGER AS chunk_index, substring(p, 1, 500) AS text FROM l WHERE n < 20""")
def chunk_previews(spark, sf_dir):
    """What a list shows of each document: twenty chunks of 500 signs, as the operator's report has it."""
    chunks = C.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", partial(C.regex_spans, pattern=r"\n+"))
    return P.preview(chunks, "doc_id").select("doc_id", "chunk_index", "text")


@query("SELECT user_id AS query_id, event_id % 50 AS doc_id, event_id % 3 AS chunk_index, min(event_id) AS rank FROM events GROUP BY ALL")
def distinct_hits(spark, sf_dir):
    """Of each query's hits one a document and chunk, the best."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 50).alias("doc_id"), (F.col("event_id") % 3).alias("chunk_index"), F.col("event_id").alias("rank"))
    return P.first_of_chunks(e)


@query()
def answer_highlights(spark, sf_dir):
    """Ranges of the question before it that each answer has too."""
    from pyspark.sql import Window

    talk = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("pair"), "role", "text", F.lag("text").over(talk).alias("before"))
    return A.highlights(pairs.where("role = 'assistant' AND before IS NOT NULL"), "pair", "text", "before")


@query()
def aligned_chunks(spark, sf_dir):
    """Every second line of a document as a model's piece, its white space changed, put back to the text."""
    pieces = F.transform(F.filter(F.split("text", "\n"), lambda l, i: i % 2 == 1), lambda l: F.regexp_replace(l, r"\s+", "  "))  # noqa: E741
    return A.aligned_chunks(table(spark, sf_dir, "documents").withColumn("pieces", pieces), "doc_id", "text", "pieces")


@query("""SELECT conv_id, string_agg('**' || role || '** ' || text || CASE WHEN turn % 2 = 1 THEN chr(10) || chr(10) || '> [1] ' || role || '：' || substring(text, 1, 500) || chr(10) || chr(10) || '> [2] more：x' ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def cited_sessions(spark, sf_dir):
    """Conversations as Markdown, answers with numbered sources."""
    of = F.array(F.struct(F.col("role").alias("document_name"), "text"), F.struct(F.lit("more").alias("document_name"), F.lit("x").alias("text")))
    return P.session_markdown(table(spark, sf_dir, "conversations").withColumn("sources", F.when(F.col("turn") % 2 == 1, of)))


@query("SELECT 'several admins' AS problem, c_nationkey AS department_id, count(*) AS n FROM customer WHERE c_custkey % 7 = 0 GROUP BY c_nationkey HAVING count(*) > 1 UNION ALL SELECT 'no active super admin', NULL, 0")
def user_violations(spark, sf_dir):
    role = F.when(F.col("c_custkey") % 7 == 0, "dept_admin").when(F.col("c_custkey") % 11 == 0, "super_admin").otherwise("user")
    return X.user_violations(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"), F.when(F.col("c_custkey") % 11 == 0, "disabled").otherwise("active").alias("status"), F.col("c_nationkey").alias("department_id")))


@query("SELECT c_custkey AS config_id, k AS kb_id FROM (SELECT c_custkey, unnest(list_distinct([c_nationkey, c_nationkey + 3, c_nationkey + 9])) AS k FROM customer) WHERE k NOT IN (SELECT n_nationkey FROM nation)")
def unknown_bases(spark, sf_dir):
    """Bases that configurations name and that are not there."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("config_id"), F.array(F.col("c_nationkey"), F.col("c_nationkey") + 3, F.col("c_nationkey") + 9).alias("kb_ids"))
    return L.unknown_bases(c, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kb_id")))


@query(f"SELECT doc_id, kb_id, total FROM (SELECT *, (SELECT count(*) FROM {DOCS_SQL} WHERE deleted) AS total FROM {DOCS_SQL} WHERE deleted ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20)")
def trash_page(spark, sf_dir):
    """The second page of the trash with its total, last deleted first: a document's length stands for the time."""
    d = documents(spark, sf_dir).select("doc_id", "kb_id", "deleted", F.col("n_chars").alias("deleted_at"))
    return L.paged(L.listed(d, trash=True), [F.desc("deleted_at"), F.asc("doc_id")], 2, 20).select("doc_id", "kb_id", "total")
