"""What a model and a reader are given: numbered references, system texts, results, previews, profiles of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chinese_count, is_numbered_heading
from .alignment import image_urls
from .chunking import pieces_of, question_statistics
from .structure import headings

# The rule on citations that goes before references a template has no place for.
CITATION_RULE = "回答中引用资料时，请在句末以 [n] 标注对应的引用编号。"


def reference_texts(sources: DataFrame, most_chars: int = 6_000) -> DataFrame:
    """query_id, refs, knowledge of ranked sources (query_id, rank, document_name, doc_id, text, parent_text, context).

    Sources are numbered from 1 in order of rank; the parent's text stands for the chunk's, cut at ``most_chars``
    in the references; a summary goes before a text that does not begin with one. Knowledge has the whole
    texts without numbers, blank ones left out.
    """
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    whole = F.coalesce(F.nullif("parent_text", F.lit("")), "text")
    cut = F.substring(whole, 1, most_chars)
    told = F.when((F.coalesce("context", F.lit("")) != "") & ~cut.startswith("【上下文】"), F.concat(F.lit("【上下文】"), "context", F.lit("\n"), cut)).otherwise(cut)
    head = F.format_string("[引用 %d]（来源：%s）\n", F.col("n"), F.coalesce(F.nullif("document_name", F.lit("")), F.col("doc_id").cast("string")))
    rows = sources.withColumn("n", n).select("query_id", F.struct("n", F.concat(head, told).alias("ref"), whole.alias("whole")).alias("s"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return listed.select("query_id", F.array_join(F.col("l.ref"), "\n\n").alias("refs"), F.array_join(F.filter("l.whole", lambda t: F.trim(t) != ""), "\n\n").alias("knowledge"))


def system_text(template: Column, refs: Column, knowledge: Column, memory: Column, default: str = "{refs}") -> Column:
    """A system text: {memory}, {knowledge} and {refs} replaced where the template has them.

    A template without a place for references gets the citation rule, the memory it has no place for and the
    references at its end; an empty one is ``default``, the memory before the references.
    """
    bare, memory = F.trim(F.coalesce(template, F.lit(""))), F.coalesce(memory, F.lit(""))
    block = F.when(memory != "", F.concat(memory, F.lit("\n\n"))).otherwise("")
    own = F.replace(F.replace(F.replace(bare, F.lit("{memory}"), memory), F.lit("{knowledge}"), knowledge), F.lit("{refs}"), refs)
    placed = bare.contains("{knowledge}") | bare.contains("{refs}")
    rest = F.when(bare.contains("{memory}"), F.lit("")).otherwise(block)
    appended = F.concat(F.replace(bare, F.lit("{memory}"), memory), F.lit(f"\n\n{CITATION_RULE}\n"), rest, F.lit("[引用]\n"), refs)
    return F.when(bare == "", F.replace(F.lit(default), F.lit("{refs}"), F.concat(block, refs))).when(placed, own).otherwise(appended)


def result_text(answer: Column, sources: Column, most: int = 6_000, most_source: int = 2_000) -> Column:
    """An answer and its numbered sources (array of document_name, text) as one text of at most ``most`` signs."""
    line = lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(F.nullif(s["document_name"], F.lit("")), F.lit("未知文档")), F.lit("："), F.substring(F.trim(F.coalesce(s["text"], F.lit(""))), 1, most_source))
    cited = F.when(F.size(sources) > 0, F.concat(F.lit("\n\n引用来源：\n"), F.array_join(F.transform(sources, line), "\n"))).otherwise("")
    text, mark = F.trim(F.concat(F.coalesce(answer, F.lit("")), cited)), "……（结果过长，已截断）"
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def preview(chunks: DataFrame, id_col: str, most: int = 20, most_chars: int = 500) -> DataFrame:
    """The first chunks of each document, cut: what a list shows."""
    return chunks.where(F.col("chunk_index") < most).withColumn("text", F.substring("text", 1, most_chars))


def first_of_chunks(hits: DataFrame) -> DataFrame:
    """One hit of each query's document and chunk, that of the best rank."""
    order = Window.partitionBy("query_id", "doc_id", "chunk_index").orderBy("rank")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def profiles(docs: DataFrame, id_col: str, text_col: str, threshold: int = 20_000) -> DataFrame:
    """What is known of each text before it is chunked, and the chunker to take: id, chars, label, over, headings, numbered, pairs, segments, is_qa, method, with_context.

    Questions and answers are kept whole (qa); a text with headings goes by sections (parent_child); others are
    cut plainly (naive), and get summaries of their context if they are not over ``threshold``.
    """
    lines = pieces_of(docs, id_col, text_col, r"\n")
    bare = F.regexp_replace("piece", r"(?U)^\s+|\s+$", "")
    numbered = lines.where((F.length(bare) <= 50) & is_numbered_heading(bare)).groupBy(id_col).agg(F.count("*").alias("numbered"))
    titled = headings(docs, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("headings"))
    chars = docs.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    rows = chars.join(titled, id_col, "left").join(numbered, id_col, "left").join(question_statistics(docs, id_col, text_col), id_col, "left").fillna(0, ["headings", "numbered"])
    structured = F.col("headings") + F.col("numbered") > 0
    method = F.when(F.col("valid"), "qa").when(structured, "parent_child").otherwise("naive")
    over = F.col("chars") > threshold
    return rows.select(id_col, "chars", chinese_count(F.col("chars")).alias("label"), over.alias("over"), "headings", "numbered", "pairs", "segments", F.col("valid").alias("is_qa"), method.alias("method"), ((method == "naive") & ~over).alias("with_context"))


def external_results(answers: DataFrame, sources: DataFrame, most: int = 4_000, most_source: int = 2_000) -> DataFrame:
    """What a caller from outside gets: query_id, answer (cut), sources (array of document_name, text, cut, in order of rank), images.

    ``answers``: query_id, answer; ``sources``: query_id, rank, document_name, text, parent_text. Images are the
    addresses in the whole texts of the sources, each once. Answers without sources have empty arrays.
    """
    whole = F.coalesce(F.nullif("parent_text", F.lit("")), "text")
    listed = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_name", F.substring(whole, 1, most_source).alias("text"), image_urls(whole).alias("images")))).alias("s"))
    joined = answers.join(listed, "query_id", "left")
    cut = F.coalesce(F.transform("s", lambda s: F.struct(s["document_name"].alias("document_name"), s["text"].alias("text"))), F.array().cast("array<struct<document_name:string,text:string>>"))
    images = F.coalesce(F.array_distinct(F.flatten(F.transform("s", lambda s: s["images"]))), F.array().cast("array<string>"))
    return joined.select("query_id", F.substring("answer", 1, most).alias("answer"), cut.alias("sources"), images.alias("images"))


def session_markdown(messages: DataFrame, snippet: int = 500) -> DataFrame:
    """conv_id, markdown of messages (conv_id, turn, role, text, sources: array of document_name, text): whole messages, each with its numbered sources, cut at ``snippet`` signs."""
    cited = F.transform(F.coalesce("sources", F.array().cast("array<struct<document_name:string,text:string>>")), lambda s, i: F.concat(F.lit("\n\n> ["), (i + 1).cast("string"), F.lit("] "), s["document_name"], F.lit("："), F.substring(s["text"], 1, snippet)))
    line = F.concat(F.lit("**"), "role", F.lit("** "), "text", F.array_join(cited, ""))
    listed = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))).alias("l"))
    return listed.select("conv_id", F.array_join(F.col("l.t"), "\n\n").alias("markdown"))
