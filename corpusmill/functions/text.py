"""Text functions as Column expressions: they stay in the JVM and take part in pushdown."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that the keyword index leaves out.
STOP_WORDS = """
的 了 和 是 在 有 我 你 他 她 它 这 那 就 都 而 及 与 着 或 又 也 还 为 对 于 从 把 被 让 向 以 之 其 此 一个 一种 我们 你们 他们 没有 什么 怎么 为什么 如何 以及 或者
因为 所以 如果 但是 然后 虽然 并且 因此 可以 需要
the a an and or of to in on for with is are was were be been being this that it as at by from not but do does did have has had will would can could should may might
about into over after before up down out off than then so also if else what which who when where how why just very more most some any
""".split()

#: Unicode white space at either end, which Spark's trim leaves.
_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(c, _ENDS, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` has it more than once."""
    return F.transform(F.array(value), use)[0]


def terms(c: Column, stop_words: list[str] = STOP_WORDS, least_chars: int = 2) -> Column:
    """Lower-case runs of letters and digits without stop words and short runs, in order; [] for null.

    Chinese has no blanks between words: a run of Han signs gives its pairs of neighbours.
    """
    text = F.lower(F.coalesce(c, F.lit("")))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    han = lambda t: F.when(t.rlike(r"^\p{IsHan}{2}"), pairs(t)).otherwise(F.array(t))
    mixed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0)), han))
    # all Han signs come after U+2E7F: a range is found faster than a script
    runs = F.when(text.rlike(r"[\x{2E80}-\x{10FFFF}]") & text.rlike(r"\p{IsHan}"), mixed).otherwise(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.filter(runs, lambda t: (F.length(t) >= least_chars) & ~t.isin(stop_words))


def normalized_name(c: Column) -> Column:
    """A name without outer white space, full-width signs made half-width, no white space between digits."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    narrow = "".join(map(chr, range(0x21, 0x7F))) + " "
    return F.regexp_replace(F.translate(strip(c), wide, narrow), r"(?<=\d)\s+(?=\d)", "")


def escaped_html(c: Column) -> Column:
    """&, <, > and double quotes as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first address of a forwarding header, else the peer's."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(peer)


def masked_key(c: Column) -> Column:
    """A key with all but its first and last four signs hidden; short ones are hidden whole."""
    return F.when(F.length(c) > 8, F.concat(F.substring(c, 1, 4), F.lit("****"), F.right(c, F.lit(4)))).when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.lit("****"))


def html_title(c: Column) -> Column:
    """The text of the first title element, stripped; empty if there is none."""
    return strip(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_body(c: Column) -> Column:
    """The visible text of a page: no scripts, styles, navigation or tags, blocks on lines of their own."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|nav|header|footer|noscript|title)\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|br|li|h[1-6]|tr|section|article)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def image_refs(c: Column) -> Column:
    """Distinct targets of Markdown images, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)))


def is_numbered_heading(line: Column) -> Column:
    """Lines such as ``1.2 Title``, ``3) Title``, ``Chapter 4``, ``第三章 Title`` or ``一、Title``."""
    return line.rlike(r"^\s*(\d+(\.\d+)*[.)]?\s+\S|(Chapter|Section|Part)\s+\d+|第[0-9一二三四五六七八九十百零]+[章节部分篇]|[一二三四五六七八九十]+、)")


@F.pandas_udf(StringType())
def _balanced(texts: pd.Series, opening: pd.Series) -> pd.Series:
    """The text from the first opening bracket to the one that closes it, brackets inside JSON strings apart."""

    def one(text: str | None, bracket: str) -> str | None:
        depth, closing = 0, {"{": "}", "[": "]"}[bracket]
        start = (text or "").find(bracket)
        for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[' + re.escape(bracket + closing) + "]", text[start:] if start >= 0 else "", re.DOTALL):
            depth += (m[0] == bracket) - (m[0] == closing)
            if not depth and m[0] == closing:
                return text[start : start + m.end()]
        return None

    return pd.Series([one(t, b) for t, b in zip(texts, opening, strict=True)], dtype=object)


def _recovered(c: Column, schema: str, opening: str) -> Column:
    fenced = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s)```(?:json)?\s*\n?(.*?)```"), F.lit(1))
    parsed = lambda t: F.from_json(F.trim(t), schema)
    # text that does not open as asked gives a row of nulls, not null
    sound = lambda t: F.when(F.trim(t).startswith(opening), parsed(t))
    blocks = F.filter(F.transform(fenced, sound), lambda x: x.isNotNull())
    return F.coalesce(F.get(blocks, F.lit(0)), sound(strip(c)), parsed(_balanced(c, F.lit(opening))))


def json_object(c: Column, schema: str) -> Column:
    """A struct from an answer of a model: a fenced block, else the whole, else the first balanced object in it; null for none."""
    return _recovered(c, schema, "{")


def entity_names(c: Column, most: int = 5, most_chars: int = 30) -> Column:
    """Names from a JSON list in an answer: normalized, cut, distinct, the first ``most``; [] for none. Only strings count."""
    items = F.filter(_recovered(c, "array<variant>", "["), lambda v: F.schema_of_variant(v) == "STRING")
    names = F.transform(items, lambda v: F.substring(normalized_name(F.variant_get(v, "$", "string")), 1, most_chars))
    kept = F.array_distinct(F.filter(names, lambda t: t.isNotNull() & (t != "")))
    return F.slice(F.coalesce(kept, F.array().cast("array<string>")), 1, most)


def chinese_count(n: Column) -> Column:
    """A number of signs as text: below 10,000 as it is, else in ten thousands with a digit after the point, halves up."""
    return F.when(n >= 10_000, F.format_string("%.1f 万字", n / 10_000)).otherwise(F.concat(n.cast("string"), F.lit(" 字")))


def embedding_text(context: Column, text: Column, most_chars: int = 8_000) -> Column:
    """What is embedded of a chunk: its summary before its text, cut at ``most_chars``."""
    bare = strip(F.coalesce(context, F.lit("")))
    return F.substring(F.when(bare != "", F.concat(F.lit("【上下文】"), bare, F.lit("\n"), text)).otherwise(text), 1, most_chars)


def valid_day(c: Column) -> Column:
    """Is the text a day as ``2024-01-31``?"""
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()


def day_of_path(path: Column) -> Column:
    """The day in the name of a log file, as a date; null if there is none."""
    return F.try_to_timestamp(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*$", 1), F.lit("yyyy-MM-dd")).cast("date")


def image_bytes(c: Column) -> Column:
    """The bytes of an image in base64, a data address before it or not; null if it is none."""
    return F.try_to_binary(F.regexp_replace(c, r"(?s)^data:[^,]*,", ""), F.lit("base64"))


def merged_setting(own: Column, common: Column) -> Column:
    """A department's setting where it has one that is not empty, else the common one."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), common)


def memory_items(c: Column) -> Column:
    """What an answer says of a user: an array of type, content and confidence (0 to 1); [] for none, items without content left out."""
    items = F.coalesce(_recovered(c, "items array<struct<type:string,content:string,confidence:double>>", "{")["items"], _recovered(c, "array<struct<type:string,content:string,confidence:double>>", "["))
    told = F.transform(items, lambda x: F.struct(x["type"].alias("type"), strip(x["content"]).alias("content"), clamped_confidence(x["confidence"]).alias("confidence")))
    return F.coalesce(F.filter(told, lambda x: F.coalesce(x["content"], F.lit("")) != ""), F.array().cast("array<struct<type:string,content:string,confidence:double>>"))


def clamped_confidence(c: Column) -> Column:
    """0 to 1; a missing or zero confidence counts as 0.5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(c)))
