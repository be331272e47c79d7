"""Filter interaction audit: what each filter removes in every order, by a walk over the trie of permutations.

A node of the trie is an order of some filters, but its survivors depend on their set alone, so each
unordered set of filters is one state: a DataFrame of the rows that passed them, made from its parent's by
one more filter and persisted while the walk is below it. The walk is depth first, at most one state a
level is held, and a state that was met by another order is not made again. One aggregate over a state's
survivors counts what each filter not yet applied removes there, so every edge is counted on the rows that
the filters before it left. The counts go to a table, a row for each part and edge; orders are rows that
are joined to it, their number depends on the number of filters alone.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import fresh_path, written
from .quality_rules import let, words_of

#: More filters have too many orders to be looked at: 7 have 5,040.
MOST_FILTERS = 7


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What filters of texts look at, one slim row per document: id, part, n_words, n_distinct, n_upper, n_chars, symbol, digest.

    Words are runs without ASCII white space; a null text is empty, a null part the empty string. Other columns are not read.
    """
    words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("words", words).select(
        "id",
        "part",
        F.col("words.n").alias("n_words"),
        F.col("words.distinct").alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length("text").cast("long").alias("n_chars"),
        F.col("text").rlike("[#$%&*|]").alias("symbol"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def with_repeated(rows: DataFrame) -> DataFrame:
    """Adds repeated: a smaller id has the same digest. ``rows``: id, digest, a table, since it is read more than once.

    Rows of equal id and digest do not repeat one another; a null id neither repeats nor is repeated. The
    join is by digest and id, so a text that very many ids bear is spread over the tasks.
    """
    firsts = written(rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")), "firsts").withColumn("_first", F.lit(True))
    known = rows.where("id IS NOT NULL").join(firsts, ["digest", "id"], "left").withColumn("repeated", F.col("_first").isNull()).drop("_first")
    return known.unionByName(rows.where("id IS NULL").withColumn("repeated", F.lit(False)))


def with_marks(rows: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Adds a boolean for each of ``marks``: a row of ``labels`` with that id has it. A null id has no marks.

    ``labels``: id and what the marks look at; an id may stand there more than once.
    """
    told = written(labels.where("id IS NOT NULL").groupBy("id").agg(*(F.max(F.coalesce(c, F.lit(False))).alias(m) for m, c in marks.items())), "marks")
    known = rows.where("id IS NOT NULL").join(told, "id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})
    return known.unionByName(rows.where("id IS NULL").withColumns({m: F.lit(False) for m in marks}))


def _walk(root: DataFrame, names: list[str], marks: list[str], path: str) -> None:
    """Appends to ``path`` part, mask (of the filters before), f, rows (there), removed and a count of each mark removed, for every edge met."""
    met = set()

    def visit(mask: int, survivors: DataFrame) -> None:
        met.add(mask)
        ahead = [i for i in range(len(names)) if not mask >> i & 1]
        if not ahead:
            return
        counted = [F.count_if(f"fails_{i}").alias(f"removed_{i}") for i in ahead]
        counted += [F.count_if(F.col(f"fails_{i}") & F.col(f"mark_{k}")).alias(f"lost_{i}_{k}") for i in ahead for k in range(len(marks))]
        sums = survivors.groupBy("part").agg(F.count("*").alias("rows"), *counted)
        edge = lambda i: F.struct(F.lit(i).alias("f"), F.col(f"removed_{i}").alias("removed"), *(F.col(f"lost_{i}_{k}").alias(f"lost_{k}") for k in range(len(marks))))
        edges = sums.select("part", F.lit(mask).alias("mask"), "rows", F.explode(F.array(*map(edge, ahead))).alias("edge")).select("part", "mask", "rows", "edge.*")
        edges.write.mode("append").parquet(path)
        for i in ahead:
            if mask | 1 << i not in met:
                left = survivors.where(f"NOT fails_{i}").persist(StorageLevel.MEMORY_AND_DISK)
                visit(mask | 1 << i, left)
                left.unpersist()

    visit(0, root)


def audit(rows: DataFrame, filters: dict[str, Column], part_col: str, marks: dict[str, Column] | None = None) -> DataFrame:
    """What every order of ``filters`` removes at each step, by part.

    ``filters``: by name of one sign, where it is true a row fails (null: it passes). ``marks``: what is counted
    apart among the removed rows (null: not marked). Returns for each part, order and step: part, filter_order,
    step (from 1), kept, removed, redundant (rows that fail the filter and were removed before), unique_fails
    (that fail it alone), ``<mark>_lost`` for each mark, and shapley, the filter's removed summed over all orders.
    A part has all its orders, with zeros where no row is left; an empty table gives an empty result. Repeated
    rows count each. ``rows`` is read once; columns of any name may be in it.
    """
    names, marks = list(filters), marks or {}
    n = len(names)
    if not 1 <= n <= MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"from 1 to {MOST_FILTERS} filters with names of one sign, not {names}")
    said = [F.coalesce(c, F.lit(False)) for c in [*filters.values(), *marks.values()]]
    flags = [f"fails_{i}" for i in range(n)] + [f"mark_{k}" for k in range(len(marks))]
    root = written(rows.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), *(c.alias(a) for c, a in zip(said, flags, strict=True))), "audited")
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "edges")
    lost = [f"lost_{k}" for k in range(len(marks))]
    _walk(root, names, list(marks), path)
    schema = "part string, mask int, rows long, f int, removed long" + "".join(f", {x} long" for x in lost)
    counted = spark.read.schema(schema).parquet(path)

    # every edge of every part: a part that has no survivors in a state was not counted there
    every = F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(i).alias("f")) for m in range(1 << n) for i in range(n) if not m >> i & 1))
    parts = counted.where("mask = 0 AND f = 0").select("part", F.explode(every).alias("edge")).select("part", "edge.*")
    edges = parts.join(counted, ["part", "mask", "f"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ["rows", "removed", *lost]})
    # an edge is part of as many orders as there are orders before and after it
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("mask") + 1)
    bit = F.expr("shiftleft(1, f)")
    alone = (F.col("mask") == (1 << n) - 1 - bit).cast("long")
    of_filter = edges.groupBy("part", "f").agg(
        F.sum(F.col("removed") * weight).alias("shapley"), F.sum(F.col("removed") * alone).alias("unique_fails"), F.sum(F.when(F.col("mask") == 0, F.col("removed"))).alias("fails")
    )
    steps = [("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, mask int, f int")  # n! * n rows, whatever the input
    out = edges.join(of_filter, ["part", "f"]).join(F.broadcast(orders), ["mask", "f"])
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *(F.col(x).alias(f"{m}_lost") for x, m in zip(lost, marks, strict=True)),
        "shapley",
    )
