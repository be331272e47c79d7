"""Document fingerprints by winnowing.

Every ``k`` neighbouring code points of a text give a hash, and of every ``window`` neighbouring hashes
the least is chosen, the rightmost one of equals. The chosen hashes with their positions are the
fingerprint. A passage of ``k + window - 1`` or more code points that two texts share, wherever it
stands and in whatever script, gives both a common hash, and nothing shorter than ``k`` counts as shared.

Everything is DataFrame functions. They have no running state, so the hashes roll by doubling: those of
2, 4, 8 ... code points are each made of two of the step before, and so are the least of 2, 4, 8 ...
hashes; the cost of a position grows with the logarithms of ``k`` and ``window``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a hashed gram, and neighbouring hashes of which one is chosen.
GRAM, WINDOW = 16, 32
#: The position is counted down from here, so that the least of equal hashes is the rightmost.
_TOP = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def _over(values: Column, width: int, both: Callable[[Column, Column], Column]) -> Column:
    """``both`` folded over each ``width`` neighbours, which may overlap; fewer at the end of the array."""

    def further(step: int) -> Callable[[Column], Column]:
        return lambda x: F.zip_with(x, F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))), both)

    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values, reach = let(values, further(step)), reach + step
    return values


def winnow(text: Column, k: int = GRAM, window: int = WINDOW, first: Column | None = None) -> Column:
    """Array of longs in order of position: the hash in the upper 32 bits, the position (in code points) in the lower 31.

    Null and empty texts give an empty array; a text of fewer than ``k`` code points is hashed as a
    whole, one of fewer than ``window`` hashes has one window. ``first`` is the position of the first code point, 0 if not given.
    """
    text = F.coalesce(text, F.lit(""))
    n, top = F.length(text), F.lit(_TOP).cast("long") - (F.lit(0) if first is None else first)
    # a hash of nulls is what was hashed before them, so grams that reach beyond the end are those of the rest
    reach = 1 << (max(k - 1, 1).bit_length() - 1)
    halves = _over(F.split(text, ""), reach, lambda p, q: F.xxhash64(p, q))
    kept = F.greatest(n - (k - 1), F.least(n, F.lit(1)))
    gram = lambda h, x, i: F.xxhash64(x, F.get(h, i + (k - reach)))
    at = lambda t: let(halves, lambda h: F.transform(F.slice(h, 1, kept), lambda x, i: F.shiftleft(F.shiftright(gram(h, x, i), 32), 31).bitwiseOR(t - i)))
    placed = let(top, at)  # what a lambda does for each position must not count the text's code points
    full = lambda x: F.slice(x, 1, F.greatest(F.size(x) - (window - 1), F.least(F.size(x), F.lit(1))))
    return F.array_distinct(let(_over(placed, window, lambda p, q: F.least(p, q)), full))


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def _position(x: Column) -> Column:
    return F.lit(_TOP).cast("long") - x.bitwiseAND(F.lit(_TOP).cast("long"))


def positions(fingerprint: Column) -> Column:
    """The positions of a fingerprint's hashes, in code points from 0."""
    return F.transform(fingerprint, _position)


def before(fingerprint: Column, start: Column, window: int = WINDOW) -> Column:
    """The part of a fingerprint that the windows which begin before position ``start`` have chosen.

    A hash is chosen first where it enters a window as the least, else where the one before it leaves.
    """

    def begins(f: Column, x: Column, i: Column) -> Column:
        last = F.get(f, i - 1)
        return F.when(i == 0, F.lit(0).cast("long")).when(F.shiftright(x, 31) <= F.shiftright(last, 31), _position(x) - (window - 1)).otherwise(_position(last) + 1)

    return let(fingerprint, lambda f: let(start, lambda s: F.filter(f, lambda x, i: begins(f, x, i) < s)))


def as_text(fingerprint: Column) -> Column:
    """Hashes and positions as text: hash in hex, ``@``, position, joined by blanks."""
    word = lambda x: F.concat(F.hex(F.shiftright(x, 31).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))), F.lit("@"), _position(x).cast("string"))
    return F.array_join(F.transform(fingerprint, word), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 if both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def with_next(rows: DataFrame, id_col: str, value: Column, out: str, derived: dict[str, Callable[[Column], Column]] | None = None, range_rows: int = 500, most_ranges: int = 20_000) -> DataFrame:
    """Adds ``out``: ``value`` of the row with the next integer id; of the first row after the last.

    For each name in ``derived``, a function of ``value``, adds it for the row and, as ``next_`` and the
    name, for the row after it: computed once a row, after the shuffle.

    Ids are cut into ranges of about ``range_rows`` rows at approximate percentiles (``most_ranges``
    numbers at most), and each range is a window group that also gets a copy of the first row of the
    next range. So the rows are shuffled once and no task holds more than a few ranges. A null id
    counts as the smallest number; equal ids stand in the order of a hash of their place in ``rows``, so
    an id, or null, that many rows have is cut into ranges too; a single row is its own next. ``rows`` is
    read several times and must give the same rows in the same order: a scan of files.
    """
    spark, derived = rows.sparkSession, derived or {}
    least = -(1 << 63)
    keyed = rows.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("_key"), value.alias("_value"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    n, low = keyed.agg(F.count("*"), F.min("_key")).first()
    ranges = max(1, min(most_ranges, -(-n // range_rows)))
    cuts = [i / ranges for i in range(1, ranges)]
    found = keyed.agg(F.percentile_approx("_key", F.lit(cuts), max(10_000, 10 * ranges))).first()[0] if cuts else []
    times = Counter([low or 0, *found])
    firsts = sorted(times)  # the first key of each run of ranges; a key that spans several has as many of its own
    ends = [0, *accumulate(times[k] for k in firsts)]
    table = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")  # folded to a constant
    begins = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<int>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(firsts).bit_length()))))
    # a binary search: how many of the first keys are at most the key
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.col("_key"), at + step).otherwise(at)) - 1
    share = F.shiftrightunsigned("_salt", 11) / F.lit(float(1 << 53))
    own = F.when(F.col("_key") == F.get(table, F.col("_place")), F.floor(share * (F.get(begins, F.col("_place") + 1) - F.get(begins, F.col("_place"))))).otherwise(F.get(begins, F.col("_place") + 1) - F.get(begins, F.col("_place")) - 1)
    salt = F.shiftrightunsigned("_salt", 11)  # in the order of the ranges that a key is cut into
    dealt = keyed.withColumn("_place", place).withColumns({"_range": F.get(begins, F.col("_place")) + own.cast("int"), "_copy": F.lit(False), "_salt": salt}).drop("_place")
    held = sorted(r[0] for r in dealt.select("_range").distinct().collect()) or [0]  # most_ranges numbers at most
    order = [F.col("_key"), F.col("_salt"), F.xxhash64("_value")]
    # the rows that may be a range's first: those with a first key
    heads = spark.range(1).select(F.explode(table).alias("_head"))
    copies = dealt.join(F.broadcast(heads), F.col("_key") == F.col("_head")).drop("_head")
    copies = copies.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).where("_nth = 1").drop("_nth")
    known = F.split(F.lit(",".join(map(str, held))), ",").cast("array<int>")
    # a range that holds nothing is passed over
    copies = copies.withColumns({"_range": F.get(known, F.pmod(F.array_position(known, F.col("_range")).cast("int") - 2, F.lit(len(held)))), "_copy": F.lit(True)})
    group = Window.partitionBy("_range").orderBy("_copy", *order)
    led = dealt.unionByName(copies).withColumn(out, F.lead("_value").over(group))
    led = led.withColumns({name: f(F.col("_value")) for name, f in derived.items()}) if derived else led
    led = led.withColumns({f"next_{name}": F.lead(name).over(group) for name in derived}) if derived else led
    return led.where(~F.col("_copy")).select(*rows.columns, out, *derived, *(f"next_{name}" for name in derived))


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike they and the next text's are.

    Edited text: the last quarter of the code points replaced by as many from the start of the next
    text. Returns id, n_chars, edited_text, fingerprint, edited_fingerprint (arrays), near_edited,
    near_next. Null texts count as empty; equal texts have equal fingerprints; a short text whose
    edit is empty is its own edited text; see ``with_next`` for ids. Of the edited text only the seam
    is hashed: the windows within either text are known. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # the next text's hashes come over with its text, so each text is hashed once
    led = with_next(rows, id_col, F.col("_text"), "_next", {"_hashed": lambda text: winnow(text, k, window)})
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    led = led.withColumn("edited_text", F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut)))
    reach, kept, taken = k + window - 1, n - cut, F.least(cut, F.length("_next"))
    # windows over both texts begin here at the earliest; where nothing is taken there is none, but a short text has a single window
    start = F.greatest(F.lit(0), kept - reach + 1)
    seam = F.when((taken > 0) | (kept < reach), F.substring(F.col("edited_text"), start + 1, kept - 1 + reach - start)).otherwise("")
    # what the next text's windows within the taken part have chosen stands further on
    moved = let(kept, lambda far: F.transform(before(F.col("next__hashed"), taken - reach + 1, window), lambda x: x - far))
    parts = F.concat(before(F.col("_hashed"), kept - reach + 1, window), winnow(seam, k, window, start), moved)
    prints = led.withColumn("edited_fingerprint", F.array_distinct(parts))
    near = lambda a, b: let(hashes(F.col(a)), lambda x: let(hashes(F.col(b)), lambda y: likeness(x, y)))
    return prints.select(
        F.col(id_col), n.cast("long").alias("n_chars"), "edited_text", F.col("_hashed").alias("fingerprint"), "edited_fingerprint", near("_hashed", "edited_fingerprint").alias("near_edited"), near("_hashed", "next__hashed").alias("near_next")
    )
