"""Filter interaction audit: what each document filter removes in every order in which the filters can be applied.

Every document becomes a mask with one bit per filter that it fails, and the table becomes cells: documents per part and
mask. A recursive query then extends filter prefixes by the letters not yet used. It joins the masks, carries the bits
applied so far, and each level says what its step does to a mask: keep it, remove it, or find it removed already. Joined
with the cells these become counts. The recursion has a fixed size for a set of filters (325 prefixes by 32 masks for
five), however large the table is.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optelem.llm.texts import per_text
from optelem.plans.lookups import settle

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
MAX_FILTERS = 6  # 720 orders
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(data: bytes) -> tuple[int]:
    """Bits of the filters A to D that a text fails: 1 few words, 2 few distinct words, 4 capitals, 8 marks."""
    words = data.split()
    points = len(data.translate(None, CONTINUATION))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2 | (len(data.translate(None, MARKS)) < len(data)) << 3,)


def failed_bits(text: Column) -> Column:
    """The bits of `text_failures` as an int column; NULL counts as empty."""
    return per_text("struct<bits:int>", text_failures)(text)["bits"]


def any_label(labels: DataFrame, row_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """_id, _good, _toxic (0 or 1), one row per id: a document is good or toxic if any of its labels says so."""
    said = [F.when(F.col(f"`{c}`") == 1, 1).otherwise(0).alias(name) for c, name in ((good, "_good"), (toxic, "_toxic"))]
    named = labels.select(F.col(f"`{row_id}`").alias("_id"), *said).where("_id IS NOT NULL")
    return named.groupBy("_id").agg(F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents per part and set of failed filters; bit 16 marks copies of a smaller id's text.

    Copies are counted, never listed: rows of one text collapse to one row per part and label before they meet, so a
    group of copies of any size stays small.
    """
    read = docs.select(F.col(f"`{row_id}`").alias("_id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)).alias("_text"),
                       failed_bits(F.col(f"`{text}`")).alias("_bits"))
    read = read.join(any_label(labels, row_id), "_id", "left").fillna(0, ["_good", "_toxic"])
    kinds = ["_text", "part", "_bits", "_good", "_toxic"]
    once = read.groupBy("_id", *kinds).agg(F.count(F.lit(1)).alias("_n"))
    named = F.col("_id").isNotNull()
    alike = once.groupBy(*kinds).agg(F.sum("_n").alias("_n"), F.sum(F.when(named, F.col("_n")).otherwise(0)).alias("_named"),
                                     F.min(F.when(named, F.struct("_id", "_n"))).alias("_least"))
    alike = settle(alike)
    first = alike.groupBy("_text").agg(F.min("_least._id").alias("_first"))
    at_first = F.when(F.col("_least._id") == F.col("_first"), F.col("_least._n")).otherwise(0)
    copies = F.col("_named") - at_first
    rows = F.explode(F.array(F.struct(F.col("_bits").alias("mask"), (F.col("_n") - copies).alias("n")),
                             F.struct((F.col("_bits") + 16).alias("mask"), copies.alias("n"))))
    split = alike.join(first, "_text").select("part", "_good", "_toxic", rows.alias("_cell")).where("_cell.n > 0")
    return split.groupBy("part", F.col("_cell.mask").alias("mask")).agg(
        F.sum("_cell.n").alias("n"), F.sum(F.col("_cell.n") * F.col("_good")).alias("good"), F.sum(F.col("_cell.n") * F.col("_toxic")).alias("toxic"))


def prefix_steps(spark: SparkSession, letters: str) -> DataFrame:
    """prefix, letter, step, mask, alive, fails, only: every prefix of distinct letters against every mask.

    `alive`: no earlier letter of the prefix removes the mask; `fails`: its last letter does; `only`: nothing else does.
    """
    if not 0 < len(set(letters)) == len(letters) <= MAX_FILTERS:
        raise ValueError(f"give 1 to {MAX_FILTERS} different letters")
    unused = ", ".join(f"({applied}, '{c}', {1 << i})" for applied in range(1 << len(letters)) for i, c in enumerate(letters) if not applied & 1 << i)
    return spark.sql(f"""
        WITH RECURSIVE unused(applied, letter, bit) AS (VALUES {unused}),
        steps(prefix, letter, bit, step, before, applied, mask) AS (
          SELECT letter, letter, bit, 1, 0, bit, explode(sequence(0, {(1 << len(letters)) - 1})) FROM unused WHERE applied = 0
          UNION ALL
          SELECT concat(s.prefix, u.letter), u.letter, u.bit, s.step + 1, s.applied, s.applied | u.bit, s.mask
          FROM steps s JOIN unused u ON u.applied = s.applied)
        SELECT prefix, letter, step, mask, mask & before = 0 AS alive, mask & bit <> 0 AS fails, mask = bit AS only FROM steps""")


def interactions(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, filter_order and step from `cells` (part, mask, n, good, toxic); letter i has bit 1 << i.

    kept, removed, redundant (failing, but removed earlier), unique_fails (failing nothing else), good_lost, toxic_lost
    and shapley: the filter's removals summed over all orders. Every part has all orders, zeros included; no cells, no rows.
    """
    spark = cells.sparkSession
    steps = F.broadcast(settle(prefix_steps(spark, letters)))  # its size is fixed by the number of letters

    def total(number: str, condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), F.col(number)).otherwise(0))

    done = settle(cells.join(steps, "mask").groupBy("part", "prefix", "letter", "step").agg(
        total("n", "alive AND NOT fails").alias("kept"), total("n", "alive AND fails").alias("removed"), total("n", "NOT alive AND fails").alias("redundant"),
        total("n", "only").alias("unique_fails"), total("good", "alive AND fails").alias("good_lost"), total("toxic", "alive AND fails").alias("toxic_lost")))
    orders_left = F.element_at(F.array(*[F.lit(factorial(len(letters) - step)) for step in range(1, len(letters) + 1)]), F.col("step"))
    shares = done.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_left).alias("shapley"))
    places = [("".join(order), step, "".join(order[:step])) for order in permutations(letters) for step in range(1, len(letters) + 1)]
    values = ", ".join(f"('{order}', {step}, '{prefix}')" for order, step, prefix in places)
    orders = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(filter_order, step, prefix)"))
    return done.drop("step").join(orders, "prefix").join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in (*MEASURES, "shapley")])


def audit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """`interactions` of the five filters A to E over `docs`.

    NULL texts are empty; a NULL part is the empty string; a row with a NULL id is no copy of anything, and nothing is a
    copy of it alone. Rows that repeat an id are counted each; those of one text are no copies of one another. Labels
    that repeat an id count if any of them does; NULL labels and those of unknown ids say nothing. Texts of any length
    are read whole. Further columns are ignored.
    """
    return interactions(mask_cells(docs, labels, row_id, text, part))
