"""Licence scan by ordered signature rules, in built-in functions only.

The lower-cased words of a text select the rules whose keyword is among them. Only those regexes run; each marks the
first and last word of its matches, so positions are word numbers. All detections of a text are then put in order of
their first word, and one fold drops those inside a detection of the same or a better priority.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.llm.license_rules import NOTICE, Rule, all_rules
from optelem.llm.texts import add_columns

OPEN, CLOSE = "\x01", "\x02"
FOUND = "array<struct<first:int,neg_last:int,priority:int,rule:int,label:string,confidence:double,base:boolean>>"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]


def spaced(text: Column) -> Column:
    """Words with a blank before and after each, so that neighbouring matches need not share one."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    bare = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(bare, F.lit(" "), F.lit("  ")), F.lit(" ")))


def pattern(rule: Rule) -> str:
    """The regex over spaced words, as one group between the blanks around its match."""
    return " (" + f"(?:{rule.regex})".replace(" ?", "(?:\t\t)?").replace(" ", "  ").replace("\t", " ") + ") "


def _rule_table(rules: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.array(*[F.lit(k) for k in r.keyword.split("|")]).alias("keywords"), F.lit(pattern(r)).alias("pattern"), F.lit(r.priority).alias("priority"),
                              F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base")) for i, r in enumerate(rules)])


def _places(spaced_text: Column, rule: Column) -> Column:
    """Detections of one rule: first word, last word negated (longer ones sort first), and the rule."""
    marked = F.split(F.trim(F.regexp_replace(spaced_text, rule["pattern"], F.lit(f" {OPEN}$1{CLOSE} "))), "  ")

    def numbers(hit) -> Column:
        return F.filter(F.transform(marked, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())

    return F.zip_with(numbers(lambda w: F.startswith(w, F.lit(OPEN))), numbers(lambda w: F.endswith(w, F.lit(CLOSE))),
                      lambda a, b: F.struct(a.alias("first"), (-b).alias("neg_last"), rule["priority"].alias("priority"), rule["rule"].alias("rule"),
                                            rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")))


def _survivors(found: Column) -> Column:
    """Labels, highest confidence and number of detections that lie in no earlier one of the same or a better priority.

    In order of first word, then longer ones first, whatever contains a detection comes before it; so it is enough to
    know the last word reached so far by each priority.
    """
    reach = [f"reach_{p}" for p in range(1, NOTICE + 1)]
    start = F.struct(*[F.lit(-1).alias(r) for r in reach], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"))

    def step(so_far: Column, d: Column) -> Column:
        last = -d["neg_last"]
        covered = F.lit(False)
        for p, r in enumerate(reach, 1):
            covered = covered | ((d["priority"] >= p) & (so_far[r] >= last))
        reached = [F.when(d["priority"] == p, F.greatest(so_far[r], last)).otherwise(so_far[r]).alias(r) for p, r in enumerate(reach, 1)]
        return F.struct(*reached, F.when(covered, so_far["labels"]).otherwise(F.array_union(so_far["labels"], F.array(d["label"]))).alias("labels"),
                        F.when(covered, so_far["score"]).otherwise(F.greatest(so_far["score"], d["confidence"])).alias("score"),
                        (so_far["n"] + F.when(covered, 0).otherwise(1)).alias("n"))

    return F.aggregate(found, start, step)


def scan(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """`df` with the words of each whole text, its base places and labels, all labels, a score and the detections that count.

    Base rules count all their places and always give their label; the others give theirs where they survive. The
    score is the highest confidence of a surviving rule, 0 without one. NULL and empty texts have no words and no
    labels (empty strings) and NULL places. Columns of `df` with the names of the results are replaced.
    """
    rules = all_rules() if rules is None else rules
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rules for k in r.keyword.split("|")})])
    staged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), spaced(F.col(text)).alias("_spaced"))
    staged = staged.withColumn("_words", F.when(F.col("_spaced") != "", F.split(F.trim("_spaced"), "  ")).otherwise(F.array().cast("array<string>")))
    staged = staged.select("_row", "_spaced", F.size("_words").cast("long").alias("_n"), F.array_intersect("_words", keywords).alias("_present"))
    tried = F.filter(_rule_table(rules), lambda r: F.arrays_overlap("_present", r["keywords"]))
    found = F.array_sort(F.flatten(F.transform(tried, lambda r: _places(F.col("_spaced"), r))))
    staged = staged.select("_row", "_n", F.when(F.size("_present") > 0, found).alias("_found"))
    base = F.filter("_found", lambda d: d["base"])
    staged = staged.select("_row", "_n", F.coalesce(base, F.array().cast(FOUND)).alias("_base"),
                           F.when(F.size("_found") > 0, _survivors(F.col("_found"))).alias("_kept"))
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("_kept.labels", none)))
    out = add_columns(staged, {
        "_n_words": F.col("_n"), "_n_base": F.size("_base").cast("long"), "_first": F.array_min(F.transform("_base", lambda d: d["first"])).cast("long"),
        "_last": F.array_max(F.transform("_base", lambda d: d["first"])).cast("long"), "_base_labels": F.array_join(base_labels, ","), "_labels": F.array_join(labels, ","),
        "_score": F.coalesce("_kept.score", F.lit(0.0)), "_n_detections": F.coalesce("_kept.n", F.lit(0).cast("long"))})
    names = {r.lower() for r in RESULTS}
    internal = ["_n_words", "_n_base", "_first", "_last", "_base_labels", "_labels", "_score", "_n_detections"]
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c.lower() not in names], *[F.col(i).alias(r) for i, r in zip(internal, RESULTS)])

