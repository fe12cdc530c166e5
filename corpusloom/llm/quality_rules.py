"""Operator 6: quality rules.

A table of thresholds is compiled into one projection over whole texts; no user
functions run. Ratios are compared as integer products, so that results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "le la les un une et en du pour que qui dans par sur au avec est pas ce plus "
    "el los las y a se del por con para su al lo como más o no si"
).split()


@dataclass(frozen=True)
class Rule:
    """100 * part compared with percent * whole; part and whole name measured columns."""

    part: str
    compare: str
    percent: int
    whole: str


#: The document fails its base check on any of these.
BASE_FAILS = (Rule("n_words", "<", 5000, "one"), Rule("n_repeat_words", ">", 50, "n_words"))

#: A document is kept if it meets all of these.
KEEP_RULES = (
    Rule("n_words", "<=", 1_000_000_000, "one"),
    Rule("word_chars", ">=", 200, "n_words"),
    Rule("word_chars", "<=", 1500, "n_words"),
    Rule("n_symbols", "<=", 30, "n_words"),
    Rule("n_stop_words", ">=", 2, "n_words"),
    Rule("n_dup_lines", "<=", 30, "n_lines"),
)


def repeated_window_words(found: Column, width: int = 3) -> Column:
    """The number of words inside windows of width words that the array holds twice or more.

    Window hashes are sorted with their positions; equal neighbours are repeats, and each repeat
    covers the words up to the next one. Time n log n, whatever the text repeats.
    """

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            let(
                order,
                lambda s: F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
                            | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                ),
            ),
            lambda at: F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def over(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
        )
        return F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(
            let(
                hashes,
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
            )
        )

    return let(found, over)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measured columns, those of lines as the struct _lines; a null text has no words and one empty line."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = fresh(docs, "_words")
    with_words = docs.withColumn(found, words(t))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return with_words.select(
        *docs.columns,
        F.size(found).cast("long").alias("n_words"),
        F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias(fresh(docs, "_lines")),
        repeated_window_words(F.col(found)).alias("n_repeat_words"),
        F.size(F.filter(found, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def compile_rules(rules: tuple[Rule, ...], any_of: bool = False) -> Column:
    """One boolean column for the whole table of rules."""
    named = {"one": F.lit(1)}
    tests = []
    for r in rules:
        left, right = 100 * F.col(r.part), F.lit(r.percent).cast("long") * named.get(r.whole, F.col(r.whole))
        tests.append({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[r.compare])
    out = tests[0]
    for x in tests[1:]:
        out = out | x if any_of else out & x
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = KEEP_RULES, base: tuple[Rule, ...] = BASE_FAILS, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_stop_words,
    base_failed and kept.

    A null or empty text has no words, fails the base check and is not kept. Columns of docs that bear
    one of these names are replaced. Every row is judged by itself: repeated rows and ties get equal verdicts, long
    texts are measured whole, and an empty table gives no rows.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]
    own = docs.drop(*[c for c in docs.columns if c.lower() in new])
    m, lines = measures(own, text), fresh(own, "_lines")
    m = m.withColumn("n_dup_lines", F.col(lines)["dup"]).withColumn("n_lines", F.col(lines)["n"]).drop(lines)
    m = m.withColumn("base_failed", compile_rules(base, any_of=True))
    return m.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
