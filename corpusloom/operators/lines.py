"""Search by line: matches with context, enclosing definitions, symbols, read windows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a symbol's definition looks like in common languages. Forms that start with a word name the symbol behind it, so a line
#: is read once for all names that it defines; the words of a line that may hold the last form ({} is the name) are tested one by one.
NAMED = (
    r"(?:(?:def|class|function|func|fn|export\s+const)|(?:const|let|var)(?=\s+\w+\s*(?:=|:)))"
    r"(?=\s+(\w+)\b)"
)
MEMBER = r"(?:public|private|protected|static).*\s{}\s*\("


def line_table(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line (from 1) and text of every line of every file."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def line_test(text: Column, pattern: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Whether a line matches; an empty or malformed pattern is refused."""
    if not pattern:
        raise ValueError("empty pattern")
    if not regex:
        return text.contains(pattern) if case_sensitive else F.lower(text).contains(pattern.lower())
    re.compile(pattern)
    return text.rlike(pattern if case_sensitive else f"(?i){pattern}")


def file_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path and lines, the array of a file's lines. What follows works inside of these rows, so that no line is shuffled."""
    return files.select(F.col(path).alias("path"), F.split(text, "\n").alias("lines"))


def _from_to(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 0) that exist, joined."""
    low, high = F.greatest(first, F.lit(0)), F.least(last, F.size(lines) - 1)
    return F.when(low <= high, F.array_join(F.transform(F.sequence(low, high), lambda i: F.get(lines, i)), "\n")).otherwise("")


def _places(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Places (from 0) of the lines that the test holds for."""
    return F.filter(F.transform(lines, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def grep(files: DataFrame, test: Callable[[Column], Column], context: int = 2) -> DataFrame:
    """path, line, text, before and after (the neighbouring lines) of every matching line of files (path, lines)."""
    lines = F.col("lines")
    hit = lambda i: F.struct((i + 1).alias("line"), F.get(lines, i).alias("text"), _from_to(lines, i - context, i - 1).alias("before"), _from_to(lines, i + 1, i + context).alias("after"))
    return files.select("path", F.transform(_places(lines, test), hit).alias("hits")).select("path", F.inline("hits"))


def enclosing(files: DataFrame, definition: Callable[[Column], Column]) -> DataFrame:
    """path, line, text and scope (the last definition on or above it) of each line of files (path, lines); definition gives a line's, or null."""
    lines, defined = F.col("lines"), lambda t: definition(t).isNotNull()
    at = files.select("path", "lines", _places(lines, defined).alias("at"))
    # stretches from each definition to the next, and one before the first
    after = lambda k: F.coalesce(F.get("at", k + 1), F.size(lines)) - 1
    named = lambda first, last, name: F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.struct((i + 1).alias("line"), F.get(lines, i).alias("text"), name.alias("scope")))).otherwise(F.array().cast("array<struct<line:int,text:string,scope:string>>"))
    first = named(F.lit(0), F.coalesce(F.get("at", F.lit(0)), F.size(lines)) - 1, F.lit(None).cast("string"))
    rest = F.flatten(F.transform("at", lambda i, k: named(i, after(k), definition(F.get(lines, i)))))
    return at.select("path", F.inline(F.concat(first, rest)))


def shown_from(files: DataFrame, name: Callable[[Column], Column], most: int = 10) -> DataFrame:
    """path, line, symbol and shown: each line that name gives a symbol for (not null or empty), with the lines after it, most in all."""
    lines = F.col("lines")
    hit = lambda i: F.struct((i + 1).alias("line"), name(F.get(lines, i)).alias("symbol"), _from_to(lines, i, i + most - 1).alias("shown"))
    return files.select("path", F.transform(_places(lines, lambda t: F.coalesce(name(t), F.lit("")) != ""), hit).alias("hits")).select("path", F.inline("hits"))


def of_interest(lines: Column, at: Column, pad: int = 1) -> Column:
    """Lines of interest (numbers from 1, in any order, repeats count once) with pad lines beside each, in one text.

    Neighbourhoods that touch are one; what is left out between them, before and after is one line with an ellipsis.
    """
    n = F.size(lines)
    inside = F.filter(at, lambda x: x.between(1, n))
    near = F.array_sort(F.array_distinct(F.flatten(F.transform(inside, lambda x: F.sequence(F.greatest(x - pad, F.lit(1)), F.least(x + pad, n))))))
    gap = lambda x, i: F.coalesce(F.get(near, i - 1), F.lit(0)) < x - 1
    shown = F.transform(near, lambda x, i: F.concat(F.when(gap(x, i), "⋮\n").otherwise(""), F.lit("│"), F.get(lines, (x - 1).cast("int"))))
    return F.concat(F.array_join(shown, "\n"), F.when((F.size(near) > 0) & (F.get(near, F.size(near) - 1) < n), "\n⋮").otherwise(""))


def match_summary(files: DataFrame, test: Callable[[Column], Column], most: int) -> tuple[Column, DataFrame]:
    """The first most + 1 matches (path, line) of files (path, lines), of each task before they meet, so that a search for a common word ends early.

    Which matches these are depends on the tasks; whether there are more than most doesn't.
    """
    hits = files.select("path", F.explode(_places(F.col("lines"), test)).alias("i")).select("path", (F.col("i") + 1).alias("line")).limit(most + 1)
    return F.count("*") > most, hits


def definitions(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, path, line: the first line that defines each symbol (by hint file, then path, then line).

    symbols: symbol, hint. One pattern gives the names that a line defines; they meet the symbols by an equality join. Only lines that
    may declare a member are exploded into words, whose form is then tested with the symbol set in.
    """
    text, most = F.col("text"), F.lit(MEMBER.replace("{}", r"\w+"))
    named = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAMED), F.lit(1)))).alias("symbol"))
    members = lines.where(F.regexp_like(text, most)).select("path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("symbol"))
    tested = members.join(symbols, "symbol").where(F.regexp_like("text", F.replace(F.lit(MEMBER), F.lit("{}"), F.col("symbol"))))
    hit = named.join(symbols, "symbol").unionByName(tested.drop("text"))
    first = F.min(F.struct((~F.coalesce(F.col("path") == F.col("hint"), F.lit(False))).alias("far"), "path", "line")).alias("d")
    return hit.groupBy("symbol").agg(first).select("symbol", "d.path", "d.line")


def references(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, path, line of every line that holds the symbol as a word."""
    words = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("symbol"))
    return words.join(symbols.select("symbol").distinct(), "symbol")


def line_symbols(text: Column) -> Column:
    """kind:name of the definition that a line of Python or JavaScript starts, or null."""
    t = F.trim(text)
    name = lambda p: F.regexp_extract(t, p, 1)
    rules = (
        ("function", r"^def\s+(\w+)"), ("class", r"^(?:export\s+)?class\s+(\w+)"),
        ("function", r"^(?:export\s+)?(?:const|function|let|var)\s+(\w+)"), ("type", r"^(?:export\s+)?(?:interface|type)\s+(\w+)"),
    )
    return F.coalesce(*[F.when(name(p) != "", F.concat(F.lit(k + ":"), name(p))) for k, p in rules])


def read_window(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """path and numbered: lines start to end of each file, each after its number in four places and a bar."""
    chosen = lines.where(F.col("line").between(start, end))
    shown = F.concat(F.lpad(F.col("line").cast("string"), 4, " "), F.lit(" | "), F.col("text"))
    return chosen.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", shown.alias("s")))), lambda x: x["s"]), "\n").alias("numbered"))
