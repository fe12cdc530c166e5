"""Cutting texts into chunks: Markdown sections, packed paragraphs and sentences, code blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP, SHORT = 2000, 150, 150
_STATE = "struct<out:array<string>,cur:string>"


def markdown_sections(lines: DataFrame) -> DataFrame:
    """path, section, heading, level, breadcrumb and content of every section of Markdown files.

    lines: path, line, text. A heading inside a closed fence is text; text before the first heading is section 0.
    The breadcrumb lists the headings above, outermost first, each the last one of its level that still holds.
    """
    by, upto = Window.partitionBy("path"), Window.partitionBy("path").orderBy("line")
    fences = F.regexp_count("text", F.lit("```"))
    before = F.coalesce(F.sum("fences").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = lines.withColumn("fences", fences).withColumns({"f": before, "all": F.sum("fences").over(by)})
    fenced = (F.col("f") % 2 == 1) & (F.col("f") < F.col("all"))
    x = x.withColumn("level", F.when(~fenced & F.col("text").rlike(r"^#{1,6}[ \t]+\S"), F.length(F.regexp_extract("text", "^(#+)", 1))))
    x = x.withColumn("heading", F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("text", r"^#+[ \t]+", ""))))
    x = x.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(upto))
    for k in range(1, 7):  # the last heading of level k or above; it holds if it is of level k
        last = F.last(F.when(F.col("level") <= k, F.struct("level", "heading")), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0))
        x = x.withColumn(f"h{k}", F.when(last["level"] == k, last["heading"]))
    crumbs = F.concat_ws(" > ", *[f"h{k}" for k in range(1, 7)])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    out = x.withColumn("crumbs", crumbs).groupBy("path", "section").agg(F.max("heading").alias("heading"), F.max("level").alias("level"), F.min_by("crumbs", "line").alias("breadcrumb"), text.alias("content"))
    return out.where(F.trim("content", F.lit(" \t\n")) != "")


def _fold(parts: Column, most: int, gap: str, overlap: int) -> Column:
    """Greedy packing of parts, joined by gap, into chunks of at most `most` characters; a chunk that follows a full one
    begins with the last `overlap` characters of it. One pass inside the JVM."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(_STATE)

    def step(acc: Column, p: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        begun = F.concat(F.right(cur, F.lit(overlap)), F.lit(gap), p) if overlap else p
        full = F.length(cur) + F.length(p) + len(gap) > most
        return F.when(p == "", acc).otherwise(
            F.struct(
                F.when(full & (cur != ""), F.concat(out, F.array(F.trim(cur, F.lit(" \t\n"))))).otherwise(out).alias("out"),
                F.when(cur == "", p).when(full, begun).otherwise(F.trim(F.concat(cur, F.lit(gap), p), F.lit(" \t\n"))).alias("cur"),
            ).cast(_STATE)
        )

    end = lambda acc: F.when(F.trim(acc["cur"], F.lit(" \t\n")) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.trim(acc["cur"], F.lit(" \t\n")))))
    return F.aggregate(F.transform(parts, lambda p: F.trim(p, F.lit(" \t\n"))), start, step, end)


def sentences(text: Column, most: int = CHUNK) -> Column:
    """Sentences packed into chunks; one that is too long by itself stays whole."""
    return _fold(F.split(text, r"(?<=[.!?。！？])[ \t\r\n]+"), most, " ", 0)


def paragraphs(text: Column, most: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed into chunks. One that is too long by itself, unless fenced, is cut into sentences, and what was
    packed before it ends there. Runs of paragraphs between long ones are packed as one array each."""
    parts = F.transform(F.split(text, r"\n[ \t\r]*\n\s*"), lambda p: F.trim(p, F.lit(" \t\n")))
    is_long = lambda p: (F.length(p) > most) & ~p.startswith("```")
    kind = "array<struct<l:boolean,p:array<string>>>"

    def group(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.array(F.struct(is_long(p).alias("l"), F.array(p).alias("p"))).cast(kind)
        joins = (F.size(acc) > 0) & ~is_long(p)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.lit(False).alias("l"), F.concat(last["p"], F.array(p)).alias("p"))).cast(kind))
        return F.when(p == "", acc).when(joins & ~F.coalesce(F.try_element_at(acc, F.lit(-1))["l"], F.lit(True)), grown).otherwise(F.concat(acc, new))

    runs = F.aggregate(parts, F.array().cast(kind), group)
    return F.flatten(F.transform(runs, lambda r: F.when(r["l"], sentences(r["p"][0], most)).otherwise(_fold(r["p"], most, "\n\n", overlap))))


def by_lines(text: Column, most: int = CHUNK) -> Column:
    """Lines packed into parts of at most `most` characters, line ends counted; a longer line is a part."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur")).cast(_STATE)
    lines = F.filter(F.split(F.regexp_replace(text, "\n", "\n\u0001"), "\u0001"), lambda x: x != "")
    strip = lambda x: F.trim(x, F.lit(" \t\r\n"))

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > most) & (acc["cur"] != "")
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"]).alias("out"), F.when(full, p).otherwise(F.concat(acc["cur"], p)).alias("cur")
        ).cast(_STATE)

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["cur"])))))


def outermost(symbols: DataFrame) -> DataFrame:
    """symbols (file, name, kind, start_line, end_line) that no other definition of their file encloses."""
    w = Window.partitionBy("file").orderBy("start_line", F.desc("end_line"), "name").rowsBetween(Window.unboundedPreceding, -1)
    return symbols.withColumn("reach", F.max("end_line").over(w)).where("reach is null or start_line > reach").drop("reach")


def code_chunks(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, start_line, end_line, name and content of each outermost definition; the whole file where there is none.

    A line belongs to the last outermost definition that starts at or above it and ends at or below: one window.
    """
    marks = outermost(symbols).select(F.col("file").alias("path"), F.col("start_line").alias("line"), F.struct("start_line", "end_line", "name").alias("def"))
    own = lines.join(marks, ["path", "line"], "left")
    w = Window.partitionBy("path")
    own = own.withColumns({"def": F.last("def", ignorenulls=True).over(w.orderBy("line")), "some": F.count("def").over(w) > 0, "last": F.max("line").over(w)})
    whole = F.struct(F.lit(1).alias("start_line"), F.col("last").alias("end_line"), F.lit(None).cast("string").alias("name"))
    own = own.withColumn("def", F.when(F.col("some"), F.when(F.col("line") <= F.col("def.end_line"), F.col("def"))).otherwise(whole)).where("def is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return own.groupBy(F.col("path").alias("file"), "def").agg(text.alias("content")).select("file", "def.*", "content")


_CHUNK = "struct<start_line:int,end_line:int,name:string,content:string>"


def normalize_code_chunks(chunks: DataFrame, short: int = SHORT, most: int = CHUNK) -> DataFrame:
    """file, chunk, start_line, end_line, name, part and content: short chunks join the next of their file, long ones are cut by lines.

    A short chunk waits: further short ones are added while they fit, and a normal one takes it in if both fit. What has
    waited keeps its own first fields and the last end line.
    """
    state = f"struct<out:array<{_CHUNK}>,wait:{_CHUNK}>"
    none = F.lit(None).cast(_CHUNK)
    start = F.struct(F.array().cast(f"array<{_CHUNK}>").alias("out"), none.alias("wait")).cast(state)

    def step(acc: Column, c: Column) -> Column:
        w, out = acc["wait"], acc["out"]
        flushed = F.when(w.isNull(), out).otherwise(F.concat(out, F.array(w)))
        both = F.concat(w["content"], F.lit("\n\n"), c["content"])
        fits = F.coalesce(F.length(both) <= most, F.lit(False))
        is_short = F.length(c["content"]) < short
        grown = F.struct(w["start_line"].alias("start_line"), c["end_line"].alias("end_line"), w["name"].alias("name"), both.alias("content")).cast(_CHUNK)
        taken = F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), c["name"].alias("name"), both.alias("content")).cast(_CHUNK)
        pack = lambda o, x: F.struct(o.alias("out"), x.alias("wait")).cast(state)
        return (
            F.when(F.length(c["content"]) > most, pack(F.concat(flushed, F.array(c)), none))
            .when(is_short & fits, pack(out, grown))
            .when(is_short, pack(flushed, c))
            .when(fits, pack(F.concat(out, F.array(taken)), none))
            .otherwise(pack(F.concat(flushed, F.array(c)), none))
        )

    row = F.struct(F.col("start_line").cast("int"), F.col("end_line").cast("int"), "name", F.trim("content", F.lit(" \t\r\n")).alias("content")).cast(_CHUNK)
    packed = F.aggregate("rows", start, step, lambda a: F.when(a["wait"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["wait"]))))
    per = chunks.groupBy("file").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("file", F.posexplode(packed).alias("chunk", "c"))
    cut = F.when(F.length("c.content") > most, by_lines(F.col("c.content"), most)).otherwise(F.array("c.content"))
    return per.select("file", "chunk", "c.start_line", "c.end_line", "c.name", F.posexplode(cut).alias("part", "content"))
