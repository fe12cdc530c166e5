"""Public names of source files, a line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Language by extension.
LANGUAGE = {"py": "py", "ts": "ts", "tsx": "ts", "js": "js", "jsx": "js"}
LONGEST = 80


def signature(text: Column, ext: Column) -> Column:
    """The public signature that a line declares, null if none: Python classes and functions, exports of scripts, components."""
    line = F.trim(text, F.lit(" \t\r"))
    head = F.get(F.split(line, ":"), F.lit(0))
    python = F.when(F.contains(line, F.lit(":")) & (line.startswith("class ") | (line.startswith("def ") & ~line.startswith("def _") & (F.length(head) < LONGEST))), head)

    def exported(pattern: str, shown: str) -> Column:
        name = F.regexp_extract(line, pattern, 1)
        return F.when(name != "", F.replace(F.lit(shown), F.lit("{}"), name))

    script = F.coalesce(
        exported(r"^export function (\w+)\s*\([^)]*\)", "export function {}()"),
        F.when(F.contains(line, F.lit("=>")), exported(r"^export const (\w+)\s*=", "export const {} = () =>")),
        exported(r"^export class (\w+)", "export class {}"),
        exported(r"^export interface (\w+)", "export interface {}"),
        exported(r"^export type (\w+)", "export type {}"),
        F.when(ext.isin("tsx", "jsx") & F.contains(line, F.lit("= (")), exported(r"^const ([A-Z]\w*)\s*[:=]", "component {}")),
    )
    return F.when(ext == "py", python).when(ext.isin("ts", "tsx", "js", "jsx"), script)


def public_signatures(lines: DataFrame, most: int = 20) -> DataFrame:
    """repo, language, place, file, line and signature: the first of each repository, scripts (ts and js together) and
    Python apart. lines: repo, file, ext, line, text."""
    found = lines.withColumn("signature", signature(F.col("text"), F.col("ext"))).where("signature is not null")
    kind = F.col("ext")
    shown = F.lit(None)
    for ext, language in LANGUAGE.items():
        shown = F.when(kind == ext, language).otherwise(shown)
    first = F.row_number().over(Window.partitionBy("repo", F.col("ext") == "py").orderBy("file", "line"))
    return found.withColumn("language", shown).withColumn("place", first).where(F.col("place") <= most).select("repo", "language", "place", "file", "line", "signature")
