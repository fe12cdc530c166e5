"""Anchors: the places in a repository that the results of tools point at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import first_line_of, quoted
from .evidence import CODE_ENDINGS

ANCHOR = "struct<kind:string,symbol:string,file:string,line:bigint,confidence:double>"
#: Words that show a definition.
DEFINITION_WORDS = ("definition", "defined in", "class ", "def ", "function ", "const ", "export ")
LONGEST_SYMBOL = 80


def _anchor(kind: Column | str, symbol: Column, file: Column, line: Column, confidence: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), symbol.alias("symbol"), file.alias("file"), line.alias("line"), confidence.alias("confidence")).cast(ANCHOR)


def _is_code(path: Column) -> Column:
    return X.any_of([path.endswith(e) for e in CODE_ENDINGS])


def _named_near_file(entities: Column, content: Column, kind: str, confidence: float) -> Column:
    """An anchor for each of the first three entities that stands after a script's or Python file's path in a line."""
    def one(entity: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)(\S+\.(?:py|ts|tsx|js|jsx)).*"), quoted(entity))
        file = F.call_function("regexp_extract", content, pattern, F.lit(1))
        return _anchor(kind, entity, X.present(file), F.lit(None), F.lit(confidence))

    found = F.transform(F.slice(entities, 1, 3), one)
    return F.filter(found, lambda a: a["file"].isNotNull())


def anchors(results: DataFrame) -> DataFrame:
    """session, seq, place (from 0, in a result), kind, symbol, file, line and confidence of each anchor.

    results: session, seq, tool, operation, symbol, pattern, file_path, primary_file, start_line, content, relevance,
    entities and sources (arrays of text), candidates (kind, symbol, file, line, confidence) and matches (file, line).
    Null arrays count as empty.
    """
    c = F.col
    listed = lambda name: F.coalesce(c(name), F.array().cast(results.schema[name].dataType))
    none, content, relevance = F.array().cast(f"array<{ANCHOR}>"), F.coalesce("content", F.lit("")), c("relevance")
    file = F.coalesce("primary_file", "file_path", X.path_in_text(content))
    given = F.transform(
        F.slice(listed("candidates"), 1, 3),
        lambda a: _anchor(
            F.when(F.contains(F.lower(a["kind"]), F.lit("definition")) | (F.lower(a["kind"]) == "def"), "definition").otherwise("reference"), F.coalesce(X.present(a["symbol"]), c("symbol")),
            F.coalesce(X.present(a["file"]), c("file_path"), F.lit("unknown")), a["line"], F.coalesce(a["confidence"], relevance),
        ),
    )
    shows = X.any_of([F.contains(F.lower(content), F.lit(w)) for w in DEFINITION_WORDS]) | (relevance > 0.5)
    defined = F.when(shows, F.array(_anchor("definition", c("symbol"), file, X.line_in_text(content), F.least(relevance + 0.1, F.lit(1.0))))).otherwise(none)
    called = F.array(_anchor("reference", c("symbol"), file, F.lit(None), relevance * 0.85))
    graph = (
        F.when(F.size(given) > 0, given).when(c("operation") == "find_definition", defined).when(c("operation").isin("find_callers", "find_callees"), called)
        .when(c("operation") == "get_all_symbols", _named_near_file(listed("entities"), content, "reference", 0.6)).otherwise(none)
    )
    inside = F.transform(F.slice(listed("entities"), 1, 2), lambda e: _anchor("definition", e, c("file_path"), first_line_of(content, e), F.lit(0.85)))
    whole = F.array(_anchor("definition", F.element_at(F.split("file_path", "/"), -1), c("file_path"), c("start_line"), F.lit(0.9)))
    read = F.when(c("file_path").isNull(), none).otherwise(F.concat(whole, F.filter(inside, lambda a: a["line"].isNotNull())))
    path = lambda s: F.trim(F.regexp_replace(s, "^[^:]*:", ""))
    bare = F.filter(F.transform(F.slice(listed("sources"), 1, 3), path), lambda p: (p != "") & (p != "unknown"))

    def searched(p: Column) -> Column:
        score = F.when(_is_code(p), F.greatest(relevance * 0.82 + 0.05, F.lit(0.72))).otherwise(relevance * 0.7)
        name = F.get(F.split(F.element_at(F.split(p, "/"), -1), r"\."), F.lit(0))
        return _anchor(F.when(_is_code(p), "definition").otherwise("reference"), name, p, F.lit(None), F.least(score, F.lit(0.92)))

    asked = F.left(F.coalesce(X.present(c("pattern")), F.lit("match")), F.lit(LONGEST_SYMBOL))
    hits = F.transform(F.filter(F.slice(listed("matches"), 1, 5), lambda m: m["file"] != ""), lambda m: _anchor("reference", asked, m["file"], m["line"], F.least(relevance, F.lit(0.88))))
    instead = F.transform(F.filter(bare, _is_code), lambda p: _anchor("reference", asked, p, F.lit(None), F.least(relevance * 0.75, F.lit(0.8))))
    found = (
        F.when(c("tool") == "code_graph", graph).when(c("tool") == "file_read", read).when(c("tool") == "repo_map", _named_near_file(listed("entities"), content, "entrypoint", 0.7))
        .when(c("tool") == "rag_search", F.transform(bare, searched)).when(c("tool") == "grep_search", F.when(F.size(listed("matches")) > 0, hits).otherwise(instead)).otherwise(none)
    )
    return results.select("session", "seq", F.posexplode(found).alias("place", "a")).select("session", "seq", "place", "a.*")


def exploration_note(anchors: DataFrame) -> DataFrame:
    """session, module and note: of each module (the first part of a path) the first definition above 0.8."""
    sure = anchors.where("kind = 'definition' and confidence > 0.8 and file is not null")
    first = F.min_by("symbol", F.struct("seq", "place"))
    return sure.groupBy("session", F.get(F.split("file", "/"), F.lit(0)).alias("module")).agg(F.concat(F.lit("Contains "), first).alias("note"))
