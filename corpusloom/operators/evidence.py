"""Evidence: admission, typing, ranking, budgets, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Weights of evidence types and confidence levels in ranking, and the order of types in a summary.
TYPE_WEIGHT = {"definition": 1.0, "direct_call": 0.9, "route_config": 0.85, "test_assertion": 0.8, "documentation": 0.75, "lexical_match": 0.72, "semantic_match": 0.6}
LEVEL_WEIGHT = {"confirmed": 1.0, "likely": 0.7, "unknown": 0.4}
#: Endings of source files whose hits count as lexical.
CODE_ENDINGS = (".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".swift", ".vue", ".svelte")


def _lookup(key: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def evidence_type(source: Column, files: Column) -> Column:
    """The type that a piece's source tells; hits of a search count as lexical if one of their files (category:path) is code."""
    s = F.lower(source)
    path = lambda f: F.trim(F.regexp_replace(f, "^[^:]*:", ""))
    has_code = F.exists(F.coalesce(files, F.array().cast("array<string>")), lambda f: X.any_of([path(f).endswith(e) for e in CODE_ENDINGS]))
    return (
        F.when(s.contains("definition"), "definition").when(s.contains("call"), "direct_call").when(s.contains("file_read"), "definition").when(s.contains("grep"), "lexical_match")
        .when(s.contains("rag"), F.when(has_code, "lexical_match").otherwise("semantic_match")).when(s.contains("graph"), "direct_call").otherwise("semantic_match")
    )


def admit(pieces: DataFrame, least: float = 0.3) -> DataFrame:
    """Evidence of pieces (session, seq, source, file_path, content, relevance, files): those above the threshold, the
    first of each source, file and opening 200 characters, with type and confidence."""
    key = F.concat_ws("|", "source", F.coalesce("file_path", F.lit("")), F.left("content", F.lit(200)))
    first = F.row_number().over(Window.partitionBy("session", "key").orderBy("seq"))
    kept = pieces.where(F.col("relevance") > least).withColumn("key", key).withColumn("n", first).where("n = 1").drop("n", "key")
    return kept.withColumns({"evidence_type": evidence_type(F.col("source"), F.col("files")), "confidence": X.confidence(F.col("relevance"))})


def rerank(evidence: DataFrame, most: int = 30) -> DataFrame:
    """The best of each session by type and confidence weight, with place; ties by seq."""
    score = _lookup(F.col("evidence_type"), TYPE_WEIGHT, 0.5) * _lookup(F.col("confidence"), LEVEL_WEIGHT, 0.4)
    scored = evidence.withColumn("score", F.round(score, 6))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "seq"))).where(F.col("place") <= most)


def summary(pieces: DataFrame, most: int = 8000) -> DataFrame:
    """session and summary: entries by relevance until the next one would pass the budget."""
    entry = F.concat(F.lit("[source: "), "source", F.lit("]"), F.coalesce(F.concat(F.lit(" [file: "), "file_path", F.lit("]")), F.lit("")), F.lit("\n"), "content")
    w = Window.partitionBy("session").orderBy(F.desc("relevance"), "seq")
    fit = pieces.withColumn("entry", entry).withColumns({"used": F.sum(F.length("entry")).over(w), "place": F.row_number().over(w)}).where(F.col("used") <= most)
    return fit.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda s: s["entry"]), "\n\n---\n\n").alias("summary"))


def hard_gate(facts: DataFrame) -> DataFrame:
    """facts with passed, max_confidence and reasons.

    facts: session, intent, rounds, n_anchors, n_definitions, n_context and has_definition, has_call, has_lexical, has_semantic.
    """
    soft, doc = F.col("intent").isin(*X.SOFT), F.col("intent").isin(*X.DOC)
    anchored = F.col("n_definitions") > 0
    structural = F.col("has_definition") | F.col("has_call") | (F.col("has_lexical") & anchored)
    mild = (soft | doc) & F.col("has_semantic")
    no_anchor = ~anchored & ~doc & ~soft & (F.col("rounds") < 2)
    chain = F.col("intent").isin("call_chain", "mechanism") & (F.col("n_anchors") < 2) & (F.col("rounds") < 2)
    limit = F.least(F.when(anchored, 1.0).when(doc, 0.85).when(soft, 0.8).otherwise(0.7), F.when(structural, 1.0).when(mild, 0.78).otherwise(0.6))
    reasons = F.array_compact(F.array(F.when(no_anchor, "No definition anchor found"), F.when(~structural & ~mild, "Missing structural evidence"), F.when(chain, "Call chain requires multiple anchors")))
    return facts.withColumns(
        {"passed": ~no_anchor & ~chain, "max_confidence": F.when(F.col("n_context") >= 3, F.greatest(limit, F.lit(0.6))).otherwise(limit), "reasons": F.array_join(reasons, "; ")}
    )


def should_stop(facts: DataFrame, most_rounds: int = 6) -> Column:
    """Whether a session has gathered enough; the tests are tried in order, and the first that decides counts.

    facts as for hard_gate, with n_evidence, n_semantic, n_structural, confidence, verified, closed_path, conflicts.
    """
    c = F.col
    light, deep, doc, soft = (c("intent").isin(*x) for x in (X.LIGHT, X.DEEP, X.DOC, X.SOFT))
    primary = c("n_definitions") > 0
    low = F.when(doc | soft, F.when(c("rounds") >= 1, 0.4).otherwise(0.5)).otherwise(F.when(c("rounds") >= 2, 0.5).otherwise(0.6))
    half = (c("rounds") >= most_rounds // 2) & (c("n_evidence") >= 3) & (primary | soft) & (~deep | c("verified"))
    path = c("intent").isin("call_chain", "architecture")
    wait = (
        (path & ~c("closed_path") & (c("rounds") < 3)) | (path & (c("n_anchors") < 2) & (c("rounds") < 2)) | (~primary & ~soft & (c("n_context") < 3) & (c("rounds") < 2))
        | (c("conflicts") & (c("rounds") < 3)) | (~soft & (c("n_structural") == 0) & (c("rounds") < 2)) | ((c("confidence") < low) & (c("rounds") < 3))
    )
    enough = (c("rounds") >= 2) & (c("n_evidence") >= 2)
    return (
        F.when(half, True).when(light & (c("rounds") >= 1) & (c("n_evidence") >= 1), True)
        .when(doc & ((c("n_semantic") >= 2) | ((c("rounds") >= 1) & (c("n_context") >= 2))), True)
        .when((c("intent") == "location") & primary & (c("n_evidence") >= 1), True).when(c("intent").isin("concept", "usage") & (c("n_evidence") >= 2), True)
        .when(wait, False).when(enough & deep, c("verified") | (c("rounds") >= most_rounds)).when(enough, True).when(light & (c("rounds") >= 1), True).otherwise(False)
    )


def graph_relevance(operation: Column, hits: Column, failed: Column) -> Column:
    """Score of a graph query: a base by operation, a little more with hits, little without, none on failure."""
    base = _lookup(operation, {"find_definition": 0.9, "find_callers": 0.85, "find_callees": 0.85, "get_class_hierarchy": 0.8, "find_imports": 0.75}, 0.7)
    return F.when(failed, 0.0).when(hits > 0, F.least(base + 0.05, F.lit(0.95))).otherwise(F.least(base, F.lit(0.12)))
