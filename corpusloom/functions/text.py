"""Text functions of retrieval, naming and routing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of a token.
TOKEN = r"[A-Za-z0-9_\x{4e00}-\x{9fff}]+"
#: Words that say nothing about what to search for.
STOP_WORDS = (
    "the and for are how what when why this that with from into not but has have was were does did can use using used "
    "one any all out our you its way may via"
).split()
#: Query intents by how much retrieval they take.
LIGHT = ("concept", "usage", "topic_coverage", "section_locator", "repo_overview", "followup_clarification", "version_check", "api_docs", "external_reference")
DEEP = ("mechanism", "call_chain", "impact_analysis", "debugging", "change_guidance")
CODE = ("location", "mechanism", "call_chain", "impact_analysis", "debugging", "change_guidance", "implementation")
DOC = ("topic_coverage", "relationship", "evidence", "section_locator", "repo_overview", "followup_clarification")
SOFT = ("concept", "architecture", "usage", *DOC, "general", "version_check", "api_docs", "external_reference")
#: Lexical signs of an intent, tried in this order; "=" whole text, "^" start, "~" anywhere.
INTENT_SIGNS = (
    ("general", "=", ("hi", "hello", "hey", "thanks", "thank you", "thx", "ty")),
    ("repo_overview", "~", ("tech stack", "what does this repo", "overview of", "what is this repo")),
    ("location", "^", ("where is", "where does", "where can i find")),
    ("architecture", "~", ("architecture", "overall structure", "high-level structure", "system design")),
    ("concept", "^", ("what is", "what are", "explain ")),
    ("topic_coverage", "~", ("which sections", "which files mention", "where is ... mentioned", "which parts discuss")),
    ("usage", "^", ("how to use", "how do i use", "how can i use")),
    ("followup_clarification", "~", ("what you just said", "can you clarify", "can you explain more", "you mentioned", "earlier you said")),
)
#: What a search type adds to a query, unless the query has one of the words.
SEARCH_SUFFIX = {
    "version": (("latest", "version"), " latest stable version"),
    "cve": (("cve", "vulnerability"), " CVE security vulnerability"),
    "code_docs": (("documentation", "docs"), " documentation API reference"),
}
#: Openings dropped from a question, and characters that end its title, in order.
TITLE_PREFIXES = ("[Current page context:", "User question:", "Question:")
TITLE_ENDS = ("？", "?", "。", "\n", "，", ",")


def lit(x: object) -> Column:
    return F.lit(x)


def present(x: Column) -> Column:
    """x, or null where it is an empty string."""
    return F.when(x != "", x)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def tokenize(text: Column) -> Column:
    """Lower-case tokens of letters, digits, underscores and CJK ideographs; null as none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, lit(""))), lit(TOKEN), lit(0))


def first_token(text: Column) -> Column:
    """The first of a text's tokens (as tokenize gives them), or null; the rest isn't read."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(text, lit(""))), TOKEN, 0), lit(""))


def doc_key(source: Column, path: Column, anchors: list[Column], content: Column) -> Column:
    """source|anchor|digest: the first present source or path, else "unknown", and the first present anchor."""
    digest = F.substring(F.md5(content.cast("binary")), 1, 12)
    return F.concat_ws("|", F.coalesce(present(source), present(path), lit("unknown")), F.coalesce(*[present(a) for a in anchors], lit("")), digest)


def plan_k(base: Column, times: int, low: int = 6, high: int = 30) -> Column:
    return F.greatest(lit(low), F.least(lit(high), base * times))


def _without_git(path: Column) -> Column:
    bare = F.regexp_replace(F.trim(path), "/+$", "")
    return F.when(bare.endswith(".git"), F.left(bare, F.length(bare) - 4)).otherwise(bare)


def normalize_repo_url(url: Column) -> Column:
    """scheme://host/owner/repo in lower case; ssh addresses become https, other strings are cleaned."""
    raw = F.trim(F.coalesce(url, lit("")))
    ssh = F.regexp_extract(raw, r"^git@([^:]*):", 1)
    ssh_parts = F.array_remove(F.split(_without_git(F.regexp_replace(raw, r"^git@[^:]*:", "")), "/"), "")
    scheme, host = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = _without_git(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    parts = F.array_remove(F.split(path, "/"), "")
    two = lambda p: F.lower(F.concat_ws("/", F.get(p, lit(0)), F.get(p, lit(1))))
    return (
        F.when(raw.startswith("git@") & (ssh != "") & (F.size(ssh_parts) >= 2), F.concat(lit("https://"), F.lower(ssh), lit("/"), two(ssh_parts)))
        .when((host != "") & (F.size(parts) >= 2), F.concat(scheme, lit("://"), host, lit("/"), two(parts)))
        .when(host != "", F.regexp_replace(F.concat(scheme, lit("://"), host, path), "/+$", ""))
        .otherwise(F.lower(_without_git(raw)))
    )


def repo_key(normal: Column) -> Column:
    """owner/repo of a normalised address, or an empty string."""
    return F.regexp_extract(F.lower(normal), r"^[a-z][a-z0-9+.-]*://[^/]*/([^/]+/[^/?#]+)", 1)


def repo_name(url: Column) -> Column:
    return F.element_at(F.split(F.replace(F.regexp_replace(url, "/+$", ""), lit(".git"), lit("")), "/"), -1)


def repo_hash(url: Column) -> Column:
    """name_digest of the lower-cased address."""
    clean = F.lower(F.replace(F.regexp_replace(url, "/+$", ""), lit(".git"), lit("")))
    return F.concat(F.element_at(F.split(clean, "/"), -1), lit("_"), F.substring(F.md5(clean.cast("binary")), 1, 8))


def safe_dir_name(name: Column) -> Column:
    held = F.when(F.trim(F.coalesce(name, lit(""))) == "", lit("repo")).otherwise(F.trim(name))
    clean = F.regexp_replace(F.regexp_replace(held, r"[/\\:\x00]", "_"), r"^\.+|\.+$", "")
    return F.left(F.when(clean == "", lit("repo")).otherwise(clean), lit(200))


def safe_filename(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(clean == "", lit("section")).otherwise(clean)


#: Latin letters with marks, and the letters that they fold to.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def collision_form(name: Column) -> Column:
    """What two file names have in common if some file system can't tell them apart."""
    clean = F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), MARKED, BARE), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(clean == "", lit("section")).otherwise(clean)


def chat_title(question: Column, most: int = 40) -> Column:
    """A short title: known openings dropped, cut at the first kind of delimiter present, then at a word."""
    q = F.trim(F.coalesce(question, lit("")), lit(" \t\r\n"))
    for p in TITLE_PREFIXES:
        q = F.when(q.startswith(p), F.trim(F.substring(q, len(p) + 1, 1 << 30), lit(" \t\r\n"))).otherwise(q)
    cut = q
    for d in reversed(TITLE_ENDS):
        cut = F.when(q.contains(d), F.trim(F.substring_index(q, d, 1), lit(" \t\r\n"))).otherwise(cut if d != TITLE_ENDS[-1] else q)
    head = F.left(cut, lit(most))
    space = most - F.instr(F.reverse(head), " ")
    short = F.when(head.contains(" ") & (space > most // 2), F.left(head, space)).otherwise(head)
    return F.when(cut == "", lit("New chat")).when(F.length(cut) <= most, cut).otherwise(F.concat(F.trim(short), lit("...")))


def parse_citation(cited: Column) -> Column:
    """category, path, symbol, start and end of category:path:12-34, category:path:symbol or category:path."""
    part = lambda k: present(F.regexp_extract(cited, r"^([A-Za-z0-9_]+):([^:]*)(?::(?:([0-9]+)(?:-([0-9]+))?|([^:]+)))?$", k))
    return F.struct(
        part(1).alias("category"), part(2).alias("path"), part(5).alias("symbol"), part(3).cast("int").alias("start"), F.coalesce(part(4), part(3)).cast("int").alias("end")
    )


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull(), path).when(start == end, F.concat(path, lit(":"), start)).otherwise(F.concat(path, lit(":"), start, lit("-"), end))


def lexical_intent(question: Column) -> Column:
    """The first intent whose signs the question shows; null if none does."""
    q = F.lower(F.trim(F.coalesce(question, lit(""))))
    out = lit(None).cast("string")
    for intent, how, signs in reversed(INTENT_SIGNS):
        if how == "=":
            test = F.regexp_replace(q, "[!.?]+$", "").isin(*signs)
        else:
            test = any_of([q.startswith(s) if how == "^" else q.contains(s) for s in signs])
        if intent == "concept":
            test = test & (F.length(q) < 100)
        out = F.when(test, lit(intent)).otherwise(out)
    return out


def answer_path(intent: Column, answered: Column) -> Column:
    return F.when(answered, lit("direct")).when(intent.isin(*LIGHT), lit("light")).when(intent.isin(*DEEP, *CODE), lit("deep")).otherwise(lit("light"))


def wants_expansion(query: Column) -> Column:
    """At least three words of over two letters, and none of the plain openings."""
    q = F.lower(F.trim(query))
    return (F.size(F.filter(F.split(q, r"[ \t\r\n]+"), lambda w: F.length(w) > 2)) >= 3) & ~any_of(
        [q.startswith(s) for s in ("what is", "where is", "how to", "list all", "show me")]
    )


def keyword_pattern(text: Column) -> Column:
    """The first four different words that aren't stop words, as alternatives; empty if there are fewer than two."""
    words = F.regexp_extract_all(text, lit("[A-Za-z][A-Za-z0-9_]{2,}"), lit(0))
    telling = F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS))
    first = F.filter(telling, lambda w, i: F.array_position(F.transform(telling, F.lower), F.lower(w)) == i + 1)
    chosen = F.slice(first, 1, 4)
    return F.when(F.size(chosen) >= 2, F.array_join(chosen, "|")).otherwise(lit(""))


def contextual_query(keyword: Column, missing: Column, question: Column) -> Column:
    """The longest missing piece with the keyword, else the longest if longer than it, else the question; 250 characters."""
    k = F.lower(keyword)
    longest = lambda a: F.element_at(F.array_sort(a, lambda x, y: F.length(y) - F.length(x)), 1)
    with_key = F.filter(missing, lambda m: F.lower(m).contains(k))
    own = F.when(F.lower(question).contains(k), question).otherwise(F.concat(keyword, lit(" "), question))
    return F.left(
        F.when(F.size(with_key) > 0, longest(with_key)).when((F.size(missing) > 0) & (F.length(longest(missing)) > F.length(keyword)), longest(missing)).otherwise(own), lit(250)
    )


def enhance_query(query: Column, kind: Column) -> Column:
    out = query
    for name, (words, suffix) in SEARCH_SUFFIX.items():
        out = F.when((kind == name) & ~any_of([F.lower(query).contains(w) for w in words]), F.concat(query, lit(suffix))).otherwise(out)
    return out


_CODE_FILE = r"\.(?:tsx|ts|jsx|js|py|go|rs|java|rb|php)"


def path_in_text(text: Column) -> Column:
    """The first source file that a text names, or "unknown"."""
    patterns = (
        rf"(?i)in[ \t\r\n]+[`\"]?([^ \t\r\n`\"]+{_CODE_FILE})[`\"]?",
        rf"(?i)file[: \t\r\n]+[`\"]?([^ \t\r\n`\"]+{_CODE_FILE})[`\"]?",
        rf"(?i)([a-zA-Z0-9_/]+{_CODE_FILE})",
    )
    return F.coalesce(*[present(F.regexp_extract(text, p, 1)) for p in patterns], lit("unknown"))


def line_in_text(text: Column) -> Column:
    """The first line number that a text names, or null."""
    patterns = (r"(?i)line[ \t\r\n]*([0-9]+)", r":([0-9]+)", r"(?i)l([0-9]+)")
    return F.coalesce(*[present(F.regexp_extract(text, p, 1)) for p in patterns]).cast("int")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, lit(most)), lit("..."))).otherwise(text)


def context_header(index: Column, kind: Column, source: Column) -> Column:
    return F.concat_ws(" | ", F.format_string("[chunk %d]", index), F.concat(lit("type: "), present(kind)), F.concat(lit("source: "), present(source)))


def confidence(score: Column) -> Column:
    return F.when(score > 0.8, lit("confirmed")).when(score > 0.5, lit("likely")).otherwise(lit("unknown"))


def prefix_key(path: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, n), "/")


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, lit(False)))
    return F.coalesce(present_position(same), F.size(same))


def present_position(flags: Column) -> Column:
    """The number of flags before the first false one; null if all are true."""
    at = F.array_position(flags, lit(False))
    return F.when(at > 0, (at - 1).cast("int"))


def sampled_tokens(text: Column, exact_below: int = 200, lines: int = 100, tokens: Callable[[Column], Column] = tokenize) -> Column:
    """Token count, exact for short texts and else scaled from every n-th line (about `lines` of them)."""
    parts = F.split(text, "\n")
    step = F.greatest(lit(1), F.floor(F.size(parts) / lines).cast("int"))
    sample = F.array_join(F.filter(parts, lambda x, i: i % step == 0), "\n")
    scaled = F.size(tokens(sample)) * F.length(text) / F.greatest(lit(1), F.length(sample))
    return F.when(F.length(text) < exact_below, F.size(tokens(text)).cast("double")).otherwise(scaled)


def json_block(text: Column) -> Column:
    """The text from its first to its last brace, code fences aside; null where braces don't balance."""
    body = F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    balance = F.regexp_count(body, lit(r"\{")) == F.regexp_count(body, lit(r"\}"))
    return F.when(balance, present(body))


def parse_time(text: Column) -> Column:
    """An ISO time; naive ones are UTC, unreadable ones null."""
    return F.try_to_timestamp(F.replace(text, lit("Z"), lit("+00:00")))
