"""Chat formatting, quality rules and personal data against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from corpusloom.llm import chat, pii, quality_rules
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "a", "a@b.com_x@d.e mail a.b@c-d.org. x@y", "1.2.3.4.5.6.7.8 256.1.1.1 010.001.0.255", "1" * 6000, "1 " * 6000,
    "x" * 20000 + "@", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "tel +1 (743) 555-3824 +49 ... 1 +12", "DE89 3704 0044 0532 0130 00 DE89370400440532013001",
    "é€😀 a@b.de ￿x@y.zz", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "0" * 16 + " " + "0" * 19 + "x" + "0" * 20,
]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pat in BASE.items():
        for m in re.finditer(pat, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def texts(spark):
    sample = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return [t for t in TEXTS if t is None or len(t) < 13000] + sample


def test_pii_matches_plain_patterns(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit(1))
    got = {r.doc_id: r for r in pii.pii_digest(pii.find_pii(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i].spans.split(",")[: len(want)] == (want or got[i].spans.split(",")[:0])
        assert got[i].n_card == sum(x.startswith("card") for x in want)


def test_pii_adds_confirmed_accounts_and_scores_context(spark):
    df = spark.createDataFrame([(1, "my bank: DE89 3704 0044 0532 0130 00, or DE89370400440532013001"), (2, "x" * 20000 + "@")], "doc_id long, text string")
    rows = pii.redact(pii.find_pii(df)).orderBy("doc_id").collect()
    assert [(s.kind, s.start, s.end, s.score) for s in rows[0].pii if s.kind == "iban"] == [("iban", 9, 36, 1.0)]
    assert rows[0].redacted.startswith("my bank: [iban], or ") and rows[1].pii == []
    assert pii.find_pii(df.limit(0)).count() == 0


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = Counter(zip(w, w[1:], w[2:]))
    at = {i + k for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at))


def test_quality_measures(spark, texts):
    texts = [*texts, "a b a b a b", "a a a", "a a a a", "x\nx\n\n \ny\nx", "a b c d a b c " * 40]
    df = spark.createDataFrame([(i, t, "?") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], plain_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_chat_round_trip_and_branches(spark):
    rows = [(1, 0, "user", "hi # \\l <b> </turn>\n### x"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "assi: stant", None), (2, 0, None, ""), (None, 5, "assistant", "😀")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}\n") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("x"))
    got = {r.tree: r for r in chat.read_template(chat.format_chats(chat.reply_nodes(df))).collect()}
    assert len(got) == 4
    for conv, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", 0.0), (1, 5, 99, "user", "lone", 9.0), (1, 6, 7, "x", "loop", 9.0), (1, 7, 6, "x", "loop", 9.0)]
    nodes = spark.createDataFrame(tree, "tree long, node long, parent long, role string, text string, score double")
    say = lambda k: sorted([t.text for t in r.turns] for r in chat.read_template(chat.format_chats(nodes, k)).collect())
    assert say(None) == [["lone"], ["q", "a"], ["q", "b", "c"]] and say(1) == [["lone"]] and say(2) == [["lone"], ["q", "b", "c"]]
    assert chat.format_chats(nodes.limit(0)).count() == 0
