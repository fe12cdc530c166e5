"""The operators that run Arrow batches, and those that hash, against brute force on small tables."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, token_counts, token_shards
from corpusloom.llm.hashing import word_hashes
from corpusloom.llm.queries import BYTE_BPE, PIECES, WORD_BPE
from corpusloom.llm.wavelet import WaveletMatrix
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [
    None, "", " ", "\n\n \t", "a", "A b", "it's we'll 'll x'r", "a \n <|endoftext|>b <|startoftext|> <|endof", "naïve café ﬁ éx́ İstanbul ΣΑΣ", "日本語 テキスト", "a b c\x1cd\x85e", "!!!???...'''s 12345",
    "x" * 300 + "1" * 50 + "é" * 40, "word " * 3000, "한국어 각", "\x00\x01 a\x07b", "  lead and trail  \n",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_word_hashes_slices():
    texts = ["Aa bB  cc", "", None, "x" * 2_500_000 + " y", "aa BB", "é é " * 400_000]
    row, h = word_hashes(pa.array(texts))
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert row.tolist() == [i for i, _ in want]
    names = {}
    for (_, w), x in zip(want, h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def brute_components(rows, width, part):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= part * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return {r[0]: (len(sets[i]), min(least[find(i)])) for i, r in enumerate(rows)}


@pytest.mark.parametrize(("width", "part", "pieces"), [(3, 90, None), (5, 80, None), (5, 80, (300, 7))])
def test_ngram_join(spark, docs, width, part, pieces, monkeypatch):
    rnd = random.Random(width)
    if pieces:  # the unions of groups in many pieces, their members dealt out
        monkeypatch.setattr(ngram_join, "PIECE_IDS", pieces[0])
        monkeypatch.setattr(ngram_join, "PIECE_MEMBERS", pieces[1])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(200)]
    for k in range(60):  # chains and stars of near copies
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = word()
        rows.append((10_000 + k, " ".join(w)))
        if k % 3 == 0:
            base = w
    for k in range(120):  # sizes around the smallest that can link
        n = rnd.randint(1, 24)
        w = [f"w{i}" for i in range(n)]
        if rnd.random() < 0.5:
            w[rnd.randrange(n)] = "X"
        rows.append((20_000 + k, " ".join(w)))
    rows += [(30_000, None), (30_001, ""), (30_002, "  \n"), (30_003, "One two"), (30_004, "one TWO")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, ngram_join.Measure(width, part)).collect()}
    assert got == brute_components(rows, width, part)


def test_overlap_bound_misses_no_link():
    rnd, measure = random.Random(4), ngram_join.Measure(3, 80)
    for _ in range(3000):
        p = set(rnd.sample(range(60), rnd.randrange(5, 30)))
        x, y = (set(p) ^ set(rnd.sample(range(60), rnd.randrange(0, 12))) or {1} for _ in "xy")
        links = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
        if not links(x, y) or links(x, p) and links(y, p):
            continue
        for a in (x, y):
            least = ngram_join.overlap_bound(measure, *(np.array([v]) for v in (links(a, p), len(a), len(p), len(a ^ p))))
            assert len((x ^ p) & (y ^ p)) >= least[0] >= 1


def test_ngram_join_empty(spark, docs):
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    for df in (docs, docs.withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 > 0, "big").otherwise(F.col("source")))):
        rows = mixing.mix(df.withColumn("size", F.lit(1))).collect()
        assert len(rows) == df.count() and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
        total, largest, per = 0, max(r.size for r in rows), defaultdict(lambda: [0, 0, 0.0])
        for r in rows:
            assert 0 <= r.copies <= 2
            per[r.source][0] += r.size
            per[r.source][1] += r.size * r.copies
            per[r.source][2] = r.target
            total += r.size
        names = sorted([s for s in per if s is not None]) + ([None] if None in per else [])
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        capped: set = set()
        while True:
            left = 1.5 * total - sum(2 * per[s][0] for s in capped)
            level = left / sum(weight[s] for s in names if s not in capped)
            more = {s for s in names if s not in capped and level * weight[s] > 2 * per[s][0]}
            if not more:
                break
            capped |= more
        for s in names:
            assert per[s][2] == pytest.approx(2 * per[s][0] if s in capped else level * weight[s])
            assert abs(per[s][1] - per[s][2]) <= largest
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = docs.withColumns({c: F.lit(c) for c in ("place", "rounds", "below", "copies", "target", "_id", "component_id")})
    took = mixing.take(clash)
    assert took.columns == clash.columns and took.count() == sum(r.copies for r in mixing.mix(docs).collect()) and {r.place for r in took.collect()} == {"place"}
    assert ngram_join.keep_one_of_each(clash).columns == clash.columns
    nothing = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.copies * r.size for r in mixing.mix(nothing).collect()] == [0, 0, 0]


def test_prefix_counts(spark, docs):
    counter = token_counts.PrefixCounter(WORD_BPE)
    rnd = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("abcdeéß.,'1 ") for _ in range(150)) for _ in range(30)]
    for t in texts:
        for n, k in enumerate(counter.counts(t[:700]).tolist(), 1):
            assert k == len(counter.whole.encode(t[:n], add_special_tokens=False).ids), t[:n]
        assert len(counter.counts(t)) == len(t)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("prefix_counts", F.lit(1))
    out = token_counts.prefix_counts(df, WORD_BPE)
    p = F.col("prefix_counts")
    for r in out.select("text", token_counts.n_tokens(p).alias("n"), token_counts.longest_prefix(p, 7).alias("fit"), token_counts.tokens_before(p, F.lit(5)).alias("five")).collect():
        size = lambda x: len(counter.whole.encode(x, add_special_tokens=False).ids)
        assert r.n == size(r.text or "") and r.five == size((r.text or "")[:5]) and size((r.text or "")[: r.fit]) <= 7
    assert token_counts.prefix_counts(df.limit(0), WORD_BPE).count() == 0


def test_prefix_counts_of_joining_characters():
    counter, rnd = token_counts.PrefixCounter(WORD_BPE), random.Random(3)
    kinds = ["\u0e01\u0e02\u0e07\u0e47\u0e48\u0e49\u0e34", "eaA\u1eb8\u0301\u0300\u0302oO\u0308\u03a3\u03c3\u0130I", "\u0915\u0916\u093f\u094d\u0902\u093c", "\uac00\u1100\u1161\u11a8\ud55c", "' lsrev!.\u0338\u0301=<", "\u212b\ufb01\u0958\u0344ab"]
    for _ in range(150):
        kind = rnd.choice(kinds) + rnd.choice(["", *kinds])
        t = "".join(rnd.choice(kind) for _ in range(rnd.randint(1, 90)))
        assert counter.counts(t).tolist() == [len(counter.whole.encode(t[:n], add_special_tokens=False).ids) for n in range(1, len(t) + 1)], t
    for kind in (kinds[0], "e\u0301a\u0300", "\u1112\u1161\u11ab"):  # long blocks without a blank, in parts that compose
        t = kind * 2000
        assert counter.counts(t)[-1] == len(counter.whole.encode(t, add_special_tokens=False).ids)


def test_token_shards(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE_BPE)
    df = spark.createDataFrame([(5_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: r[0])
    token_shards.write_shards(df.withColumn("start", F.lit(1)), BYTE_BPE, str(tmp_path / "shards"), shard_bytes=60_000)
    shards = token_shards.read_shards(spark, str(tmp_path / "shards"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_shards.documents(shards).collect()}
    at, every = 0, []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
        every += [(i, k, x) for k, x in enumerate(ids)]
    assert shards.select("shard").distinct().count() > 3
    token = every[len(every) // 2][2]
    assert sorted(map(tuple, token_shards.find_token(shards, token).collect())) == sorted((i, k) for i, k, x in every if x == token)
    assert token_shards.count_token(shards, token).first()[0] == sum(x == token for *_, x in every)
    token_shards.write_shards(df.limit(0), BYTE_BPE, str(tmp_path / "none"))
    assert token_shards.documents(token_shards.read_shards(spark, str(tmp_path / "none"))).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).zipf(1.3, 5000).clip(0, 999).astype("<u2")
    for n in (0, 1, 511, 512, 513, 5000):
        w = WaveletMatrix.unpack(WaveletMatrix.build(ids[:n], 10).pack())
        assert (w.decode() == ids[:n]).all()
        at = np.arange(n)
        assert (w.access(at) == ids[:n]).all()
        for token in (1, 2, 7, 999, 1023, 5000):
            where = np.flatnonzero(ids[:n] == token)
            assert w.find(token).tolist() == where.tolist() and w.find(token, 1, 3).tolist() == where[1:3].tolist()
            assert w.rank(token, n // 2) == (where < n // 2).sum()


def test_language_id(spark, docs):
    df = docs.select("doc_id", "text", "lang").withColumn("score", F.lit("x"))
    model = language_id.learn(df.where(~language_id.held_out(F.col("doc_id"))), PIECES)
    rows = language_id.identify(df, model).where(language_id.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in language_id.identify(odd, model).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    nothing = language_id.learn(df.limit(0), PIECES)
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd, nothing).collect()} == {("und", 0.0)}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "aba"]
    h = np.array([language_id._hash(p) for p in pieces], np.uint64)
    order = np.argsort(h)
    probs = np.random.default_rng(0).random((len(pieces), 2)) / 4
    m = language_id.Model(("x", "y"), h[order], probs[order], 3)

    def brute(w, k):
        if not w:
            return 1.0
        return sum(probs[pieces.index(w[:n]), k] * brute(w[n:], k) for n in range(1, len(w) + 1) if w[:n] in pieces)

    for w in ("a", "ab", "abba", "ababababababab"):
        got = language_id.WordScores(m).score([w, f"{w} b"])
        for k in range(2):
            assert got[0, k] == pytest.approx(np.log(brute("▁" + w, k)))
            assert got[1, k] == pytest.approx(np.log(brute("▁" + w, k)) + np.log(brute("▁b", k)))


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs):
    rnd, lemma = random.Random(5), decontaminate.Lemma()
    items = [(i, "".join(rnd.choice("abcde fgh") for _ in range(n)).strip() or "x") for i, n in enumerate([30, 60, 95, 140, 200, 300, 25, 21, 27, 39])] + [(90, None), (91, " "), (92, "tiny"), (93, "ab c"), (None, "no id at all, but sixty characters or so of words nevertheless")]
    texts = []
    for i, t in items[:10]:
        for edits in (0, lemma.edits(len(t)) - 1, lemma.edits(len(t)), lemma.edits(len(t)) + 1, 3 * lemma.edits(len(t)) + 3):
            w = list(t)
            for _ in range(max(0, edits)):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], ["z"], [w[k], "z"]])
            around = lambda: "".join(rnd.choice("abcde fgh") for _ in range(rnd.randrange(200)))
            texts.append(around() + "".join(w).upper().replace(" ", "\n") + around())
    rows = [(k, t) for k, t in enumerate([*texts, None, "", "x"])]
    rows += [(900, "so AB\nC."), (901, "cab c"), (902, "ab cd"), (903, "Tiny"), (904, "tinyx tiny"), (905, f"({items[-1][1].upper()})"), (None, "untouched"), (None, items[3][1]), (4000, "clean"), (4000, items[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edits", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    short = {k for k in got if k[1] in (92, 93) and k[0] is not None and k[0] >= 900 or k[1] is None}
    assert short == {(900, 93), (903, 92), (904, 92), (905, None)} and got[904, 92][2:] == (0, 6, 10)
    for k in [k for k in got if k[1] in (92, 93) or k[1] is None]:
        del got[k]
    for d, t in rows:
        low = re.sub(r"\s", " ", (t or "").lower())
        for i, item in items[:10]:
            want = plain_edits(item, low)
            if want <= lemma.edits(len(item)):
                r = got.pop((d, i), None) or got[d, i]
                assert r.edits == want and plain_edits(item, low[r.start : r.end]) == want
    assert not got
    clean = decontaminate.decontaminate(df, bench)
    kept = clean.collect()
    assert clean.columns == df.columns and 0 < len(kept) < len(rows)
    assert sorted(r.text for r in kept if r.doc_id in (None, 4000) and r.text is not None) == ["clean", "untouched"] and sum(r.text is None for r in kept) == 1
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0
    held = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in held.collect() if b.text in d.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, held).collect()} and want


def test_line_dedup(spark):
    rnd = random.Random(2)
    line = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(999)) for _ in range(8))
    passage = [line() for _ in range(12)]
    rows = [(k, "\n".join([line() for _ in range(rnd.randrange(5))] + passage + [line() for _ in range(rnd.randrange(5))])) for k in range(6)]
    rows += [(10, None), (11, ""), (12, "\n\n"), (13, line()), (14, rows[0][1]), (None, rows[0][1]), (15, "é\n" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chunks_removed", F.lit("x")).withColumn("extra", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(got) == len(rows) and got[0].text == rows[0][1] and got[10].text is None and got[12].text == "\n\n" and got[13].text == rows[9][1]
    rule = line_dedup.Chunks()
    chunks = {i: [(c.n_lines, c.text) for c in r] for i, r in df.where("text is not null").select("doc_id", line_dedup.chunk_texts(F.col("text"), rule)).collect()}
    seen = set()
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda x: (x[0] is None, x[0] or 0)):
        assert "\n".join(c for _, c in chunks[i]) == t
        keep = []
        for n, c in chunks[i]:
            if n < rule.least_lines or len(c) < rule.least_chars or c not in seen:
                keep.append(c)
            seen.add(c)
        assert got[i].text == "\n".join(keep) and got[i].n_chunks_removed == len(chunks[i]) - len(keep)
    assert sum(got[k].n_chunks_removed for k in range(1, 6)) >= 5
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_passages(rows, rule):
    """Text and stretches removed of each row, from all runs of lines."""
    def runs(lines):
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                t = "\n".join(lines[a:z])
                if (z - a >= rule.least_lines and len(t) >= rule.least_chars) or (z - a == 1 and len(t.split()) >= rule.least_words):
                    yield a, z, t

    first, out = {}, []
    key = lambda i, a: (i is None, i or 0, a)
    for i, t in rows:
        for a, _, x in runs(t.split("\n")) if t is not None else ():
            first[x] = min(first.get(x, key(i, a)), key(i, a))
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        lines, gone = t.split("\n"), set()
        for a, z, x in runs(lines):
            if first[x] != key(i, a):
                gone |= set(range(a, z))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), sum(k - 1 not in gone for k in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rule", [line_dedup.Passages(), line_dedup.Passages(3, 25, 12)])
def test_passages_go_whole(spark, rule):
    rnd = random.Random(9)
    line = lambda n=8: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(9999)) for _ in range(n))
    rows = []
    for k in range(60):  # passages of 1 to 6 lines, some of one long line
        passage = [line() for _ in range(k % 6 + 1)] if k % 10 else [line(50)]
        rows += [(10 * k + j, "\n".join([line() for _ in range(rnd.randrange(4))] + passage + [line() for _ in range(rnd.randrange(4))])) for j in range(2)]
    rows += [(2000 + k, "\n".join(rnd.choice(["", "a", "bb", "- c", "one more line", "yes, that is a line of some length"]) for _ in range(rnd.randrange(30)))) for k in range(25)]
    rows += [(3000, None), (3001, ""), (3002, "\n\n"), (3003, "\n" * 90), (3004, "é\n" * 60), (0, rows[1][1]), (0, rows[1][1]), (None, rows[0][1]), (None, rows[5][1]), (3005, "\n".join([rows[30][1]] * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chunks_removed", F.lit("x")).withColumn("extra", F.lit(1))
    out = line_dedup.dedup_passages(df, rule)
    assert out.columns == ["doc_id", "text", "extra", "n_chunks_removed", "n_chars_removed"]
    got = out.collect()
    assert sorted([(r.doc_id, r.text, r.n_chunks_removed) for r in got], key=str) == brute_passages(rows, rule)
    assert sum(r.n_chars_removed for r in got) == sum(len(t or "") for _, t in rows) - sum(len(r.text or "") for r in got) > 0
    assert line_dedup.dedup_passages(df.limit(0), rule).count() == 0


def test_line_dedup_query_removes_short_passages(spark, tmp_path):
    from corpusloom.llm.queries import op9_line_dedup

    line = lambda k, n=8: " ".join(f"w{k}x{i}" for i in range(n))
    passages = [[line(100 * n + k) for k in range(n)] for n in range(2, 7)] + [[line(999, 50)]]
    rows = [(10 * p + d, "\n".join([line(10_000 + 20 * p + d), *x, line(11_000 + 20 * p + d)])) for p, x in enumerate(passages) for d in range(2)]
    rows += [(90 + d, "\n".join([line(12_000 + d), line(998), line(13_000 + d)])) for d in range(2)]  # a single short line stays
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text.split("\n") for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    for p, x in enumerate(passages):
        assert len(got[10 * p]) == len(x) + 2 and got[10 * p + 1] == [line(10_001 + 20 * p), line(11_001 + 20 * p)]
    assert len(got[90]) == len(got[91]) == 3


@pytest.mark.parametrize("part", [80, 90])
def test_ngram_join_repeated_rows(spark, part):
    rnd = random.Random(part)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for family in range(25):  # a head with close copies, and chains that leave it step by step
        head = [word() for _ in range(120)]
        copies = [list(head)]
        for _ in range(5):
            w = list(head)
            w[rnd.randrange(120)] = word()
            copies.append(w)
        for _ in range(3):
            w = list(head)
            for _ in range(6):
                for k in rnd.sample(range(120), 1 if part == 90 else 2):
                    w[k] = word()
                w = list(w)
                copies.append(w)
        rows += [(100 * family + k, " ".join(w)) for k, w in enumerate(copies)]
    rows = [r for r in rows for _ in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, ngram_join.Measure(3, part)).collect()}
    assert got == brute_components(rows, 3, part)


def test_ngram_sets_are_made_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text)] * 3 + [(2, text + " x"), (2, text + " x")], "doc_id long, text string")
    measure = ngram_join.Measure(3, 90)
    described = ngram_join.describe_sets(df, measure)
    sets = ngram_join.fetch_sets(df, described, described.select("node").distinct(), measure)
    assert sets.count() == sets.select("node").distinct().count() == 2
