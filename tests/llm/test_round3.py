"""Vector codes, alignment and BPE against plain versions; long and repetitive texts; null and repeated ids."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from corpusloom.llm import alignment, bpe, chat, decontaminate, ngram_join, pii, queries, vector_codes
from corpusloom.llm.queries import BYTE_BPE, PIECES, WORD_BPE
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DIR = "/root/testdata/sf0.001"
ODD = [
    "", None, "   \n", "Hello World's it's 'twas don't O'SAMPLE ’s", "a<|endoftext|>b <|startoftext|> <s>", "été Été İstanbul ΣΑΣ Straße", "日本語 テキスト, ok 中文", "x\x1cy\x1fz\x00w \x85q\xa0r\r\n\t",
    "1234 ½ ² Ⅷ ९ 😀😃 ok👍🏽!", "a▁b", "x" * 5000, "word " * 3000, "ab" * 40 + " \n" * 30 + "end", " lead", "trail ", "\n", "{\r\n};\r\n  x();\r\n" * 20, "  " * 50 + "a, b. c" + "\n" * 50, "áb ç",
]
ROWS = [*enumerate(ODD), (None, "null id"), (3, "again"), (3, "again")]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, ids string").repartition(3)


def brute_codes(rows, entries=64, rounds=2, parts=16):
    rows = [(i, [math.floor(256 * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in rows], np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()
    away = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)], axis=1)
    for _ in range(rounds):
        at = away().argmin(2)
        for p in range(parts):
            for k in range(books.shape[1]):
                own = x[at[:, p] == k, p]
                if len(own):
                    books[p, k] = [int(s) // len(own) for s in own.sum(0)]
    d = away()
    error, label = d.min(2).sum(1), defaultdict(int)
    for r, e in zip(rows, error.tolist(), strict=True):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return by_text((r[0], "".join(f"{k:02x}" for k in d[i].argmin(1)), int(error[i]), label[r[2]], digest) for i, r in enumerate(rows))


def test_vector_codes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert by_text(map(tuple, queries.op11_vector_codes(spark, DIR).collect())) == brute_codes(rows)


def test_vector_codes_of_odd_rows(spark):
    rows = [
        (1, None, 1), (2, [1.0] * 16, None), (3, [float("nan")] + [0.0] * 15, 1), (4, [None] + [0.0] * 15, 1), (5, [0.1] * 16, None),
        (6, [-0.3] * 16, 2), (7, [float("inf")] * 16, 2), (8, [0.1] * 16, 2), (None, [0.7] * 16, 3), (6, [-0.3] * 16, 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("entries", F.lit("mine"))
    coded, books = vector_codes.compress(df)
    assert coded.count() == 6 and books.shape == (16, 6, 1)
    got = [(r.vec_id, "".join(f"{e:02x}" for e in r.entries), r.error, r.label_error, vector_codes.codebook_digest(books)) for r in vector_codes.label_errors(coded).collect()]
    assert by_text(got) == brute_codes(rows)
    coded, books = vector_codes.compress(df.limit(0))
    assert coded.count() == 0 and books.size == 0
    with pytest.raises(Exception, match="one length"):
        vector_codes.compress(df.withColumn("embedding", F.array(F.lit(1.0))))[0].count()


def test_bounds_leave_the_nearest_entry():
    rnd = np.random.default_rng(3)
    for scale in (2, 50, 5000):
        entries, parts = rnd.integers(-scale, scale, (40, 3)), rnd.integers(-scale, scale, (500, 3))
        pivots = vector_codes._far(entries, 4)
        at, best = vector_codes.nearest(parts, ((parts[:, None] - pivots[None]) ** 2).sum(2), entries, pivots)
        d = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def brute_alignment(rows):
    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(k): k for k in prints} | {chr(256 + n): k for n, k in enumerate(sorted(set(range(256)) - set(prints)))}

    def groups(text):
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        said_x = [bytes(letter[c] for c in a.id_to_token(i)) for i in x]
        said_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(said_x) != (" " + text).encode() or b"".join(said_y) != (" " + text).encode():
            return None
        ends = [np.cumsum([len(s) for s in said]).tolist() for said in (said_x, said_y)]
        out = [([], [])]
        both, done = sorted(set(ends[0]) & set(ends[1])), [0, 0]
        out = []
        for e in both:
            g = []
            for k, ids in enumerate((x, y)):
                to = ends[k].index(e, done[k]) + 1
                g.append(ids[done[k] : to])
                done[k] = to
            out.append(tuple(g))
        return x, y, out

    read = [(i, groups(t)) for i, t in rows]
    count = Counter()
    for _, r in read:
        count.update({(p, q) for x, y in r[2] for p in x for q in y} if r else ())
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    for i, r in read:
        if r is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
            continue
        links = [(p, q) for x, y in r[2] for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2])
        yield i, len(r[0]), len(r[1]), len(r[2]), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()


def aligned(df, **k):
    out = alignment.align(df, BYTE_BPE, PIECES, **k).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return by_text(tuple(r[c] for c in columns) for r in alignment.link_counts(out).collect())


def test_alignment(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert aligned(docs) == by_text(brute_alignment([(r.doc_id, r.text) for r in docs.collect()]))
    want = by_text(brute_alignment(ROWS))
    for size, beside in ((1 << 16, 1 << 13), (1000, 50), (7, 3)):  # texts cut into ever more ranges
        assert aligned(odd, size=size, beside=beside) == want
    assert aligned(odd.limit(0)) == []


def test_fragments_compose_in_any_grouping():
    rnd, tool = random.Random(5), alignment.Aligner(BYTE_BPE, PIECES)
    shown = lambda f: (f.cut, tuple(map(list, f.head)), tuple(map(list, f.tail)), ";".join(f.groups), f.counts.tolist(), f.same)
    for text in ("the quick brown-fox, jumps over 12345 lazydogs and unbelievablylongwords", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa bbb", "日本語テキスト é à ü"):
        parts = [tool.part(x, lead, span) for x, lead, span in alignment.ranges(text, 3, 40)]
        def fold(ps):
            if len(ps) == 1:
                return ps[0]
            k = rnd.randrange(1, len(ps))
            return alignment.compose(fold(ps[:k]), fold(ps[k:]))

        whole = shown(fold(parts))
        assert len(parts) > 2 and all(shown(fold(parts)) == whole for _ in range(20))
        assert shown(alignment.compose(alignment.Fragment(), fold(parts))) == whole == shown(alignment.compose(fold(parts), alignment.Fragment()))


def test_bpe(spark, odd, monkeypatch):
    whole = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    for df in (odd, docs):
        rows = [(r.doc_id, whole.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()]
        want = by_text((i, tuple(ids), whole.decode(ids, skip_special_tokens=False)) for i, ids in rows)
        assert by_text((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(df, WORD_BPE, decoded=True).collect()) == want
        again = bpe.decode(bpe.encode(df, WORD_BPE), WORD_BPE)
        assert by_text((r.doc_id, r.decoded) for r in again.collect()) == by_text((i, d) for i, _, d in want)
    assert bpe.encode(odd.limit(0), WORD_BPE, decoded=True).count() == 0
    plan = bpe.encode(docs, WORD_BPE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # the lists of words, to their buckets and back; no document is shuffled


def test_decode_of_any_ids(spark):
    rows = [(1, [320, None, 999_999, 321]), (2, []), (3, None), (4, [49407]), (4, [49407])]
    df = spark.createDataFrame([(*r, "pos") for r in rows], "k long, tokens array<int>, pos string")
    got = [(r.k, r.pos, r.decoded) for r in bpe.decode(df, WORD_BPE, "tokens").collect()]
    piece = Tokenizer.from_file(WORD_BPE).id_to_token
    end = piece(49407)
    assert by_text(got) == by_text([(1, "pos", f"{piece(320)} {piece(321)}"), (2, "pos", ""), (3, "pos", ""), (4, "pos", end), (4, "pos", end)])


def test_decontamination_of_repetitive_texts():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(60)]
    items = [(k, "\n".join(" " * 40 + " ".join(rnd.choices(words, k=5)) for _ in range(8))) for k in range(20)] + [(30, "-" * 60 + "x"), (31, "ab" * 60)]
    scan = decontaminate.Scan(items, decontaminate.Lemma())
    began = time.process_time()
    for text, want in ((" " * 1_000_000, []), ("a" * 1_000_000, []), ("-" * 1_000_000, [(0, 30, 1, 0, 60)]), ("| --- " * 100_000, []), ("ab" * 300_000, [(0, 31, 0, 0, 120)])):
        assert scan.find(pa.array([text])) == want
    assert time.process_time() - began < 20
    deep = "-" * 50_000 + items[3][1] + " " * 50_000 + items[4][1].replace("a", "q", 3)
    got = {i: (e, a) for _, i, e, a, _ in scan.find(pa.array([deep]))}
    stripped = items[3][1].strip()
    assert got[3][0] == 0 and deep[got[3][1] :].startswith(stripped) and got[4][0] == 3


def test_many_matches_take_time_in_proportion(spark):
    took = []
    for n in (2_000, 20_000, 200_000):
        df = spark.createDataFrame([(1, "a@b.co " * n)], "doc_id long, text string")
        began = time.time()
        last = pii.find_pii(df).select(F.size("pii").alias("n"), F.element_at("pii", -1)["start"].alias("at")).first()
        took.append(time.time() - began)
        assert tuple(last) == (n, 7 * (n - 1))
    assert took[2] < 30 * max(took[1], 1)
    n = 20_000
    turns = spark.range(n).select(F.lit(1).alias("tree"), F.lit(5).alias("leaf"), (n - F.col("id")).alias("steps"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("hi").alias("text"))
    assert chat.write_template(turns).select(F.size("loss_mask")).first()[0] == n // 2


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "p"), (None, a, "q"), (None, b, "r"), (None, b + " x", "s"), (None, b, "r"), (5, c, "t"), (5, "zz yy xx ww vv uu", "u"), (3, c + " y", "v"), (7, "", "w"), (7, None, "w2"), (None, "", "e"), (None, None, "e2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumn("_id", F.lit(9))
    got = by_text((r.doc_id, r.component_id, r.class_size) for r in ngram_join.ngram_jaccard_join(df).collect())
    want = [(1, 1, 2), (None, 1, 2), *[(None, None, 3)] * 3, *[(3, 3, 3)], (5, 3, 3), (5, 3, 3), (7, 7, 1), (7, 7, 1), (None, None, 1), (None, None, 1)]
    assert got == by_text(want)
    kept = ngram_join.keep_one_of_each(df)
    rows = [(r.doc_id, r.mark) for r in kept.collect()]
    assert kept.columns == df.columns and by_text(rows) == by_text((r.doc_id, r.mark) for r in ngram_join.keep_one_of_each(df.repartition(3)).collect())
    assert Counter(i for i, _ in rows) == Counter([1, 3, 7, None, None, None]) and (1, "p") in rows and {"e", "e2"} < {m for _, m in rows}
    same = spark.createDataFrame([(5, a, "p"), (5, a, "p"), (5, b, "q")], "doc_id long, text string, mark string")
    first = ngram_join.keep_one_of_each(same).collect()
    assert len(first) == 1 and first == ngram_join.keep_one_of_each(same.repartition(2)).collect()
    assert ngram_join.keep_one_of_each(df.limit(0)).count() == 0
