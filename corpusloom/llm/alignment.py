"""Operator 12: alignment of two tokenizers over an associative monoid of fragments.

A range of a text's bytes gives a fragment: the tokens of both tokenizers that end in it, as an open prefix (up to the
first place where tokens of both end), closed groups between such places, and an open suffix. Fragments of neighbouring
ranges compose: the left suffix and the right prefix make one group. Composition is associative and the fragment of an
empty range is its identity, so a long text is cut into ranges that go to tasks of their own, and a tree of groupings puts
the fragments together again. A short text is one range.

Tokens never reach over a place where a blank follows another letter, so texts are tokenized by stretches between such
places, each distinct one once a task. A range that ends within a stretch takes of it the tokens that end before.

How often an id pair is linked is counted over documents by blocks, as operator 13 looks its words up.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, spans, unpack
from .common import stash, tidy, worker_state

#: Characters of a range of a long text, characters beside its end that may belong to the stretch it cuts, fragments that a task composes.
RANGE, BESIDE, FAN = 1 << 16, 1 << 13, 32
#: Hash buckets of pairs, pairs after which a block is closed, links that a row of a block's documents holds, stretches that a task remembers.
BUCKETS, BLOCK_PAIRS, ROW_LINKS, MEMO = 1024, 1_000_000, 1 << 19, 125_000
#: Links of a group above which its equal pairs are put together at once.
BIG = 4096


#: Letters, and marks that both tokenizers may split off letters.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?)"


class Rough(Exception):
    """The blanks of a text aren't single ones between words."""


class Tokens:
    """A byte-level BPE file of the tokenizers library (A) and a sentencepiece file with a leading blank (B)."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.merges = self.a.model
        self.space = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(" ")[0][0]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.length_a = np.zeros(self.a.get_vocab_size(True), np.int64)
        for t, i in self.a.get_vocab(True).items():
            self.length_a[i] = len(t)  # a letter stands for a byte
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.length_b = np.array(list(map(len, self.bytes_b)))
        self.blank = self.b.piece_to_id("▁")
        pieces = "\0".join(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i))
        if re.search("[^▁\0]▁|\n", pieces):
            raise ValueError(f"{b} has pieces that reach over blanks")
        marks = self.marks = [m for m in MARKS if not re.search(f"[{LETTERS}]{re.escape(m)}", pieces)]
        self.cut = re.compile(r"(?<=\S)(?=[ \n])" + (f"|(?<=[{LETTERS}])(?=[{re.escape(''.join(marks))}])" if marks else ""))

    def batch(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of A and of B of each stretch (as cut gives them)."""
        word = [s[0] == " " and s[1:].isalpha() and s.isascii() for s in stretches]
        others = [s for s, w in zip(stretches, word, strict=True) if not w]
        several = (self.a.encode_batch_fast(others[k : k + 1024], add_special_tokens=False) for k in range(0, len(others), 1024))
        rest = (e.ids for es in several for e in es)
        tokenize, space = self.merges.tokenize, self.space
        a = [[t.id for t in tokenize(space + s[1:])] if w else next(rest) for s, w in zip(stretches, word, strict=True)]
        # B adds a blank; what begins otherwise is read after a line end, which nothing joins
        asked = [s[1:] if s[0] == " " else s if s[0] == "\n" else "\n" + s for s in stretches]
        b = self.b.encode(asked, num_threads=1)
        for k, s in enumerate(stretches):
            if s[0] != " ":
                b[k] = b[k][1:] if s[0] == "\n" else b[k][2:]
            elif s == " ":
                b[k] = [self.blank]
        return a, b

    def is_text(self, a: list[int], b: list[int], said: bytes) -> bool:
        """Whether the tokens of both are the text."""
        return sum(self.length_a[i] for i in a) == len(said) and b"".join([self.bytes_b[i] for i in b]) == said


@dataclass
class Fragment:
    """What a range of bytes holds. cut: whether tokens of both end at a place in it, or where it begins."""

    cut: bool = False
    head: tuple[list[int], list[int]] = ((), ())
    tail: tuple[list[int], list[int]] = ((), ())
    groups: list[str] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))  # tokens of A, of B, groups, links
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # linked ids as a << 32 | b, and how often
    same: bool = True


def shown(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def linked(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group, as a << 32 | b, and how often each is linked."""
    (x, m), (y, n) = (np.unique(np.array(ids, np.int64), return_counts=True) for ids in (a, b))
    return (x[:, None] << 32 | y).reshape(-1), (m[:, None] * n).reshape(-1)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not x.cut and not y.cut:
        return Fragment(False, _join(x.head, y.head), ((), ()), [], x.counts + y.counts, [], x.same and y.same)
    out = Fragment(True, x.head, y.tail, x.groups + y.groups, x.counts + y.counts, x.pairs + y.pairs, x.same and y.same)
    if not x.cut:
        out.head = _join(x.head, y.head)
    elif not y.cut:
        out.tail = _join(x.tail, y.head)
    else:
        a, b = _join(x.tail, y.head)
        if a or b:
            out.groups = [*x.groups, shown(a, b), *y.groups]
            out.pairs = [*x.pairs, linked(a, b), *y.pairs]
            out.counts = out.counts + np.array([0, 0, 1, len(a) * len(b)])
    return out


def _join(x: tuple[list[int], list[int]], y: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return [*x[0], *y[0]], [*x[1], *y[1]]


def groups(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> list[tuple[list[int], list[int]]]:
    """The tokens between places where both end, and those after the last one."""
    out, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if ends_a[i] == ends_b[j]:
            i, j = i + 1, j + 1
            out.append((a[x:i], b[y:j]))
            x, y = i, j
        elif ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
    return [*out, (a[x:], b[y:])]


def fragment(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int], begun: bool, same: bool = True) -> Fragment:
    """The fragment of tokens with their ends; begun: tokens of both end where its range begins."""
    *closed, tail = groups(a, ends_a, b, ends_b)
    counts = np.array([len(a), len(b), 0, 0])
    if not begun:
        if not closed:
            return Fragment(False, tail, counts=counts, same=same)
        head, *closed = closed
    else:
        head = ((), ())
    counts[2:] = len(closed), sum(len(x) * len(y) for x, y in closed)
    return Fragment(True, head, tail, [shown(x, y) for x, y in closed], counts, [linked(x, y) for x, y in closed], same)


pack_number = struct.Struct("<I").pack


class Aligner(dict):
    """Aligns texts. It remembers stretches: the number of each, packed."""

    def __init__(self, a: str, b: str):
        self.tokens = Tokens(a, b)
        self.cut = self.tokens.cut
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.stretch: dict[str, int] = {}
        self.shown: list[str] = []
        self.new: list[str] = []  # numbered, not tokenized yet
        #: of each stretch: whether its tokens give it back, counts, first pair, number of pairs; and all pairs and times
        self.arrays = (np.zeros(0, bool), np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def trim(self) -> None:
        """Give up what is remembered, if it is much. Numbers of stretches hold until then."""
        if len(self.shown) > MEMO:
            self.reset()

    def _number(self, stretch: str) -> int:
        self.new.append(stretch)
        return len(self.shown) + len(self.new) - 1

    def number(self, stretch: str) -> int:
        n = self.stretch.get(stretch)
        if n is None:
            n = self.stretch[stretch] = self._number(stretch)
        return n

    def __missing__(self, part: str) -> bytes:
        """The numbers of the stretches of a blank and a part."""
        if part.isascii() and part.isalpha():  # most parts
            got = self[part] = pack_number(self._number(" " + part))
            return got
        if not part or part[0].isspace() or part[-1].isspace():
            raise Rough
        if part[-1] in self.tokens.marks and (word := part[:-1]).isascii() and word.isalpha():
            return self[word] + pack_number(self.number(part[-1]))
        first, *rest = self.cut.split(" " + part)
        if rest:
            return self[first[1:]] + b"".join([pack_number(self.number(s)) for s in rest])
        got = self[part] = pack_number(self._number(first))
        return got

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of the stretches of a blank and the text."""
        try:
            return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), "<u4")
        except Rough:
            return np.array([self.number(s) for s in self.cut.split(" " + text)], "<u4")

    def columns(self) -> tuple[np.ndarray, ...]:
        if not self.new:
            return self.arrays
        t, (a, b), said = self.tokens, self.tokens.batch(self.new), [s.encode() for s in self.new]
        many_a, many_b, size = (np.array(list(map(len, x)), np.int64) for x in (a, b, said))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, many_a), (b, many_b)))
        if b"".join(map(t.bytes_b.__getitem__, flat_b.tolist())) == b"".join(said) and int(t.length_a[flat_a].sum()) == int(size.sum()):
            same = np.ones(len(said), bool)
            same &= np.add.reduceat(t.length_a[flat_a], np.cumsum(many_a) - many_a) == size
            same &= np.add.reduceat(t.length_b[flat_b], np.cumsum(many_b) - many_b) == size
        else:
            same = np.zeros(len(said), bool)
        for k in np.flatnonzero(~same).tolist():
            same[k] = t.is_text(a[k], b[k], said[k])
        a, b = flat_a[np.repeat(same, many_a)], flat_b[np.repeat(same, many_b)]
        ends_a, ends_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = (np.searchsorted(e, both, "right") for e in (ends_a, ends_b))
        of = np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), both)]  # the stretch of each group
        n, m = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        from_a, from_b = to_a - n, to_b - m
        links = n * m
        few = np.where(links > BIG, 0, links)
        k = spans(np.zeros(len(few), np.int64), few)
        pairs = a[np.repeat(from_a, few) + k // np.repeat(m, few)] << 32 | b[np.repeat(from_b, few) + k % np.repeat(m, few)]
        times, group = np.ones(len(pairs), np.int64), np.repeat(np.arange(len(few)), few)
        for g in np.flatnonzero(links > BIG).tolist():
            more = linked(a[from_a[g] : to_a[g]].tolist(), b[from_b[g] : to_b[g]].tolist())
            pairs, times = np.concatenate([pairs, more[0]]), np.concatenate([times, more[1]])
            group = np.concatenate([group, np.full(len(more[0]), g)])
        order = np.argsort(group, kind="stable") if len(group) > few.sum() else slice(None)
        each = np.bincount(of[group], minlength=len(said))
        sum_of = lambda x: np.bincount(of, x, len(said)).astype(np.int64)
        counts = np.stack([many_a, many_b, sum_of(np.ones(len(of))), sum_of(links)], axis=1)
        self.arrays = tuple(
            np.concatenate(x) for x in zip(self.arrays, (same, counts, np.cumsum(each) - each + len(self.arrays[4]), each, pairs[order], times[order]), strict=True)
        )
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        text = [
            f"{sa[p]}|{sb[q]}" if r - p == 1 and s - q == 1 else ",".join(sa[p:r]) + "|" + ",".join(sb[q:s])
            for p, r, q, s in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True)
        ]
        ends = np.cumsum(counts[:, 2]).tolist()
        self.shown += [text[x] if y - x == 1 else ";".join(text[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        self.new = []
        return self.arrays

    def whole(self, numbers: np.ndarray) -> Fragment:
        """The fragment of a row of stretches."""
        if not len(numbers):
            return Fragment()
        same, counts, first, size, pairs, times = self.columns()
        at = spans(first[numbers], size[numbers])
        groups = [";".join(map(self.shown.__getitem__, numbers.tolist()))]
        return Fragment(True, groups=groups, counts=counts[numbers].sum(axis=0), pairs=[(pairs[at], times[at])], same=bool(same[numbers].all()))

    def part(self, text: str, lead: int, span: int) -> Fragment:
        """The fragment of a range of a text: span characters after the first lead ones. text begins and ends where stretches do."""
        self.trim()
        stretches = self.cut.split(text)
        size = np.array([len(s.encode()) for s in stretches])
        ends = np.cumsum(size)
        low = len(text[:lead].encode())
        high = low + len(text[lead : lead + span].encode())
        out, inner = Fragment(), []
        for k in range(int(np.searchsorted(ends, low, "right")), len(ends)):
            begin, end = int(ends[k] - size[k]), int(ends[k])
            if begin >= high:
                break
            if low <= begin and end <= high:
                inner.append(self.number(stretches[k]))
                continue
            out = compose(compose(out, self.whole(np.array(inner, np.int64))), self._within(stretches[k], begin, low, high))
            inner = []
        return compose(out, self.whole(np.array(inner, np.int64)))

    def _within(self, stretch: str, at: int, low: int, high: int) -> Fragment:
        """The tokens of a stretch that end after low and not after high."""
        (a,), (b,) = self.tokens.batch([stretch])
        same = self.tokens.is_text(a, b, stretch.encode())
        ends_a, ends_b = np.cumsum(self.tokens.length_a[a]).tolist(), np.cumsum(self.tokens.length_b[b]).tolist()
        inside = lambda ids, ends: zip(*[(i, e) for i, e in zip(ids, ends, strict=True) if low < at + e <= high], strict=True)
        (a, ends_a), (b, ends_b) = (list(map(list, inside(*x))) or ([], []) for x in ((a, ends_a), (b, ends_b)))
        return fragment(a, ends_a, b, ends_b, at >= low, same)


def ranges(text: str, size: int, beside: int) -> Iterator[tuple[str, int, int]]:
    """A blank and the text in ranges of about size characters, each with the text around its ends up to blanks: (text, lead, span).

    Where no blank is beside a range's end, the range goes on to the next one.
    """
    text, cut, at, back = " " + text, re.compile(r"(?<=\S)(?=[ \n])"), 0, 0
    while at < len(text):
        to = min(at + size, len(text))
        before = after = to
        if to < len(text):
            ahead = cut.search(text, to)
            after = ahead.start() if ahead else len(text)
            before = max((m.start() for m in cut.finditer(text, max(at, to - beside), to)), default=None)
            if before is None or after - to > beside:
                before = to = after
        yield text[back:after], at - back, to - at
        at, back = to, before


SHORT = "doc_id long, same boolean, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"
LONG = "row long, at int, cut boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, " + SHORT
_LONG = pa.schema(
    [("row", pa.int64()), ("at", pa.int32()), ("cut", pa.bool_()), *((c, pa.list_(pa.int32())) for c in ("head_a", "head_b", "tail_a", "tail_b")), ("doc_id", pa.int64()), ("same", pa.bool_())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), ("links", pa.binary())]
)
_SHORT = pa.schema([_LONG.field(c) for c in ("doc_id", "same", "n_a", "n_b", "n_groups", "n_links", "groups", "links")])


def _counted(f: Fragment) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, and how often each is linked."""
    if not f.pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, times = (np.concatenate(x) for x in zip(*f.pairs, strict=True))
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(times[order], first) if len(first) else first


def _links(f: Fragment) -> bytes:
    """Distinct pairs and how often each is linked, packed: A's ids, B's ids, times."""
    pairs, times = _counted(f)
    return pack(np.concatenate([pairs >> 32, pairs & 0xFFFFFFFF, times]))


def links_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, as a << 32 | b, and times that links holds."""
    a, b, times = unpack(packed).reshape(3, -1).astype(np.int64)
    return a << 32 | b, times


def _packed(f: Fragment) -> dict:
    return {
        "cut": f.cut, "head_a": list(f.head[0]), "head_b": list(f.head[1]), "tail_a": list(f.tail[0]), "tail_b": list(f.tail[1]), "same": f.same,
        **dict(zip(("n_a", "n_b", "n_groups", "n_links"), f.counts.tolist(), strict=True)), "groups": ";".join(f.groups), "links": _links(f),
    }


def _loose(r: dict) -> Fragment:
    counts, pairs = np.array([r["n_a"], r["n_b"], r["n_groups"], r["n_links"]]), links_of(r["links"])
    groups = [r["groups"]] if r["groups"] else []
    return Fragment(r["cut"], (r["head_a"], r["head_b"]), (r["tail_a"], r["tail_b"]), groups, counts, [pairs] if len(pairs[0]) else [], r["same"])


def align(docs: DataFrame, a: str, b: str, size: int = RANGE, beside: int = BESIDE) -> DataFrame:
    """The alignment of each text of docs (doc_id, text): doc_id, n_a, n_b (tokens), n_groups, n_links, groups (`a1,a2|b1;a3|b2`: ids of A and
    B by group) and links (its id pairs and how often each is linked, as links_of reads them).

    a is the path of a byte-level BPE file of the tokenizers library, which reads a blank and the text; b of a sentencepiece model,
    which adds that blank itself; both on every executor. Control strings in texts are text. A null or empty text, or one that the
    tokens of A or B don't give back byte by byte, has no tokens: zeros, and empty groups. Each row is aligned by itself, so rows
    with a null or repeated doc_id come back one by one; an empty table gives no rows; other columns are not read. Texts above
    2 * size characters go by ranges of size; a stretch without blanks is tokenized whole by one task. The groups of one text are
    one value, so they must fit 2 GB.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def aligner() -> Aligner:
        return worker_state(f"aligner of {a} and {b}", lambda: Aligner(a, b))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner()
        for batch in batches:
            ids, held, chars = [], [], 0
            for k, (doc, x) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"], strict=True)):
                text = x.as_py()
                ids.append(doc)
                held.append(one.numbers(text) if text and "▁" not in text else np.zeros(0, np.int64))
                chars += len(text)
                if chars > 1 << 20 or k == batch.num_rows - 1:
                    yield _short([(doc, one.whole(n)) for doc, n in zip(ids, held, strict=True)])
                    one.trim()
                    ids, held, chars = [], [], 0
        one.reset()  # a worker may stay idle beside those of the next stages

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, x in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = x.as_py()
                for at, (part, lead, span) in enumerate(ranges("" if "▁" in text else text, size, beside)):
                    fields = {"row": row, "at": at, "doc_id": doc, "text": part, "lead": lead, "span": span}
                    yield pa.record_batch([pa.array([v]) for v in fields.values()], list(fields))
                row += 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner()
        for batch in batches:
            for r in _by_row(batch):
                f = _packed(one.part(r["text"], r["lead"], r["span"]))
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "at": r["at"], "doc_id": r["doc_id"], **f}], _LONG)
        one.reset()

    def together(group: pa.Table) -> pa.Table:
        rows, out = sorted(group.to_pylist(), key=lambda r: r["at"]), Fragment()
        for r in rows:
            out = compose(out, _loose(r))
        return pa.Table.from_pylist([{"row": rows[0]["row"], "at": rows[0]["at"] // FAN, "doc_id": rows[0]["doc_id"], **_packed(out)}], _LONG)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a range of nothing, where tokens of both end
            yield _short([(r["doc_id"], compose(compose(Fragment(True), _loose(r)), Fragment(True))) for r in _by_row(batch)])

    few = own.where(F.octet_length("text") <= 2 * size).mapInArrow(tidy(short), SHORT)
    cuts = own.where(F.octet_length("text") > 2 * size).mapInArrow(cut, "row long, at long, doc_id long, text string, lead long, span long")
    parts = cuts.repartition("row", "at").mapInArrow(tidy(pieces), LONG)
    for _ in range(3):  # FAN ** 3 ranges are more than a Spark string holds
        parts = parts.groupBy("row", F.floor(F.col("at") / FAN).alias("next")).applyInArrow(together, LONG)
    return few.unionByName(parts.mapInArrow(ended, SHORT)).drop("same")


def _short(rows: list[tuple[int | None, Fragment]]) -> pa.RecordBatch:
    rows = [(doc, f if f.same else Fragment()) for doc, f in rows]
    counts = np.array([f.counts for _, f in rows])
    cols = [pa.array([d for d, _ in rows], pa.int64()), pa.array([f.same for _, f in rows]), *(pa.array(counts[:, k]) for k in range(4))]
    cols += [pa.array([";".join(f.groups) for _, f in rows], pa.string()), pa.array([_links(f) for _, f in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, schema=_SHORT)


BLOCKS = "kind int, block long, part int, doc_ids array<long>, sizes array<int>, places binary, times binary, rest binary, pairs array<long>, many array<int>"
_BLOCKS = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
    + [("places", pa.binary()), ("times", pa.binary()), ("rest", pa.binary()), ("pairs", pa.list_(pa.int64())), ("many", pa.list_(pa.int32()))]
)


def _by_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time: to_pylist would hold a copy of all of them."""
    for k in range(batch.num_rows):
        yield {c: batch[c][k].as_py() for c in batch.schema.names}


class Known:
    """The distinct pairs of a block in order, the place of each (by first appearance), and, by place, how many documents hold it."""

    def __init__(self):
        self.pairs, self.place, self.many = (np.zeros(0, np.int64) for _ in range(3))

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """The places of the pairs of some documents, which have each pair once."""
        own, at, many = np.unique(pairs, return_inverse=True, return_counts=True)
        k = np.searchsorted(self.pairs, own)
        here = np.zeros(len(own), bool)
        here[k < len(self.pairs)] = self.pairs[k[k < len(self.pairs)]] == own[k < len(self.pairs)]
        place = np.zeros(len(own), np.int64)
        place[here] = self.place[k[here]]
        place[~here] = len(self.many) + np.arange(int((~here).sum()))
        self.pairs, self.place = np.insert(self.pairs, k[~here], own[~here]), np.insert(self.place, k[~here], place[~here])
        self.many = np.concatenate([self.many, np.zeros(int((~here).sum()), np.int64)])
        self.many[place] += many
        return place[at]


def in_blocks(aligned: DataFrame) -> DataFrame:
    """Blocks of documents: rows of kind 0 have a block's distinct pairs in one hash bucket of A's ids (part), how many of its documents hold
    each, and its place in the block; rows of kind 1 have documents with their pairs' places, times, and the other columns (rest)."""
    others = [c for c in aligned.columns if c not in ("doc_id", "links")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("blocks of links", dict)  # lets go of an aligner that this worker had
        block, part, known, held, said, links = TaskContext.get().partitionId() << 24, 0, Known(), [], [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            pairs, times = (np.concatenate(x) for x in zip(*said, strict=True))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(others).schema) as w:
                w.write_table(table.select(others))
            rest = len(sink.getvalue()).to_bytes(8, "little") + pa.compress(sink.getvalue(), "zstd", asbytes=True)
            fields = {"kind": 1, "block": block, "part": part, "doc_ids": table["doc_id"].to_pylist(), "sizes": [len(x) for x, _ in said]}
            return pa.RecordBatch.from_pylist([{**fields, "places": pack(known.places(pairs)), "times": pack(times), "rest": rest}], _BLOCKS)

        def close() -> pa.RecordBatch:
            bucket = (known.pairs >> 32) % BUCKETS
            order = np.argsort(bucket, kind="stable")
            rows = []
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                rows.append({"kind": 0, "block": block, "part": int(bucket[at[0]]), "places": pack(known.place[at]), "pairs": known.pairs[at], "many": known.many[known.place[at]]})
            return pa.RecordBatch.from_pylist(rows, _BLOCKS)

        for b in batches:
            at = 0
            for k, packed in enumerate(b["links"]):
                said.append(links_of(packed.as_py()))
                links += len(said[-1][0])
                if links >= ROW_LINKS or k == b.num_rows - 1:
                    held.append(b.slice(at, k + 1 - at))
                    at = k + 1
                if links >= ROW_LINKS or k == b.num_rows - 1 and len(said) >= 20_000:
                    yield row()
                    part, held, said, links = part + 1, [], [], 0
                    if len(known.pairs) >= BLOCK_PAIRS:
                        yield close()
                        block, part, known = block + 1, 0, Known()
        if held:
            yield row()
        if held or part:
            yield close()

    return aligned.mapInArrow(tidy(run), BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, the number of documents that hold the pair linked (documents), and whether no pair of the same a has more (best)."""
    each = blocks.where("kind = 0").select(F.explode(F.arrays_zip("pairs", "many")).alias("p"))
    a, b = F.shiftright("p.pairs", 32).cast("int"), F.col("p.pairs").bitwiseAND(0xFFFFFFFF).cast("int")
    counts = each.select(a.alias("a"), b.alias("b"), F.col("p.many").cast("long").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("documents"))
    most = F.max("documents").over(Window.partitionBy("a"))  # rows of one a: as many as B has ids
    return counts.select("a", "b", "documents", (F.col("documents") == most).alias("best"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """aligned (as align gives it) without links, with n_best: links whose pair is linked in as many documents as any of its A id,
    and count_sum: these numbers of documents, over all links. Other columns of aligned come back as they are; every row comes back."""
    blocks = stash(in_blocks(aligned), "links")
    counts = stash(pair_counts(blocks).withColumn("part", F.col("a") % BUCKETS), "pair-counts")
    others = [c for c in aligned.columns if c not in ("doc_id", "links")]
    schema = aligned.select("doc_id", *others).schema.add("n_best", "long").add("count_sum", "long")

    asked = blocks.where("kind = 0").select(F.lit(1).alias("kind"), "block", "part", "places", "pairs", F.lit(None).cast("long").alias("documents"), F.lit(None).cast("boolean").alias("best"))
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    told = counts.select(F.lit(0).alias("kind"), F.col("b").cast("long").alias("block"), "part", F.lit(None).cast("binary").alias("places"), F.array(pair).alias("pairs"), "documents", "best")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("answers", dict)  # lets go of an aligner that this worker had
        part, held, known = None, [], None
        for batch in batches:
            kinds, parts = batch["kind"].to_numpy(), batch["part"].to_numpy()
            edges = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(parts) != 0)) + 1
            for at, to in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                run = batch.slice(at, to - at)
                if at < to and parts[at] != part:
                    part, held, known = parts[at], [], None
                if at < to and kinds[at] == 0:
                    held.append((run["pairs"].flatten().to_numpy(), run["documents"].to_numpy(), run["best"].to_numpy(zero_copy_only=False)))
                    continue
                if at == to:
                    continue
                if known is None:
                    pairs, documents, best = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(pairs)
                    known, held = (pairs[order], documents[order], best[order].astype(np.int64)), []
                out = []
                for block, places, pairs in zip(run["block"].to_pylist(), run["places"].to_pylist(), run["pairs"], strict=True):
                    k = np.searchsorted(known[0], pairs.values.to_numpy())
                    many = known[1][k]
                    both = np.concatenate([many & 0xFFFFFFFF, many >> 32, known[2][k]])
                    out.append({"kind": 0, "block": block, "part": int(part), "places": places, "rest": pack(both)})
                yield pa.RecordBatch.from_pylist(out, _BLOCKS)

    answers = told.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "block").mapInArrow(tidy(answer), BLOCKS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("answers", dict)
        block, lists, known = None, [], None
        for batch in batches:
            for r in _by_row(batch):
                if r["block"] != block:
                    block, lists, known = r["block"], [], None
                if r["kind"] == 0:
                    lists.append((unpack(r["places"]), unpack(r["rest"]).reshape(3, -1)))
                    continue
                if known is None:
                    at = np.concatenate([x for x, _ in lists]) if lists else np.zeros(0, np.int64)
                    said = np.concatenate([x for _, x in lists], axis=1).astype(np.int64) if lists else np.zeros((3, 0), np.int64)
                    known = np.zeros((2, len(at)), np.int64)
                    known[:, at], lists = np.stack([said[0] | said[1] << 32, said[2]]), []
                place, times, ends = unpack(r["places"]), unpack(r["times"]).astype(np.int64), np.cumsum(r["sizes"])
                total = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(known[:, place] * times, axis=1)], axis=1)
                total = total[:, ends] - total[:, np.concatenate([[0], ends[:-1]])]
                size = int.from_bytes(r["rest"][:8], "little")
                table = pa.ipc.open_stream(pa.decompress(r["rest"][8:], size, "zstd")).read_all().combine_chunks()
                cols = [pa.array(r["doc_ids"], pa.int64()), *(table[c].combine_chunks() for c in others), pa.array(total[1]), pa.array(total[0])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *others, "n_best", "count_sum"])

    met = blocks.where("kind = 1").drop("pairs", "many").unionByName(answers.drop("pairs", "many"))
    return met.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(tidy(fill), schema)
