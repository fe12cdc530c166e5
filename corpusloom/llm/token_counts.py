"""Operator 7: token counts at every prefix.

For each text the table holds the exact token count of each of its prefixes, so that truncation and budget
questions are answered by lookup. Counts come from a dynamic program over prefixes: the count of a prefix is
that of the blocks before its last one plus that of the last block's own prefix; the counts of a block's
prefixes extend those of shorter prefixes that any block shared (a memo over prefixes, filled by the library's
own merges). Blocks are the runs between blanks, which the tokenizer never joins.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import worker_state

#: Distinct words and blocks that a task remembers; beyond it the memo is begun anew.
MEMO = 600_000
#: Characters of text whose counts one output batch holds.
BATCH_CHARS = 1 << 20

#: White space as the tokenizer sees it, and the word parts that it splits off.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

class PrefixCounter:
    """Token counts of all prefixes of a text under a BPE tokenizer file of the tokenizers library with word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.ended = self.whole.model
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end, self.vocab = model["end_of_word_suffix"], model["vocab"]
        self.longest = max(map(len, self.vocab))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.open = models.BPE(vocab=self.vocab, merges=merges)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.blocks = re.compile(f"[{BLANKS}]*+[^{BLANKS}]*+[{BLANKS}]*+")
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANKS}\p{{L}}\p{{N}}]+")
        self.clusters = regex.compile(r"[\p{M}\u1160-\u11ff]+|[^\p{M}\u1160-\u11ff][\p{M}\u1160-\u11ff]*")
        self.words: dict[str, int] = {}
        self.memo: dict[str, bytes] = {}
        self.fits = lru_cache(maxsize=MEMO)(self._fits)

    def _mapped(self, w: str) -> str:
        return w if w.isascii() and w.isprintable() and " " not in w else self.alphabet.pre_tokenize_str(w)[0][0]

    def _word(self, w: str) -> int:
        """Token count of one piece. Every prefix that any piece asked for is known."""
        n = self.words.get(w)
        if n is None:
            n = self.words[w] = len(self.ended.tokenize(self._mapped(w)))
        return n

    def _fits(self, left: str, right: str, last: bool) -> bool:
        """Whether the merges leave this pair of tokens as it is. A row of tokens is an encoding if each of its pairs fits."""
        got = [t.value for t in (self.ended if last else self.open).tokenize(left + right)]
        return got == [left, right + self.end if last else right]

    def _prefixes(self, piece: str) -> list[int]:
        """Token counts of a piece's prefixes."""
        if piece[0] == "'" and piece in CONTRACTIONS:
            return [self._word("'"), *([2] if len(piece) == 3 else []), self._word(piece)]
        if len(piece) <= 32:
            return [self._word(piece[:k]) for k in range(1, len(piece) + 1)]
        return self._long(piece)[0]

    def _long(self, piece: str, tails: list[tuple[int, str]] = ()) -> tuple[list[int], list[int]]:
        """Token counts of a piece's prefixes, by a program over pairs of tokens that fit; and those of the prefixes
        that stop after `at` characters and go on with another text, for each (at, text) of tails, in order of `at`."""
        m, ends = self._mapped(piece), [0, *np.cumsum([len(self._mapped(c)) for c in piece]).tolist()]
        token, count, out, beside = [""], [0], [], []

        def best(m: str, base: int, i: int, last: bool) -> tuple[str, int]:
            for a in range(i - 1, max(-1, i - self.longest - 1), -1):
                t = m[a - base : i - base]
                if (t + self.end if last else t) in self.vocab and (not a or self.fits(token[a], t, last)):
                    return t, count[a] + 1
            raise ValueError("no row of tokens fits")  # every byte is a token, so there is one

        def grow(m: str, base: int, until: int) -> None:
            for i in range(len(token), until + 1):
                t, n = best(m, base, i, False)
                token.append(t)
                count.append(n)

        k = 0
        for c, end in enumerate(ends):
            grow(m, 0, end)
            if c:
                out.append(best(m, 0, end, True)[1])
            while k < len(tails) and tails[k][0] == c:
                base = max(0, end - self.longest)
                other = m[base:end] + self._mapped(tails[k][1])
                grow(other, base, base + len(other))
                beside.append(best(other, base, base + len(other), True)[1])
                del token[end + 1 :], count[end + 1 :]
                k += 1
        return out, beside

    def _plain(self, text: str) -> np.ndarray:
        """Counts after each character of a text without control strings whose characters normalise one by one."""
        out, done = [], 0
        for m in self.pieces.finditer(text):
            out += [done] * (m.start() - len(out))
            out += [done + n for n in self._prefixes(m[0])]
            done = out[-1]
        return np.array(out + [done] * (len(text) - len(out)), np.int32)

    def _block(self, block: str) -> np.ndarray:
        """Counts after each character of a block, its blanks included."""
        for s in self.specials:  # inside an unfinished control string its characters count as text
            if s in block:
                a, _, c = block.partition(s)
                before, rest = self._block(a), self._block(c)
                within = self._block(a + s[:-1])[len(a) :]
                done = (int(before[-1]) if a else 0) + 1
                return np.concatenate([before, within, np.array([done], np.int32), rest + np.int32(done)])
        low = block.lower()
        if block.isascii() or len(low) == len(block) and "Σ" not in block and unicodedata.is_normalized("NFC", block):
            return self._plain(low)
        return self._composed(block)

    def _composed(self, block: str) -> np.ndarray:
        """Counts after each character of a block whose characters may join to others, or become several.

        Only marks, and Korean vowels and finals, join to what stands before them, so a prefix reads as the block does up to its last
        cluster, and that cluster's part may read otherwise (e for the e of a later é).
        """
        def form(x: str) -> str:
            return "".join(c.lower() for c in unicodedata.normalize("NFC", x))

        text, size, at, other = [], 0, [], []  # other: place in the block, place in the text, what stands there instead
        for m in self.clusters.finditer(block):
            whole = form(m[0])
            for k in range(1, len(m[0])):
                part = form(m[0][:k])
                if not whole.startswith(part):
                    other.append((len(at), size, part))
                at.append(size + len(part))
            text.append(whole)
            size += len(whole)
            at.append(size)
        text = "".join(text)
        plain = self._plain(text)
        at = np.array(at)
        out = plain[np.minimum(at, size) - 1]
        starts = [m.start() for m in self.pieces.finditer(text)]
        tails: dict[int, list[tuple[int, int, str, int]]] = {}
        for place, end, part in other:
            i = bisect_left(starts, end) - 1
            start = starts[i] if i >= 0 else 0
            if end - start <= 32:  # short pieces are counted anew, with the quotation mark that may join them
                start -= int(start > 0 and text[start - 1] == "'")
                out[place] = (plain[start - 1] if start else 0) + self._plain(text[start:end] + part)[-1]
            elif (n := len(self.pieces.match(text[end - 1] + part)[0]) - 1) == 0:
                out[place] = plain[end - 1] + self._plain(part)[-1]
            else:
                rest = int(self._plain(part[n:])[-1]) if part[n:] else 0
                tails.setdefault(start, []).append((end - start, place, part[:n], rest))
        for start, asked in tails.items():
            piece = self.pieces.match(text, start)[0]
            found = self._long(piece, [(n, part) for n, _, part, _ in asked])[1]
            for (_, place, _, rest), n in zip(asked, found):
                out[place] = (plain[start - 1] if start else 0) + n + rest
        return out

    def counts(self, text: str) -> np.ndarray:
        """The count after each character of the text."""
        if len(self.memo) > MEMO or len(self.words) > 2 * MEMO:
            self.memo.clear()
            self.words.clear()
        memo, blocks = self.memo, self.blocks.findall(text)
        for b in blocks:
            if b not in memo:
                memo[b] = self._block(b).tobytes()
        parts = [memo[b] for b in blocks if b]
        if not parts:
            return np.zeros(0, np.int32)
        out = np.frombuffer(b"".join(parts), np.int32)
        ends = np.cumsum([len(p) // 4 for p in parts])
        before = np.concatenate([[0], np.cumsum(out[ends - 1])[:-1]])
        return out + np.repeat(before, np.diff(ends, prepend=0)).astype(np.int32)


def prefix_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with prefix_counts: for each text, the token count after each of its characters as packed
    big-endian 32-bit integers (empty for a null or empty text). The text column is kept.

    tokenizer is the path of a file of the tokenizers library, there on every executor. A column of docs
    named prefix_counts is replaced.
    """
    own = docs.drop(*[c for c in docs.columns if c.lower() == "prefix_counts"])
    schema = StructType([*own.schema.fields, StructField("prefix_counts", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_state(f"prefix counter of {tokenizer}", lambda: PrefixCounter(tokenizer))
        for b in batches:
            out, chars, start = [], 0, 0
            for i, x in enumerate(b[text]):
                c = count.counts(x.as_py() or "")
                out.append(c.astype(">i4").tobytes())
                chars += len(c)
                if chars >= BATCH_CHARS or i == b.num_rows - 1:
                    part = b.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "prefix_counts"])
                    out, chars, start = [], 0, i + 1

    return own.mapInArrow(run, schema)


def _at(packed: Column, i: Column) -> Column:
    """The i-th (from 0) integer of a packed column."""
    return F.conv(F.hex(F.substring(packed, 4 * i + 1, F.lit(4))), 16, 10).cast("long")


def n_tokens(packed: Column) -> Column:
    """The token count of the whole text."""
    n = (F.octet_length(packed) / 4).cast("int")
    return F.when(n > 0, _at(packed, n - 1)).otherwise(F.lit(0).cast("long"))


def tokens_before(packed: Column, chars: Column) -> Column:
    """The token count of the first chars characters."""
    n = F.least(chars, (F.octet_length(packed) / 4).cast("int"))
    return F.when(n > 0, _at(packed, n - 1)).otherwise(F.lit(0).cast("long"))


def longest_prefix(packed: Column, budget: int) -> Column:
    """The number of characters of the longest prefix of at most budget tokens."""

    @F.pandas_udf("long")
    def fit(x):
        def one(p):
            fits = np.flatnonzero(np.frombuffer(p, ">i4") <= budget)
            return int(fits[-1]) + 1 if len(fits) else 0

        return x.map(one)

    return fit(packed)
