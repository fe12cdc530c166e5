"""Operator 2: n-gram Jaccard join over a token-group matrix.

Documents become sets of distinct word shingles; equal sets are one node. The join is exact:

1. Similar sets fall into groups. The hash range is cut into m parts, one more than two linked sets can
   differ in, so that linked sets agree in all tokens of some part; sets that share a part have the part's head
   in common, the sharer of most parts (of near copies, their origin). A group is a head with all that share a
   part with it: linked sets are in a common group.
2. The matrix stores each group's token union, with the number of members that hold each token. A union is cut
   into pieces by token, so that no task holds a large group.
3. The bound: tokens of a set that no other member holds are lost to any link in the group. A set that has too
   many of them doesn't open the group. That is tested on a half of the hash range first, then, for the groups that
   don't hang together yet, on what each remaining member and its head differ in.
4. In opened groups, members meet on the rarest of the tokens that the bound leaves (a prefix filter), only
   where the holders of a token stand in different components; the pairs so met are verified, each once.
5. The components of the verified links give each document its class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, stash, tidy, unstash, worker_state
from .hashing import mix, shingle_sets, stretches
from .links import components

_U = np.uint64
#: Token ids and members of a group that one piece of its union takes in, more or less.
PIECE_IDS, PIECE_MEMBERS = 4_000_000, 500_000
#: Bytes of sets or ids that one output batch holds, unless a single one is longer.
BATCH_BYTES = 8 << 20
#: Distinct sets that a task remembers, to emit the parts of equal sets once.
SEEN = 200_000


@dataclass(frozen=True)
class Measure:
    """Sets of width-word shingles link when whole * intersection >= part * union."""

    width: int = 5
    part: int = 80
    whole: int = 100

    def band(self, n: int) -> int:
        return _bands(self.part, self.whole, n)[0]

    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts for pairs whose larger set is in the band, and how many may be empty in one set; 0: equal sets only."""
        low, high = _edges(self.part, self.whole)[band : band + 2]
        differ = 2 * (high - 1) * (self.whole - self.part) // (self.whole + self.part)
        if not differ:
            return 0, 0
        spare = 1 + int(1.5 * (differ + 1) * math.exp(-low * self.part / self.whole / (differ + 1)))
        return differ + 1 + spare, spare


@lru_cache(maxsize=8)
def _edges(part: int, whole: int) -> list[int]:
    """Lower ends of the size bands: partners of a set lie in its own band or the next one to either side."""
    out = [1, 2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * whole // part + 1))
    return out


@lru_cache(maxsize=200_000)
def _bands(part: int, whole: int, n: int) -> tuple[int, int]:
    k = int(np.searchsorted(_edges(part, whole), n, "right")) - 1
    return k, k + 1


@lru_cache(maxsize=2_000)
def _cuts(m: int) -> np.ndarray:
    return np.array([(j << 64) // m for j in range(1, m)], _U)


def part_keys(tokens: np.ndarray, measure: Measure) -> np.ndarray:
    """Keys of the set's parts, for its own band and the next one."""
    keys, own = [], measure.band(len(tokens))
    for band in (own, own + 1):
        m, spare = measure.parts(band)
        if not m:
            continue
        v = tokens
        for level in range(4):
            at = np.concatenate([[0], np.searchsorted(v, _cuts(m), "left"), [len(v)]])
            size = np.diff(at)
            total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(v ^ _U(0xA5A5A5A5 + level)))])
            key = total[at[1:]] - total[at[:-1]] + size.astype(_U) * _U(0x9E3779B97F4A7C15)
            name = np.arange(m, dtype=_U) + _U(((band * 8 + level) << 32) + 1)
            keys.append(mix(key ^ mix(name))[size > 0])
            if (size == 0).sum() <= spare:
                break
            v = np.sort(mix(tokens + _U(level + 1)))
        else:  # too sparse for its band at every level: such sets meet in one group
            keys.append(mix(np.array([(band << 32) + 7], _U)))
    return np.concatenate(keys) if keys else np.zeros(0, _U)


def _prints(tokens: np.ndarray) -> tuple[int, int]:
    a, b = mix(tokens ^ _U(11)).sum(dtype=_U), mix(tokens ^ _U(1 << 40)).sum(dtype=_U)
    both = mix(np.array([a + _U(len(tokens)), b], _U))
    return both.astype(np.int64).tolist()


def describe_sets(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, n_shingles and node (a 64-bit print of the set; null for an empty set) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join", dict)  # lets go of what other operators kept
        for b in batches:
            n, node = [], []
            for texts in stretches(b["text"]):
                for s in shingle_sets(texts, measure.width):
                    n.append(len(s))
                    node.append(_prints(s)[0] if len(s) else None)
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["doc_id", "n_shingles", "node"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, node long")


def _part_rows(docs: DataFrame, measure: Measure) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join", dict)  # lets go of what other operators kept
        seen: set[int] = set()
        for b in batches:
            for texts in stretches(b["text"]):
                keys, nodes = [], []
                for s in shingle_sets(texts, measure.width):
                    if not len(s) or (node := _prints(s)[0]) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    keys.append(part_keys(s, measure))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(nodes))], ["part", "node"])

    return docs.select("text").mapInArrow(tidy(run), "part long, node long")


def similar_groups(docs: DataFrame, measure: Measure) -> DataFrame:
    """a and b: every set (a) that shares a part with others, with each head (b) of its parts, itself left out.

    Parts with the same sharers are one. The head of a part is the sharer with the most sharers in all its parts.
    """
    by = Window.partitionBy("part")
    rows = _part_rows(docs, measure)
    rows = rows.withColumn("again", F.lag("node").over(by.orderBy("node"))).where("again is null or again <> node")
    rows = rows.withColumn("c", F.count("*").over(by)).withColumn("x", F.bit_xor(F.xxhash64("node")).over(by)).where("c > 1")
    sharer = rows.groupBy(F.xxhash64("x", "c").alias("shared"), "node").agg(F.count("*").alias("parts"), F.max("c").alias("c"))
    sharer = stash(sharer, "sharers")
    weight = sharer.groupBy("node").agg(F.sum(F.col("parts") * (F.col("c") - 1)).alias("weight"))
    head = sharer.join(weight, "node").groupBy("shared").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
    pairs = stash(sharer.join(head, "shared").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "members")
    unstash(sharer)
    return pairs


def _tokens(x: pa.Scalar, kind: type = _U) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _of_texts(docs: DataFrame, described: DataFrame, nodes: DataFrame, run: Callable, schema: str) -> DataFrame:
    """What run makes (first column: the node) of the text of one document for each of the nodes named.

    Nodes that only rows without doc_id have are looked for among all of those rows.
    """
    key = schema.split()[0]
    # one row for all copies before the join, so that many copies don't meet in one task
    first = stash(described.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi").select("node", "doc_id"), "wanted")
    wanted, lone = first.where("doc_id is not null").select("doc_id"), first.where("doc_id is null").select(F.col("node").alias(key))
    made = docs.select("doc_id", "text").join(broadcast_if_small(wanted, 16), "doc_id", "left_semi").select("text").mapInArrow(tidy(run), schema)
    if not lone.isEmpty():
        unnamed = docs.where("doc_id is null").select("text").mapInArrow(tidy(run), schema)
        made = made.unionByName(unnamed.join(broadcast_if_small(lone, 16), key, "left_semi"))
    # rows that repeat a doc_id make their set once each
    return made.dropDuplicates([key])


def fetch_sets(docs: DataFrame, described: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """node and tokens (sorted 64-bit hashes, packed) for the nodes named; made anew from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in stretches(b["text"], BATCH_BYTES // 2):
                sets = [s for s in shingle_sets(texts, measure.width) if len(s)]
                yield pa.record_batch([pa.array([_prints(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"])

    return stash(_of_texts(docs, described, nodes, run, "node long, tokens binary"), "sets")


def compare(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """a, b, linked, n_a, n_b, d and ids of each pair: d tokens stand in one of the two sets only; ids are 32 bits of each, sorted and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "linked", "n_a", "n_b", "d", "ids"]
        for b in batches:
            linked, na, nb, differ, held, start = [], [], [], [], 0, 0
            for i, (x, y) in enumerate(zip(b["ta"], b["tb"], strict=True), 1):
                p, q = _tokens(x), _tokens(y)
                d = np.setxor1d(p, q, assume_unique=True)
                both = (len(p) + len(q) - len(d)) // 2
                linked.append(measure.whole * both >= measure.part * (len(p) + len(q) - both))
                na.append(len(p))
                nb.append(len(q))
                differ.append((d >> _U(32)).astype(np.uint32).tobytes())
                held += len(differ[-1])
                if held >= BATCH_BYTES or i == b.num_rows:
                    cols = [b["a"].slice(start, i - start), b["b"].slice(start, i - start), pa.array(linked, pa.bool_()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())]
                    yield pa.record_batch([*cols, pa.array([len(x) // 4 for x in differ], pa.int64()), pa.array(differ, pa.binary())], names)
                    linked, na, nb, differ, held, start = [], [], [], [], 0, i

    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    heads = right.join(pairs.select("b").distinct(), "b", "left_semi")
    both = pairs.join(left, "a").join(heads, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(tidy(run), "a long, b long, linked boolean, n_a long, n_b long, d long, ids binary")


def overlap_bound(measure: Measure, linked: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The fewest differences from the head b that a shares with any partner whose link isn't through the head.

    x and y, that differ in d and e tokens from the head p and share o of these, link only if
    (whole + part) (d + e - 2 o) <= (whole - part) (n_x + n_y), where n_y <= n_p + e and e >= o. One of them, x, does
    not link to p. What follows for o is rounded up; for y, which may link to p, o is above its bound.
    """
    s, k = measure.whole + measure.part, measure.whole - measure.part
    apart = -(-(s * d - k * (n_a + n_b)) // (2 * measure.whole))
    near = (s * d + k * (n_b - n_a)) // (2 * s) + 1
    return np.where(linked, near, apart)


_UNION = pa.schema([("b", pa.int64()), ("r", pa.int32()), ("salts", pa.int32()), ("ids", pa.binary()), ("often", pa.binary())])
_OPENED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("n_a", pa.int64()), ("d", pa.int64()), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("often", pa.binary())])
_ddl = lambda schema: ", ".join(f"{f.name} {({pa.int64(): 'long', pa.int32(): 'int', pa.bool_(): 'boolean', pa.binary(): 'binary'})[f.type]}" for f in schema)


def _cut(rows: DataFrame) -> DataFrame:
    """rows with their ids (sorted, packed) cut into as many pieces by value as the column pieces says, one row for each (r) that isn't empty."""
    out = rows.withColumn("r", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, r, ids = [], [], []
            for i, (x, n) in enumerate(zip(b["ids"], b["pieces"].to_pylist(), strict=True)):
                v = _tokens(x, np.uint32)
                cut = np.concatenate([[0], np.searchsorted(v, [(j << 32) // n for j in range(1, n)]), [len(v)]])
                for j in np.flatnonzero(np.diff(cut)).tolist():
                    at.append(i)
                    r.append(j)
                    ids.append(v[cut[j] : cut[j + 1]].tobytes())
            part, new = b.take(pa.array(at, pa.int32())), {"r": pa.array(r, pa.int32()), "ids": pa.array(ids, pa.binary())}
            yield pa.record_batch([new[c] if c in new else part[c] for c in b.schema.names], b.schema.names)

    return out.mapInArrow(tidy(run), out.schema)


def _sized(groups: DataFrame) -> DataFrame:
    """b, pieces and salts of groups (b, ids: of all members together, members)."""
    pieces, salts = (F.col("ids") / PIECE_IDS).cast("int") + 1, (F.col("members") / PIECE_MEMBERS).cast("int") + 1
    return stash(groups.select("b", pieces.alias("pieces"), salts.alias("salts")), "groups")


def sketches(docs: DataFrame, described: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """a, n (tokens of the set) and ids (32 bits of its tokens in the lower half of the hash range) of the nodes named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in stretches(b["text"]):
                sets = [s for s in shingle_sets(texts, measure.width) if len(s)]
                half = [(s[: np.searchsorted(s, _U(1 << 63))] >> _U(31)).astype(np.uint32).tobytes() for s in sets]
                node = pa.array([_prints(s)[0] for s in sets], pa.int64())
                yield pa.record_batch([node, pa.array([len(s) for s in sets], pa.int64()), pa.array(half, pa.binary())], ["a", "n", "ids"])

    return _of_texts(docs, described, nodes, run, "a long, n long, ids binary")


def qualifying_members(docs: DataFrame, described: DataFrame, members: DataFrame, measure: Measure) -> DataFrame:
    """The rows (a, b) of members whose overlap with the union of the other members, head included, allows a link.

    Of a set of n tokens, n part / whole at least are in any set linked to it. Groups of so many members that they are
    dealt out later stay whole.
    """

    def own(group: pa.Table) -> pa.Table:
        ids = _all(group["ids"])
        v, often = _unite(ids)
        size = [len(x.as_buffer()) // 4 for x in group["ids"]]
        alone = np.bincount(np.repeat(np.arange(len(size)), size)[often[np.searchsorted(v, ids)] == 1], minlength=len(size))
        return pa.table([group["a"], group["b"], group["n"], pa.array(alone, pa.int64())], names=["a", "b", "n", "alone"])

    with_head = members.unionByName(members.select(F.col("b").alias("a"), "b").distinct())
    size = described.where("node is not null").groupBy(F.col("node").alias("a")).agg(F.first("n_shingles").alias("ids"))
    groups = _sized(with_head.join(size, "a").groupBy("b").agg(F.sum(F.col("ids") / 2).alias("ids"), F.count("*").alias("members")))
    placed = with_head.join(broadcast_if_small(groups.where("salts = 1"), 24), "b").select("a", "b", "pieces")
    sketch = sketches(docs, described, with_head.select(F.col("a").alias("node")).distinct(), measure)
    alone = _cut(placed.join(sketch, "a")).groupBy("b", "r").applyInArrow(own, "a long, b long, n long, alone long")
    alone = alone.groupBy("a", "b").agg(F.first("n").alias("n"), F.sum("alone").alias("alone"))
    few = alone.where((F.col("a") != F.col("b")) & (measure.whole * F.col("alone") <= (measure.whole - measure.part) * F.col("n"))).select("a", "b")
    # a set without tokens in the lower half has no row above; it is small, and stays
    unseen = members.join(broadcast_if_small(groups.where("salts > 1"), 24), "b", "left_semi")
    bare = members.join(alone.select("a").distinct(), "a", "left_anti")
    out = stash(few.unionByName(unseen).unionByName(bare).distinct(), "qualifying")
    unstash(groups)
    return out


def _unite(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v, often = np.unique(ids, return_counts=True)
    return v, often.astype(np.uint32)


def _all(column: pa.ChunkedArray, kind: type = np.uint32) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_tokens(x, kind) for x in column)])


def _opens(members: pa.Table, union: tuple[np.ndarray, np.ndarray], measure: Measure) -> pa.Table:
    """The members whose overlap with the union of the others can meet their bound, with what of the union they share."""
    ids = _all(members["ids"])
    often = union[1][np.searchsorted(union[0], ids)]
    linked, n_a, n_b, d = (members[c].to_numpy() for c in ("linked", "n_a", "n_b", "d"))
    size = np.array([len(x.as_buffer()) // 4 for x in members["ids"]])
    shared, n = often > 1, np.zeros(len(size), np.int64)
    np.add.at(n, np.repeat(np.arange(len(size)), size), shared)
    least = overlap_bound(measure, linked, n_a, n_b, d)
    keep = np.flatnonzero((n > 0) & ((n >= least) | (members["pieces"].to_numpy() > 1)))
    at = np.concatenate([[0], np.cumsum(size)])
    of = lambda v: pa.array([v[at[i] : at[i + 1]][shared[at[i] : at[i + 1]]].tobytes() for i in keep], pa.binary())
    kept = members.take(pa.array(keep))
    return pa.table([kept["a"], kept["b"], kept["linked"], kept["n_a"], kept["d"], pa.array(least[keep]), pa.array(n[keep]), of(ids), of(often)], _OPENED)


def open_groups(slices: DataFrame, measure: Measure) -> DataFrame:
    """The matrix and its bound: a, b, linked, n_a, d, least, n, ids and often of the members that open their group b, by piece."""

    def whole(members: pa.Table) -> pa.Table:
        return _opens(members, _unite(_all(members["ids"])), measure)

    def share(members: pa.Table) -> pa.Table:
        return _row(members, *_unite(_all(members["ids"])))

    def merge(unions: pa.Table) -> pa.Table:
        v, at = np.unique(_all(unions["ids"]), return_inverse=True)
        often = np.bincount(at, _all(unions["often"]), len(v)).astype(np.uint32)
        return _row(unions, v, often)

    def _row(of: pa.Table, v: np.ndarray, often: np.ndarray) -> pa.Table:
        return pa.table([*(of[c].slice(0, 1) for c in ("b", "r", "salts")), pa.array([v.tobytes()], pa.binary()), pa.array([often.tobytes()], pa.binary())], _UNION)

    def against(members: pa.Table, union: pa.Table) -> pa.Table:
        return _opens(members, (_all(union["ids"]), _all(union["often"])), measure)

    usual = slices.where("salts = 1").groupBy("b", "r").applyInArrow(whole, _ddl(_OPENED))
    large = slices.where("salts > 1")
    unions = large.groupBy("b", "r", "s").applyInArrow(share, _ddl(_UNION)).groupBy("b", "r").applyInArrow(merge, _ddl(_UNION))
    unions = unions.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return usual.unionByName(large.groupBy("b", "r", "s").cogroup(unions.groupBy("b", "r", "s")).applyInArrow(against, _ddl(_OPENED)))


def rarest_shared(opened: DataFrame) -> DataFrame:
    """The rarest of the tokens that each opening member shares, as many as its bound leaves: b, id, left (of the shared tokens, this one
    and those after it), and the member's a, linked, n_a and d."""
    own = ["b", "a", "linked", "n_a", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids, left = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for i, (parts, n, least) in enumerate(zip(b["parts"].to_pylist(), b["n"].to_pylist(), b["least"].to_pylist(), strict=True)):
                v, often = (np.concatenate([np.frombuffer(x[c], np.uint32) for x in parts]) for c in ("ids", "often"))
                ids.append(v[np.lexsort([v, often])[: n - least + 1]])
                rows.append(np.full(len(ids[-1]), i))
                left.append(n - np.arange(len(ids[-1])))
            cols = b.select(own).take(pa.array(np.concatenate(rows))).columns
            yield pa.record_batch([*cols, pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(left))], [*own, "id", "left"])

    first = [F.first(c).alias(c) for c in ("linked", "n_a", "d", "least")]
    whole = opened.groupBy("a", "b").agg(*first, F.sum("n").alias("n"), F.collect_list(F.struct("ids", "often")).alias("parts"))
    return whole.where("n >= least").mapInArrow(tidy(run), "b long, a long, linked boolean, n_a long, d long, id long, left long")


def pairs_to_verify(compared: DataFrame, label: DataFrame, measure: Measure) -> DataFrame:
    """a, b: the pairs in different components that may link, each once. label: node and component of linked nodes."""
    component = label.select(F.col("node").alias("a"), "component")
    placed = lambda df: df.join(component, "a", "left").withColumn("component", F.coalesce("component", "a"))
    spread = [F.min("component").alias("p"), F.max("component").alias("q")]
    groups = placed(compared.select("a", "b", "d")).groupBy("b").agg(*spread, F.sum("d").alias("ids"), F.count("*").alias("members")).where("p <> q")
    groups = _sized(groups)
    slices = compared.where("d > 0").join(broadcast_if_small(groups, 24), "b").withColumn("s", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    rare = stash(placed(rarest_shared(open_groups(_cut(slices), measure))), "rare-tokens")
    asked = rare.groupBy("b", "id").agg(*spread, F.bool_or(~F.col("linked")).alias("asked")).where("p <> q and asked").select("b", "id")
    index = rare.join(asked, ["b", "id"], "left_semi")
    x, y = (index.select("b", "id", *[F.col(c).alias(f"{c}_{side}") for c in ("a", "component", "linked", "n_a", "d", "left")]) for side in "xy")
    s, k, size = measure.whole + measure.part, measure.whole - measure.part, F.col("n_a_x") + F.col("n_a_y")
    # the first token on which two members meet leaves room for the overlap that a link needs
    room = 2 * s * F.least("left_x", "left_y") >= s * (F.col("d_x") + F.col("d_y")) - k * size
    can_link = measure.whole * F.least("n_a_x", "n_a_y") >= measure.part * F.greatest("n_a_x", "n_a_y")
    once = F.col("linked_y") | (F.col("a_x") < F.col("a_y"))
    same = (x["b"] == y["b"]) & (x["id"] == y["id"])
    met = x.where("not linked_x").join(y, same & once & (F.col("component_x") != F.col("component_y")) & can_link & room)
    pairs = stash(met.select(F.least("a_x", "a_y").alias("a"), F.greatest("a_x", "a_y").alias("b")).distinct(), "met")
    unstash(groups, rare)
    return pairs


def same_document(described: DataFrame) -> DataFrame:
    """a, b: the nodes of documents whose rows have different texts, each with the least of its document."""
    per = described.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    several = per.where("a <> b").select("doc_id", "a")
    return described.where("node is not null").select("doc_id", F.col("node").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct()


def link_sets(docs: DataFrame, described: DataFrame, measure: Measure) -> DataFrame:
    """node and component of every node that some link reaches. Each pair that could join two components is verified. Rows of one doc_id hang together."""
    sharers = similar_groups(docs, measure)
    members = qualifying_members(docs, described, sharers, measure)
    unstash(sharers)
    nodes = members.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = fetch_sets(docs, described, nodes, measure)
    compared = stash(compare(members, sets, measure), "compared")
    links = compared.where("linked").select("a", "b")
    label = components(links)
    met = pairs_to_verify(compared, label, measure)
    if not met.isEmpty():
        label = components(links.unionByName(compare(met, sets, measure).where("linked").select("a", "b")))
    same = same_document(described)
    if not same.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(same))
    label = stash(label, "label")
    unstash(members, sets, compared, met)
    return label


def _classes(own: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """describe_sets of own, and node, component, component_id (the least doc_id of the component) and class_size of the nodes in components of several rows."""
    described = stash(describe_sets(own, measure), "described")
    label = link_sets(own, described, measure)
    by_node = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    by_node = stash(by_node.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    unstash(label)
    whole = by_node.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("class_size")).where("class_size > 1")
    classes = stash(by_node.join(whole, "component").select("node", "component", "component_id", "class_size"), "classes")
    unstash(by_node)
    return described, classes


def ngram_jaccard_join(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and class_size of every row of docs (doc_id, text).

    A null or blank text has an empty set, no links, and is its own component. Rows that repeat a doc_id are one document: what any of
    them links to is in one component with the others. A row without doc_id is a document of its own and links like any other; where a
    component has no doc_id at all its component_id is null. A long text is one set, looked at whole by one task; an empty table gives
    no rows. Other columns of docs are not read. Nodes are 64-bit prints of sets: of a billion different sets, the chance that
    any two share a print is about 3 %.
    """
    described, classes = _classes(docs.select("doc_id", "text"), measure)
    keyed = described.where("node is not null").join(broadcast_if_small(classes.drop("component"), 32), "node", "left")
    alone = described.where("node is null").withColumn("component_id", F.lit(None).cast("long")).withColumn("class_size", F.lit(None).cast("long"))
    return keyed.unionByName(alone).select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def keep_one_of_each(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """One row of docs for each component of ngram_jaccard_join, with all its columns: of the smallest doc_id.

    Of rows that repeat that doc_id, and of a component without any doc_id, the row with the smallest hash of its columns stays (equal
    rows are one), so that reruns agree. Rows without words and without doc_id all stay; those of one doc_id are one document. An empty
    table stays empty; long texts are looked at whole.
    """
    own = docs.select("doc_id", "text")
    described, classes = _classes(own, measure)
    keyed = described.join(broadcast_if_small(classes.drop("class_size"), 32), "node", "left")
    ids = keyed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "doc_id")).alias("least"), F.count("*").alias("rows"))
    kept = stash(ids.where("doc_id = least").select(F.col("doc_id").alias("_id"), "rows"), "kept")
    single, repeated = kept.where("rows = 1").select("_id"), kept.where("rows > 1").select("_id")
    once = docs.join(broadcast_if_small(single, 8), docs["doc_id"] == single["_id"], "left_semi")
    unnamed = own.where("doc_id is null").isEmpty()
    if unnamed and repeated.isEmpty():
        return once
    # what doc_id can't tell apart goes by a hash of its columns
    mark = fresh(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") if t[:3] != "map" else F.map_entries(F.col(f"`{c}`")) for c, t in docs.dtypes]))
    several = marked.join(repeated, marked["doc_id"] == repeated["_id"], "left_semi")
    first = several.groupBy(F.col("doc_id").alias("_id")).agg(F.min(mark).alias("_mark"))
    out = several.join(first, (several["doc_id"] == first["_id"]) & (several[mark] == first["_mark"]), "left_semi").dropDuplicates(["doc_id", mark])
    if not unnamed:
        out = out.unionByName(_of_unnamed(marked.where("doc_id is null"), mark, classes, measure))
    return once.unionByName(out.drop(mark))


def _of_unnamed(rows: DataFrame, mark: str, classes: DataFrame, measure: Measure) -> DataFrame:
    """The rows without doc_id that stay: those without words, and one of each component that has no doc_id."""
    placed = describe_sets(rows.select(F.col(mark).alias("doc_id"), "text"), measure).distinct()
    placed = placed.join(broadcast_if_small(classes.drop("class_size"), 32), "node", "left").where("component_id is null")
    best = placed.where("node is not null").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("doc_id").alias("_mark")).select("_mark").distinct()
    worded = rows.join(best, rows[mark] == best["_mark"], "left_semi").dropDuplicates([mark])
    blank = placed.where("node is null").select(F.col("doc_id").alias("_mark"))
    return worded.unionByName(rows.join(blank, rows[mark] == blank["_mark"], "left_semi"))
