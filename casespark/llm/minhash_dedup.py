"""Near duplicates by bottom-k sketches of one hash function.

* Every document's distinct word shingles are hashed once; the ``SKETCH`` least values are retained.  Documents with
  the same set (count and 128-bit sum of the set) form one class, and only its smallest id goes on.
* Inverted lists hold the classes that retain the same ``RUN`` values one after the other among their ``LEAD`` least.
  Two sets miss each other only if the ``LEAD`` least values of their union hold no ``RUN`` shared ones in a row: below
  5e-6 at similarity 0.8, never if the union is no larger than ``LEAD``.  Sets of up to ``TINY`` values, for which that
  may fail, are also in the lists of each two of their values.  Unlike lists of any two of a few values, which unrelated
  texts share the more the larger the corpus, such lists hardly grow by chance.
* In each list a few centres (least under different hashes of the id) meet all members; the union sketch of a pair
  estimates its similarity, and pairs estimated at five standard errors below the threshold or more are compared on
  their full sets.  This is linear in the length of a list.
* In lists whose members still lie in several components, a member next to a component of ``BIG`` nodes or more meets
  all of that component on full sets, once.  The members of small components are then estimated against each other
  in blocks, each pair in one of its lists; all lists around one large component count as a single list.
* Members of lists that are longer than ``LONG`` leave them for the lists of their rarest values: of two sets that share
  at least t values, the rarest shared one is among the ``size - t + 1`` rarest of either.  Documents with one common
  line hold enough values of their own to be in none of these lists, however many have the line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.components import connected_components
from casespark.llm.exact_dedup import one_of_each
from casespark.llm.shared import Scratch
from casespark.llm.text_arrays import LOWER, combine, mix, span_hashes, steps, text_buffers, word_spans

SKETCH, RUN, LEAD, TINY, CENTRES, SIDE, SALTS, BIG = 64, 3, 35, 12, 3, 256, 64, 32
#: members of a list outside its largest component that meet each other as they are: the blocks of a longer list would
#: grow with the square of its length
LONG = 256


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, ascending within a document, and where each document begins.

    A document with fewer words than ``words`` has its whole word sequence as the one shingle, without words none.
    """
    n = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = span_hashes(LOWER[data], starts, ends)
    count = np.bincount(doc, minlength=n)
    rolled = h[:max(0, len(h) - words + 1)].copy()
    for k in range(1, words):
        rolled = combine(rolled, h[k:k + len(rolled)])
    whole = doc[:len(rolled)] == doc[words - 1:] if len(rolled) else np.zeros(0, bool)
    keys, owner = [mix(rolled[whole])], [doc[:len(rolled)][whole]]
    begin = np.concatenate([[0], np.cumsum(count)])
    for length in range(1, words):                             # short documents, by their number of words
        few = np.flatnonzero(count == length)
        if len(few):
            value = h[begin[few]]
            for k in range(1, length):
                value = combine(value, h[begin[few] + k])
            keys.append(mix(value + np.uint64(length)))
            owner.append(few)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _sets(batch_column: pa.Array, words: int) -> Iterator[np.ndarray]:
    data, offs = text_buffers(batch_column)
    for lo, hi in steps(offs):
        keys, begin = shingle_sets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], words)
        for i in range(hi - lo):
            yield keys[begin[i]:begin[i + 1]]


def _sketcher(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for s in _sets(batch.column(1), words):
                a = int(mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64))
                b = int(mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64))
                out.append((len(s), a - 2**63, b - 2**63, s[:SKETCH].tobytes()))
            n, a, b, sketch = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch({"id": batch.column(0), "n": pa.array(n, pa.int64()), "d1": pa.array(a, pa.int64()),
                                   "d2": pa.array(b, pa.int64()), "sketch": pa.array(sketch, pa.binary())})
    return sketch


def estimate(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Similarity of two sets from the least ``size`` values of the union of their sketches."""
    union = np.sort(np.concatenate([a, b]))
    twice = union[1:] == union[:-1]
    distinct = len(union) - int(twice.sum())
    if distinct <= size:
        return float(twice.sum()) / max(distinct, 1)
    rank = np.cumsum(np.r_[True, ~twice])
    return float((twice & (rank[1:] <= size)).sum()) / size


def _estimates(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = [i for i in range(batch.num_rows)
                if estimate(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64))
                >= least]
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def _shared(asked: list[np.ndarray], met: list[np.ndarray]) -> np.ndarray:
    """Number of shared values of each asking set (rows) with each met set (columns)."""
    if not sum(map(len, asked)):
        return np.zeros((len(asked), len(met)), np.int64)
    values, where = np.unique(np.concatenate(asked), return_inverse=True)
    holder = np.repeat(np.arange(len(asked)), [len(s) for s in asked])[np.argsort(where, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
    flat = np.concatenate(met)
    member = np.repeat(np.arange(len(met)), [len(s) for s in met])
    spot = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    hit = values[spot] == flat
    spot, member = spot[hit], member[hit]
    held = first[spot + 1] - first[spot]
    query = holder[np.repeat(first[spot] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))]
    return np.bincount(query * len(met) + np.repeat(member, held), minlength=len(asked) * len(met)).reshape(len(asked), -1)


def _runs(s: np.ndarray) -> np.ndarray:
    """A hash of each RUN values in a row."""
    out = s[:max(0, len(s) - RUN + 1)]
    for k in range(1, RUN):
        out = combine(out, s[k:k + len(out)])
    return out


def _block_pairs(batches: Iterator[pa.RecordBatch], least: float, share: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each (list, block, part): first come its queries, then the members to meet.

    However many values two sets share, their pair is estimated once among the lists: in that of their first common run
    (the values before position ``start`` of a member's sketch; of two values in a ``tiny`` list), and in the lower of the
    size classes that both are in (``own``: the list's is the set's own class); in lists of rarest values, in that of the
    rarest shared one (``before`` holds a member's rarer values, null elsewhere).  Of two that ask, the one of the smaller
    id does.  A list of ``start`` 0 stands for no run.
    """
    group, asked, met, found = None, [], [], []

    def sets(side: list[dict], name: str = "sketch") -> list[np.ndarray]:
        return [np.frombuffer(r[name], np.uint64) for r in side]

    def pairs() -> None:
        rows, columns = asked, met
        if not (rows and columns):
            return

        def column(name: str) -> tuple[np.ndarray, np.ndarray]:
            return np.array([r[name] for r in rows])[:, None], np.array([r[name] for r in columns])[None]

        def narrowed(fits: np.ndarray) -> tuple[list[dict], list[dict], np.ndarray]:
            x, y = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
            return [rows[k] for k in x], [columns[k] for k in y], fits[np.ix_(x, y)]

        # what is cheap to tell first: most blocks hold no pair that is worth more
        (n, m), (c, d), (x, y), (u, v) = column("n"), column("component"), column("node"), column("own")
        fits = (c != d) & (np.minimum(n, m) >= share * np.maximum(n, m)) & (u | v) & ((x < y) | ~column("asks")[1])
        rows, columns, fits = narrowed(fits)
        if rows:
            longest = np.maximum.outer([len(r["sketch"]) for r in rows], [len(r["sketch"]) for r in columns]) // 8
            rows, columns, fits = narrowed(fits & (_shared(sets(rows), sets(columns)) >= least * longest))   # no estimate is above this share
        if rows and rows[0]["start"]:
            seen, twice = (lambda s, r: s[:r["start"]], 2) if rows[0]["tiny"] else (lambda s, r: _runs(s[:r["start"] - 1]), 0)
            fits &= twice == _shared(*([seen(s, r) for s, r in zip(sets(side), side)] for side in (rows, columns)))
        if rows and rows[0]["before"] is not None:
            fits &= 0 == _shared(sets(rows, "before"), sets(columns, "before"))
        for x, y in zip(*(k.tolist() for k in np.nonzero(fits))):
            r, t = rows[x], columns[y]
            if estimate(*sets([r, t])) >= least:
                found.append((min(r["node"], t["node"]), max(r["node"], t["node"]), group[0]))

    def batch_of() -> pa.RecordBatch:
        a, b, block = zip(*found) if found else ((), (), ())
        found.clear()
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "block": pa.array(block, pa.int64())})

    for batch in batches:
        for row in batch.to_pylist():
            at = (row["block"], row["i"], row["j"])
            if at != group:
                pairs()
                group, asked, met = at, [], []
            if row["role"] == 0:
                asked.append(row)
            else:
                met.append(row)
                if len(met) == SIDE:
                    pairs()
                    met = []
        yield batch_of()
    pairs()
    yield batch_of()


def _verifier(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, node, asks, text), sorted; those with null ``asks`` bring the sets that the others of the block ask for."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            a, b = [], []
            for block, node, asks, s in zip(*(batch.column(k).to_pylist() for k in range(3)), _sets(batch.column(3), words)):
                if block != at:
                    at, held = block, {}
                if asks is None:
                    held[node] = s.copy()
                    continue
                for x in asks if len(s) else ():
                    mine = held[x]
                    spot = np.minimum(np.searchsorted(mine, s), max(len(mine) - 1, 0))
                    shared = int((mine[spot] == s).sum()) if len(mine) else 0
                    if 100 * shared >= percent * (len(mine) + len(s) - shared):
                        a.append(x)
                        b.append(node)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return verify


def _meeter(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (c, i, j, role, id, text), sorted; in each group the texts of role 0 ask, those of role 1 are met."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asking, index = None, [], None

        def built() -> tuple:
            sets = [s for _, s in asking]
            values, where = np.unique(np.concatenate(sets), return_inverse=True)
            holder = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[np.argsort(where, kind="stable")]
            first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
            return values, holder, first, np.array([len(s) for s in sets]), np.ones(len(sets), bool)

        for batch in batches:
            a, b = [], []
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for (*at, role, node), s in zip(keys, _sets(batch.column(5), words)):
                if at != group:
                    group, asking, index = at, [], None
                if role == 0:
                    asking.append((node, s.copy()))
                elif asking:
                    index = index or built()
                    values, holder, first, size, open_ = index
                    spot = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    spot = spot[values[spot] == s]
                    held = first[spot + 1] - first[spot]
                    at_ = np.repeat(first[spot] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
                    shared = np.bincount(holder[at_], minlength=len(size))
                    linked = np.flatnonzero((100 * shared >= percent * (size + len(s) - shared)) & open_)
                    open_[linked] = False
                    a += [asking[k][0] for k in linked]
                    b += [node] * len(linked)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return meet


class _Search:
    def __init__(self, base: DataFrame, scratch: Scratch, words: int, percent: int):
        self.base, self.scratch, self.words, self.percent = base, scratch, words, percent
        self.share = percent / 100
        self.least = self.share - 5 * (self.share * (1 - self.share) / SKETCH) ** 0.5
        self.size = f"floor(ln(n) / ln({1 / self.share + 1e-9}))"

    def lists(self, nodes: DataFrame) -> DataFrame:
        """(key, start, tiny, node, n, members): the lists of a class that another class is in too.

        ``start`` is the place in the sketch after the values that the list stands for."""
        runs = (f"transform(sequence(0, size(v) - {RUN}), i -> named_struct('key', xxhash64(slice(v, i + 1, {RUN})),"
                f" 'start', i + {RUN}, 'tiny', false))")
        twos = ("flatten(transform(v, (x, i) -> transform(slice(v, i + 2, greatest(size(v) - i - 1, 0)),"
                " (y, j) -> named_struct('key', xxhash64(x, y), 'start', i + j + 2, 'tiny', true))))")
        none = "cast(array() AS array<struct<key: bigint, start: int, tiny: boolean>>)"
        rows = (nodes.select("node", "n", F.expr(f"slice({_VALUES}, 1, {LEAD})").alias("v"))
                .select("node", "n", F.explode(F.expr(f"concat(if(size(v) >= {RUN}, {runs}, {none}), if(n <= {TINY}, {twos}, {none}))")).alias("x"))
                .select("x.key", "x.start", "x.tiny", "node", "n"))
        shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        return self.scratch.table(rows.join(shared, "key"), "lists")

    def compare(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough; each is compared in one of its blocks.

        A text travels once to each block that has pairs of it, so pairs of a crowd of similar texts that stand in one
        block cost no text each."""
        pairs = self.scratch.table(pairs.groupBy("a", "b").agg(F.min("block").alias("block")), f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        texts = self.scratch.table(self.base.join(ids, "id", "left_semi").dropDuplicates(["id"]), f"{name}-texts")
        sides = pairs.groupBy("block", F.col("b").alias("id")).agg(F.collect_list("a").alias("asks")).unionByName(
            pairs.select("block", F.col("a").alias("id"), F.lit(None).cast("array<long>").alias("asks")).distinct())
        return (sides.join(texts, "id").select("block", "id", "asks", "text")
                .repartition("block").sortWithinPartitions("block", F.col("asks").isNotNull())
                .mapInArrow(_verifier(self.words, self.percent), "a long, b long"))

    def central_pairs(self, nodes: DataFrame, lists: DataFrame) -> DataFrame:
        """Members of each list against its centres, filtered by size and by the estimate; a frequent ``a`` is dealt over
        up to SALTS blocks."""
        centres = lists.groupBy("key").agg(*[
            F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node", "n")).alias(f"c{k}") for k in range(CENTRES)])
        met = (lists.join(centres, "key")
               .select("node", "n", F.explode(F.array(*[F.struct(F.col(f"c{k}.node").alias("node"), F.col(f"c{k}.n").alias("n"))
                                                        for k in range(CENTRES)])).alias("c"))
               .where("node <> c.node").where(f"least(n, c.n) >= {self.share} * greatest(n, c.n)")
               .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())
        salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
        return self.estimated(met, nodes).withColumn("block", F.xxhash64("a", salt))

    def estimated(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose union sketch does not rule them out."""
        sketches = nodes.select("node", "sketch")
        least = self.least
        return (pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
                .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
                .select("a", "b", "sa", "sb")
                .mapInArrow(lambda batches: _estimates(batches, least), "a long, b long"))

    def open_lists(self, nodes: DataFrame, lists: DataFrame, parts: DataFrame, large: DataFrame) -> DataFrame:
        """(key, start, tiny, own, before, node, n, component, crowd, divided): the lists that still hold several components.

        Lists are divided by size first: a set is in the lists of its own size class and of the next, and sets of the
        required similarity, whose sizes differ by less than a class, have one in common.  A list that is mostly one
        large component stays whole and names it in ``crowd``; members of other long lists meet in the lists of their
        rarest values, and so do those around a large component that are too many for one list (``divided``).
        """
        placed = (lists.where("members > 2").join(parts, "node", "left")   # of two, one was the centre
                  .withColumn("size", F.explode(F.expr(f"sequence({self.size}, {self.size} + 1)")))
                  .select(F.xxhash64("key", "size").alias("key"), F.expr(f"size = {self.size}").alias("own"), "start", "tiny", "node", "n",
                          F.coalesce("component", "node").alias("component")))
        counts = (placed.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key")
                  .agg(F.count("*").alias("parts"), (F.sum("m") - F.max("m")).alias("outside"), F.max(F.struct("m", "component")).alias("top"))
                  .where("parts > 1").withColumn("of", F.col("top.component"))
                  .join(large.select(F.col("component").alias("of"), F.lit(True).alias("big")), "of", "left")
                  .select("key", "outside", F.when(F.expr("big AND 4 * top.m >= outside"), F.col("of")).alias("crowd")))
        rows = self.scratch.table(placed.join(counts, "key").withColumn("before", F.lit(None).cast("binary")), "open")
        around = self.scratch.table(
            rows.where("crowd IS NOT NULL").join(large, "component", "left_anti").select("crowd", "node", "n", "component").distinct(), "around")
        many = self.scratch.table(around.groupBy("crowd").count().where(f"count > {LONG}").select("crowd"), "many")
        rest = f"outside > {LONG} AND crowd IS NULL"
        members = self.scratch.table(
            rows.where(rest).select("node", "n", "component")
            .unionByName(around.join(many, "crowd", "left_semi").select("node", "n", "component")).distinct(), "members")
        return (rows.where(f"NOT ({rest})").drop("outside").join(many.withColumn("divided", F.lit(True)), "crowd", "left")
                .unionByName(self.rarest(nodes, members), allowMissingColumns=True))

    def rarest(self, nodes: DataFrame, members: DataFrame) -> DataFrame:
        """The lists of ``members`` (node, n, component) by their rarest values that another member has too.

        Sets whose likely partners are retained whole share ``percent`` of their values, others as many retained ones as
        the estimate asks for; values of a single member are the rarest and make no list."""
        values = self.scratch.table(
            members.join(nodes.select("node", "sketch"), "node")
            .select("node", "n", "component", F.size(F.expr(_VALUES)).alias("held"), F.explode(F.expr(_VALUES)).alias("x")), "values")
        often = values.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
        least = (f"if(n <= {SKETCH} * {self.percent} div 100, cast((n * {self.percent} + 99) div 100 AS int),"
                 f" cast(ceil(held * {max(self.least, 0)!r}D - 1e-9D) AS int))")
        shared = (values.join(often, "x").groupBy("node", "n", "component", "held")
                  .agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("v"))
                  .withColumn("v", F.expr(f"slice(transform(v, s -> s.x), 1, greatest(size(v) - greatest({least}, 1) + 1, 0))")))
        rows = (shared.select("node", "n", "component", "v", F.posexplode("v").alias("i", "x"))
                .withColumn("size", F.explode(F.expr(f"sequence({self.size}, {self.size} + 1)")))
                .select(F.xxhash64(F.lit(19), "x", "size").alias("key"), F.lit(0).alias("start"), F.lit(False).alias("tiny"),
                        F.expr(f"size = {self.size}").alias("own"), F.expr("aggregate(slice(v, 1, i), X'', (a, x) -> concat(a, x))").alias("before"), "node", "n", "component"))
        several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        return self.scratch.table(rows.join(several.select("key"), "key", "left_semi"), "rarest")

    def others(self, nodes: DataFrame, lists: DataFrame, parts: DataFrame, links: DataFrame) -> DataFrame:
        """Links between components that no centre has joined, from the lists that still hold several of them.

        A member that shares a list with a component of ``BIG`` nodes or more meets all nodes of it, once however
        many lists they share.  Then members of smaller components meet each other inside their lists.
        """
        large = self.scratch.table(
            parts.join(nodes.select("node", "n"), "node").groupBy("component")
            .agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high")).where(f"size >= {BIG}"), "large")
        rows = self.open_lists(nodes, lists, parts, large)
        met = self.scratch.table(self.meet(self._touching(rows, large), parts, large), "links-2")
        now = self.scratch.table(connected_components(links.unionByName(met), self.scratch, "parts-2"), "parts-2")
        small = rows.join(large, "component", "left_anti").drop("component")
        around = (small.where("crowd IS NOT NULL AND divided IS NULL")     # one list for all lists around a large component
                  .select(F.xxhash64(F.lit(17), "crowd").alias("key"), F.lit(0).alias("start"), F.lit(False).alias("tiny"), F.lit(True).alias("own"),
                          F.lit(None).cast("binary").alias("before"), "node", "n")
                  .distinct())
        small = (small.where("crowd IS NULL").drop("crowd", "divided").unionByName(around).join(now, "node", "left")
                 .withColumn("component", F.coalesce("component", "node")))
        return met.unionByName(self.compare(self._against_all(nodes, small), "other"))

    def _touching(self, rows: DataFrame, large: DataFrame) -> DataFrame:
        """(component, node): a node and a larger component of its list; of two large ones the fewer members ask."""
        per_list = rows.groupBy("key", "component").agg(F.count("*").alias("m")).join(large, "component", "left")
        rank = F.struct(F.col("size").isNotNull().alias("big"), "m", "component")
        mine = rows.join(per_list.select("key", "component", rank.alias("rank")), ["key", "component"])
        theirs = per_list.where("size IS NOT NULL").select("key", F.col("component").alias("other"), rank.alias("other_rank"), "low", "high")
        return (mine.join(theirs, "key").where("other_rank > rank")
                .where(f"n >= {self.share} * low AND {self.share} * n <= high")
                .select(F.col("other").alias("component"), "node").distinct())

    def meet(self, asked: DataFrame, parts: DataFrame, large: DataFrame) -> DataFrame:
        """Exact links (a, b) of nodes with the components they ask, at most one for each node and part of a component."""
        asked = self.scratch.table(asked, "asked")
        load = (asked.groupBy("component").agg(F.ceil(F.count("*") / (4 * SIDE)).cast("int").alias("blocks"))
                .join(large.select("component", F.ceil(F.col("size") / (8 * SIDE)).cast("int").alias("spread")), "component"))
        targets = parts.join(load, "component")
        ids = asked.select(F.col("node").alias("id")).union(targets.select("node")).distinct()
        texts = self.scratch.table(self.base.join(ids, "id", "left_semi").dropDuplicates(["id"]), "meeting-texts")
        asking = asked.join(load, "component").select(
            F.col("component").alias("c"), F.pmod(F.xxhash64(F.lit(11), "node"), F.col("blocks")).cast("int").alias("i"),
            F.explode(F.expr("sequence(0, spread - 1)")).alias("j"), F.lit(0).alias("role"), F.col("node").alias("id"))
        meeting = targets.select(
            F.col("component").alias("c"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"),
            F.pmod(F.xxhash64(F.lit(13), "node"), F.col("spread")).cast("int").alias("j"), F.lit(1).alias("role"),
            F.col("node").alias("id"))
        return (asking.unionByName(meeting).join(texts, "id").select("c", "i", "j", "role", "id", "text")
                .repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "role")
                .mapInArrow(_meeter(self.words, self.percent), "a long, b long"))

    def _against_all(self, nodes: DataFrame, rows: DataFrame) -> DataFrame:
        """Pairs of different components in a list, by the estimate: members outside the largest one meet all members."""
        counts = (rows.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key")
                  .agg(F.sum("m").alias("members"), F.count("*").alias("parts"), F.max(F.struct("m", "component")).alias("top"))
                  .where("parts > 1"))
        members = (rows.join(counts, "key")
                   .select("key", "start", "tiny", "own", "before", "node", "n", "component", (F.col("component") != F.col("top.component")).alias("asks"),
                           F.ceil((F.col("members") - F.col("top.m")) / SIDE).cast("int").alias("blocks"),
                           F.ceil(F.col("members") / (8 * SIDE)).cast("int").alias("spread"))
                   .join(nodes.select("node", "sketch"), "node")
                   .withColumn("mine", F.pmod(F.xxhash64(F.lit(11), "node"), F.col("blocks")).cast("int"))
                   .withColumn("spot", F.pmod(F.xxhash64(F.lit(13), "node"), F.col("spread")).cast("int")))
        told = ["start", "tiny", "own", "before", "asks", "node", "n", "sketch", "component"]
        asking = members.where("asks").select("key", F.col("mine").alias("i"), F.explode(F.expr("sequence(0, spread - 1)")).alias("j"),
                                              F.lit(0).alias("role"), *told)
        meeting = members.select("key", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.col("spot").alias("j"),
                                 F.lit(1).alias("role"), *told)
        least, share = self.least, self.share
        pairs = (asking.unionByName(meeting).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
                 .withColumn("block", F.xxhash64("key", "i", "j"))
                 .mapInArrow(lambda batches: _block_pairs(batches, least, share), "a long, b long, block long"))
        return pairs


#: the retained values as an array of 8-byte binaries, least first
_VALUES = "transform(sequence(0, greatest(length(sketch) div 8 - 1, 0)), i -> substring(sketch, i * 8 + 1, 8))"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    Documents are linked when 100 * shared shingles >= percent * shingles in either (shingles of ``words`` lower-cased
    words); ``component_id`` is the smallest id reachable, ``kept`` tells whether it is the row's own.  Null and empty
    texts have no shingle and no link; a text with fewer words has one shingle.  Rows that repeat an id count as one
    document and may share a component; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = scratch.table(base.mapInArrow(_sketcher(words), "id long, n long, d1 long, d2 long, sketch binary"), "sketches")
    classes = scratch.table(table.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("node")), "classes")
    nodes = scratch.table(classes.join(table.select(F.col("id").alias("node"), "n", "d1", "d2", "sketch"),
                                       ["node", "n", "d1", "d2"]).select("node", "n", "sketch").dropDuplicates(["node"]), "nodes")
    # each step fetches the texts of its candidates by id: they lie in buckets, so that no step shuffles all texts
    texts = scratch.bucketed(base.where("id IS NOT NULL"), "texts", "id")
    search = _Search(texts, scratch, words, percent)
    lists = search.lists(nodes)
    links = scratch.table(search.compare(search.central_pairs(nodes, lists), "central"), "links-1")
    parts = scratch.table(connected_components(links, scratch, "parts-1"), "parts-1")
    more = scratch.table(search.others(nodes, lists, parts, links), "links-3")
    final = connected_components(links.unionByName(more), scratch, "parts-3")
    return (table.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
            .join(final, "node", "left")
            .withColumn("component_id", F.coalesce("component", "node", "id"))
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input rows of one document of each group, with their own columns; of rows that repeat id and text one stays."""
    kept = (near_duplicates(docs, id_col, text_col, **parameters).where("kept")
            .select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__id")).distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")))
            .withColumn("__sha", F.sha2(text, 256)))
    return one_of_each(rows.join(kept, "__id", "left_semi"), ["__id", "__sha"], F.lit(0)).select(*docs.columns)
