"""N-gram Jaccard join by a token-group matrix.

A document's set are its distinct shingles of ``SHINGLE`` words; two documents link when
100 * intersection >= ``PERCENT`` * union. The join finds the components of all links:

1. Documents with equal sets form one class; one set stands for it.
2. Shingles are ordered by their hashes. Two sets that link share at least ``extra(m)`` of the
   first n - needed(n) + extra(n) shingles of each, m the size of the smaller. Spark counts these
   first shingles; a class that shares too few of its own with any others goes.
3. Of the classes that are left, all shingles are counted. Those that only one class has cannot
   be common, so a class with fewer than needed(n) others goes. This leaves little beside the
   near copies. The rare shingles come first in the order from here on.
4. Similar classes are partitioned into groups: each elects, by a sample of its shingles, the
   class that stands first among those it shares them with, and joins it if their similarity is
   ``SIMILAR`` at least. A group are the classes that are joined so.
5. Each group has the union of its members' shingles, hashed to 2**``COLUMN_BITS`` columns (its
   row of the token-group matrix, of bounded size). Where two groups have one of the first
   n - needed(n) + 1 shingles in common, the classes of the smaller group query the larger one.
   A query overlaps no member in more shingles than it has in those columns, so a group whose
   overlap stays below needed(n) is not opened; others are opened to the query.
6. A group and the queries it was opened to are compared by the whole sets in one task, or, if
   they have more than ``TILE`` shingles, cut into tiles by a hash, one task for every two tiles.
   A task follows an inverted index and puts out a spanning forest of the links, no pairs; what
   the group's centre links with is not compared among itself again.

Steps 2 to 5 lose no link, as two sets that link share a first shingle in any fixed order.

Defined cases: a text that is null or has no words has the empty set and is its own component;
with fewer than five words the whole sequence is the one shingle; equal rows get equal results;
rows without an id count as documents of id null, whose component is null unless a smaller id
is reachable (nulls are last); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.llm.components import connected_components
from vidra.llm.kernels import buffers, parts, shingle_sets
from vidra.llm.shared import Kept, count_upto, ship, tidy

SHINGLE, PERCENT = 5, 80
#: Shingles of a class that vote for its leader, and the percentage of similarity to join it.
SAMPLE, SIMILAR = 32, 30
COLUMN_BITS = 16
#: Shingles of a tile.
TILE = 1 << 19
#: Rows sent to every executor (a hash table of a few longs each); beyond it, a shuffle.
MAX_BROADCAST_IDS = 500_000
#: Stands for a null id: greater than all others.
_LAST = 2**63 - 1


def needed(n):
    """How many shingles a set of n must share with another that it links with."""
    return (n * PERCENT + 99) // 100


def extra(n):
    """How many of their first shingles two sets that link share, the smaller one of n."""
    return 1 + n // 10


def _needed(n: str) -> Column:
    return F.floor((F.col(n) * PERCENT + 99) / 100)


def set_id(s: np.ndarray) -> int:
    """A hash of the whole set, as a signed 64-bit number; 0 only for the empty set."""
    return (xxhash.xxh3_64_intdigest(s.tobytes()) | 1) - (1 << 63) if len(s) else 0


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=off[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h, class, size and the first shingles of each row of (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 2):
                sets = shingle_sets(*buffers(batch.column(2)), SHINGLE)
                ids, sizes = [set_id(s) for s in sets], [len(s) for s in sets]
                first = _lists([s[: len(s) - needed(len(s)) + extra(len(s))] if len(s) else s for s in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), first], ["doc_id", "h", "class", "size", "first"])

    return docs.mapInArrow(run, "doc_id long, h long, class long, size long, first array<long>")


def _small(table: DataFrame) -> DataFrame:
    """``table`` to be sent to every executor, if it is small enough."""
    return F.broadcast(table) if count_upto(table, MAX_BROADCAST_IDS) <= MAX_BROADCAST_IDS else table


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, size, tokens) of the rows named by ``wanted`` (doc_id, h, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 1):
                sets = shingle_sets(*buffers(batch.column(1)), SHINGLE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["class", "size", "tokens"])

    return docs.join(_small(wanted), ["doc_id", "h"]).select("class", "text").mapInArrow(run, "class long, size long, tokens array<long>")


def _first_round(rows: DataFrame, spark: SparkSession) -> Kept:
    """(doc_id, h, class) of the classes that share enough of their first shingles."""
    full = rows.filter("size > 0")
    copies = Kept(spark, full.groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("class", "at"), "copies")
    standing = full.join(_small(copies.df), "class", "left").filter(F.col("at").isNull() | (F.col("at") == F.struct("doc_id", "h")))
    tokens = standing.select("class", "size", "doc_id", "h", "first")
    each = tokens.select("class", F.explode("first").alias("token"))
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    shared = each.join(common, "token", "left_semi").groupBy("class").agg(F.count(F.lit(1)).alias("shared"))
    found = Kept(spark, shared, "shared")
    able = standing.select("class", "size", "doc_id", "h").join(found.df, "class").filter(F.col("shared") >= 1 + F.floor(_needed("size") / 10))
    out = Kept(spark, able.select("doc_id", "h", "class").distinct(), "candidates")
    for x in (copies, found):
        x.drop()
    return out


def _second_round(sets: DataFrame, spark: SparkSession) -> Kept:
    """(class, size, tokens) of the classes that share enough of all their shingles; tokens are the shared ones, the rarest first."""
    each = sets.select("class", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = each.join(common, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    able = sets.select("class", "size").distinct().join(shared, "class").filter(F.size("ts") >= _needed("size"))
    return Kept(spark, able.select("class", "size", F.col("ts.token").alias("tokens")), "able")


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    return len(np.intersect1d(s, t, assume_unique=True))


def _similar(pairs: DataFrame) -> DataFrame:
    """(class, leader) of rows (class, leader, size, lead_size, tokens, lead_tokens) whose similarity is ``SIMILAR`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                both = _overlap(s.values.to_numpy(zero_copy_only=False), t.values.to_numpy(zero_copy_only=False))
                good.append(100 * both >= SIMILAR * (n + m - both))
            keep_ = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep_), batch.column(1).filter(keep_)], ["class", "leader"])

    return pairs.select("class", "leader", "size", "lead_size", "tokens", "lead_tokens").mapInArrow(run, "class long, leader long")


def _groups(able: DataFrame, spark: SparkSession) -> Kept:
    """``able`` with the group of each class."""
    sample = able.select("class", F.explode(F.slice(F.array_sort("tokens"), 1, SAMPLE)).alias("token"))
    lead = sample.groupBy("token").agg(F.min(F.struct(F.xxhash64("class").alias("o"), F.col("class").alias("leader")))["leader"].alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", "leader")
    votes = sample.join(lead, "token").filter("leader <> class").groupBy("class", "leader").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("class").agg(F.max(F.struct("n", "leader"))["leader"].alias("leader"))
    pairs = chosen.join(able, "class").join(able.select(F.col("class").alias("leader"), F.col("size").alias("lead_size"), F.col("tokens").alias("lead_tokens")), "leader")
    joined = _roots(spark, _similar(pairs))
    out = Kept(spark, able.join(joined.df.select("class", F.col("leader").alias("group")), "class", "left").withColumn("group", F.coalesce("group", "class")), "groups")
    joined.drop()
    return out


def _roots(spark: SparkSession, leaders: DataFrame) -> Kept:
    """(class, leader) with the last leader of each class; a leader stands before its followers in one order, so there are no circles."""
    now = Kept(spark, leaders.withColumn("moved", F.lit(True)), "leaders")
    while now.df.filter("moved").limit(1).count():
        above = now.df.select(F.col("class").alias("leader"), F.col("leader").alias("higher"))
        new = Kept(spark, now.df.join(above, "leader", "left").select("class", F.coalesce("higher", "leader").alias("leader"), F.col("higher").isNotNull().alias("moved")), "leaders")
        now.drop()
        now = new
    return now


def _column(tokens: str) -> Column:
    return F.transform(tokens, lambda t: F.shiftrightunsigned(t, 64 - COLUMN_BITS).cast("int"))


def _opened(grouped: DataFrame, spark: SparkSession) -> tuple[Kept, list[Kept]]:
    """(q, group): the classes that query a group whose union leaves room for enough of their shingles."""
    first = grouped.select("class", "size", "group", F.explode(F.slice("tokens", 1, (F.size("tokens") - _needed("size") + 1).cast("int"))).alias("token"))
    open_ = first.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("token")
    members = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    held = Kept(spark, first.join(open_, "token", "left_semi").join(members, "group"), "met")
    # Per token, groups and not classes meet: a group of any size is one row.
    at = held.df.groupBy("token", "group").agg(F.first("members").alias("members"), F.min("size").alias("least"), F.max("size").alias("most"))
    asking = held.df.select("token", F.col("class").alias("q"), F.col("size").alias("q_size"), F.col("group").alias("q_group"), F.col("members").alias("q_members"))
    fits = (F.col("q_size") * 100 >= F.col("least") * PERCENT) & (F.col("most") * 100 >= F.col("q_size") * PERCENT)
    asked = Kept(spark, asking.join(at, "token").filter((F.struct("q_members", "q_group") < F.struct("members", "group")) & fits).select("q", "group").distinct(), "asked")
    cells = grouped.join(asked.df.select("group").distinct(), "group", "left_semi").select("group", F.explode(F.array_distinct(_column("tokens"))).alias("c")).distinct()
    matrix = cells.groupBy("group").agg(F.collect_list("c").alias("g_columns"))
    asking = grouped.select(F.col("class").alias("q"), _needed("size").alias("least"), _column("tokens").alias("q_columns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.zeros(1 << COLUMN_BITS, bool)
        for batch in batches:
            good = []
            for least, q, g in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                g, q = g.values.to_numpy(zero_copy_only=False), q.values.to_numpy(zero_copy_only=False)
                inside[g] = True
                good.append(int(inside[q].sum()) >= least)
                inside[g] = False
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["q", "group"])

    rows = asked.df.join(asking, "q").join(matrix, "group").select("q", "group", "least", "q_columns", "g_columns")
    return Kept(spark, rows.mapInArrow(run, "q long, `group` long"), "opened"), [held, asked]


def forest(sizes: np.ndarray, flat: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; set i are the tokens flat[off[i]:off[i + 1]] and others that no set shares, sizes[i] in all."""
    m = len(sizes)
    up = list(range(m))
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    _, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders = np.repeat(np.arange(m), np.diff(off))[order]
    at = np.searchsorted(token[order], np.arange(int(token.max(initial=-1)) + 2))
    held = np.diff(at)

    def links(i: int) -> np.ndarray:
        mine = token[off[i] : off[i + 1]]
        mine = mine[held[mine] > 1]
        if not len(mine):
            return mine
        both = np.bincount(np.concatenate([holders[at[k] : at[k + 1]] for k in mine.tolist()]), minlength=m)
        return np.flatnonzero(100 * both >= PERCENT * (sizes[i] + sizes - both))

    def merge(i: int) -> None:
        for j in links(i).tolist():
            a, b = root(i), root(j)
            if a != b:
                up[a] = b
                out.append((i, j))

    # The centre: the set whose tokens most others have.
    weight = np.zeros(m, np.int64)
    np.add.at(weight, np.repeat(np.arange(m), np.diff(off)), held[token])
    centre = int(weight.argmax()) if m else 0
    if m > 1:
        merge(centre)
    around = [root(i) == root(centre) for i in range(m)]
    for i in range(m):
        if not around[i]:
            merge(i)
    return out


def _links(grouped: DataFrame, opened: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links within each group and with the queries that it was opened to."""
    asking = opened.join(grouped.select(F.col("class").alias("q"), "size", "tokens"), "q").select("group", F.col("q").alias("class"), "size", "tokens")
    present = grouped.select("group", "class", "size", "tokens").unionByName(asking)
    weight = present.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("w")).filter("n > 1")
    tiles = F.ceil(F.col("w") / TILE)
    placed = present.join(weight.select("group", tiles.alias("tiles")), "group").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = pairs.select("group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "class", "size", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> pa.RecordBatch:
            classes = np.concatenate([x[1] for x in held])
            flat = np.concatenate([x[3] for x in held])
            off = np.concatenate([[0], np.cumsum(np.concatenate([x[4] for x in held]))])
            found = forest(np.concatenate([x[2] for x in held]), flat, off)
            return pa.RecordBatch.from_arrays([pa.array(classes[[a for a, _ in found]], pa.int64()), pa.array(classes[[b for _, b in found]], pa.int64())], ["a", "b"])

        held: list = []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            classes, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            off = batch.column(5).offsets.to_numpy()
            flat = batch.column(5).values.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if held and held[0][0] != key:
                    yield done(held)
                    held = []
                held.append((key, classes[a:b], sizes[a:b], flat[off[a] : off[b]].copy(), np.diff(off[a : b + 1])))
        if held:
            yield done(held)

    return pairs.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a long, b long")


def components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    ship(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    signatures = Kept(spark, _signatures(docs), "signatures")
    candidates = _first_round(signatures.df, spark)
    rows = Kept(spark, signatures.df.select("doc_id", "class", "size"), "classes")
    signatures.drop()
    tidy(spark)
    sets = Kept(spark, _sets(docs, candidates.df), "sets")
    able = _second_round(sets.df, spark)
    sets.drop()
    tidy(spark)
    grouped = _groups(able.df, spark)
    tidy(spark)
    opened, more = _opened(grouped.df, spark)
    links = Kept(spark, _links(grouped.df, opened.df), "links")
    for x in (candidates, able, grouped, opened, *more):
        x.drop()
    tidy(spark)
    found = connected_components(spark, links.df)
    merged = rows.df.filter("size > 0").join(_small(found), F.col("class") == F.col("node")).groupBy("component").agg(F.min("doc_id").alias("least"))
    merged = Kept(spark, found.join(merged, "component").select(F.col("node").alias("class"), "least"), "merged")
    alone = rows.df.filter("size > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("class", "first")
    tidy(spark)
    leads = Kept(spark, alone.join(merged.df, "class", "full").select("class", F.coalesce("least", "first").alias("component_id")), "leads")
    out = rows.df.join(_small(leads.df), "class", "left")
    known = lambda c: F.nullif(c, F.lit(_LAST))
    return out.select(known(F.col("doc_id")).alias("doc_id"), F.col("size").alias("n_shingles"), known(F.coalesce("component_id", "doc_id")).alias("component_id"))
