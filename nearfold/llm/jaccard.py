"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Documents are sets of word shingles. Documents with equal sets form a class at once; the
join runs between classes, in these steps.

1. Grams that one document alone has cannot meet. Blocks of documents, some BLOCK_CHARS
   long, send each gram that they hold once, by hash, to buckets, which count the blocks of
   every gram and send a bit for each gram back. Which document has which gram travels with
   the block and not with the gram, so a block costs the same at any number of buckets, and
   of a gram in every document a bucket sees one number a block. Documents that share fewer
   grams than the threshold asks for have no partner.
2. One document of each class that is left sends its grams once more and gets their
   frequencies: the global order, rare first. The first n - ceil(t n) + 1 grams are the
   prefix; its unshared part is dropped, the rest is the index.
3. Classes that share a prefix gram are candidates, under the length filter, the
   positional filter and the suffix filter, which bounds the overlap from the number of
   grams that either set has in each of BINS parts of the hash range. What is left is
   verified once by the whole sets.
4. Long posting lists hold families of near copies. First the members of a list meet a
   few pivots of the list only, and linked classes are merged, some rounds long; then all
   pairs of a list that are still apart and have not met are candidates, found from the
   members outside the list's largest component. A list is done once each member was a
   pivot. So a family does not cost the pairs of its members, and no link between
   different components is missed: the components are exact.

Empty documents (null, no words) have no shingles and link with nothing. Null ids take
part and get the smallest id they reach, null if none has one. Repeated rows are one class.
Columns beside id and text play no part. Blocks are named by their place in the input; an
input that is not read from files row by row is written first, so that a task that runs
again makes the same blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm import shingles as S
from nearfold.llm.common import dropped, fresh, give_back, slices, small_batches, steady, stored
from nearfold.operators.components import components

#: Grams that a bucket counts, on average.
BUCKET_GRAMS = 1_000_000

#: Bytes of text, and documents, of a block. A document's number in it has 16 bits.
BLOCK_CHARS, BLOCK_ROWS = 4 << 20, 1 << 16

#: Bytes of a block's rows that are sent at once, but for single rows.
SENT_BYTES = 1 << 20

#: So many ids (16 MB) are sent to all executors, counted first, so that texts are not
#: shuffled for a few of them; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

#: Parts of the hash range that the suffix filter tells apart.
BINS = 32

PACK = "bucket int, block string, kind int, a binary, b binary, c binary, ids array<long>"
PACK_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abc"), ("ids", pa.list_(pa.int64()))])
COUNTS, ROWS = 0, 1


def needed(n: int, num: int, den: int) -> int:
    """Grams that a set of n must share with any partner."""
    return -(-num * n // den)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the 24 high bits of the hash."""
    return (((grams >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


@dataclass
class Dealt:
    """The distinct grams of a block in order of bucket and first owner, how many of its
    sets have each, and which: the numbers of these sets, gram by gram."""

    grams: np.ndarray
    times: np.ndarray
    owners: np.ndarray
    where: np.ndarray  # buckets that get some
    cuts: np.ndarray  # where each one's grams end

    def parts(self) -> Iterator[tuple[int, slice]]:
        at = 0
        for bucket, end in zip(self.where.tolist(), self.cuts.tolist(), strict=True):
            yield bucket, slice(at, end)
            at = end


def first_of_each(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of an ordered array begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def deal(sets: Sequence[np.ndarray], buckets: int) -> Dealt:
    """An executor has several workers beside its heap, so arrays of a block's length are
    few at a time, and go as soon as they are used."""
    grams = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owners = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    turn = np.argsort(grams, kind="stable")
    grams, owners = grams[turn], owners[turn]
    del turn
    at = first_of_each(grams)
    found = grams[at]
    del grams
    # Ordered grams are in order of bucket.
    key = bucket_of(found, buckets)
    ends = np.flatnonzero(np.diff(key, append=-1)) + 1 if len(key) else np.zeros(0, np.int64)
    where = key[ends - 1]
    key <<= 16
    key |= owners[at]
    turn = np.argsort(key, kind="stable")
    del key
    found = found[turn]
    times = np.diff(at, append=len(owners))[turn]
    at = at[turn]
    del turn
    at -= np.cumsum(times) - times
    by_gram = np.repeat(at, times)
    del at
    by_gram += np.arange(len(owners))
    return Dealt(found, times, owners[by_gram], where, ends)


def narrow(counts: np.ndarray) -> bytes:
    """The counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // n] if n else np.uint8).astype(np.int64)


def totals(grams: Sequence[np.ndarray], times: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each gram of each part the sum of its times (one each, if not given)."""
    every = np.concatenate(grams)
    turn = np.argsort(every)
    every = every[turn]
    at = first_of_each(every)
    del every
    each = np.diff(at, append=len(turn))
    sums = each if times is None or not len(at) else np.add.reduceat(np.concatenate(times)[turn], at)
    out = np.empty(len(turn), np.int64)
    out[turn] = np.repeat(sums, each)
    return np.split(out, np.cumsum([len(g) for g in grams])[:-1])


def cut_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[np.ndarray], list]]:
    """(name, sets, ids) of blocks of documents."""
    from pyspark import TaskContext

    made, held, ids, chars = 0, [], [], 0

    def name() -> str:
        return f"{TaskContext.get().partitionId():08d}-{made:08d}"

    for b in slices(batches, "text", rows=1024, chars=1 << 20):
        if held and len(held) + b.num_rows > BLOCK_ROWS:
            yield name(), held, ids
            made, held, ids, chars = made + 1, [], [], 0
        held += S.shingle_sets(b.column("text"), size)
        ids += b.column("id").to_pylist()
        chars += sum(len(s) for s in held[-b.num_rows :]) * 6
        if chars >= BLOCK_CHARS:
            yield name(), held, ids
            made, held, ids, chars = made + 1, [], [], 0
    if held:
        yield name(), held, ids


def split_rows(group: pa.Table) -> tuple[dict, list[dict]]:
    """The row of a block's documents, and those of its buckets in order."""
    rows = group.to_pylist()
    return next(r for r in rows if r["kind"] == ROWS), sorted((r for r in rows if r["kind"] == COUNTS), key=lambda r: r["bucket"])


def blank(bucket: int, block: str, kind: int, **filled) -> dict:
    return {"bucket": bucket, "block": block, "kind": kind, "a": None, "b": None, "c": None, "ids": None} | filled


def sent(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """The rows of a block, SENT_BYTES at a time, taken from the list as they go; then what
    the block took goes back, so that the next one does not come on top of it."""
    rows.reverse()
    part, taken = [], 0
    while rows:
        more = sum(len(rows[-1][x] or b"") for x in "abc")
        if part and taken + more > SENT_BYTES:
            yield pa.RecordBatch.from_pylist(part, schema=PACK_ARROW)
            part, taken = [], 0
        part.append(rows.pop())
        taken += more
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=PACK_ARROW)
    part.clear()
    give_back()


def shared_counts(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """id, class (digest of the set), n (its size) and shared (grams that other documents
    have too; seldom too many, as 32 bits of a gram are compared) of all documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sets, ids in cut_blocks(batches, size):
            dealt = deal(sets, buckets)
            rows = [blank(k, block, COUNTS, a=dealt.grams[at].astype(np.uint32).tobytes()) for k, at in dealt.parts()]
            rows.append(blank(hash_of(block) % buckets, block, ROWS, a=dealt.owners.tobytes(), b=b"".join(map(S.digest, sets)), c=narrow(dealt.times), ids=ids))
            del dealt, sets, ids
            yield from sent(rows)

    def count(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        counted = [r for r in rows if r["kind"] == COUNTS]
        grams = [np.frombuffer(r["a"], np.uint32) for r in counted]
        for r, blocks in zip(counted, totals(grams) if grams else (), strict=True):
            r["a"], r["c"] = np.packbits(blocks >= 2).tobytes(), len(blocks).to_bytes(8, "little")
        give_back()
        return pa.Table.from_pylist(rows, schema=PACK_ARROW)

    def gather(group: pa.Table) -> pa.Table:
        of, rows = split_rows(group)
        m = len(of["ids"])
        flags = [np.unpackbits(np.frombuffer(r["a"], np.uint8), count=int.from_bytes(r["c"], "little")) for r in rows]
        flags = np.concatenate([*flags, np.zeros(0, np.uint8)])
        times, owners = widened(of["c"], len(flags)), np.frombuffer(of["a"], np.uint16)
        shared = np.bincount(owners[np.repeat((flags > 0) | (times > 1), times)], minlength=m)
        names = [of["b"][16 * i : 16 * i + 16].hex() for i in range(m)]
        return pa.table({"id": pa.array(of["ids"], pa.int64()), "class": names, "n": pa.array(np.bincount(owners, minlength=m)), "shared": pa.array(shared)})

    packs = docs.mapInArrow(pack, PACK)
    counted = packs.groupBy("bucket").applyInArrow(count, PACK)
    return counted.groupBy("block").applyInArrow(gather, "id long, class string, n long, shared long")


def hash_of(block: str) -> int:
    return int.from_bytes(hashlib.blake2b(block.encode(), digest_size=4).digest(), "little")


def bins_of(grams: np.ndarray) -> np.ndarray:
    return np.bincount(grams & (BINS - 1), minlength=BINS)


def ordered_sets(docs: DataFrame, buckets: int, size: int, num: int, den: int) -> DataFrame:
    """class, n, lone (grams that no other class has), bins (the others counted by part of
    the hash range) and grams, the others in global order, of classes with a shared prefix.
    A gram is its frequency class in the high byte (rarer is less) and 56 bits of its hash,
    so that the order is that of the numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sets, _ in cut_blocks(batches, size):
            dealt = deal(sets, buckets)
            rows = [blank(k, block, COUNTS, a=dealt.grams[at].tobytes(), c=narrow(dealt.times[at])) for k, at in dealt.parts()]
            rows.append(blank(hash_of(block) % buckets, block, ROWS, a=dealt.owners.tobytes(), b=b"".join(map(S.digest, sets)), c=narrow(dealt.times)))
            del dealt, sets, _
            yield from sent(rows)

    def count(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        counted = [r for r in rows if r["kind"] == COUNTS]
        grams = [np.frombuffer(r["a"], np.uint64) for r in counted]
        times = [widened(r["c"], len(g)) for r, g in zip(counted, grams, strict=True)]
        for r, g, all_ in zip(counted, grams, totals(grams, times) if grams else (), strict=True):
            level = np.minimum(127, np.floor(4 * np.log2(all_))).astype(np.uint64)
            r["a"], r["c"] = ((level << np.uint64(56)) | (g >> np.uint64(8))).tobytes(), None
        give_back()
        return pa.Table.from_pylist(rows, schema=PACK_ARROW)

    def gather(group: pa.Table) -> pa.Table:
        of, rows = split_rows(group)
        m = len(of["b"]) // 16
        found = np.concatenate([*(np.frombuffer(r["a"], np.uint64) for r in rows), np.zeros(0, np.uint64)])
        owners = np.frombuffer(of["a"], np.uint16)
        every = np.repeat(found, widened(of["c"], len(found))).astype(np.int64)[np.argsort(owners, kind="stable")]
        out = []
        for i, part in enumerate(np.split(every, np.cumsum(np.bincount(owners, minlength=m))[:-1])):
            grams = np.sort(part)
            n, lone = len(grams), int(np.searchsorted(grams, 1 << 56))
            if n and lone < n - needed(n, num, den) + 1:
                out.append({"class": of["b"][16 * i : 16 * i + 16].hex(), "n": n, "lone": lone, "bins": bins_of(grams[lone:]), "grams": grams[lone:]})
        return pa.Table.from_pylist(out, schema=pa.schema([("class", pa.string()), ("n", pa.int64()), ("lone", pa.int64()), ("bins", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64()))]))

    packs = docs.mapInArrow(pack, PACK)
    counted = packs.groupBy("bucket").applyInArrow(count, PACK)
    return counted.groupBy("block").applyInArrow(gather, "class string, n long, lone long, bins array<int>, grams array<long>")


def overlap_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """No fewer than the grams that two ordered sets share: the suffix filter's bound."""
    if not len(x) or not len(y):
        return 0
    if depth == 0:
        return min(len(x), len(y))
    mid = len(y) // 2
    i = int(np.searchsorted(x, y[mid]))
    hit = int(i < len(x) and x[i] == y[mid])
    return overlap_bound(x[:i], y[:mid], depth - 1) + hit + overlap_bound(x[i + hit :], y[mid + 1 :], depth - 1)


def verified(x: np.ndarray, y: np.ndarray, at_x: int, at_y: int, least: int) -> bool:
    """Whether the ordered sets share `least` grams. at_x, at_y: where they share one."""
    if overlap_bound(x[:at_x], y[:at_y], 1) + 1 + overlap_bound(x[at_x + 1 :], y[at_y + 1 :]) < least:
        return False
    both = np.searchsorted(x, y)
    both[both == len(x)] = 0
    return int((x[both] == y).sum()) >= least


def bounded(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ...) whose bins admit a link, with `least`, the grams to share."""
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    least = F.ceil((F.col("n_a") + F.col("n_b")) * num / (num + den))
    most = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return pairs.join(a, "a").join(b, "b").withColumn("least", least).where(most >= F.col("least")).select(*pairs.columns, "least")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, linked for each pair (a, b, at_a, at_b: places in the whole ordered sets)."""
    of = sets.select("node", "lone", "grams")
    a, b = (of.withColumnsRenamed({"node": x, **{c: f"{c}_{x}" for c in ("lone", "grams")}}) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, gb = batch.column("grams_a"), batch.column("grams_b")
            fa, fb = ga.flatten().to_numpy(), gb.flatten().to_numpy()
            oa, ob = ga.offsets.to_numpy() - ga.offsets[0].as_py(), gb.offsets.to_numpy() - gb.offsets[0].as_py()
            at_a, at_b, least = (batch.column(c).to_numpy() for c in ("at_a", "at_b", "least"))
            linked = [verified(fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]], at_a[i], at_b[i], least[i]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    met = bounded(pairs, sets, num, den).join(a, "a").join(b, "b").select("a", "b", (F.col("at_a") - F.col("lone_a")).alias("at_a"), (F.col("at_b") - F.col("lone_b")).alias("at_b"), "least", "grams_a", "grams_b")
    return met.mapInArrow(run, "a long, b long, linked boolean")


def filters(num: int, den: int) -> Column:
    """Length and positional filter over members (n, pos) and (n2, pos2) of the list of
    their first common gram. At a later gram it may refuse a link, which the list of the
    first one lets through."""
    lengths = (F.least("n", "n2") * den) >= (F.greatest("n", "n2") * num)
    least = F.ceil((F.col("n") + F.col("n2")) * num / (num + den))
    return lengths & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= least)


def classes_linked(sets: DataFrame, num: int, den: int, rounds: tuple[int, ...] = (2, 8, 16, 32, 64)) -> DataFrame:
    """node, component (the least node linked with it) of all nodes in `sets` (node, n,
    lone, grams). rounds: expected pivots of a posting list in each round before all pairs
    that are left meet."""
    prefix = F.slice("grams", F.lit(1), (F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("lone")).cast("int"))
    entries = sets.select("node", "n", "lone", F.posexplode(prefix).alias("i", "gram")).select("gram", "node", "n", (F.col("lone") + F.col("i")).alias("pos"))
    entries = stored(entries, "prefixes")
    labels = sets.select("node", F.col("node").alias("component"))
    refused = None

    def met(pairs: DataFrame) -> DataFrame:
        """Each new pair once, at the first gram at which it was found."""
        first = F.col("node") < F.col("node2")
        ordered = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), "gram", F.when(first, F.col("pos")).otherwise(F.col("pos2")).alias("at_a"), F.when(first, F.col("pos2")).otherwise(F.col("pos")).alias("at_b"))
        # The first place of a set is that of the least gram.
        once = ordered.groupBy("a", "b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
        return once if refused is None else once.join(refused, ["a", "b"], "left_anti")

    for turn, pivots in enumerate([*rounds, 0]):
        now = stored(entries.join(labels, "node"), "posted")
        dropped(entries)
        # Lists of one component are done, and stay so. The open ones are written, so that
        # they are joined by their size, and a long list is split where it is joined.
        sizes = now.groupBy("gram", "component").agg(F.count("*").alias("members"))
        top = sizes.groupBy("gram").agg(F.max(F.struct("members", "component")).alias("top"), F.sum("members").alias("members"))
        lists = stored(top.where("top.members < members").select("gram", F.col("top.component").alias("largest"), "members"), "lists")
        if lists.isEmpty():
            break
        open_ = stored(now.join(lists, "gram"), "open")
        dropped(now)
        others = open_.select("gram", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("component2"), F.col("largest").alias("largest2"), F.col("members").alias("members2"))
        if pivots:
            # Others in each round, by a seeded hash; all members of short lists.
            chance = F.pmod(F.xxhash64("node2", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
            pairs = open_.join(others.where(chance * F.col("members2") < pivots), "gram").where("component <> component2")
        else:
            # Of two members apart, one at least is outside the list's largest component.
            pairs = open_.join(others.where("component2 <> largest2"), "gram").where("component <> component2 and (component = largest or component < component2)")
        # A list all of whose members were pivots is done.
        entries = open_.where(F.col("members") > pivots).select("gram", "node", "n", "pos")
        found = stored(verify(met(pairs.where(filters(num, den))), sets, num, den), "verified")
        # Linked pairs are in one component from now on and do not meet again.
        no = found.where("not linked").select("a", "b")
        refused = no if refused is None else refused.unionByName(no)
        one, two = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        links = found.where("linked").join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        up = components(links).select(F.col("node").alias("component"), F.col("component").alias("root"))
        before, labels = labels, stored(labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        if turn:
            dropped(before)
    return labels


def small_side(ids: DataFrame) -> DataFrame:
    """The ids, marked to be broadcast if they are BROADCAST_IDS at most."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, size: int = 5, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links of Jaccard
    similarity of at least num/den, the row's own included), class (of equal sets) and
    component, which names the group even where it has no id; null for empty rows."""
    if not 0 < num <= den:
        raise ValueError("the threshold must lie in (0, 1]")
    spark = docs.sparkSession
    small_batches(spark)
    docs = steady(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "texts")
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 24, max(1, -(-amount // (6 * bucket_grams))))

    every = stored(shared_counts(docs, buckets, size), "classes")
    left = every.where((F.col("n") > 0) & (F.col("shared") * den >= F.col("n") * num))
    known = every.groupBy("id").agg(F.count("*").alias("rows"))
    chosen = left.groupBy("class").agg(F.min("id").alias("id")).join(known, "id", "left").select("class", "id", F.coalesce("rows", F.lit(2)).alias("rows"))
    chosen = stored(chosen, "chosen")

    def texts(ids: DataFrame) -> DataFrame:
        return docs.join(small_side(ids), "id", "left_semi")

    # Ids that stand for one row need no look at their class; of the others (repeated or
    # null ids) every text is kept once.
    single = texts(chosen.where("rows = 1").select("id"))
    many = chosen.where("rows > 1")
    if not many.isEmpty():
        again = texts(many.where("id is not null").select("id")).unionByName(docs.where("id is null")).select(F.lit(None).cast("long").alias("id"), "text")
        single = single.unionByName(again.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("id"), "text"))
    # Written first: what a join or an aggregation gives has no order that a task that runs
    # again would repeat, and blocks are named by place.
    sets = ordered_sets(stored(single.select("text", "id"), "single"), buckets, size, num, den).dropDuplicates(["class"])
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    linked = classes_linked(sets, num, den).join(sets.select("node", "class"), "node").select("class", F.col("component").cast("string").alias("component"))

    firsts = every.where("n > 0").groupBy("class").agg(F.min("id").alias("first"))
    # Written, as are the sums by component, so that a component of many classes is split
    # where they are joined.
    firsts = stored(firsts.join(linked, "class", "left").withColumn("component", F.coalesce("component", "class")), "firsts")
    least = stored(firsts.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = firsts.join(least, "component").select("class", "component", "component_id")
    # The largest classes are hot keys of this join; the adaptive skew join splits them.
    out = every.join(named, "class", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "class", F.when(F.col("n") > 0, F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, size: int = 5) -> DataFrame:
    """docs without all but one row of every component: the one of the smallest id (of a
    null id, if none has one; among equals, of the least class). Empty rows all stay."""
    found = stored(near_duplicates(docs, id_col, text_col, num, den, size), "found")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "class"))
    kept = stored(found.where("n_shingles > 0").groupBy("component").agg(first.alias("f")).select("component", F.col("f.id").alias("kept_id"), F.col("f.class").alias("kept_class")), "kept")
    judged = found.join(kept, "component", "left").withColumn("stays", (F.col("n_shingles") == 0) | (F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("class") == F.col("kept_class"))))
    by_id = stored(judged.groupBy("id").agg(F.count("*").alias("rows"), F.max("stays").alias("stays")), "by_id")

    # Ids of one row go or stay by id alone; the rows of other ids are told apart by text.
    gone, mark, amount = (fresh(x, docs.columns) for x in ("_gone", "_class", "_n"))
    this = F.col(id_col).cast("long")
    out = by_id.where("id is not null and rows = 1 and not stays").select(F.col("id").alias(gone))
    unclear = by_id.where("id is not null and rows > 1").select(F.col("id").alias(gone))
    out = out.unionByName(unclear)
    clear = docs.where(docs[id_col].isNotNull()).join(small_side(out), this == F.col(gone), "left_anti")
    if by_id.where("id is null or rows > 1").isEmpty():
        return clear
    rest = docs.where(docs[id_col].isNull()).unionByName(docs.join(unclear, this == F.col(gone), "left_semi"))
    first_id, first_class = fresh("_kept_id", docs.columns), fresh("_kept_class", docs.columns)
    kept = kept.select(F.col("kept_id").alias(first_id), F.col("kept_class").alias(first_class))
    named = with_class(rest, text_col, size, mark, amount).join(kept, this.eqNullSafe(F.col(first_id)) & (F.col(mark) == F.col(first_class)), "left")
    firsts = named.where((F.col(amount) > 0) & F.col(first_class).isNotNull()).dropDuplicates([first_class])
    return clear.unionByName(named.where(F.col(amount) == 0).unionByName(firsts).select(*docs.columns))


def with_class(docs: DataFrame, text_col: str, size: int, mark: str, amount: str) -> DataFrame:
    """docs with mark and amount, the digest and the size of each text's set."""
    small_batches(docs.sparkSession)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, rows=256, chars=1 << 20):
            sets = S.shingle_sets(b.column(text_col), size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([S.digest(s).hex() for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64())], names=[*columns, mark, amount])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(mark, T.StringType()), T.StructField(amount, T.LongType())]))
