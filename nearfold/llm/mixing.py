"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are added up by membership pattern
(the set of their sources); a pattern can give its words once at no cost, a second time at
a higher price and so on up to `max_repeats` passes, and every source takes words up to
its quota. The flow of least cost decides how many words each pattern gives to each
source. Within a pattern documents are taken in the order of a seeded hash: all of them
for the full passes, then the first ones until the rest is met.

The driver sees one number for each pattern, some hundred bytes of its memory; the flow
takes time in proportion to the patterns where sources do not overlap (120,000 of them in
a second or two).

A document without sources, or of size 0, takes part in nothing and is taken 0 times.
Null is a source like any other, the last one. Rows are taken by a hash of all their
columns, so reruns agree; repeated rows share a hash and are told apart by number only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.common import WORD, stored


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of sizes by weight, none above `most` times its size; what one
    cannot take is shared again by weight among the others."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    free, by = float(sum(sizes)), sum(weights[i] for i in open_)
    # Who is full first: the smaller what a unit of weight brings to the bound.
    open_.sort(key=lambda i: (most * sizes[i] / weights[i], i))
    for at, i in enumerate(open_):
        if free * weights[i] / by <= most * sizes[i]:
            for j in open_[at:]:
                out[j] = free * weights[j] / by
            break
        out[i] = most * sizes[i]
        free, by = free - out[i], by - weights[i]
    return out


#: Parts of the hash range: twelve bits of the hash.
DIGITS = 1 << 12


class Flow:
    """Words from patterns to sources. Only a pattern's passes have a price, so the flow of
    least cost is made price by price: for each, as much more as can be, along paths that
    may take words back from a source and give it others (blocking flows by layers)."""

    def __init__(self, patterns: Iterable[tuple], quotas: dict) -> None:
        self.room = dict(quotas)
        self.given = {p: {x: 0 for x in p if x in quotas} for p in patterns}
        self.supply = dict.fromkeys(self.given, 0)
        self.holders: dict = {x: [] for x in quotas}
        for p, sources in self.given.items():
            for x in sources:
                self.holders[x].append(p)

    def supplied(self, more: dict[tuple, int]) -> None:
        """As much as can be of what the patterns have left and of `more`."""
        for p, words in more.items():
            self.supply[p] += words
            for x in self.given[p]:
                push = min(self.supply[p], self.room[x])
                self.given[p][x] += push
                self.supply[p] -= push
                self.room[x] -= push
        while layers := self.layers():
            self.block(layers)

    def layers(self) -> dict | None:
        """How many steps patterns and sources are away from words that are left; None if
        these come to no source with room."""
        now = [p for p, words in self.supply.items() if words > 0 and self.given[p]]
        steps: dict = {("p", p): 0 for p in now}
        step, found = 0, False
        while now and not found:
            step += 1
            reached = list({x for p in now for x in self.given[p] if ("s", x) not in steps})
            steps |= {("s", x): step for x in reached}
            found = any(self.room[x] > 0 for x in reached)
            step += 1
            now = list({p for x in reached for p in self.holders[x] if self.given[p][x] > 0 and ("p", p) not in steps})
            steps |= {("p", p): step for p in now}
        return steps if found else None

    def block(self, steps: dict) -> None:
        """Paths through the layers until there is none."""
        ahead = {key: iter(self.given[key[1]] if key[0] == "p" else self.holders[key[1]]) for key in steps}
        for start in [key for key, n in steps.items() if n == 0]:
            path = [start]
            while path and self.supply[start[1]] > 0:
                kind, at = path[-1]
                if kind == "s" and self.room[at] > 0:
                    back = [self.given[q[1]][x[1]] for x, q in zip(path[1::2], path[2::2], strict=False)]
                    push = min([self.supply[start[1]], self.room[at], *back])
                    if push:
                        self.supply[start[1]] -= push
                        self.room[at] -= push
                        for p, x in zip(path[::2], path[1::2], strict=True):
                            self.given[p[1]][x[1]] += push
                        for x, q in zip(path[1::2], path[2::2], strict=False):
                            self.given[q[1]][x[1]] -= push
                    empty = next((i for i, b in enumerate(back) if b == push), None)
                    if empty is not None:  # on from before the arc that is used up
                        del path[2 * empty + 2 :]
                    continue
                for there in ahead[path[-1]]:
                    key = ("s" if kind == "p" else "p", there)
                    if steps.get(key) == steps[path[-1]] + 1 and (kind == "p" or self.given[there][at] > 0):
                        path.append(key)
                        break
                else:
                    path.pop()


def route(capacity: dict[tuple, int], quotas: dict, max_repeats: int = 3, prices: Sequence[int] = (0, 1, 3, 6, 10, 15)) -> dict[tuple, dict]:
    """Words that each pattern gives to each source. prices: of the passes, not falling."""
    if max_repeats > len(prices) or list(prices) != sorted(prices):
        raise ValueError("one price for each pass, not falling")
    flow = Flow(capacity, quotas)
    for _ in prices[:max_repeats]:
        flow.supplied(capacity)
    return flow.given


def seeded_hash(seed: int, columns: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in columns])


def mix(docs: DataFrame, sources: Column, size: Column, quotas, key_cols: Sequence[str], keep: Sequence[str], max_repeats: int = 3, seed: int = 17) -> tuple[DataFrame, dict[tuple, dict], dict, dict]:
    """row (a struct of the columns `keep`), size, pattern and taken, the words taken from
    the row, a multiple of its size; the words that each pattern gives to each source; the sources'
    sizes; their quotas.

    sources: array of the row's sources. quotas: a function of {source: size} that gives
    {source: words wanted}. key_cols: columns whose seeded hash orders the rows.
    """
    # Kept columns travel as one, so that none can clash with a working column.
    n, pat, order = "size", "pattern", "order"
    rows = docs.select(F.struct(*keep).alias("row"), size.cast("long").alias(n), F.array_sort(F.array_distinct(sources)).alias(pat), seeded_hash(seed, key_cols).alias(order))
    rows = stored(rows, "mix")
    by_pattern = rows.groupBy(pat).agg(F.sum(n).alias("words")).collect()  # one row a pattern
    capacity = {tuple(r[pat] or ()): int(r["words"] or 0) for r in by_pattern}
    sizes: dict = {}
    for p, words in capacity.items():
        for x in p:
            sizes[x] = sizes.get(x, 0) + words
    wanted = quotas(sizes)
    given = route(capacity, {x: round(w) for x, w in wanted.items()}, max_repeats)

    # Full passes of a pattern, and the words left for its first documents.
    plan = []
    for p, words in capacity.items():
        out = sum(given[p].values())
        passes, rest = divmod(out, words) if words else (0, 0)
        plan.append((list(p), int(passes), int(rest)))
    spark = docs.sparkSession
    kind = rows.schema[pat].dataType.simpleString()
    # Written, so that it is broadcast or shuffled by its size.
    plan_rows = stored(spark.createDataFrame(plan, f"_p {kind}, passes long, rest long"), "plan")
    dealt = rows.join(plan_rows, rows[pat].eqNullSafe(F.col("_p")), "left").drop("_p")

    # The hash range is cut in DIGITS parts twice; only the part in which the rest ends
    # is cut again, and only the rows of that part are ordered one by one.
    first, second = F.shiftrightunsigned(order, 52), F.shiftrightunsigned(order, 40).bitwiseAND(DIGITS - 1)
    dealt = dealt.withColumn("_a", first.cast("int")).withColumn("_b", second.cast("int"))

    def cut(frame: DataFrame, keys: list[str], digit: str) -> DataFrame:
        """The part of each key in which the rest ends, and the words before it."""
        sums = frame.groupBy(*keys, "rest", digit).agg(F.sum(n).alias("w"))
        w = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("before", F.coalesce(F.sum("w").over(w), F.lit(0)))
        return before.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("w") > F.col("rest"))).select(*keys, F.col(digit).alias("_cut"), "before")

    def mark(frame: DataFrame, cuts: DataFrame, keys: list[str], digit: str, name: str) -> DataFrame:
        """Adds name: -1 before the cut, 0 in it, 1 behind it or without a cut."""
        sides = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        joined = frame.alias("f").join(cuts.alias("c"), sides, "left")  # at most one row a pattern
        return joined.select("f.*", F.signum(F.col(f"f.{digit}") - F.coalesce(F.col("c._cut"), F.lit(-1))).cast("int").alias(name), F.col("c.before").alias(f"{name}_before"))

    cuts = stored(cut(dealt.where(f"rest > 0 and `{n}` > 0"), [pat], "_a"), "cut")
    one = mark(dealt, cuts, [pat], "_a", "_s")
    inside = one.where(f"_s = 0 and `{n}` > 0").withColumn("rest", F.col("rest") - F.col("_s_before"))
    cuts2 = stored(cut(inside, [pat], "_b"), "cut")
    two = mark(one.where("_s = 0").withColumn("rest", F.col("rest") - F.col("_s_before")), cuts2, [pat], "_b", "_t")
    last = two.where("_t = 0").withColumn("rest", F.col("rest") - F.col("_t_before"))
    upto = F.sum(n).over(Window.partitionBy(pat).orderBy(order, n).rowsBetween(Window.unboundedPreceding, -1))
    # The document in which the rest ends is taken if at least half of it is wanted.
    last = last.withColumn("_in", F.coalesce(upto, F.lit(0)) + F.col(n) / 2 <= F.col("rest"))
    columns = ["row", n, pat, "passes"]
    out = one.where("_s <> 0").select(*columns, (F.col("_s") < 0).alias("_in"))
    out = out.unionByName(two.where("_t <> 0").select(*columns, (F.col("_t") < 0).alias("_in"))).unionByName(last.select(*columns, "_in"))
    taken = F.col(n) * (F.coalesce(F.col("passes"), F.lit(0)) + F.col("_in").cast("long"))
    return out.select("row", n, pat, taken.alias("taken")), given, sizes, wanted


def mix_by_source(docs: DataFrame, keep: Sequence[str], text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """Mixes documents of one source each. Sources by code point, null last, weigh
    `weights` in turn and share all words; adds size, source_size, target and taken."""


    def quotas(sizes: dict) -> dict:
        named = sorted((x for x in sizes if x is not None), key=str)
        names = [*named, *([None] if None in sizes else [])]
        return dict(zip(names, targets([sizes[x] for x in names], [weights[i % len(weights)] for i in range(len(names))], max_repeats), strict=True))

    keep = [c for c in keep if c.lower() not in ("size", "source_size", "target", "taken", "pattern")]
    id_cols = [c for c in docs.columns if c in ("doc_id", text_col, source_col)]
    # array_distinct and array_sort keep a null source: it is a member like the others.
    mixed, _, totals, wanted = mix(docs, F.array(F.col(source_col).cast("string")), word_count(text_col), quotas, id_cols, keep, max_repeats, seed)
    named = stored(docs.sparkSession.createDataFrame([(x, int(totals[x]), float(w)) for x, w in wanted.items()], "_x string, source_size long, target double"), "targets")
    out = mixed.withColumn("_x0", F.element_at("pattern", 1)).join(named, F.col("_x0").eqNullSafe(F.col("_x")), "left")
    return out.select("row.*", "size", "source_size", "target", "taken")
