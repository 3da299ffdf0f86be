"""Mixing overlapping sources to target weights by minimum-cost flow.

A document may belong to several sources. Documents are summed up by membership pattern; a pattern
offers its words once for nothing, and again at a cost that rises with every repetition. The flow
from patterns to source quotas of least total cost says how many words of each pattern are taken
for each source and in which repetition. Documents are then selected by a seeded order: a pattern's
words are laid in a line in that order, and a flow of ``f`` words takes the first ``f`` of them,
round and round; only the document at the end of the line is taken in part.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm.common import WORD, materialize

#: Weights of the sources in order of their names, again and again.
WEIGHTS = (5, 2, 1)


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


# ---- targets and flow, on the driver -------------------------------------------------------------


def by_name(source: str | None) -> tuple[bool, str]:
    """Sources in order of code points, null last."""
    return source is None, source or ""


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all words by weight, none above ``most`` times its size.

    What lies above is shared anew by weight among the others until none is above. The sources that
    stop are those with the least size for their weight, so one pass in that order finds them.
    """
    order = sorted(sizes, key=by_name)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, rest, out = share * sum(sizes.values()), float(sum(weight.values())), {}
    for s in sorted(order, key=lambda s: (most * sizes[s] / weight[s], *by_name(s))):
        if left * weight[s] / rest > most * sizes[s]:
            out[s] = most * sizes[s]
            left, rest = left - out[s], rest - weight[s]
        else:
            break
    return {s: out[s] if s in out else left * weight[s] / rest for s in order}


@dataclass
class Arc:
    to: int
    capacity: int
    cost: int
    back: int
    flow: int = 0


class Flow:
    """Successive shortest paths with potentials; all first costs are 0 or more."""

    def __init__(self, nodes: int):
        self.arcs: list[list[Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int = 0) -> Arc:
        there, back = Arc(b, capacity, cost, len(self.arcs[b])), Arc(a, 0, -cost, len(self.arcs[a]))
        self.arcs[a].append(there)
        self.arcs[b].append(back)
        return there

    def run(self, source: int, sink: int) -> None:
        n = len(self.arcs)
        potential = [0] * n
        while True:
            far, via = [float("inf")] * n, [None] * n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for k, arc in enumerate(self.arcs[a]):
                    step = d + arc.cost + potential[a] - potential[arc.to]
                    if arc.capacity > arc.flow and step < far[arc.to]:
                        far[arc.to], via[arc.to] = step, (a, k)
                        heapq.heappush(heap, (step, arc.to))
            if via[sink] is None:
                return
            potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
            path, b = [], sink
            while b != source:
                a, k = via[b]
                path.append(self.arcs[a][k])
                b = a
            much = min(x.capacity - x.flow for x in path)
            for x in path:
                x.flow += much
                self.arcs[x.to][x.back].flow -= much


def allocate(patterns: dict[tuple, int], quotas: dict[str | None, int], repeats: int = 2) -> dict[tuple, dict[str | None, int]]:
    """Words of each pattern (a sorted tuple of sources) for each source, of least repetition cost.

    The k-th repetition of a word costs the square of k, so repeating a little of everything comes
    before repeating one part again.
    """
    keys, sources = list(patterns), sorted(quotas, key=by_name)
    at = {s: 1 + len(keys) + k for k, s in enumerate(sources)}
    net = Flow(2 + len(keys) + len(sources))
    sink, into = len(net.arcs) - 1, {}
    for k, key in enumerate(keys):
        for again in range(repeats):
            net.add(0, 1 + k, patterns[key], again * again)
        for s in key:
            into[key, s] = net.add(1 + k, at[s], repeats * patterns[key])
    for s in sources:
        net.add(at[s], sink, quotas[s])
    net.run(0, sink)
    return {key: {s: into[key, s].flow for s in key} for key in keys}


# ---- on Spark ----------------------------------------------------------------------------------


def _mixed(
    docs: DataFrame,
    members: Column,
    id_col: str,
    text_col: str,
    keep: Sequence[str],
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 7,
    max_patterns: int = 20_000,
) -> tuple[DataFrame, dict[str | None, dict]]:
    """doc_id, size, pattern, taken and the columns of ``keep`` as k0, k1, ...; and the sources' figures."""
    named = F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("~")))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), word_count(text_col).alias("size"), F.array_sort(F.array_distinct(named)).alias("pattern"), *kept)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    rows = rows.withColumn("order", order).withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    rows = materialize(rows, "sizes")
    parts = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    parts = materialize(parts, "size-parts")  # 4096 rows a pattern at most
    totals = parts.groupBy("pattern").agg(F.sum("words").alias("words")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = {tuple(r["pattern"]): tuple(None if x == "~" else x[1:] for x in r["pattern"]) for r in totals}
    patterns = {names[tuple(r["pattern"])]: int(r["words"]) for r in totals}
    sizes: dict[str | None, int] = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    wanted = targets(sizes, weights, share, float(repeats)) if sizes else {}
    flows = allocate({p: w for p, w in patterns.items() if p}, {s: int(t + 0.5) for s, t in wanted.items()}, repeats)
    take = {p: sum(f.values()) for p, f in flows.items()}
    figures = {s: {"size": sizes[s], "target": float(wanted[s]), "taken": sum(f.get(s, 0) for f in flows.values())} for s in sizes}

    plan = [(list(k), take.get(p, 0) // max(patterns[p], 1), take.get(p, 0) % max(patterns[p], 1)) for k, p in names.items()]
    plan_df = F.broadcast(docs.sparkSession.createDataFrame(plan, "pattern array<string>, rounds long, rest long"))  # max_patterns rows at most
    upto = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    last = parts.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(plan_df, "pattern")
    # of each pattern the one bucket in which the last round ends
    last = last.filter("before <= rest AND rest < before + words").select("pattern", "rounds", "rest", "before", F.col("bucket").alias("edge"))
    rows = rows.join(F.broadcast(last), "pattern", "left")  # one row a pattern at most
    line = W.partitionBy("pattern").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    here = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    cols = ["doc_id", "size", "pattern", *(f"k{i}" for i in range(len(keep)))]
    taken = lambda more: (F.coalesce(F.col("rounds"), F.lit(0)) * F.col("size") + more).cast("long").alias("taken")
    inside = rows.filter(here).withColumn("upto", F.col("before") + F.sum("size").over(line))  # 1 row in 4096
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))
    whole = F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0))
    return inside.select(*cols, taken(part)).unionAll(rows.filter(~here).select(*cols, taken(whole))), figures


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, dict[str | None, dict]]:
    """Every row's doc_id, size, pattern (its sources) and taken words, and each source's size, target and taken words.

    ``members`` is an array of the names of the sources that a row belongs to; null stands for the
    source without a name; an empty or null array joins none, and nothing is taken of such a row. A
    source's size counts the words of all its members. Rows are ordered by a seeded hash of id and
    size; rows that are equal in both follow one another and each counts for itself. Null text has
    size 0 and gives nothing. An empty table gives no row. More membership patterns than
    ``max_patterns`` raise an error; none is cut.
    """
    rows, figures = _mixed(docs, members, id_col, text_col, (), **options)
    pattern = F.transform("pattern", lambda x: F.when(x != "~", F.substring(x, 2, 2**31 - 1)))
    return rows.select("doc_id", "size", pattern.alias("pattern"), "taken"), figures


def mix_by_source(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Each row belongs to the one source in ``source_col``: doc_id, size, source_size, target, taken."""
    rows, figures = _mixed(docs, F.array(F.col(f"`{source_col}`").cast("string")), id_col, text_col, (), **options)
    told = [(["~" if s is None else "s" + s], f["size"], f["target"]) for s, f in figures.items()]
    told_df = docs.sparkSession.createDataFrame(told, "pattern array<string>, source_size long, target double")
    return rows.join(F.broadcast(told_df), "pattern").select("doc_id", "size", "source_size", "target", "taken")  # one row a source


def mixed_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every taking of a document.

    The document at the end of a source's line is cut to the words that are taken of it; all others
    are whole. Documents without words (null, empty or blank texts) give no row; a null source is one of
    its own; rows that repeat are taken each for itself; an empty table gives no row; columns may have any name.
    """
    names = docs.columns
    rows, _ = _mixed(docs, F.array(F.col(f"`{source_col}`").cast("string")), id_col, text_col, names, **options)
    text, size = F.col(f"k{names.index(text_col)}"), F.col("size")
    rows = rows.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / size).cast("int"))))
    rows = rows.withColumn("words", F.least(size, F.col("taken") - (F.col("copy") - 1) * size).cast("int"))
    words = F.regexp_extract_all(text.cast("string"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(F.col("words") < size, F.array_join(F.slice(words, F.lit(1), F.col("words")), "")).otherwise(text)
    return rows.select(*((cut if c == text_col else F.col(f"k{i}")).alias(c) for i, c in enumerate(names)))
