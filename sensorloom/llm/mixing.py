"""Mix sources to target weights: min-cost flow over membership patterns, then seeded picks.

Documents are aggregated by the set of sources they belong to. A flow routes the tokens of
each pattern to the quotas of its sources; using a pattern's tokens a second or third time
costs more each time, so repetition goes where it is needed and no further. Only the pattern
table (a few rows per source) reaches the driver; documents are picked in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import durable

MAX_REPEATS = 3
MAX_PATTERNS = 20_000
BUCKET_SHIFT = 48  # 65,536 buckets by the top bits of the hash
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, total: float, repeats: int = MAX_REPEATS) -> dict:
    """Share ``total`` by weight; what exceeds ``repeats`` times a source's size is reshared by weight."""
    out = {s: 0.0 for s in sizes}
    open_, left = set(sizes), float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > repeats * sizes[s]}
        if not full:
            out |= {s: left * weights[s] / weight for s in open_}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
        left -= sum(repeats * sizes[s] for s in full)
        open_ -= full
    return out


def min_cost_flow(capacity: dict, wanted: dict, repeats: int = MAX_REPEATS) -> dict:
    """Tokens from each pattern (tuple of sources) to each of its sources.

    ``capacity``: tokens of a pattern; ``wanted``: whole tokens of a source. The n-th use of a
    pattern's tokens costs 2n - 1, so costs are convex. Only leaving the start costs anything, so a
    shortest path costs what its pattern's next use does and cheapest paths come use by use: each
    use is opened in turn and its level filled by blocking flows, which may reroute what earlier uses
    sent but take none of it back. That gives the cheapest of the largest flows, in exact integers.
    """
    patterns, sources = list(capacity), list(wanted)
    node = {s: len(patterns) + i + 1 for i, s in enumerate(sources)}
    start, end = 0, len(patterns) + len(sources) + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room = [], []

    def arc(a: int, b: int, most: int) -> int:
        for x, y, m in ((a, b, most), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y), room.append(m)
        return len(to) - 2

    uses, middle = [], {}
    for i, p in enumerate(patterns):
        uses.append(arc(start, i + 1, 0))
        for s in p:
            if s in wanted:
                middle[p, s] = arc(i + 1, node[s], repeats * capacity[p])
    for s in sources:
        arc(node[s], end, wanted[s])
    for _ in range(repeats):
        for p, e in zip(patterns, uses):
            room[e] += capacity[p]
        _fill(graph, to, room, start, end)
    return {key: room[e ^ 1] for key, e in middle.items() if room[e ^ 1]}


def _fill(graph: list[list[int]], to: list[int], room: list[int], start: int, end: int) -> None:
    """Largest flow in what ``room`` leaves, by blocking flows along the arcs of breadth-first levels."""
    while True:
        level = [-1] * len(graph)
        level[start], front = 0, [start]
        while front and level[end] < 0:
            reached = []
            for x in front:
                for e in graph[x]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[x] + 1
                        reached.append(to[e])
            front = reached
        if level[end] < 0:
            return
        tried, path, x = [0] * len(graph), [], start
        while True:
            if x == end:
                amount = min(room[e] for e in path)
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                full = next(i for i, e in enumerate(path) if not room[e])
                x = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[x] < len(graph[x]):
                e = graph[x][tried[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    break
                tried[x] += 1
            else:
                if not path:
                    break
                level[x] = -1
                x = to[path.pop() ^ 1]
                continue
            path.append(e)
            x = to[e]


def mix(docs: DataFrame, weights=None, share: float = 1.0, repeats: int = MAX_REPEATS, seed: int = 0) -> tuple[DataFrame, dict, dict]:
    """Pick documents so that each source comes near its quota.

    ``docs``: ``doc_id, size`` and ``sources`` (array of names, null names allowed; an empty or
    null array takes no part), other columns are kept. Quotas share ``share`` of all sizes by
    ``weights`` (a function from the sorted source list, null last, to their weights).
    Returns the documents with ``copies`` and ``taken``, the quotas and the flow.

    A pattern's whole passes go to all of its documents; of the pass left over, documents are
    taken in the order of a seeded hash until the flow is met as nearly as whole documents can.
    Repeated rows count as documents of their own, size 0 or null takes nothing.
    """
    pattern = F.to_json(F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.struct(s.isNull().alias("n"), s.alias("s"))))))
    rows = docs.withColumns({"_pattern": pattern, "_size": F.coalesce("size", F.lit(0)).cast("long"), "_order": F.xxhash64(F.col("doc_id"), F.lit(seed))})
    rows = rows.withColumn("_bucket", F.shiftright("_order", BUCKET_SHIFT).cast("int"))
    sums = rows.where("sources is not null").groupBy("_pattern").agg(
        F.sum("_size").alias("tokens"), F.first("sources").alias("sources")
    )
    found = sums.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; name fewer sources")
    key = {r["_pattern"]: tuple(sorted(set(r["sources"]), key=_null_last)) for r in found}
    capacity = {key[r["_pattern"]]: r["tokens"] for r in sorted(found, key=lambda r: r["_pattern"])}
    sizes: dict = {}
    for p, tokens in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + tokens
    ordered = sorted(sizes, key=_null_last)
    weight = dict(zip(ordered, weights(ordered) if weights else [1] * len(ordered)))
    targets = quotas(sizes, weight, share * sum(capacity.values()), repeats)
    flow = min_cost_flow(capacity, {s: round(t) for s, t in targets.items()}, repeats)
    used: dict = {}
    for (p, _), tokens in flow.items():
        used[p] = used.get(p, 0) + tokens
    plan = []
    for text, p in key.items():
        whole, rest = divmod(used.get(p, 0), capacity[p]) if capacity[p] else (0, 0)
        plan.append((text, int(whole), int(rest)))
    spark = docs.sparkSession
    passes = spark.createDataFrame(plan, "_pattern string, _whole long, _rest long")  # at most MAX_PATTERNS rows
    return _picked(rows, passes).drop("_pattern", "_size", "_order", "_bucket"), targets, flow


def _null_last(s) -> tuple:
    return (s is None, s or "")


def _picked(rows: DataFrame, passes: DataFrame) -> DataFrame:
    """``copies`` and ``taken`` of each row, by comparing it with its pattern's last picked row.

    The order is cut in buckets of the hash's top bits and summed by bucket, so that only the
    one bucket of a pattern where the flow runs out is sorted.
    """
    narrow = rows.where("_pattern is not null").select("_pattern", "_bucket", "_order", "doc_id", "_size")
    by_bucket = narrow.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("_tokens"))
    running = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_bucket.withColumn("_before", F.sum("_tokens").over(running) - F.col("_tokens"))
    cut = durable(
        before.join(F.broadcast(passes), "_pattern")
        .where("_before < _rest and _before + _tokens >= _rest")
        .select("_pattern", F.col("_bucket").alias("_cut"), (F.col("_rest") - F.col("_before")).alias("_left"))
    )  # one row per pattern
    place = F.struct("_order", "doc_id", "_size")
    order = Window.partitionBy("_pattern").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("_size").over(order) - F.col("_size") / 2
    places = (
        narrow.join(F.broadcast(cut), "_pattern")
        .where("_bucket = _cut")
        .withColumn("_inside", middle <= F.col("_left"))
        .groupBy("_pattern", "_cut", "_order", "doc_id", "_size")
        .agg(F.count_if("_inside").alias("_picked"), F.count("*").alias("_equal"))
    )
    # The last place picked, and how many of the rows equal there are: repeated rows count on their own.
    end = F.struct("_order", "doc_id", "_size", "_picked", "_equal")
    last = durable(places.groupBy("_pattern", "_cut").agg(F.max(F.when(F.col("_picked") > 0, end)).alias("_last")))
    joined = rows.join(F.broadcast(passes), "_pattern", "left").join(F.broadcast(last), "_pattern", "left")
    reached = F.struct("_last._order", "_last.doc_id", "_last._size")
    if last.where("_last._picked < _last._equal").isEmpty():
        inside = place <= reached
    else:
        at_end = F.coalesce((F.col("_bucket") == F.col("_cut")) & (place == reached), F.lit(False))
        alike = Window.partitionBy("_pattern").orderBy("_order")
        numbered = joined.where(at_end).withColumn("_number", F.row_number().over(alike))
        joined = joined.where(~at_end).withColumn("_number", F.lit(0)).unionByName(numbered)
        inside = (place < reached) | ((place == reached) & (F.col("_number") <= F.col("_last._picked")))
    extra = (F.col("_bucket") < F.col("_cut")) | ((F.col("_bucket") == F.col("_cut")) & inside)
    copies = F.coalesce(F.col("_whole"), F.lit(0)) + F.coalesce(extra, F.lit(False)).cast("long")
    dropped = [c for c in ("_whole", "_rest", "_cut", "_last", "_number") if c in joined.columns]
    return joined.withColumns({"copies": copies, "taken": copies * F.col("_size")}).drop(*dropped)


def mixed_documents(docs: DataFrame, weights=None, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix by ``source`` takes them, with all their columns."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.array("source").alias("sources"), word_count(F.col("text")).alias("size"))
    picked, _, _ = mix(rows, weights, seed=seed)
    repeated = picked.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("_row.*")


def cycle_weights(ordered: list) -> list[int]:
    """1, 2, 3, repeating in the order of the sources."""
    return [i % 3 + 1 for i in range(len(ordered))]
