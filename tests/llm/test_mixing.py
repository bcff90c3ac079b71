import itertools
import random
import time

from llm_data import documents, shown
from pyspark.sql import functions as F

from sensorloom.llm import mixing


def test_quotas_reshare_what_exceeds_the_cap():
    found = mixing.quotas({"a": 10, "b": 100, "c": 1000}, {"a": 3, "b": 2, "c": 1}, 1110)
    assert found == {"a": 30.0, "b": 300.0, "c": 780.0}
    assert mixing.quotas({}, {}, 0) == {}
    assert mixing.quotas({"a": 0}, {"a": 1}, 0) == {"a": 0.0}


def cost(capacity, flow):
    total = 0
    for p, c in capacity.items():
        used = sum(x for (q, _), x in flow.items() if q == p)
        total += sum(2 * (i // c) + 1 for i in range(used))
    return total


def test_flow_is_the_cheapest_of_the_largest():
    capacity = {("a",): 2, ("a", "b"): 2, ("b",): 1}
    wanted = {"a": 5, "b": 4}
    flow = mixing.min_cost_flow(capacity, wanted)
    arcs = [(p, s) for p in capacity for s in p]
    best = None
    for amounts in itertools.product(range(7), repeat=len(arcs)):
        trial = dict(zip(arcs, amounts))
        if any(sum(x for (q, _), x in trial.items() if q == p) > 3 * c for p, c in capacity.items()):
            continue
        if any(sum(x for (_, t), x in trial.items() if t == s) > w for s, w in wanted.items()):
            continue
        key = (-sum(amounts), cost(capacity, trial))
        best = key if best is None else min(best, key)
    assert (-sum(flow.values()), cost(capacity, flow)) == best


def test_flow_of_many_overlapping_patterns():
    """Random flows are as cheap and large as augmenting along single cheapest paths; 20,000 patterns take seconds."""
    rng = random.Random(3)
    for _ in range(60):
        names = "abcd"[: rng.randint(1, 4)]
        patterns = {tuple(sorted(rng.sample(names, rng.randint(1, len(names))))) for _ in range(4)}
        capacity = {p: rng.randint(0, 4) for p in sorted(patterns)}
        wanted = {s: rng.randint(0, 9) for s in names}
        flow = mixing.min_cost_flow(capacity, wanted)
        assert all(sum(x for (_, t), x in flow.items() if t == s) <= w for s, w in wanted.items())
        used = {p: sum(x for (q, _), x in flow.items() if q == p) for p in capacity}
        assert all(used[p] <= 3 * c for p, c in capacity.items())
        assert (sum(used.values()), cost({p: c for p, c in capacity.items() if c}, flow)) == one_by_one(capacity, wanted)
    names = [f"s{i}" for i in range(300)]
    patterns = set()
    while len(patterns) < mixing.MAX_PATTERNS:
        patterns.add(tuple(sorted(rng.sample(names, rng.randint(1, 5)))))
    capacity = {p: rng.randint(1, 10**9) for p in sorted(patterns)}
    share = sum(capacity.values()) // 200
    wanted = {s: share * rng.randint(0, 3) for s in names}
    begun = time.monotonic()
    flow = mixing.min_cost_flow(capacity, wanted)
    assert time.monotonic() - begun < 60
    assert sum(flow.values()) <= sum(wanted.values())


def one_by_one(capacity, wanted):
    """Tokens and cost of the cheapest largest flow, one token at a time along a cheapest alternating path."""
    sent = {(p, s): 0 for p in capacity for s in p if s in wanted}
    used, got, total = dict.fromkeys(capacity, 0), dict.fromkeys(wanted, 0), 0
    while True:
        for p in sorted((p for p in capacity if used[p] < 3 * capacity[p]), key=lambda p: used[p] // capacity[p]):
            via, front = {("p", p): None}, [("p", p)]
            for kind, x in front:
                steps = [("s", s) for s in x if s in wanted] if kind == "p" else [("p", q) for q in capacity if sent.get((q, x))]
                for step in steps:
                    if step not in via:
                        via[step] = (kind, x)
                        front.append(step)
            ends = [n for n in front if n[0] == "s" and got[n[1]] < wanted[n[1]]]
            if ends:
                break
        else:
            return sum(used.values()), total
        total += 2 * (used[p] // capacity[p]) + 1
        used[p] += 1
        got[ends[0][1]] += 1
        here = ends[0]
        while via[here]:
            before = via[here]
            if here[0] == "s":
                sent[before[1], here[1]] += 1
            else:
                sent[here[1], before[1]] -= 1
            here = before


def sized(spark, rows=None):
    docs = documents(spark, rows)
    return docs.withColumns({"size": mixing.word_count(F.col("text")), "sources": F.array("source")})


def test_mix_comes_near_the_targets(spark):
    picked, targets, _ = mixing.mix(sized(spark), mixing.cycle_weights)
    rows = picked.select("doc_id", "source", "size", "taken", "copies").collect()
    assert len(rows) == sized(spark).count()
    largest = max(r["size"] for r in rows)
    for s, target in targets.items():
        assert abs(sum(r.taken for r in rows if r.source == s) - target) <= largest
    assert all(r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in rows)
    assert list(targets)[-1] is None or None in targets
    again = mixing.mix(sized(spark).repartition(3), mixing.cycle_weights)[0]
    assert sorted(map(str, rows)) == sorted(map(str, again.select("doc_id", "source", "size", "taken", "copies").collect()))


def test_overlapping_sources_and_no_rows(spark):
    rows = [(i, "w " * (i % 5)) for i in range(200)]
    docs = sized(spark, rows).withColumn("sources", F.expr("case when doc_id % 3 = 0 then array('a', 'b') when doc_id % 3 = 1 then array('a') when doc_id = 2 then null else array() end"))
    picked, targets, flow = mixing.mix(docs, lambda names: [1] * len(names))
    taken = {r[0]: r[1] for r in picked.groupBy(F.expr("doc_id % 3")).agg(F.sum("taken")).collect()}
    assert taken[2] == 0 and abs(sum(targets.values()) - sum(taken.values())) <= 8
    assert mixing.mix(sized(spark, []), mixing.cycle_weights)[0].count() == 0


def test_mixed_documents_keep_their_columns(spark):
    docs = documents(spark).withColumn("copies", F.lit("c"))
    out = mixing.mixed_documents(docs, mixing.cycle_weights)
    assert out.columns == docs.columns
    assert shown(out) <= shown(docs)


def test_repeated_rows_are_taken_on_their_own(spark):
    rows = [(1, 10, ["a"], "x")] * 300 + [(i, 10, ["b"], "x") for i in range(2, 102)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>, copies_of string").repartition(4)
    picked, targets, _ = mixing.mix(docs, mixing.cycle_weights, share=0.75)
    taken = {r.doc_id == 1: r.n for r in picked.groupBy(F.col("doc_id") == 1).agg(F.sum("taken").alias("n"), F.first("doc_id").alias("doc_id")).collect()}
    assert picked.count() == 400 and abs(taken[True] - targets["a"]) <= 10 and abs(taken[False] - targets["b"]) <= 10
