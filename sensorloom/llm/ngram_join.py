"""Jaccard self-join on word n-grams by adaptive multi-match prefixes.

Shingles are ordered alike everywhere (the commonest last, others by hash). Two sets of
Jaccard t share l tokens within their first n - ceil(t n) + l, for any l. Each document picks
its own l from the estimated number of candidates: a longer prefix costs a few more look-ups
and asks for as many more shared tokens (the smaller l of the two) before anything is
verified. Copies of one set are joined beforehand and verified once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import shingle_sets, slices, trimmed
from sensorloom.llm.graph import components
from sensorloom.llm.grouped import blocks, map_groups, spanning_links
from sensorloom.session import durable, sized_side

LEAST_MATCHES = 2
MOST_MATCHES = 8
HOT_TOKENS = 10_000
HOT_FROM = 64
SMALL_BUCKET = 8
BLOCK_MEMBERS = 4_096
BLOCK_TOKENS = 1_000_000
EDGES = "doc_id long, root long"
EDGE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("root", pa.int64())])


def needed(n, percent: int):
    """Tokens that a set of ``n`` shares at least with any set it is linked to."""
    return -(-n * percent // 100)


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def node_of(sig: bytes) -> int:
    """What a set is called in links: a doc_id may come with several texts."""
    return int.from_bytes(sig[:8], "little", signed=True)


def first_tokens(tokens: np.ndarray, percent: int, matches: int, hot: np.ndarray) -> np.ndarray:
    """The prefix of a set: its first tokens in the common order, as many as ``matches`` common ones need."""
    n = len(tokens)
    length = min(n, n - needed(n, percent) + matches)
    if len(hot) and n:
        place = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        common = hot[place] == tokens
        tokens = np.concatenate([tokens[~common][:length], tokens[common]])
    return tokens[:length]


def prefixes(docs: DataFrame, k: int, percent: int, matches: int, hot: np.ndarray) -> DataFrame:
    """``doc_id, n, sig, node, prefix``: set size, digest of the whole set, its first half as a number, and its first tokens in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, digests, lists = [], [], []
                for tokens in shingle_sets(part.column(1), k):
                    sizes.append(len(tokens))
                    digests.append(digest(tokens))
                    lists.append(first_tokens(tokens, percent, matches, hot))
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(map(node_of, digests), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
                    ],
                    ["doc_id", "n", "sig", "node", "prefix"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(trimmed(run), "doc_id long, n int, sig binary, node long, prefix array<long>")


def hot_tokens(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """The most frequent prefix tokens, at most ``HOT_TOKENS``.

    Tokens that occur once in a batch of documents are not counted: common ones occur more often
    there. Which tokens are taken changes only the work, never the result. Prefixes are made and counted in one
    step: two steps in a row would keep two Python workers a core.
    """
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [first_tokens(tokens, percent, 1, none) for part in slices(batch) for tokens in shingle_sets(part.column(0), k)]
            tokens, counts = np.unique(np.concatenate([none, *lists]), return_counts=True)
            often = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often], pa.int64()), pa.array(counts[often], pa.int64())], ["token", "n"])

    local = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "token long, n long")
    counts = local.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).collect()], np.int64))


def representatives(sets: DataFrame) -> DataFrame:
    """``sig, node, n, rep``: each set that is not empty, and the smallest doc_id that holds it."""
    named = sets.where("n > 0 and doc_id is not null")
    return named.groupBy("sig", "node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"))


def one_each(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``doc_id`` (the node), ``n, prefix`` of every different set, without a shuffle of prefixes unless doc_ids repeat."""
    named = sets.where("n > 0 and doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        copies = named.select("doc_id", "sig").join(reps.select("sig", "rep"), "sig").where("doc_id <> rep").select("doc_id")
        one = named.join(sized_side(copies), "doc_id", "left_anti")
    else:
        own = reps.select(F.col("rep").alias("doc_id"), "sig")
        one = named.join(own, ["doc_id", "sig"], "left_semi").dropDuplicates(["sig"])
    return one.select(F.col("node").alias("doc_id"), "n", "prefix")


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``, more columns are ignored).

    Documents link when ``100 * common >= percent * union`` of their distinct ``k``-word
    shingles (A-Z lower-cased; fewer words: the whole sequence is one). component_id is the
    smallest doc_id reachable. Null and empty texts have no shingles and link with nothing; a
    null doc_id links with nothing and has no component. Repeated rows are copies; different
    texts of one doc_id are documents of their own, and each may link.
    """
    hot = hot_tokens(docs, k, percent)
    sets = durable(prefixes(docs, k, percent, MOST_MATCHES, hot))
    reps = durable(representatives(sets))
    links = candidate_links(one_each(sets, reps), percent)
    clusters = components(links, "doc_id", "root")
    edges = verified_links(docs, clusters, reps.select("node", "n", "rep"), k, percent)
    found = components(edges, "doc_id", "root").select(F.col("id").alias("node"), F.col("component").alias("_class"))
    joined = durable(reps.join(found, "node", "left").select("sig", "rep", F.coalesce("_class", "node").alias("_class")))
    smallest = joined.groupBy("_class").agg(F.min("rep").alias("component_id"))
    labelled = durable(joined.join(smallest, "_class").select("sig", "component_id"))
    out = sets.select("doc_id", "n", "sig").join(labelled, "sig", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that represent their component (its smallest doc_id), with all their columns.

    Texts without words and rows without doc_id stay. Of rows that repeat a doc_id one stays.
    """
    found = durable(ngram_components(docs, k, percent))
    later = found.groupBy("doc_id").agg(F.min(F.col("component_id") != F.col("doc_id")).alias("later")).where("later").select("doc_id")
    kept = docs.join(sized_side(later), "doc_id", "left_anti").select(*docs.columns)
    again = durable(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    several = kept.join(sized_side(again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(sized_side(again), "doc_id", "left_anti").select(*docs.columns).unionByName(several)


def candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """``doc_id, root``: documents that share enough prefix tokens, as links that connect them.

    Pairs of a rare token are counted as rows. Documents of a token that more than
    ``SMALL_BUCKET`` hold meet in blocks, which give out a spanning forest. A bucket is left
    out where all its members have one such token in common and so meet there.
    """
    # The least number of matches whose prefix reaches as far as the token.
    level = F.greatest(F.col("pos") - F.expr(f"n - (n * {percent} + 99) div 100") + 1, F.lit(1)).cast("int")
    tokens = sets.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "doc_id", level.alias("level"))
    shared = durable(tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1"))
    found = tokens.join(shared, "token").groupBy("doc_id").agg(F.collect_list(F.struct("level", "token", "freq")).alias("found"))
    chosen = durable(adaptive(found.join(sets.select("doc_id", "n"), "doc_id"), percent))
    narrow = chosen.withColumn("top_freq", F.array_max(F.transform("tokens", lambda t: t["freq"]))).select(
        "doc_id", "n", "matches", "top", "top_freq", F.explode("tokens").alias("t")
    )
    rows = narrow.select("doc_id", "n", "matches", "top", "top_freq", F.col("t.token").alias("token"), F.col("t.freq").alias("freq"))
    kept = durable(
        rows.groupBy("token")
        .agg(F.count("*").alias("members"), F.min("top").alias("low"), F.max("top").alias("high"), F.max("top_freq").alias("top_freq"))
        .where(f"members > 1 and not (low = high and low <> token and top_freq > {SMALL_BUCKET})")
        .select("token", "members")
    )
    small = rows.where(F.col("freq") <= SMALL_BUCKET).select("token", "doc_id", "n", "matches").join(kept.select("token"), "token")
    other = small.select("token", *(F.col(c).alias(f"{c}_2") for c in ("doc_id", "n", "matches")))
    least, most = F.least("n", "n_2"), F.greatest("n", "n_2")
    pairs = small.join(other, "token").where((F.col("doc_id_2") < F.col("doc_id")) & (100 * least >= percent * most))
    counted = pairs.groupBy("doc_id", F.col("doc_id_2").alias("root"), F.least("matches", "matches_2").alias("asked")).count().where("count >= asked")
    met = rows.where(F.col("freq") > SMALL_BUCKET).select("doc_id", "token").join(kept, "token")
    lists = chosen.select("doc_id", "n", "matches", F.transform("tokens", lambda t: t["token"]).alias("tokens"))
    dealt = blocks(met.join(lists, "doc_id"), "token", F.col("doc_id"), F.ceil(F.col("members") / BLOCK_MEMBERS))

    def link(table: pa.Table) -> pa.RecordBatch | None:
        ids, lists, extra = _members(table, "tokens", ["n", "matches"])
        n, matches = extra

        def linked(i, others, common):
            sizes = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
            return sizes & (common >= np.minimum(matches[i], matches[others]))

        return _edges(*spanning_links(ids, *lists, linked))

    forest = map_groups(dealt.select("block", "doc_id", "n", "matches", "tokens"), "block", link, EDGES)
    return counted.select("doc_id", "root").unionByName(forest)


def adaptive(mine: DataFrame, percent: int) -> DataFrame:
    """Each document's number of matches, the shared tokens of its prefix and the most frequent of them.

    For each l the tokens in the prefix bring ``sum(freq - 1)`` look-ups, and at most that over
    l partners reach l matches, each costing a verification of n tokens; the cheapest l wins.
    Documents with fewer shared tokens than any partner asks for are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            offsets = found.offsets.to_numpy()
            flat = found.values
            level, token, freq = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = []
            for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                a, b = offsets[i], offsets[i + 1]
                order = np.argsort(level[a:b], kind="stable")
                p, t, f = level[a:b][order], token[a:b][order], freq[a:b][order]
                need = needed(n, percent)
                partner = needed(needed(n, percent), percent)
                if len(t) < min(LEAST_MATCHES, partner):
                    continue
                lookups = np.cumsum(f - 1)
                best, least = None, 0.0
                for matches in range(LEAST_MATCHES, MOST_MATCHES + 1):
                    end = np.searchsorted(p, matches, "right")
                    cost = lookups[end - 1] * (1.0 + n / 32 / matches**2) if end else 0.0
                    if best is None or cost < least:
                        best, least = matches, cost
                matches = min(best, need)
                end = np.searchsorted(p, matches, "right")
                if not end:
                    continue
                top = t[:end][np.lexsort((t[:end], -f[:end]))[0]]
                out.append((doc, n, matches, t[:end], f[:end], int(top)))
            doc, n, matches, tokens, freqs, top = list(zip(*out)) or [[]] * 6
            ends = pa.array(np.cumsum([0, *map(len, tokens)]).astype(np.int32))
            flat = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in (tokens, freqs))
            pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["token", "freq"])
            columns = [pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(matches, pa.int32()), pa.ListArray.from_arrays(ends, pairs), pa.array(top, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "matches", "tokens", "top"])

    return mine.select("doc_id", "n", "found").mapInArrow(trimmed(run), "doc_id long, n int, matches int, tokens array<struct<token:long,freq:long>>, top long")


def verified_links(docs: DataFrame, clusters: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """A spanning forest of the true links (between nodes) inside each cluster of candidates, from whole texts.

    Texts meet a small table of clusters where they are read; beyond its checked size they are
    shuffled. Of the texts of one doc_id each stands for its own node.
    """
    clusters = durable(clusters.join(reps, F.col("id") == F.col("node")).select("node", "component", "n", F.col("rep").alias("id")))
    side = sized_side(clusters.select("id", "node", "component"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(side, "id")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                nodes = part.column(0).to_pylist()
                sets = shingle_sets(part.column(2), k)
                own = pa.array([node_of(digest(tokens)) == node for tokens, node in zip(sets, nodes)], pa.bool_())
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                arrays = [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "component", "tokens"]).filter(own)

    sets = texts.select("node", "component", "text").mapInArrow(trimmed(shingle), "doc_id long, component long, tokens array<long>")
    large = clusters.groupBy("component").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_TOKENS)
    joined = sets.join(durable(large), "component", "left")
    dealt = blocks(joined, "component", F.col("doc_id"), F.ceil(F.coalesce("total", F.lit(1)) / BLOCK_TOKENS))

    def link(table: pa.Table) -> pa.RecordBatch | None:
        ids, lists, _ = _members(table, "tokens", [])
        n = np.diff(lists[1])

        def linked(i, others, common):
            return 100 * common >= percent * (n[i] + n[others] - common)

        return _edges(*spanning_links(ids, *lists, linked))

    return durable(map_groups(dealt.select("block", "doc_id", "tokens"), "block", link, EDGES))


def _members(table: pa.Table, column: str, more: list[str]) -> tuple:
    """Ids in ascending order, their token lists (flat values and offsets) and further columns alike."""
    ids = table["doc_id"].to_numpy()
    lists = table[column].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    order, first = np.unique(ids, return_index=True)
    lists = lists.take(pa.array(first))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return order, (flat, offsets - offsets[0]), [table[c].to_numpy()[first].astype(np.int64) for c in more]


def _edges(left: list, right: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=EDGE_SCHEMA)
