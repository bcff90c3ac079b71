"""Benchmark decontamination with DataFrame functions only.

Windows of an item's size get a 64-bit SimHash of their words. Multi-index hashing finds the
items near a window: both fingerprints are cut into four blocks of 16 bits, and of fingerprints
at most ``RADIUS`` bits apart at least one block differs in at most ``RADIUS // 4`` bits, so every
such pair meets in a table that holds each item's blocks with all those flips. Candidates
are then verified by the exact weighted Jaccard similarity of their five-word shingles.

Only windows that can pass the last step are fingerprinted: those aligned with an item on one of
its rarest shingles, which together weigh so much that no window without them reaches the
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import durable, sized_side

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
BLOCK_BITS = 16
BROADCAST_KEYS = 100_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def shingles(hashes: Column, k: int = SHINGLE) -> Column:
    """Hash of the ``k`` words from each position on (none with fewer words)."""
    places = F.sequence(F.lit(1), F.size(hashes) - (k - 1))
    return F.when(F.size(hashes) >= k, F.transform(places, lambda i: F.xxhash64(*(F.get(hashes, i + (j - 1)) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, n, hashes``: items with at least ``SHINGLE`` words; shorter, null and nameless ones can't be told from chance."""
    found = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).dropDuplicates(["item_id"])
    return found.where(F.size("words") >= SHINGLE).select(
        "item_id", F.size("words").alias("n"), "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    )


def item_shingles(items: DataFrame, count: int, similarity: float) -> DataFrame:
    """``item_id, n, shingle, weight, pos, chosen``: distinct shingles of each item, first place, whether windows are sought by it.

    A shingle in ``d`` of ``count`` items weighs ln(1 + count / d). Taken from the rarest on, the
    chosen ones outweigh 1 - ``similarity`` of the item.
    """
    texts = F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), lambda i: F.array_join(F.slice("words", i, SHINGLE), " "))
    every = items.select("item_id", "n", F.posexplode(F.arrays_zip(shingles(F.col("hashes")).alias("h"), texts.alias("t"))).alias("pos", "s"))
    first = every.groupBy("item_id", "n", F.col("s.h").alias("shingle"), F.col("s.t").alias("words")).agg(F.min("pos").alias("pos"))
    rarity = first.groupBy("shingle").agg(F.count("*").alias("items"))
    weighted = first.join(rarity, "shingle").withColumn("weight", F.log(1 + F.lit(count) / F.col("items")))
    item = Window.partitionBy("item_id")
    before = F.sum("weight").over(item.orderBy("items", "words").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    chosen = before <= (1 - similarity) * F.sum("weight").over(item) + 1e-9
    return weighted.select("item_id", "n", "shingle", "weight", "pos", chosen.alias("chosen"))


#: A window: the document, its text (a doc_id may come with several), first word and size.
PLACE = ["doc_id", "text_id", "start", "n"]


def windows(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``PLACE`` and ``hashes``: item-sized windows (clipped at the text's ends) aligned on a seed.

    ``text_id`` is a hash of the text's words, so equal rows are one text and different texts of one doc_id stay apart. With few seeds (their number is checked) positions meet them in a broadcast join of the
    scan's own stage and carry their text along; otherwise positions are shuffled alone and texts joined
    to the windows found.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    hashed = texts.where(F.size("words") >= SHINGLE).select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("all"))
    hashed = hashed.select("doc_id", F.xxhash64("all").alias("text_id"), "all")
    start = F.col("pos") - F.col("item_pos")
    first, last = F.greatest(start, F.lit(0)), F.least(start + F.col("n"), F.size("all"))
    cut = F.slice("all", (first + 1).cast("int"), (last - first).cast("int"))
    if seeds.count() <= BROADCAST_KEYS:
        places = hashed.select("doc_id", "text_id", "all", F.posexplode(shingles(F.col("all"))).alias("pos", "shingle"))
        found = places.join(F.broadcast(seeds), "shingle").select("doc_id", "text_id", start.alias("start"), "n", cut.alias("hashes"))
        return found.dropDuplicates(PLACE)
    places = hashed.select("doc_id", "text_id", F.posexplode(shingles(F.col("all"))).alias("pos", "shingle"))
    found = places.join(seeds, "shingle").select("doc_id", "text_id", "pos", "item_pos", "n").withColumn("start", start).dropDuplicates(PLACE)
    texts = hashed.dropDuplicates(["doc_id", "text_id"])
    return found.join(texts, ["doc_id", "text_id"]).select(*PLACE, cut.alias("hashes"))


def simhash(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``fingerprint``: bit b is set where more than half of the words' hashes have it set."""
    exploded = rows.select(*key, F.explode("hashes").alias("h"))
    ones = exploded.groupBy(*key).agg(F.count("*").alias("total"), *(F.sum(F.shiftright("h", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)))
    bits = [F.when(2 * F.col(f"b{b}") > F.col("total"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return ones.select(*key, total.alias("fingerprint"))


def block_value(block: int) -> Column:
    return F.shiftrightunsigned("fingerprint", block * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")


def blocks() -> Column:
    return F.explode(F.array(*(F.struct(F.lit(b).alias("block"), block_value(b).alias("value")) for b in range(BLOCKS))))


def hamming_candidates(prints: DataFrame, item_prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every window (all columns of ``prints`` but the fingerprint) and ``item_id`` of equal size at most ``radius`` bits apart."""
    place = [c for c in prints.columns if c != "fingerprint"]
    flips = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda x: F.bit_count(x) <= radius // BLOCKS)
    masks = durable(item_prints.sparkSession.range(1).select(flips.alias("masks"))).first()["masks"]  # 697 numbers at radius 15
    near = item_prints.select("item_id", "n", F.col("fingerprint").alias("item_print"), blocks().alias("b")).select(
        "item_id", "n", "item_print", F.col("b.block").alias("block"), F.col("b.value").alias("own"), F.explode(F.lit(masks)).alias("flip")
    )
    table = near.select("item_id", "n", "item_print", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
    asked = prints.select(*place, "fingerprint", blocks().alias("b")).select(*place, "fingerprint", "b.block", "b.value")
    met = asked.join(table, ["n", "block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
    return met.select(*place, "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: the best window of each document and item it leaks.

    ``start`` is the window's first word (negative where the item begins before the text),
    ``n_words`` the item's size. Ties go to the first window. Null texts, ids and items, items
    with fewer than five words and empty tables give no rows; repeated rows count once. Other
    columns are ignored. Of a doc_id with several texts all are searched.
    """
    items = durable(benchmark_items(benchmark))
    count = items.count()
    found = durable(item_shingles(items, count, similarity))
    seeds = durable(found.where("chosen").select("shingle", "n", F.col("pos").alias("item_pos")).distinct())
    cut = durable(windows(docs, seeds))
    prints = simhash(cut, PLACE)
    item_prints = simhash(items, ["item_id", "n"])
    candidates = durable(hamming_candidates(prints, item_prints, radius))
    parts = cut.join(candidates.select(*PLACE).distinct(), PLACE, "left_semi")
    inside = parts.select(*PLACE, F.explode(F.array_distinct(shingles(F.col("hashes")))).alias("shingle"))
    weights = found.groupBy("shingle").agg(F.first("weight").alias("weight"))
    weighed = durable(inside.join(weights, "shingle", "left").withColumn("weight", F.coalesce("weight", F.log(1 + F.lit(float(count))))))
    window_weight = weighed.groupBy(*PLACE).agg(F.sum("weight").alias("window_weight"))
    item_weight = found.groupBy("item_id").agg(F.sum("weight").alias("item_weight"))
    common = (
        candidates.join(weighed, PLACE)
        .join(found.select("item_id", "shingle"), ["item_id", "shingle"])
        .groupBy(*PLACE, "item_id")
        .agg(F.sum("weight").alias("common"))
    )
    verified = common.join(window_weight, PLACE).join(item_weight, "item_id")
    exact = F.round(F.col("common") / (F.col("window_weight") + F.col("item_weight") - F.col("common")), 6)
    best = verified.withColumn("similarity", exact).where(F.col("similarity") >= similarity)
    top = best.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", -F.col("start"))).alias("w"))
    return top.select("doc_id", "item_id", F.col("w.start").cast("long").alias("start"), F.col("w.n").cast("long").alias("n_words"), F.col("w.similarity").alias("similarity"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with all their columns."""
    leaks = contaminated(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    return docs.join(sized_side(leaks), "doc_id", "left_anti").select(*docs.columns)


#: The same rows without fingerprints: windows on the chosen shingles, compared with every item of their size.
SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, w, len(w) AS n FROM item_words WHERE len(w) >= 5),
every AS (SELECT item_id, n, unnest(range(0, n - 4)) AS pos, w FROM items),
firsts AS (SELECT item_id, n, array_to_string(w[pos + 1 : pos + 5], ' ') AS sh, min(pos) AS pos FROM every GROUP BY ALL),
weighted AS (SELECT *, count(*) OVER (PARTITION BY sh) AS items FROM firsts),
found AS (SELECT *, ln(1 + (SELECT count(*) FROM items) / items) AS weight FROM weighted),
running AS (SELECT *, sum(weight) OVER (PARTITION BY item_id ORDER BY items, sh ROWS UNBOUNDED PRECEDING) - weight AS before,
  sum(weight) OVER (PARTITION BY item_id) AS total FROM found),
seeds AS (SELECT DISTINCT sh, n, pos AS item_pos FROM running WHERE before <= 0.2 * total + 1e-9),
doc_words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, w FROM doc_words WHERE len(w) >= 5),
doc_shingles AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS sh FROM places),
windows AS (SELECT DISTINCT doc_id, pos - item_pos AS start, n FROM doc_shingles JOIN seeds USING (sh)),
inside AS (SELECT DISTINCT v.doc_id, v.start, v.n, s.sh FROM windows v JOIN doc_shingles s
  ON s.doc_id = v.doc_id AND s.pos >= v.start AND s.pos + 5 <= v.start + v.n),
weights AS (SELECT sh, min(weight) AS weight FROM found GROUP BY sh),
weighed AS (SELECT i.*, coalesce(w.weight, ln(1 + (SELECT count(*) FROM items))) AS weight FROM inside i LEFT JOIN weights w USING (sh)),
window_weight AS (SELECT doc_id, start, n, sum(weight) AS ww FROM weighed GROUP BY ALL),
item_weight AS (SELECT item_id, sum(weight) AS iw FROM found GROUP BY ALL),
common AS (SELECT g.doc_id, g.start, g.n, f.item_id, sum(g.weight) AS c FROM weighed g JOIN found f ON f.sh = g.sh AND f.n = g.n GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, n, round(c / (ww + iw - c), 6) AS similarity FROM common JOIN window_weight USING (doc_id, start, n) JOIN item_weight USING (item_id))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_words, similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
