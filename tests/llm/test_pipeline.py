import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from llm_data import documents
from test_ngram_join import expected
from test_quality import direct_scores
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sensorloom.llm import arrow_text, decontaminate, mixing, ngram_join, registry
from sensorloom.llm.queries import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


def test_stages_narrow_the_documents(spark):
    docs = registry.read(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == docs.count()


def test_empty_documents(spark):
    docs = registry.read(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_awkward_documents(spark):
    docs = documents(spark).drop("hashes", "pos", "block")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def quality_brute(rows, sf_dir):
    labels: dict = {}
    for d, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet' WHERE quality IS NOT NULL").fetchall():
        labels.setdefault(d, []).append(q)
    scores = direct_scores({r.doc_id: r.text or "" for r in rows}, {d: sum(q) / len(q) for d, q in labels.items()})
    assert min(abs(s - 0.7) for s in scores.values()) > 1e-5
    return Counter(r.doc_id for r in rows if scores[r.doc_id] >= 0.7)


def near_duplicates_brute(rows, sf_dir):
    return Counter(d for d, _, root in expected([(r.doc_id, r.text) for r in rows], 5, 80) if d == root)


def decontamination_brute(rows, sf_dir):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in rows])
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    leaks = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({decontaminate.SQL})").fetchall()}
    assert leaks
    return Counter(r.doc_id for r in rows if r.doc_id not in leaks)


def check_mix(before, after):
    """Whole documents, at most three times each, every source near its share."""
    size = {r.doc_id: len(re.findall(mixing.WORD, r.text or "")) for r in before}
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and {tuple(r) for r in after} <= {tuple(r) for r in before}
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += size[r.doc_id]
    for r in after:
        taken[r.source] += size[r.doc_id]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.quotas(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()))
    for s in names:
        assert abs(taken[s] - targets[s]) <= max(size[r.doc_id] for r in before if r.source == s)


def check_tokens(before, after):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    start, want = 0, []
    for r in sorted(before, key=lambda r: r.doc_id):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, after)) == want


def test_every_stage_against_brute_force(spark):
    """Each stage on what the stages before it kept."""
    sf_dir = "/root/testdata/sf0.01"
    docs = registry.read(spark, sf_dir, "documents")
    rows = docs.collect()
    narrow = [quality_brute, near_duplicates_brute, decontamination_brute]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, narrow):
        kept = stage(spark, docs, sf_dir).collect()
        assert Counter(r.doc_id for r in kept) == brute(rows, sf_dir), name
        assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}, name
        rows, docs = kept, spark.createDataFrame(kept, docs.schema)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).collect()
    check_mix(rows, mixed)
    check_tokens(mixed, corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(mixed, docs.schema), sf_dir).collect())


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_each(n):
    assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1 and "pipeline" in entry.queries()


def test_no_stage_of_near_duplicates_keeps_two_python_workers_a_core(spark, monkeypatch):
    """Two Python steps in a row in one stage hold two workers a core, and idle ones stay beside the JVM's heap."""
    docs = documents(spark, [(i, " ".join(f"w{i % 3}x{j}" for j in range(9))) for i in range(30)])
    seen, before = [], type(docs).mapInArrow

    def look(self, *args, **more):
        plan = self._jdf.queryExecution().executedPlan().toString()
        seen.append("MapInArrow" in plan and "Exchange" not in plan)
        return before(self, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", look)
    assert ngram_join.keep_one_each(docs).count() == 3
    assert len(seen) >= 4 and not any(seen)


def test_hash_tables_of_a_worker_take_four_bytes_a_power():
    hashing = arrow_text.PrimeHash(1)
    hashing.prefixes(np.zeros(10, np.uint8))
    assert sum(t.nbytes for pair in hashing.tables for t in pair) <= 4 * 4 * (arrow_text.SLICE_BYTES + 1)
