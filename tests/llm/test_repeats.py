import random

import numpy as np
import pytest
from llm_data import documents, texts

from sensorloom.llm import repeats


def expected(rows, length):
    seen, out = {}, {}
    for doc, text in sorted({r for r in rows if r[0] is not None}):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p : p + length], (doc, p)) != (doc, p):
                covered[p : p + length] = b"\1" * length
        runs, at = [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and covered[end]:
                end += 1
            if end > at:
                runs.append((at, end))
            at = max(end, at + 1)
        out[doc] = (len(raw), runs, bytes(x for x, c in zip(raw, covered) if not c))
    return out


@pytest.mark.parametrize("length, width, group", [(100, 28, 8_000), (20, 6, 8_000), (20, 6, 2), (12, 3, 1)])
def test_spans_match_brute_force(spark, monkeypatch, length, width, group):
    monkeypatch.setattr(repeats, "GROUP_PHRASES", group)
    rows = texts(seed=length)
    found = repeats.remove_repeats(documents(spark, rows), length, width).collect()
    want = expected(rows, length)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == want[r.doc_id]
        else:
            assert r.spans == []
    assert any(s for _, s, _ in want.values())


def test_ranks_are_those_of_sorted_strings():
    rng = random.Random(1)
    for length in (1, 5, 8, 13, 40):
        data = np.array([rng.choice(b"ab") for _ in range(300)], np.uint8)
        strings = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        order = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert repeats.suffix_ranks(data, length)[: len(strings)].tolist() == [order[s] for s in strings]


def test_every_string_lies_in_one_phrase():
    rng = random.Random(2)
    data = np.array([rng.choice(b"abc") for _ in range(2000)], np.uint8)
    offsets = np.array([0, 5, 700, 700, 2000])
    first, last, at, _, _ = repeats.parse(data, offsets, 30, 8)
    starts = sorted(p for a, b in zip(first, last) for p in range(a, b + 1))
    assert starts == [p for a, b in zip(offsets[:-1], offsets[1:]) for p in range(a, b - 29)]
    assert ((at >= last) & (at - first <= 22)).all()


def test_no_rows(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(4)
    shared, alone = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (688, 685))
    found = repeats.remove_repeats(documents(spark, [(1, shared), (2, shared), (2, alone), (2, alone)])).collect()
    spans = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans]) for r in found)
    assert spans == [(1, 688, []), (2, 685, []), (2, 685, []), (2, 688, [(0, 688)])]


@pytest.mark.parametrize("gathered", [1, 7, 1 << 19])
def test_repeats_found_by_their_task(spark, monkeypatch, gathered):
    monkeypatch.setattr(repeats, "GATHERED", gathered)
    rng = random.Random(gathered)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, line * rng.randint(0, 4) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rng.shuffle(rows)
    want = expected(rows, 20)
    for parts in (1, 5):
        for r in repeats.remove_repeats(documents(spark, rows).repartition(parts), 20, 6).collect():
            assert [tuple(s) for s in r.spans] == want[r.doc_id][1]


def test_a_common_phrase_leaves_a_task_once(spark):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(150))
    docs = documents(spark, [(i, text) for i in range(400)]).selectExpr("doc_id", "text", "0L as text_id").repartition(4)
    parsed = repeats.phrases(docs, 100, 28)
    firsts = parsed.where("trigger is not null")
    assert parsed.count() >= 400
    assert firsts.groupBy("trigger", "phrase").count().where("count > 4").count() == 0
