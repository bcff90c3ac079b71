import re
from collections import Counter

import pytest
from llm_data import documents, texts

from sensorloom.llm import ngram_join


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def expected(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 50)])
def test_components_match_brute_force(spark, k, percent):
    found = ngram_join.ngram_components(documents(spark), k, percent)
    assert Counter(tuple(r) for r in found.collect()) == expected(texts(), k, percent)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 500)
    found = ngram_join.ngram_components(documents(spark), 3, 60)
    assert Counter(tuple(r) for r in found.collect()) == expected(texts(), 3, 60)


def test_hot_tokens_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_FROM", 3)
    found = ngram_join.ngram_components(documents(spark), 3, 80)
    assert Counter(tuple(r) for r in found.collect()) == expected(texts(), 3, 80)


def test_no_rows(spark):
    assert ngram_join.ngram_components(documents(spark, []), 3, 90).count() == 0
    assert ngram_join.keep_one_each(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    groups = {d: c for d, _, c in expected(texts(), 5, 80)}
    named = Counter(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert named == Counter({d: 1 for d, c in groups.items() if d is not None and d == c})
    assert kept.where("doc_id is null").count() == 2


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    one, other = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    edited = other.replace("b3 ", "edit ")
    rows = [(1, one), (1, other), (2, edited), (3, one + " more"), (3, "something else entirely here"), (4, "something else entirely here"), (1, one)]
    found = ngram_join.ngram_components(documents(spark, rows), 3, 90)
    sizes = {one: 78, other: 78, edited: 78, one + " more": 79, rows[4][1]: 2}
    wanted = Counter([(1, 78, 1), (1, 78, 1), (1, 78, 1), (2, sizes[edited], 1), (3, 79, 1), (3, 2, 3), (4, 2, 3)])
    assert Counter(tuple(r) for r in found.collect()) == wanted


def test_words_that_collide_modulo_powers_of_two_are_different(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    pair = word, word.translate(str.maketrans("ab", "ba"))
    found = ngram_join.ngram_components(documents(spark, [(1, pair[0]), (2, pair[1]), (3, pair[0])]), 3, 90)
    assert Counter(tuple(r) for r in found.collect()) == Counter([(1, 1, 1), (2, 1, 2), (3, 1, 1)])
