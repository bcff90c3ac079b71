import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import documents, texts
from tokenizers import Tokenizer

from sensorloom.llm import token_files as tf
from sensorloom.llm.queries import tokenizer_path


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=6))
@settings(max_examples=60, deadline=None)
def test_coding_round_trip(docs):
    ranks, counts = np.array([x for d in docs for x in d], np.uint32), np.array([len(d) for d in docs], np.int64)
    control, control_at, data, data_at = tf.encode_ranks(ranks, counts)
    assert len(control) == sum(-(-len(d) // 4) for d in docs) == control_at[-1] and data_at[-1] == len(data)
    assert (tf.decode_ranks(control, data, counts) == ranks).all()
    blob = tf.pack_chunk([None, *range(1, len(docs))][: len(docs)], counts.tolist(), control.tobytes(), data.tobytes())
    ((names, found, back),) = tf.unpack_chunks(blob)
    assert names == [None, *range(1, len(docs))][: len(docs)] and (found == counts).all() and (back == ranks).all()


def test_damage_is_noticed():
    control, _, data, _ = tf.encode_ranks(np.arange(500, dtype=np.uint32), np.array([500]))
    blob = tf.pack_chunk([1], [500], control.tobytes(), data.tobytes())
    for bad in (blob[:-1], blob[:20], blob[:60] + bytes([blob[60] ^ 1]) + blob[61:], b"x" + blob[1:]):
        with pytest.raises((ValueError, struct.error)):
            list(tf.unpack_chunks(bad))


def direct(strings):
    """By a tokenizer of its own, as the library loads it."""
    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(strings, add_special_tokens=False)]


def thue_morse(n=1024):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


ODD = ["", " ", "  a  b\n\n c\t", "it's we'll I'M don't 'tis", "café naïve — “quoted” word", "a b c 　d", "x,y. (z)! 3.14 a1b2", "<|endoftext|> a", "x<|endoftext|>y. <|endoftext|", *thue_morse(), "日本語 テスト", "\x1c\x85 a\x0bb", "é,ü. ñ'o"]


def test_added_tokens_are_themselves():
    raw = np.frombuffer(b"<|endoftext|>", np.uint8)
    assert tf.Encoder(tokenizer_path()).encode(raw, np.array([0, len(raw)]))[0].tolist() == direct(["<|endoftext|>"])[0] == [50256]


def test_equal_hashes_do_not_mix_pieces(monkeypatch):
    class One:
        def prefixes(self, data):
            return data

        def between(self, prefixes, start, end):
            return np.zeros(len(start), np.uint64)

    monkeypatch.setattr(tf, "rolling_hash", lambda seed: One())
    coder = tf.Encoder(tokenizer_path())
    strings = ["ab cd ef ab", "ef gh cd", "xyz ab ef"]
    for _ in range(2):
        raw = [s.encode() for s in strings]
        ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == direct(strings)


@pytest.mark.parametrize("strings", [ODD, ODD[::-1] * 3])
def test_cached_pieces_give_the_ids_of_whole_texts(strings):
    raw = [s.encode() for s in strings]
    bounds = np.cumsum([0, *map(len, raw)])
    ids, at = tf.encoder(tokenizer_path()).encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == direct(strings)


@given(st.lists(st.text(alphabet=" \n\t'sabé,.!1—  ", max_size=30), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_cached_pieces_on_random_texts(strings):
    test_cached_pieces_give_the_ids_of_whole_texts(strings)


@pytest.mark.parametrize("rows", [None, []])
def test_files_round_trip(spark, rows):
    docs = documents(spark, rows)
    found = sorted(tf.token_files(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    given_ = texts() if rows is None else rows
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == [(r.doc_id is not None, r.doc_id or 0) for r in found]
    want, place = [], 0
    ids = {(d, t): np.array([*x, 0], "<u4") for (d, t), x in zip(given_, direct([t or "" for _, t in given_]))}
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in found) == sorted(str((d, len(ids[d, t]), zlib.crc32(ids[d, t].tobytes()))) for d, t in given_)
    for r in found:
        want.append(place)
        place += r.n_tokens
    assert [r.start for r in found] == want
