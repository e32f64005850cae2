"""The words that a worker of the packing remembers."""

import numpy as np

from railflow.llm import packing, vocabulary


def _spelt(table, words):
    return table.spell(table.lookup(words)).tolist()


def test_words_that_come_again_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    table, fresh = packing.WordIds(vocabulary.word_bpe()), packing.WordIds(vocabulary.word_bpe())
    often = [b"the", b"station", b"\xc3\xbcber"]
    for i in range(40):
        once = [f"w{i}x{j}".encode() for j in range(10)]
        words = [*often, *once]  # different words, as ``token_ids`` gives them
        ids, _ = fresh.encode(words)
        assert _spelt(table, words) == ids.tolist()
        assert len(table.index) == len(table.count) == len(table.again) == len(table.end) - 1 <= 120
        assert np.array_equal(np.diff(table.end), 4 * table.count) and table.end[-1] == 4 * len(table.ids)
    encoded = []
    monkeypatch.setattr(table, "encode", lambda words: encoded.extend(words) or fresh.encode(words))
    monkeypatch.setattr(packing, "CACHE_WORDS", len(table.index) - 1)  # the next look trims
    assert _spelt(table, often) == fresh.encode(often)[0].tolist()
    assert not encoded


def test_a_full_cache_of_words_in_use_keeps_half(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    table = packing.WordIds(vocabulary.word_bpe())
    words = [f"k{j}".encode() for j in range(30)]
    table.lookup(words)
    table.again[:] = True
    table._trim()
    assert list(table.index) == words[-10:]
    assert _spelt(table, words) == table.encode(words)[0].tolist()
