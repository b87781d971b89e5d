"""Rounds of merges look up only the pairs that changed."""

import public_tokenizers

from tessella.llm import bpe


def test_rounds_look_up_changed_pairs_only(monkeypatch):
    merges = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json")).merges
    words = [(w * 20)[:200].encode() for w in ("international", "counterrevolutionary", "a", "qzx")]
    seen = []
    ranks = bpe.MergeTable.ranks
    monkeypatch.setattr(bpe.MergeTable, "ranks", lambda self, left, right: (seen.append(len(left)), ranks(self, left, right))[1])
    assert [len(x) % 4 for x in merges.encode_short(words)] == [0] * 4
    assert sum(seen) <= 2 * sum(map(len, words))
