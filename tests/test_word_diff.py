"""Diffs of words are handed on in parts of a bounded size."""

from __future__ import annotations

import pyarrow as pa

from sedgework.operators import quality as Q


def test_a_batch_is_handed_on_in_parts(monkeypatch):
    before, after = ["a b", None, "x" * 50, "", "a b c"], ["a c", "new", "y", "", "a b c"]
    whole = list(Q.word_diff.func(iter([(pa.array(before), pa.array(after))])))
    monkeypatch.setattr(Q, "DIFF_CHARS", 10)
    parts = list(Q.word_diff.func(iter([(pa.array(before), pa.array(after))])))
    assert len(whole) == 1 and [len(p) for p in parts] == [2, 1, 2]
    assert [r for p in parts for r in p.to_pylist()] == whole[0].to_pylist()
    assert [d["text"] for d in whole[0].to_pylist()[0]] == ["a ", "b", "c"]
