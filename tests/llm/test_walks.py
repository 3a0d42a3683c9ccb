"""Both directions of a text walk together."""

from skirmish.llm import edit_fingerprints as ef


def test_one_walk_for_both_directions(monkeypatch):
    texts = ["", "a", "abc" * 200, "other words " * 40]
    want = [(a[0], a[1].tolist(), b[1].tolist()) for a, b in zip(ef.walk(texts), ef.walk([t[::-1] for t in texts]), strict=True)]
    calls, walk = [], ef.walk
    monkeypatch.setattr(ef, "walk", lambda t: calls.append(len(t)) or walk(t))
    assert [(level, a.tolist(), b.tolist()) for level, a, b in ef.embed(texts)] == want and calls == [8]
    assert ef.embed([]) == []
