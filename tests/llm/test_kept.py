"""Only one operator's memory stays with a worker."""

from welfarelens.llm import kept


def test_another_operator_clears():
    first, second = {1: 1}, {2: 2}
    kept.at_work("first", first.clear)
    kept.at_work("first", first.clear)
    assert first
    kept.at_work("second", second.clear)
    assert not first and second
    get = kept.word_hash()
    assert not second and get(b"a") == get(b"a") and len(kept._HASHES) == 1
    kept.at_work("first", first.clear)
    assert not kept._HASHES
