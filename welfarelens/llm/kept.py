"""What a Python worker keeps from one task to the next, so that no word is worked out twice.

A worker serves tasks of many operators one after the other. Only the operator at work keeps anything: when another one
begins, the memory of the one before is given up. This changes no result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
import xxhash

#: Different words whose hashes a worker keeps.
KEPT_WORDS = 200_000

_clear: dict[str, Callable[[], None]] = {}
_at_work: list[str] = []


def at_work(name: str, clear: Callable[[], None]) -> None:
    """``name`` uses its memory now; ``clear`` empties it when another one does."""
    _clear[name] = clear
    if _at_work != [name]:
        for other in [n for n in _clear if n != name]:
            _clear.pop(other)()
        _at_work[:] = [name]
        gc.collect()
        pa.default_memory_pool().release_unused()  # what batches of the operator before have left


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h


_HASHES = WordHashes()


def word_hash() -> Callable[[bytes], int]:
    """A function from words to 64-bit hashes that remembers them."""
    at_work("words", _HASHES.clear)
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    return _HASHES.__getitem__
