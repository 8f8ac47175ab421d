"""Arrow plumbing shared by the text operators: bounded chunks of whole texts."""

from __future__ import annotations

import pyarrow as pa

#: Texts are worked on in chunks of about this many bytes; a longer text is a chunk by itself.
CHUNK_BYTES = 3_000_000


_HELD: dict = {}


def held(key, make):
    """What an operator keeps in a worker between batches. One operator's at a time: a worker
    serves all stages of an application, and what earlier ones kept would add up."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    if _HELD:
        _HELD.clear()
        release()


def release() -> None:
    """Give freed memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def chunks(batch, column: str, limit: int = CHUNK_BYTES):
    """Yield (slice, list of texts) with about ``limit`` bytes of text each; null stays None."""
    start, size = 0, 0
    texts: list = []
    for i, value in enumerate(batch.column(column)):
        text = value.as_py()
        if texts and size + len(text or "") > limit:
            yield batch.slice(start, i - start), texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text or "")
    if texts:
        yield batch.slice(start), texts
    if batch.nbytes > CHUNK_BYTES:
        release()


def arrow_schema(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl])
