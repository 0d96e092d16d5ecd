"""Shared pieces: tables of a folder, vocabulary files, files that all executors see."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from tidewrack.session import discard, durable, read_table, scratch_root

__all__ = ["discard", "durable", "read_table", "scratch_root", "vocabulary", "shared_folder", "open_store", "slices", "WORD_BYTES"]


def _word_byte(byte: int) -> int:
    """ASCII letters in lower case, digits and the bytes of other characters as they are, a blank for the rest."""
    if byte >= 128 or chr(byte).isalnum():
        return byte + 32 if 65 <= byte <= 90 else byte
    return 32


#: Translates UTF-8 bytes so that words are what stands between blanks.
WORD_BYTES = bytes(map(_word_byte, range(256)))


def vocabulary(name: str, path: str | None = None) -> str:
    """Place of a public vocabulary file; ``path`` overrides it."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` for files that are not Spark tables."""
    return f"{scratch_root(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def open_store(uri: str):
    """(filesystem, path) of a file or folder that Spark names by URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose summed sizes stay near ``most``; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
