"""Hashes and paths of a Merkle tree, without Spark, so that workers load nothing else for them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

#: Consecutive nodes that a parent hashes.
FANOUT = 8


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spread(key: tuple[int, int]) -> int:
    """The task of a vertex."""
    return zlib.crc32(b"%d:%d" % key)


def own_hash(n: int, kids: list[str]) -> str:
    """The hash of a vertex; the only node of a level is taken as it is."""
    return kids[0] if n == 1 else digest("".join(kids))


def entry(slot: int, siblings: list[str]) -> bytes:
    """One level of a path: the place among the run, the number of siblings, their digests."""
    return bytes([slot, len(siblings)]) + b"".join(map(bytes.fromhex, siblings))


def steps(path: bytes) -> Iterator[tuple[str, str]]:
    """For each level of a path, from the leaf up: the digests left and right of the own one, as hex text."""
    at = 0
    while at < len(path):
        slot, number = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + 32 * number].hex()
        yield text[: 64 * slot], text[64 * slot :]
        at += 2 + 32 * number


def fold(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings of its path give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf
