"""Line dedup across documents: an exact set-similarity join of the lines' word sets.

A line is removed when an earlier line, kept or not, in the order of (id,
content hash, line number), has a word set of Jaccard similarity ``percent`` /
100 or more.  Lines without words stay.

``dedup_lines`` finds them by DataFrame operations alone, as ``line_sets`` says.
``removed`` is the same join over packed columns in NumPy, which is taken if its
limits are given:

1. Order by rarity: occurrences of words are counted over all documents in
   CELLS cells that words share by hash; a set's words are ordered by the count
   of their cell, then by hash.
2. Prefixes: similar sets share one of their rarest words, the prefix.  A word
   of a common cell is too weak a key, so there a word and the next one of the
   set are one.  Of the pairs of neighbours among a set's common words, a word
   that the other set lacks breaks two, and one that it has more breaks one; so
   similar sets that share no rarer word of their prefixes share one of as many
   first pairs as can break, and one more.  Very long lines keep single words.
3. Each task combines the copies of a line, compares near copies with the first
   line of their key at once, and sends what is left as packed columns, a block
   for each bucket of keys.  A line that is settled is still compared with later
   ones, but needs no earlier one.
4. In a bucket, the lines of a key lie by size, so only sizes that can be similar
   meet; a picture of the set (the parity of its words in 64 to 1,024 cells, which
   differs in no more cells than the sets in words) and positional filters rule
   out pairs.  Each line that isn't settled leaves with its FIRST earliest
   candidates of a key.  Where there are more, the lines of that key are kept;
   should all of the first fail, a second round takes the rest from there.
5. Verify: the lines of the candidates are read again and compared word by word
   hash.

Words are identified by 64-bit hashes.  The keys of a very common word are dealt
over several buckets: each line is found in one of them and asks in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as vt
from ..operators.ranking import global_positions
from ..scratch import fresh, materialize, small_side
from .line_sets import similar_lines
from .words import HAS_WORD

#: Cells of the table of word counts.
CELLS = 1 << 18
#: Words whose cell has more occurrences than this make keys in pairs, in lines of at most 1.25 * LONG words.
COMMON, LONG = 1 << 15, 160
#: Occurrences of a word for each bucket that its keys are dealt over.
DEAL = 1 << 22
#: Words that a task collects before it sends blocks, and entries of a bucket.
UNIT, BUCKET = 1 << 20, 1 << 19
#: Candidates of a line and key in the first round.
FIRST = 64
#: Longs of the picture at most.
MOST_LONGS = 16
_SCALE = 16.0


class Lines:
    """Lines with words, as columns: doc, line, n (distinct words), key of the set, and its words from ``begin`` on, rarest first."""

    def __init__(self, doc: np.ndarray, line: np.ndarray, n: np.ndarray, key: np.ndarray, words: np.ndarray):
        self.doc, self.line, self.n, self.key, self.words = doc, line, n, key, words
        self.begin = np.cumsum(n) - n


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def _words(chunk: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, member = vt.item_bytes(chunk)
    start, end = vt.spans(member, own)
    return start, vt.quick_hashes(low, start, end)


def cut(chunk: np.ndarray, own: np.ndarray, doc: np.ndarray, rare: np.ndarray) -> Lines:
    """The lines of the rows ``doc`` of a chunk of text."""
    start, words = _words(chunk, own)
    begin, row, number = vt.lines(chunk, own)
    size = np.diff(np.r_[np.searchsorted(start, begin), len(start)])
    of = np.repeat(np.arange(len(begin), dtype=np.uint64), size)
    level = rare[cells(words)]
    if len(begin) < 1 << 20:
        packed = of << np.uint64(44) | level.astype(np.uint64) << np.uint64(36) | words >> np.uint64(28)
        order = np.argsort(packed)
        packed, clash = packed[order], words[order]
        clash = ((packed[1:] == packed[:-1]) & (clash[1:] != clash[:-1])).any()
    else:
        clash = True
    if clash:
        order = np.lexsort((words, words >> np.uint64(28), level, of))
    words, of = words[order], of[order]
    new = np.r_[True, (words[1:] != words[:-1]) | (of[1:] != of[:-1])] if len(words) else np.zeros(0, bool)
    words, of = words[new], of[new]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    at = of[first].astype(np.int64)
    key = vt.mix64(np.add.reduceat(vt.mix64(words), first)) if len(first) else np.zeros(0, np.uint64)
    return Lines(doc[row[at]], number[at], np.diff(np.r_[first, len(words)]), key, words)


def pictures(x: Lines, longs: int) -> np.ndarray:
    """Parities of the words of each line in 64 * ``longs`` cells; halves that are combined by exclusive or are the picture of half the size."""
    out = np.zeros((len(x.n), longs), np.uint64)
    if len(x.n):
        bit = np.uint64(1) << (x.words >> np.uint64(18) & np.uint64(63))
        if longs == 1:
            out[:, 0] = np.bitwise_xor.reduceat(bit, x.begin)
        else:
            column = (x.words >> np.uint64(24)).astype(np.int64) & (longs - 1)
            np.bitwise_xor.at(out, (np.repeat(np.arange(len(x.n)), x.n), column), bit)
    return out


def longs_of(n: np.ndarray) -> np.ndarray:
    """Longs of the picture of a set of n words: at least two cells for three words; unlike sets differ in more cells than similar ones may, then."""
    out = np.ones(len(n), np.int64)
    for k in range(MOST_LONGS.bit_length() - 1):
        out[n > 96 << k] = 2 << k
    return out


def take(x: Lines, rows: np.ndarray) -> Lines:
    return Lines(x.doc[rows], x.line[rows], x.n[rows], x.key[rows], x.words[_spread(x.begin[rows], x.n[rows])])


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each of runs of n."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def join(parts: list[Lines]) -> Lines:
    return Lines(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("doc", "line", "n", "key", "words")))


def keys_of(x: Lines, percent: int, rare: np.ndarray, common: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, place of the first word, key, cell of the first word) of each key of the lines."""
    p = x.n - -(-x.n * percent // 100) + 1
    row = np.repeat(np.arange(len(x.n)), p)
    at = _spread(np.zeros(len(p), np.int64), p)
    word = x.words[x.begin[row] + at]
    cell = cells(word)
    paired = rare[cell] >= common
    # Rarer words of the set come first; those beyond the prefix don't matter.
    rarer = np.bincount(row[~paired], minlength=len(p))
    need, there = breaks(x.n, p - 1, percent) - 2 * rarer + 1, x.n - rarer - 1
    lone = (x.n == 1) & (rarer == 0)
    # Where all pairs may break, single words are needed too.
    single = ~paired | (x.n > long)[row] | ((need > there) & ~(lone & (percent > 50)))[row]
    parts = [(row[single], at[single], vt.mix64(word[single]), cell[single])]
    pairs = np.where((x.n * 4 <= long * 5) & (rarer < p), np.clip(np.minimum(need, there), 0, None), 0)
    row = np.repeat(np.arange(len(p)), pairs)
    at = _spread(rarer, pairs)
    word, second = x.words[x.begin[row] + at], x.words[x.begin[row] + at + 1]
    with np.errstate(over="ignore"):
        # Shared words may come before a shared pair, so its place says nothing.
        parts.append((row, at * 0, vt.mix64(vt.mix64(word) * np.uint64(3) + second), cells(word)))
    row = np.flatnonzero(lone)
    word = x.words[x.begin[row]]
    parts.append((row, row * 0, vt.mix64(~word), cells(word)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def breaks(n: np.ndarray, lacks: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of neighbours of a set of n words that a similar set breaks at most, if it lacks at most ``lacks`` of the words."""
    if percent < 50:
        return 2 * n
    # A word that is lacking leaves room for 100 / percent, at most 2, fewer words that the other set has more.
    return 2 * lacks + (n - lacks) * 100 // percent - n


def shared_words(words: np.ndarray, begin: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of common words of the sets a[i] and b[i]."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        of = np.concatenate([np.repeat(np.arange(len(x)), n[x]), np.repeat(np.arange(len(y)), n[y])])
        value = np.concatenate([words[_spread(begin[x], n[x])], words[_spread(begin[y], n[y])]])
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        both = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
        out[i : i + len(x)] = np.bincount(of[1:][both], minlength=len(x))
    return out


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Words in which similar sets of n and m words differ at most; negative if their sizes are too far apart."""
    return np.where(np.minimum(n, m) * 100 >= np.maximum(n, m) * percent, n + m - 2 * overlap(n, m, percent), -1)


def overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return ((n + m) * percent + 99 + percent) // (100 + percent)


class Entries:
    """Columns of entries of keys: token (32 bits of the key), key of the set, doc, line, n, place, asks, leads, pic, and the wide picture from ``wide_at`` on."""

    NAMES = ("token", "key", "doc", "line", "n", "place", "flags", "pic")
    KINDS = (np.uint32, np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint64)

    def __init__(self, columns: dict[str, np.ndarray], wide: np.ndarray):
        self.__dict__.update(columns)
        self.wide, self.longs = wide, longs_of(columns["n"].astype(np.int64))
        room = np.where(self.longs > 1, self.longs, 0)
        self.wide_at = np.cumsum(room) - room

    def pack(self) -> bytes:
        """The columns, each compressed by itself; of wide pictures ``pic`` is made again."""
        parts = []
        for name, kind in zip(self.NAMES, self.KINDS, strict=True):
            c = getattr(self, name)
            base = 0
            if name == "doc" and len(c) and int(c.max()) - int(c.min()) < 1 << 32:
                base, kind = int(c.min()), np.uint32
                c = c - base
            elif kind == np.uint32 and name != "token" and (not len(c) or c.max() < 1 << 16):
                kind = np.uint16
            elif name == "pic":
                c = c[self.longs == 1]
            parts.append((base, np.dtype(kind).itemsize, c.astype(kind).tobytes()))
        parts.append((0, 8, self.wide.tobytes()))
        small = [pa.compress(raw, codec="zstd", asbytes=True) if raw else b"" for *_, raw in parts]
        head = np.array([x for (base, size, raw), body in zip(parts, small, strict=True) for x in (base, size, len(raw), len(body))], np.int64)
        return b"".join([head.tobytes(), *small])

    def some(self, rows: np.ndarray) -> Entries:
        room = np.where(self.longs[rows] > 1, self.longs[rows], 0)
        return Entries({k: getattr(self, k)[rows] for k in self.NAMES}, self.wide[_spread(self.wide_at[rows], room)])

    @classmethod
    def unpack(cls, bodies: list[bytes]) -> Entries:
        found: dict[str, list[np.ndarray]] = {k: [] for k in (*cls.NAMES, "wide")}
        for body in bodies:
            head = np.frombuffer(body, np.int64, 4 * len(found)).reshape(-1, 4)
            at = head.nbytes
            for (name, column), kind, (base, size, whole, small) in zip(found.items(), (*cls.KINDS, np.uint64), head.tolist(), strict=True):
                raw = pa.decompress(body[at : at + small], whole, codec="zstd", asbytes=True) if small else b""
                c = np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size])
                column.append(c.astype(np.int64) + base if name == "doc" else c.astype(kind))
                at += small
        joined = {k: np.concatenate(v) for k, v in found.items()}
        narrow, wide = joined["pic"], joined.pop("wide")
        joined["pic"] = np.zeros(len(joined["n"]), np.uint64)
        out = cls(joined, wide)
        out.pic[out.longs == 1] = narrow
        rows = np.flatnonzero(out.longs > 1)
        if len(rows):
            out.pic[rows] = np.bitwise_xor.reduceat(wide, out.wide_at[rows])
        return out


ASKS, LEADS = 1, 2
_GONE, _BLOCK = 0, 1


def _pairs_fit(e: Entries, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """True for the pairs of entries that the filters let through."""
    n, m = e.n[a].astype(np.int64), e.n[b].astype(np.int64)
    most = most_apart(n, m, percent)
    ok = np.bitwise_count(e.pic[a] ^ e.pic[b]) <= most
    ok &= np.minimum(n - e.place[a], m - e.place[b]) >= overlap(n, m, percent)
    at = np.flatnonzero(ok)
    longs = np.minimum(e.longs[a[at]], e.longs[b[at]])
    for w in np.unique(longs[longs > 1]):
        some = at[longs == w]
        x, y = (_folded(e, c[some], int(w)) for c in (a, b))
        ok[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[some]
    return ok


def _folded(e: Entries, rows: np.ndarray, longs: int) -> np.ndarray:
    out = np.zeros((len(rows), longs), np.uint64)
    for w in np.unique(e.longs[rows]):
        at = np.flatnonzero(e.longs[rows] == w)
        whole = e.wide[e.wide_at[rows[at]][:, None] + np.arange(w)]
        out[at] = np.bitwise_xor.reduce(whole.reshape(len(at), w // longs, longs), 1)
    return out


def _earlier(e: Entries, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (e.doc[a] < e.doc[b]) | (e.doc[a] == e.doc[b]) & (e.line[a] < e.line[b])


def settle_unit(x: Lines, percent: int, rare: np.ndarray, common: int, long: int) -> tuple[Lines, np.ndarray, Entries, np.ndarray]:
    """Of the lines of a unit: those that copy or resemble another of it (doc and line), and the entries and cells of the rest."""
    order = np.lexsort((x.line, x.doc, x.key, x.n))
    copy = np.r_[False, (x.key[order][1:] == x.key[order][:-1]) & (x.n[order][1:] == x.n[order][:-1])] if len(order) else np.zeros(0, bool)
    gone, heads = [order[copy]], order[~copy]
    heads = heads[np.lexsort((x.line[heads], x.doc[heads]))]
    y = take(x, heads)
    row, place, key, cell = keys_of(y, percent, rare, common, long)
    wide_n = longs_of(y.n)
    pic = pictures(y, 1)[:, 0]
    flags = np.full(len(row), ASKS, np.uint8)
    # A set's copies meet in all its keys; they are told of in the one of least value.
    by_row = np.argsort(row, kind="stable") if (row[1:] < row[:-1]).any() else slice(None)
    least = np.minimum.reduceat(key[by_row], np.searchsorted(row[by_row], np.arange(len(y.n)))) if len(row) else key
    flags |= np.where(key == least[row], LEADS, 0).astype(np.uint8)
    wide, wide_at = [np.zeros(0, np.uint64)], np.zeros(len(y.n), np.int64)
    at = 0
    for w in np.unique(wide_n[wide_n > 1]):
        rows = np.flatnonzero(wide_n == w)
        made = pictures(take(y, rows), int(w))
        wide.append(made.ravel())
        wide_at[rows] = at + np.arange(len(rows)) * w
        at += made.size
    columns = {"token": (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), "key": y.key[row], "doc": y.doc[row], "line": y.line[row].astype(np.uint32), "n": y.n[row].astype(np.uint32), "place": place.astype(np.uint32), "flags": flags, "pic": pic[row]}
    room = np.where(wide_n[row] > 1, wide_n[row], 0)
    e = Entries(columns, np.concatenate(wide)[_spread(wide_at[row], room)])
    if len(row):
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        order = order[np.lexsort((row[order], key[order]))]
        start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else order
        pivot = np.repeat(order[start], np.diff(np.r_[start, len(order)]))
        near = order[order != pivot]
        pivot = pivot[order != pivot]
        fit = _pairs_fit(e, pivot, near, percent)
        pairs = np.unique(np.stack([row[pivot[fit]], row[near[fit]]], 1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
        both = shared_words(y.words, y.begin, y.n, a, b)
        done = np.unique(b[both * 100 >= (y.n[a] + y.n[b] - both) * percent])
        gone.append(heads[done])
        settled = np.zeros(len(y.n), bool)
        settled[done] = True
        e.flags[settled[row]] &= np.uint8(255 - ASKS)
    out = np.concatenate(gone)
    return take(x, out), key, e, cell


def match(e: Entries, percent: int, first: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: entries that copy an earlier one; the candidates (later, earlier) of the entries that ask, at most ``first`` a line and key, and whether there are more; and the entries of all keys for which there are more."""
    copies = np.zeros(0, np.int64)
    keep = np.ones(len(e.token), bool)
    if first is not None and len(keep):
        order = np.argsort(e.token.astype(np.uint64) << np.uint64(32) | e.key & np.uint64(0xFFFFFFFF))
        a, b = order[:-1], order[1:]
        same = (e.token[a] == e.token[b]) & (e.key[a] == e.key[b]) & (e.n[a] == e.n[b]) & (e.pic[a] == e.pic[b])
        run = np.cumsum(np.r_[True, ~same])
        many = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        rows = order[many]
        rows = rows[np.lexsort((e.flags[rows] & ASKS, e.line[rows], e.doc[rows], run[many]))]
        run = np.sort(run[many])
        # An entry that was dealt twice, to ask here and to be found here, is no copy of itself.
        head = np.r_[True, run[1:] != run[:-1]] if len(rows) else np.zeros(0, bool)
        mine = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))] if len(rows) else rows
        twin = (e.doc[rows] == e.doc[mine]) & (e.line[rows] == e.line[mine])
        later = rows[~twin]
        copies = later[e.flags[later] & LEADS > 0]
        # The first of a set's copies asks if any of its entries does.
        keep[rows[~head]] = False
        asks = rows[twin & (e.flags[rows] & ASKS > 0)]
        e.flags[mine[np.isin(rows, asks)]] |= np.uint8(ASKS)
    # By key and size: once sizes are too far apart, they are at all greater distances.
    order = np.flatnonzero(keep)
    order = order[np.argsort(e.token[order].astype(np.uint64) << np.uint64(32) | e.n[order])]
    token, n, pic, asks = e.token[order], e.n[order].astype(np.int64), e.pic[order], e.flags[order] & ASKS > 0
    sums = np.arange(2 * int(n.max()) + 1 if len(n) else 1)
    most = sums - 2 * overlap(sums, 0, percent)
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    more, held = np.zeros(0, np.int64), 0
    start = np.arange(max(0, len(order) - 1))
    lag = 1

    def trim() -> None:
        nonlocal later, earlier, more, held
        x, y = np.concatenate(later), np.concatenate(earlier)
        rank = np.lexsort((e.line[y], e.doc[y], x))
        x, y = x[rank], y[rank]
        begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        number = np.arange(len(x)) - np.repeat(begin, np.diff(np.r_[begin, len(x)]))
        if first is not None:
            more = np.union1d(more, x[number >= first])
            x, y = x[number < first], y[number < first]
        later, earlier, held = [x], [y], 0

    while len(start):
        start = start[start + lag < len(order)]
        start = start[(token[start] == token[start + lag]) & (n[start + lag] * percent <= n[start] * 100)]
        for i in range(0, len(start), 1 << 16):
            a = start[i : i + (1 << 16)]
            b = a + lag
            fit = np.bitwise_count(pic[a] ^ pic[b]) <= most[n[a] + n[b]]
            fit &= asks[a] | asks[b]
            a, b = order[a[fit]], order[b[fit]]
            fit = _pairs_fit(e, a, b, percent)
            a, b = a[fit], b[fit]
            before = _earlier(e, a, b)
            x, y = np.where(before, b, a), np.where(before, a, b)
            ok = (e.flags[x] & ASKS > 0) & ((e.doc[x] != e.doc[y]) | (e.line[x] != e.line[y]))
            later.append(x[ok])
            earlier.append(y[ok])
            held += int(ok.sum())
            if held > 1 << 20:
                trim()
        lag += 1
    trim()
    return copies, later[0], earlier[0], np.isin(later[0], more), order[np.isin(token, e.token[more])]


def _counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of words in each cell, over all documents."""
    ranges = 16
    size = CELLS // ranges

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, offsets = vt.buffers(batch["t"])
            for _, _, chunk, own in vt.chunks(data, offsets, UNIT):
                total += np.bincount(cells(_words(chunk, own)[1]), minlength=CELLS)
        for k in range(ranges):
            part = total[k * size : (k + 1) * size]
            full = np.flatnonzero(part)
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([full.astype(np.uint16).tobytes()]), pa.array([part[full].astype(np.uint32 if part.max() < 2**32 else np.uint64).tobytes()])], names=["k", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(batch[c].to_pylist() for c in ("k", "at", "n")), strict=True):
                where = np.frombuffer(at, np.uint16)
                total.setdefault(k, np.zeros(size, np.int64))[where] += np.frombuffer(n, np.uint32 if len(n) == 4 * len(where) else np.uint64).astype(np.int64)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()])], names=["k", "n"])

    out = np.zeros(CELLS, np.int64)
    made = texts.select("t").mapInArrow(count, "k int, at binary, n binary").repartitionById(ranges, F.col("k")).mapInArrow(add, "k int, n binary")
    for r in made.collect():  # a row for each of the ranges
        out[r.k * size : (r.k + 1) * size] = np.frombuffer(r.n, np.int64)
    return out


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, t) of all texts, doc in the order of id and content hash; and the numbers by (id, th), unless doc is the id itself."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if dict(src.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint") and src.groupBy("id").count().where("count > 1 or id is null").limit(1).count() == 0:
        return src.where("t is not null").select(F.col("id").cast("bigint").alias("doc"), "t"), None
    keyed = src.where("t is not null").withColumn("th", F.xxhash64("t"))
    pairs = keyed.select("id", "th").distinct()
    numbers, _ = global_positions(pairs, [F.col("id").asc_nulls_first(), F.col("th")])
    numbers = materialize(numbers.select(F.col("id").alias("nid"), F.col("th").alias("nth"), F.col("pos").cast("bigint").alias("doc")), "numbers")
    joined = keyed.join(small_side(numbers), keyed["id"].eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth")))
    return materialize(joined.select("doc", "t").dropDuplicates(["doc"]), "texts"), numbers


def removed(texts: DataFrame, percent: int, *, common: int = COMMON, long: int = LONG, deal: int = DEAL, first: int = FIRST, unit: int = UNIT) -> DataFrame:
    """(doc, line) of the lines of ``texts`` (doc, t) that go."""
    spark = texts.sparkSession
    counts = _counts(texts)
    rare = np.minimum(np.log2(counts + 1) * (255 / 48) + 0.5, 255).astype(np.uint8)  # 48: the logarithm of 3e14 words
    level = int(np.log2(common + 1) * (255 / 48) + 0.5)
    dealt = np.maximum(1, -(-counts // deal)).astype(np.int64)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum() // (5 * BUCKET)) + 1)

    def send():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[Lines] = []
            held = 0
            for batch in batches:
                data, offsets = vt.buffers(batch["t"])
                doc = batch["doc"].to_numpy()
                for i, j, chunk, own in vt.chunks(data, offsets):
                    parts.append(cut(chunk, own, doc[i:j], rare))
                    held += len(parts[-1].words)
                    if held > unit:
                        yield from flush(parts)
                        parts, held = [], 0
            if parts:
                yield from flush(parts)
            vt.give_back()

        def flush(parts: list[Lines]) -> Iterator[pa.RecordBatch]:
            x = join(parts)
            gone, key, e, cell = settle_unit(x, percent, rare, level, long)
            rows: list[tuple[int, int, bytes]] = []
            if len(gone.n):
                rows.append((int(gone.doc[0] % buckets), _GONE, np.stack([gone.doc, gone.line.astype(np.int64)]).tobytes()))
            share = dealt[cell]
            home = (vt.mix64(e.key) % share.astype(np.uint64)).astype(np.int64)
            # Found in its home; asks in all.
            copies = np.where(e.flags & ASKS > 0, share, 1)
            at = np.repeat(np.arange(len(key)), copies)
            deal_no = np.where(copies[at] > 1, _spread(np.zeros(len(copies), np.int64), copies), home[at])
            bucket = (vt.mix64((key[at] >> np.uint64(32)) + deal_no.astype(np.uint64) * np.uint64(2**33 + 1)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.zeros(0, np.int64)
            for i, j in zip(edge, np.r_[edge[1:], len(order)] if len(edge) else edge, strict=True):
                rows.append((int(bucket[order[i]]), _BLOCK, e.some(at[order[i:j]]).pack()))
            for i in range(0, len(rows), 64):
                some_rows = rows[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some_rows], pa.int32()), pa.array([r[1] for r in some_rows], pa.int32()), pa.array([r[2] for r in some_rows], pa.binary())], names=["bucket", "kind", "body"])

        return run

    names = ["doc", "line", "with_doc", "with_line", "more", "bucket", "body"]

    def rows_of(bucket: int, e: Entries, x: np.ndarray, y: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x), 1 << 16):
            a, b = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
            mate = b >= 0
            columns = [e.doc[a], e.line[a].astype(np.int64), pa.array(e.doc[b], mask=~mate), pa.array(e.line[b].astype(np.int64), mask=~mate), more[i : i + (1 << 16)], np.full(len(a), bucket, np.int32), pa.nulls(len(a), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, kind, body in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "body")), strict=True):
                if kind == _BLOCK:
                    blocks.setdefault(bucket, []).append(body)
                else:
                    doc, line = np.frombuffer(body, np.int64).reshape(2, -1)
                    none = [pa.nulls(len(doc), k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line), *none], names=names)
        for bucket in list(blocks):
            e = Entries.unpack(blocks.pop(bucket))
            copies, x, y, more, kept = match(e, percent, first)
            yield from rows_of(bucket, e, np.r_[copies, x], np.r_[np.full(len(copies), -1), y], np.r_[np.zeros(len(copies), bool), more])
            for i in range(0, len(kept), 1 << 15):
                body = pa.array([e.some(kept[i : i + (1 << 15)]).pack()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())), pa.array([bucket], pa.int32()), body], names=names)
            del e, copies, x, y, more, kept
        vt.give_back()

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        asked: dict[int, set[tuple[int, int]]] = {}
        for batch in batches:
            for bucket, body, doc, line in zip(*(batch[c].to_pylist() for c in ("bucket", "body", "doc", "line")), strict=True):
                if body is None:
                    asked.setdefault(bucket, set()).add((doc, line))
                else:
                    blocks.setdefault(bucket, []).append(body)
        for bucket, lines in asked.items():
            e = Entries.unpack(blocks.pop(bucket))
            e.flags[:] = [ASKS if at in lines else 0 for at in zip(e.doc.tolist(), e.line.tolist(), strict=True)]
            _, x, y, more, _ = match(e, percent, None)
            yield from rows_of(bucket, e, x, y, more)
        vt.give_back()

    kinds = "doc bigint, line bigint, with_doc bigint, with_line bigint, more boolean, bucket int, body binary"
    sent = texts.select("doc", "t").mapInArrow(send(), "bucket int, kind int, body binary").repartitionById(buckets, F.col("bucket"))
    found = materialize(sent.mapInArrow(meet, kinds), "candidates")
    copies = found.where("body is null and with_doc is null").select("doc", "line").distinct()
    near = _verified(texts, found.where("with_doc is not null"), percent)
    gone = materialize(copies.unionByName(near).distinct(), "gone")
    left = materialize(found.where("more").select("bucket", "doc", "line").distinct().join(gone, ["doc", "line"], "left_anti"), "left")
    if left.limit(1).count():
        kept = found.where("body is not null").join(small_side(left.select("bucket").distinct()), "bucket", "left_semi").select("bucket", "body", "doc", "line")
        rest = kept.unionByName(left.select("bucket", F.lit(None).cast("binary").alias("body"), "doc", "line")).repartitionById(buckets, F.col("bucket"))
        gone = gone.unionByName(_verified(texts, rest.mapInArrow(meet_again, kinds), percent)).distinct()
    return gone


def _verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of the later lines of the candidates (doc, line, with_doc, with_line) that are similar, word by word."""
    pairs = materialize(pairs.select("doc", "line", "with_doc", "with_line").distinct(), "pairs")
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("with_doc").alias("doc"), F.col("with_line").alias("line"))).distinct()
    wanted = materialize(ends.groupBy("doc").agg(F.collect_list("line").alias("want")), "wanted")
    flat = np.zeros(CELLS, np.uint8)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vt.buffers(batch["t"])
            doc, want = batch["doc"].to_numpy(), batch["want"].to_pylist()
            ask = {(d, n) for d, w in zip(doc.tolist(), want, strict=True) for n in w}
            for i, j, chunk, own in vt.chunks(data, offsets):
                x = cut(chunk, own, doc[i:j], flat)
                rows = np.array([(d, n) in ask for d, n in zip(x.doc.tolist(), x.line.tolist(), strict=True)], bool)
                y = take(x, np.flatnonzero(rows))
                words = [y.words[b : b + n].tobytes() for b, n in zip(y.begin, y.n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(y.doc), pa.array(y.line.astype(np.int64)), pa.array(words, pa.binary())], names=["doc", "line", "words"])

    lines = materialize(texts.join(small_side(wanted), "doc").select("doc", "t", "want").mapInArrow(read, "doc bigint, line bigint, words binary"), "words")

    @F.arrow_udf("boolean")
    def similar(sets: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in sets:
            parts = [np.frombuffer(v, np.uint64) for v in (*a.to_pylist(), *b.to_pylist())]
            n = np.array([len(p) for p in parts], np.int64)
            k = np.arange(len(a))
            both = shared_words(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(n) - n, n, k, k + len(a))
            yield pa.array(both * 100 >= (n[k] + n[k + len(a)] - both) * percent)

    mates = lines.select(F.col("doc").alias("with_doc"), F.col("line").alias("with_line"), F.col("words").alias("with_words"))
    joined = pairs.join(lines, ["doc", "line"]).join(mates, ["with_doc", "with_line"])
    return joined.where(similar("words", "with_words")).select("doc", "line").distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, **how) -> DataFrame:
    """``docs`` with the later of similar lines removed from the text, and two columns more: n_lines and removed_lines (their numbers from 0, in order).

    A null text has no lines and stays null; an empty text has one empty line.
    A null id comes first in the order.  Rows that repeat an id and a text are
    a document and its copies: the copies lose all lines with words.  An empty
    table gives an empty one; a text or line of any length is read whole.
    Columns named n_lines or removed_lines are replaced; all others pass
    through, whatever their names.  ``how``: limits of ``removed``, which then
    finds the same lines in NumPy.
    """
    texts, numbers = _numbered(docs, id_col, text_col)
    found = removed(texts, percent, **how) if how else similar_lines(texts, percent)
    gone = materialize(found.groupBy("doc").agg(F.sort_array(F.collect_list(F.col("line").cast("int"))).alias("gone")), "lines")
    doc, lost, copy, part, th = fresh(docs, "doc", "lost", "copy", "part", "th")
    text = F.col(text_col)
    out = docs.withColumn("n_lines", F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"))
    none = F.array().cast("array<int>")
    if numbers is None:
        gone = gone.select(F.col("doc").alias(doc), F.col("gone").alias(lost))
        out = out.join(small_side(gone), out[id_col] == F.col(doc), "left").withColumn("removed_lines", F.coalesce(lost, none))
    else:
        nid, nth = fresh(docs, "nid", "nth")
        gone = materialize(numbers.join(gone, "doc", "left").select(F.col("nid").alias(nid), F.col("nth").alias(nth), F.coalesce("gone", none).alias(lost)), "lost")
        out = out.withColumn(th, F.xxhash64(text)).join(small_side(gone), out[id_col].eqNullSafe(F.col(nid)) & (F.col(th) == F.col(nth)) & text.isNotNull(), "left")
        # The first of rows that repeat keeps its lines: first within its partition, then of these.
        out = out.withColumn(part, F.spark_partition_id())
        out = out.withColumn(copy, F.row_number().over(Window.partitionBy(id_col, th, part).orderBy(F.lit(0))))
        out = out.withColumn(part, F.when(F.col(copy) == 1, -1).otherwise(F.col(part)))
        out = out.withColumn(copy, F.when(F.col(copy) == 1, F.row_number().over(Window.partitionBy(id_col, th, part).orderBy(F.lit(0)))).otherwise(F.col(copy)))
        out = out.withColumn("removed_lines", F.when(F.col(copy) == 1, F.coalesce(lost, none)).otherwise(F.coalesce(_with_words(text), none)))
    text = F.when(F.size("removed_lines") == 0, F.col(text_col)).otherwise(_without(F.col(text_col), F.col("removed_lines")))
    return out.withColumn(text_col, text).select(*[c for c in docs.columns if c not in ("n_lines", "removed_lines")], "n_lines", "removed_lines")


def _without(text: Column, lost: Column) -> Column:
    """``text`` without the lines numbered in ``lost``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains(lost, k)), "\n")


def _with_words(text: Column) -> Column:
    """Numbers of the lines with words."""
    return F.array_compact(F.transform(F.split(text, "\n"), lambda x, k: F.when(x.rlike(HAS_WORD), k)))
