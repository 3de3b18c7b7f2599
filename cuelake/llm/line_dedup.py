"""Line dedup by a segment-partition edit join.

Two lines within ``k`` edits share a whole segment of an even split of the shorter into ``k + 1`` segments, at nearly the
same place. ``k`` grows with the shorter line (``Reach``). A line is indexed by its segments; it probes the segments that
a line of its own length or up to ``k`` characters fewer would have, only at the places that the length difference leaves
possible. So that a probe need not name every place, a segment is named by the least hash of the grams in it: places that
follow each other mostly have one least gram, and a line has few more probes than segments. What meets so may still differ
(it shares a gram, not a segment); nothing that shares a segment is missed, and every pair is verified.

First a filter that moves no text: each piece of the corpus sends each bucket of names its distinct lines' index and probe
entries (12 bytes each), and the bucket names the entries that meet another line. Of the lines that already meet each
other in a piece only the two ends of their name go there, and the rest are known; with many pieces, slices of them meet
first, so a segment that a third of all lines share is a few entries a slice in its bucket. Then only the lines that met
are fetched, once each, with their text, to the names they met at; a name with too many lines or bytes is dealt to pairs
of blocks. There pairs are formed as arrays, each pair at its first common name only, cut to what lies between their
common ends, and verified by a bit-parallel edit distance in a band of ``2 * k + 1`` diagonals. A task returns numbers of
links and a spanning forest, not pairs.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bytesvec import U64, fmix, inverse, pieces, powers, ragged, strings, trimmed
from cuelake.llm.components import components, unite
from cuelake.llm.store import drop, table, text_bytes, text_hashes

_M = U64(0x9DDFEA08EB382D69)
_SALT = (U64(0xB492B66FBE98F273), U64(0x9AE16A3B2F90404F), U64(0xC3A5C85C97CB3127))
#: Lengths that one name covers, and the most characters of a segment that name it.
_LENGTHS, _NAMING = 32, 128
_GRAMS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32])
#: Lines and bytes of one name beyond which it is dealt to pairs of blocks.
_BLOCK_LINES, _BLOCK_BYTES = 1024, 1 << 20
#: Bytes of text a piece, and of the pieces a slice.
_PIECE, _SLICE = 1 << 20, 4 << 30
_BLANKS = " \t\n\x0b\x0c\r"


class Reach(NamedTuple):
    """How many edits near lines are apart at most: one for each ``per`` code points of the shorter, within bounds.

    Lines of less than ``shortest`` code points are only ever equal.
    """

    least: int = 2
    per: int = 64
    most: int = 8
    shortest: int = 16

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.clip(size // self.per, self.least, self.most)

    def sizes(self, k: int) -> tuple[int, int]:
        """The lengths with ``k`` edits."""
        return self.shortest if k == self.least else max(k * self.per, self.shortest), 1 << 40 if k == self.most else (k + 1) * self.per - 1


def split_lines(column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines of texts, the text and the number in it of each; nulls are empty texts."""
    parts = [t.split("\n") for t in strings(column).to_pylist()]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return [x for p in parts for x in p], np.repeat(np.arange(len(parts)), n), ragged(np.zeros(len(n), np.int64), n)


def hashes(lines: list[str]) -> np.ndarray:
    """Two hashes of each line."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x.encode()) for x in lines]), "<u8").reshape(-1, 2).astype(U64)


def solid(lines: list[str]) -> np.ndarray:
    """Which lines are more than blanks."""
    return np.fromiter((bool(x.strip(_BLANKS)) for x in lines), bool, len(lines))


class Lines:
    """Lines as code points: where each begins and ends, and hashes of any stretch."""

    _pow: tuple = (np.zeros(0, U64), np.zeros(0, U64))
    _value = fmix(np.arange(1, (1 << 16) + 1, dtype=U64))

    def __init__(self, lines: list[str]):
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.hi = np.cumsum(self.size + 1) - 1
        self.lo = self.hi - self.size
        self.points = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le"), np.uint32)
        k = len(self.points) + 1
        if len(Lines._pow[0]) < k:
            Lines._pow = (powers(_M, k + k // 2), powers(inverse(_M), k + k // 2))
        value = Lines._value[self.points & np.uint32(0xFFFF)]
        wide = np.flatnonzero(self.points > 0xFFFF)
        value[wide] = fmix(self.points[wide].astype(U64) + U64(1))
        self.total = np.zeros(k, U64)
        np.cumsum(value * Lines._pow[0][: k - 1], out=self.total[1:])

    def stretch(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of code points lo .. hi - 1."""
        return fmix((self.total[hi] - self.total[lo]) * Lines._pow[1][lo])

    def grams(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` code points from each place on."""
        h = (self.total[at + size] - self.total[at]) * Lines._pow[1][at]
        h = (h ^ (h >> U64(29))) * _SALT[2]
        return h ^ (h >> U64(32))


def split_at(size: np.ndarray, i: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of segment i (from 0) of an even split into edits + 1, the longer ones last."""
    parts = edits + 1
    short, more = size // parts, size % parts
    late = np.maximum(0, i - (parts - more))
    return i * short + late, short + (i >= parts - more)


class _Least:
    """Least of any run of a list of values, runs of up to ``longest``."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        for j in range(1, int(longest).bit_length()):
            up, half = self.levels[-1], 1 << (j - 1)
            both = up.copy()
            np.minimum(up[:-half], up[half:], out=both[:-half])
            self.levels.append(both)

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), U64)
        level = np.frexp(size)[1] - 1
        for j in np.unique(level).tolist():
            mine = np.flatnonzero(level == j)
            out[mine] = np.minimum(self.levels[j][at[mine]], self.levels[j][at[mine] + size[mine] - (1 << j)])
        return out


def entries(x: Lines, rows: np.ndarray, reach: Reach):
    """(name, row, is index) of all index and probe entries of the lines ``rows``; index entries by segment, in order."""
    names, of, index = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    if not len(rows):
        return names[0], of[0], index[0]
    size = x.size[rows]
    for k in range(reach.least, int(reach.of(size.max())) + 1):
        low, high = reach.sizes(k)
        mine = rows[(size >= low) & (size - k <= high)]
        for back in (0, 1):
            n = x.size[mine]
            band = n // _LENGTHS - back
            m_low, m_high = np.maximum(np.maximum(low, n - k), band * _LENGTHS), np.minimum(
                np.minimum(high, n), band * _LENGTHS + _LENGTHS - 1
            )
            some = m_low <= m_high
            gram = _GRAMS[np.searchsorted(_GRAMS, np.maximum(1, _gram(np.maximum(low, band * _LENGTHS) // (k + 1))), "right") - 1]
            for g in np.unique(gram[some]).tolist():
                at = some & (gram == g)
                for part in _class_entries(x, mine[at], k, band[at], m_low[at], m_high[at], g):
                    names.append(part[0]), of.append(part[1]), index.append(np.full(len(part[0]), part[2]))
    return np.concatenate(names), np.concatenate(of), np.concatenate(index)


def _gram(short: np.ndarray) -> np.ndarray:
    return np.where(short <= 8, short, np.maximum(8, short * 3 // 4))


def _class_entries(x: Lines, rows, k: int, band, m_low, m_high, g: int):
    """Entries for partners of ``m_low`` to ``m_high`` characters, all with ``k`` edits, in a band of lengths."""
    n = x.size[rows][:, None]
    i = np.arange(k + 1)[None, :]
    begin, end, width = np.full((len(rows), k + 1), 1 << 40), np.zeros((len(rows), k + 1), np.int64), np.full((len(rows), k + 1), 1 << 40)
    for d in range(k + 1):
        m = n - d
        at, size = split_at(m, i, k)
        size = np.minimum(size, _NAMING)
        first, last = at + np.maximum(-i, d - (k - i)), at + np.minimum(i, d + (k - i)) + size
        fits = (m >= m_low[:, None]) & (m <= m_high[:, None]) & (last > first)
        begin = np.where(fits, np.minimum(begin, first), begin)
        end = np.where(fits, np.maximum(end, last), end)
        width = np.where(fits, np.minimum(width, size), width)
    begin, end = np.maximum(begin, 0), np.minimum(end, n)
    row, seg = np.nonzero(end - begin >= width)
    begin, end, width = begin[row, seg], end[row, seg], width[row, seg]
    grams = end - begin - g + 1
    first = np.cumsum(grams) - grams
    low = x.lo[rows[row]] + begin
    window = width - g + 1
    own_k = (m_high == x.size[rows])[row]
    at, size = split_at(x.size[rows[row]], seg, k)
    exact = np.minimum(size, _NAMING) - g + 1
    least = _Least(x.grams(ragged(low, grams), g), int(max(window.max(initial=1), exact[own_k].max(initial=1))))
    salt = fmix(band[row].astype(U64) * _SALT[0] + (seg * 64 + k).astype(U64) * _SALT[1])
    # index: the least gram of each segment of the line itself
    mine = np.flatnonzero(own_k)
    yield fmix(least.of(first[mine] + at[mine] - begin[mine], exact[mine]) ^ salt[mine]), rows[row[mine]], True
    # probes: the different least grams of all places where a partner's segment may be
    tries = grams - window + 1
    each = np.repeat(np.arange(len(row)), tries)
    value = least.of(ragged(first, tries), window[each])
    new = np.ones(len(each), bool)
    new[1:] = (value[1:] != value[:-1]) | (each[1:] != each[:-1])
    yield fmix(value[new] ^ salt[each[new]]), rows[row[each[new]]], False


def _place(name: np.ndarray, buckets: int) -> np.ndarray:
    """A name as buckets know it: the bucket's number, and 32 bits beside it."""
    return (((name >> U64(32)) % U64(buckets)) << U64(32)) | (name & U64(0xFFFFFFFF))


def _meeting(named: np.ndarray, line: np.ndarray, index: np.ndarray):
    """Of entries sorted by name: which meet an entry of the other kind and of another line; and which are the least or
    greatest line of their name and kind."""
    first = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    size = np.diff(np.append(first, len(named)))
    top = ~U64(0)
    met, end = np.zeros(len(named), bool), np.zeros(len(named), bool)
    ends = []
    for kind in (index, ~index):
        least = np.repeat(np.minimum.reduceat(np.where(kind, line, top), first), size)
        most = np.repeat(np.maximum.reduceat(np.where(kind, line, U64(0)), first), size)
        ends.append((least, most))
        end |= kind & ((line == least) | (line == most))
    for kind, (least, most) in ((index, ends[1]), (~index, ends[0])):
        met |= kind & (least <= most) & ((least != line) | (most != line))
    return met, end


_SENT = "bucket long, kind int, slice long, body binary"


def _messages(named, line, index, known, sent, buckets: int, number: int, slices: int) -> pa.RecordBatch:
    """Entries, sorted by name, as messages: 0 and 1 are index and probe entries for a bucket, 2 and 3 known ones (on any
    task, below 0)."""
    bucket = (named >> U64(32)).astype(np.int64)
    out_bucket, out_kind, body = [], [], []
    for kind, some in ((0, sent & index), (1, sent & ~index), (2, known & index), (3, known & ~index)):
        at = np.flatnonzero(some)
        if not len(at):
            continue
        names, lines, of = named[at].astype("<u8"), line[at].astype("<u8"), bucket[at]
        if kind >= 2:
            out_bucket.append(-1 - number % buckets), out_kind.append(kind)
            body.append(names.tobytes() + lines.tobytes())
            continue
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        low = np.ascontiguousarray(names.view("<u4")[::2])
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
            out_bucket.append(int(of[lo])), out_kind.append(kind)
            body.append(low[lo:hi].tobytes() + lines[lo:hi].tobytes())
    n = len(out_bucket)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(out_bucket, pa.int64()),
            pa.array(out_kind, pa.int32()),
            pa.array([number % slices] * n, pa.int64()),
            pa.array(body, pa.binary()),
        ],
        names=["bucket", "kind", "slice", "body"],
    )


def _send(reach: Reach, buckets: int, slices: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        for count, batch in enumerate(pieces(batches, "text", _PIECE)):
            lines, _, _ = split_lines(batch.column(0))
            keep = [x for x in dict.fromkeys(lines) if len(x) >= reach.shortest and x.strip(_BLANKS)]
            if not keep:
                continue
            name, row, index = entries(Lines(keep), np.arange(len(keep)), reach)
            named = _place(name, buckets)
            order = np.argsort(named)
            named, line, index = named[order], hashes(keep)[row[order], 0], index[order]
            met, end = _meeting(named, line, index)
            yield _messages(named, line, index, met & ~end, ~met | end, buckets, task + count * 7919, slices)

    return run


def _unpacked(t: pa.Table):
    """named, line, index and known of all entries of messages of one bucket, sorted by name."""
    bucket = t["bucket"][0].as_py()
    named, lines, index, known = [], [], [], []
    for kind, body in zip(t["kind"].to_pylist(), t["body"].to_pylist()):
        width = 16 if kind >= 2 else 12
        n = len(body) // width
        named.append(
            np.frombuffer(body, "<u8", n) if kind >= 2 else (U64(max(bucket, 0)) << U64(32)) | np.frombuffer(body, "<u4", n).astype(U64)
        )
        lines.append(np.frombuffer(body, "<u8", n, offset=n * (width - 8)))
        index.append(np.full(n, kind % 2 == 0))
        known.append(np.full(n, kind >= 2))
    named, line, index, known = (np.concatenate(v) for v in (named, lines, index, known))
    order = np.argsort(named)
    return named[order].astype(U64), line[order].astype(U64), index[order], known[order]


def _once(named: np.ndarray, line: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One place of each distinct entry, in order."""
    return np.sort(np.unique(fmix(named ^ fmix(line + U64(1))) ^ index.astype(U64), return_index=True)[1])


def _slice_meets(buckets: int):
    """The entries of one bucket from one slice of the pieces: what is known, and what goes on."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        if bucket < 0:
            return t
        named, line, index, _ = _unpacked(t)
        once = _once(named, line, index)
        named, line, index = named[once], line[once], index[once]
        met, end = _meeting(named, line, index)
        return pa.Table.from_batches(
            [_messages(named, line, index, met & ~end, ~met | end, buckets, bucket * 31 + t["slice"][0].as_py(), 1)]
        )

    return run


@trimmed
def _name(t: pa.Table) -> pa.Table:
    """Entries of a bucket that meet another line: ``key`` (the name with the bucket), ``line``, ``index``."""
    named, line, index, known = _unpacked(t)
    met = known if t["bucket"][0].as_py() < 0 else _meeting(named, line, index)[0]
    named, line, index = named[met], line[met], index[met]
    once = _once(named, line, index)
    return pa.table({"key": named[once].view(np.int64), "line": line[once].view(np.int64), "index": pa.array(index[once])})


_COLUMNS = 32


def banded_within(a: np.ndarray, a_lo, a_hi, b: np.ndarray, b_lo, b_hi, edits) -> np.ndarray:
    """Is the edit distance of a[a_lo:a_hi] and b[b_lo:b_hi] at most ``edits`` (one number, or one a pair, up to 30)?

    All pairs go along one column a step. A pair's column is a band of 2 * (most edits) + 1 rows, kept as two words of
    bits: where the value grows by one to the next row, and where it falls by one. The value at the band's lower edge is
    counted along; once that edge has reached the last row, the value in the last row is. Characters are fetched for
    ``_COLUMNS`` columns at a time; then pairs that are done, or can no longer be within, leave.
    """
    m, n = a_hi - a_lo, b_hi - b_lo
    ok = np.zeros(len(m), bool)
    edits = np.broadcast_to(np.asarray(edits, np.int64), m.shape)
    live = np.flatnonzero(np.abs(m - n) <= edits)
    if not len(live):
        return ok
    most = int(edits[live].max())
    w = 2 * most + 1
    kind = np.int32 if w <= 30 else np.int64
    ok[live] = np.maximum(m, n)[live] <= edits[live]  # the rest has columns to go along
    live = live[(n[live] > 0) & ~ok[live]]
    m, n, pa_, pb, own = m[live].astype(kind), n[live].astype(kind), a_lo[live], b_lo[live], edits[live].astype(kind)
    one = kind(1)
    full, low = kind((1 << w) - 1), kind(1 << (w - 1))
    up = np.full(len(live), ((1 << w) - 1) >> (most + 1) << (most + 1), kind)
    down = np.zeros(len(live), kind)
    # at column 0 the edge is row `most`, which may be below the last row: step back up to it
    value = (most - np.maximum(0, most - m)).astype(kind)
    j = 0
    while len(live):
        rows = j - most + np.arange(_COLUMNS + 2 * most)[:, None]  # from 0
        inside = (rows >= 0) & (rows < m)
        left = np.where(inside, a[np.where(inside, pa_ + rows, 0)], np.uint32(0xFFFFFFFF))
        right = b[np.minimum(pb + (j + np.arange(_COLUMNS)[:, None]), len(b) - 1)]
        same = np.zeros(right.shape, kind)
        for k in range(w):
            same |= (left[k : k + _COLUMNS] == right).astype(kind) << kind(k)
        over = np.zeros(len(live), bool)
        for c in range(_COLUMNS):
            j += 1
            eq = same[c]
            # the band has moved down one row: align the last column's vertical words with this one's rows
            v_up, v_down = (up >> 1) | low, down >> 1  # a row that enters the band is one more than the one above at most
            zero = ((((eq & v_up) + v_up) ^ v_up) | eq | v_down) & full
            h_up = (v_down | ~(zero | v_up)) & full
            h_down = zero & v_up
            bit = np.clip(m - kind(j - most), 0, w - 1)
            on_edge = one - ((zero >> (w - 1)) & one)
            value = value + np.where(m >= j + most, on_edge, ((h_up >> bit) & one) - ((h_down >> bit) & one))
            x = (h_up << 1) | one
            up, down = ((h_down << 1) | ~(zero | x)) & full, x & zero & full
            done = n == j
            if done.any():
                ok[live[done & ~over]] = value[done & ~over] <= own[done & ~over]
                over |= done
        # the least value of the column, from the counted one upwards: no path costs less
        at, least = value.copy(), value.copy()
        known = np.minimum(m - kind(j - most), w - 1)
        for k in range(w - 1, 0, -1):
            at -= np.where(known >= k, ((up >> kind(k)) & one) - ((down >> kind(k)) & one), 0)
            np.minimum(least, at, out=least)
        over |= least > own
        keep = np.flatnonzero(~over)
        live, m, n, pa_, pb, up, down, value, own = (v[keep] for v in (live, m, n, pa_, pb, up, down, value, own))
    return ok


def _common(x: Lines, p: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many code points two lines have in common at their beginning (or end), by halving with hashes."""
    good, bad = np.zeros(len(p), np.int64), most + 1
    while True:
        mid = (good + bad) // 2
        open_ = bad - good > 1
        if not open_.any():
            return good
        if back:
            same = x.stretch(x.hi[p] - mid, x.hi[p]) == x.stretch(x.hi[q] - mid, x.hi[q])
        else:
            same = x.stretch(x.lo[p], x.lo[p] + mid) == x.stretch(x.lo[q], x.lo[q] + mid)
        good = np.where(open_ & same, mid, good)
        bad = np.where(open_ & ~same, mid, bad)


class _Names:
    """The names of some lines: which a line probes, and each line's index names by segment."""

    def __init__(self, x: Lines, reach: Reach, buckets: int):
        name, row, index = entries(x, np.arange(len(x.size)), reach)
        named = _place(name, buckets)
        self.probed = np.sort(self._pair(row[~index], named[~index]))
        order = np.argsort(row[index], kind="stable")
        self.named, rows = named[index][order], row[index][order]
        self.first = np.searchsorted(rows, np.arange(len(x.size) + 1))

    @staticmethod
    def _pair(row: np.ndarray, named: np.ndarray) -> np.ndarray:
        return fmix(named ^ (row.astype(U64) * _SALT[0]))

    def first_common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first index name of line p that line q probes; all ones if none."""
        out = np.full(len(p), ~U64(0))
        todo, at = np.arange(len(p)), 0
        while len(todo) and len(self.probed):
            todo = todo[self.first[p[todo]] + at < self.first[p[todo] + 1]]
            named = self.named[self.first[p[todo]] + at]
            pair = self._pair(q[todo], named)
            hit = self.probed[np.minimum(np.searchsorted(self.probed, pair), len(self.probed) - 1)] == pair
            out[todo[hit]] = named[hit]
            todo, at = todo[~hit], at + 1
        return out


def _verify(reach: Reach, buckets: int, width: int = 1 << 18):
    """Links among the lines of some names: ``line, links, root`` for each line with a link."""

    @trimmed
    def run(t: pa.Table) -> pa.Table:
        ids, first, row_line = np.unique(t["line"].to_numpy(), return_index=True, return_inverse=True)
        x = Lines(t["text"].take(pa.array(first)).to_pylist())
        names = _Names(x, reach, buckets)
        keys = t["key"].to_numpy()
        group = np.unique(
            fmix(keys.view(U64) ^ fmix((t["low"].to_numpy() * (1 << 31) + t["high"].to_numpy()).view(U64))), return_inverse=True
        )[1]
        index, block = t["index"].to_numpy(zero_copy_only=False), t["block"].to_numpy()
        across = t["low"].to_numpy() != t["high"].to_numpy()
        a, b = np.flatnonzero(index), np.flatnonzero(~index)
        a, b = a[np.argsort(group[a], kind="stable")], b[np.argsort(group[b], kind="stable")]
        b_first, b_to = np.searchsorted(group[b], group[a]), np.searchsorted(group[b], group[a], "right")
        size = b_to - b_first
        links = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        part = np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), width)), len(a))
        for lo, hi in zip(part.tolist(), part[1:].tolist()):
            if lo == hi:
                continue
            ra = np.repeat(a[lo:hi], size[lo:hi])
            rb = b[ragged(b_first[lo:hi], size[lo:hi])]
            p, q = row_line[ra], row_line[rb]
            gap = x.size[q] - x.size[p]
            # a false meeting of hashes can have any lengths; equal lengths are taken from one side
            fit = (~across[ra] | (block[ra] != block[rb])) & (p != q) & (gap >= 0) & (gap <= reach.of(x.size[p])) & ((gap > 0) | (p < q))
            p, q, where = p[fit], q[fit], keys[ra[fit]].view(U64)
            here = names.first_common(p, q) == where
            p, q = p[here], q[here]
            if not len(p):
                continue
            _, once = np.unique(p * np.int64(len(ids)) + q, return_index=True)
            p, q = p[once], q[once]
            ok = within(x, p, q, reach.of(x.size[p]))
            p, q = p[ok], q[ok]
            np.add.at(links, p, 1)
            np.add.at(links, q, 1)
            unite(label, p, q)
        some = links > 0
        return pa.table({"line": ids[some], "links": links[some], "root": ids[label[some]]})

    return run


def within(x: Lines, p: np.ndarray, q: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Pairs of lines within ``edits`` edits each: the common ends are cut off, the rest goes through the band."""
    most = np.minimum(x.size[p], x.size[q])
    head = _common(x, p, q, most, False)
    tail = _common(x, p, q, most - head, True)
    out = np.zeros(len(p), bool)
    for low, high in ((-1, 4), (4, 8), (8, 30)):  # bands of about one width go together
        of_width = np.flatnonzero((edits > low) & (edits <= high))
        for at in range(0, len(of_width), 1 << 14):
            some = of_width[at : at + (1 << 14)]
            u, v, h, t = p[some], q[some], head[some], tail[some]
            out[some] = banded_within(x.points, x.lo[u] + h, x.hi[u] - t, x.points, x.lo[v] + h, x.hi[v] - t, edits[some])
    return out


_FILTER_BITS = 1 << 19


def _filter_part(parts: int):
    """A Bloom filter of one part of the lines that met."""

    def run(t: pa.Table) -> pa.Table:
        h = fmix(t["line"].to_numpy().view(U64))
        bits = np.zeros(_FILTER_BITS, np.uint8)
        for shift in (U64(0), U64(20)):
            bits[((h >> shift) % U64(_FILTER_BITS)).astype(np.int64)] = 1
        return pa.table({"part": t["part"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


class LineFilter:
    """What may be among the lines that met: parts of 64 KB, at most 512 of them, so it is sent to every worker at every
    size. With more lines it lets more others pass, which an exact join then removes."""

    MOST_PARTS = 512

    def __init__(self, parts: int, found: dict[int, bytes]):
        self.parts = parts
        self.table = np.zeros((parts, _FILTER_BITS // 8), np.uint8)
        for k, v in found.items():
            self.table[k] = np.frombuffer(v, np.uint8)

    @classmethod
    def build(cls, lines: DataFrame, count: int) -> "LineFilter":
        parts = max(1, min(cls.MOST_PARTS, count * 16 // _FILTER_BITS + 1))
        rows = lines.select("line", F.pmod(F.col("line"), F.lit(parts)).cast("int").alias("part")).distinct()
        # a slice of a part at a time, so that no group grows with the input; slices are laid over each other by bits
        slices = max(1, count // (parts << 20))
        sliced = rows.groupBy(
            "part", F.pmod(F.xxhash64("line"), F.lit(slices)).alias("slice")
        ).applyInArrow(_filter_part(parts), "part int, bits binary")

        def over(t: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
            return pa.table({"part": t["part"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

        if slices > 1:
            sliced = sliced.groupBy("part").applyInArrow(over, "part int, bits binary")
        return cls(parts, {r["part"]: r["bits"] for r in sliced.collect()})

    def may_have(self, line: np.ndarray) -> np.ndarray:
        part = line.view(np.int64) % self.parts
        h = fmix(line)
        out = np.ones(len(line), bool)
        for shift in (U64(0), U64(20)):
            at = ((h >> shift) % U64(_FILTER_BITS)).astype(np.int64)
            out &= (self.table[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def _texts(wanted, reach: Reach):
    """``line, text`` of the lines that may be among those that met, once a piece."""

    def run(batches):
        found = wanted.value
        for batch in pieces(batches, "text", _PIECE):
            lines, _, _ = split_lines(batch.column(0))
            keep = [x for x in dict.fromkeys(lines) if len(x) >= reach.shortest and x.strip(_BLANKS)]
            if keep:
                line = hashes(keep)[:, 0].copy()
                some = np.flatnonzero(found.may_have(line))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line[some].view(np.int64)), pa.array([keep[i] for i in some.tolist()], pa.string())], names=["line", "text"]
                )

    return run


def line_links(
    spark: SparkSession, docs: DataFrame, reach: Reach = Reach(), bucket_bytes: int = 2 << 20, part_bytes: int = 2 << 20
) -> DataFrame:
    """``docs(text)`` -> ``line, links, root`` for each distinct line (by its hash) with a link: a table in the shared folder.

    links: number of other distinct lines near it; root: a line that stands for its component.
    """
    total = text_bytes(docs, "text")
    buckets, slices = max(1, -(-total // bucket_bytes)), max(1, total // _SLICE)
    sent = docs.mapInArrow(_send(reach, buckets, slices), _SENT)
    if slices > 1:
        sent = sent.groupBy("bucket", "slice").applyInArrow(_slice_meets(buckets), _SENT)
    met = table(spark, sent.groupBy("bucket").applyInArrow(_name, "key long, line long, index boolean"))
    named = table(spark, met.select("line").distinct())
    wanted = spark.sparkContext.broadcast(LineFilter.build(named, named.count()))
    texts = docs.mapInArrow(_texts(wanted, reach), "line long, text string").join(named, "line", "left_semi")
    texts = table(spark, texts.groupBy("line").agg(F.first("text").alias("text")))
    sized = met.join(texts.select("line", F.octet_length("text").alias("size")), "line")
    of_key = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / _BLOCK_LINES), F.ceil(F.col("bytes") / _BLOCK_BYTES)).cast("long")
    keys = table(spark, of_key.select("key", "bytes", blocks.alias("blocks")))
    dealt_bytes = keys.agg(F.coalesce(F.sum(F.col("bytes") * F.col("blocks")), F.lit(0))).first()[0]
    crowded = keys.where("blocks > 1").select("key", "blocks")
    dealt = (
        met.join(crowded, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        .withColumn("block", F.pmod(F.xxhash64("line"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", "line", "index", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    part = F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(1, -(-int(dealt_bytes) // part_bytes)))).alias("part")
    met_texts = dealt.join(texts, "line").select("key", "line", "index", "block", "low", "high", "text", part)
    found = table(spark, met_texts.groupBy("part").applyInArrow(_verify(reach, buckets), "line long, links long, root long"))
    roots = components(spark, found.select(F.col("line").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("line").agg(F.sum("links").alias("links"))
    out = table(spark, links.join(roots, links.line == roots.node).select("line", "links", "root"))
    for done in (met, named, texts, keys, found):
        drop(spark, done)
    return out


def line_classes(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", reach: Reach = Reach(), by_text: bool = False
) -> DataFrame:
    """One row a line: ``key, line_no, class_key, class_line_no, n_links, kept``.

    Lines are what ``\\n`` parts; blank lines have no row. Lines of one class are equal, or joined over any number of
    steps by pairs of lines that differ by as many insertions, deletions or replacements of a code point as ``reach``
    allows for the shorter one; lines below its ``shortest`` are only ever equal. A class is named by its first line, by
    key (nulls first) and line number, and that line is kept. ``n_links`` is the number of different lines that near this
    one. Null texts have no lines; rows that repeat a key are taken for one document, whose lines with one number are
    kept or not together; no rows give no rows; other columns of the input play no part.

    by_text: only rows with the same key and the same text are one document, told apart by two hashes of the text, which
    are further columns; of lines with one key and number, that of the smallest hash is first.
    """
    own = ["text_hash", "text_hash2"] if by_text else []
    near = line_links(spark, docs.select(F.col(f"`{text}`").alias("text")), reach)

    def run(batches):
        for batch in pieces(batches, "text", _PIECE):
            lines, of, number = split_lines(batch.column(1))
            rows = np.flatnonzero(solid(lines))
            h = hashes(lines)[rows]
            at = pa.array(of[rows])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(number[rows].astype(np.int32)),
                    pa.array(h[:, 0].copy().view(np.int64)),
                    pa.array(h[:, 1].copy().view(np.int64)),
                ]
                + [batch.column(2 + k).take(at) for k in range(len(own))],
                names=["id", "line_no", "line", "second", *own],
            )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), *text_hashes(text)[: len(own)])
    where = source.mapInArrow(run, ", ".join([f"id {kind}, line_no int, line long, second long", *[f"{c} long" for c in own]]))
    joined = where.join(near.withColumnRenamed("line", "near_line"), F.col("line") == F.col("near_line"), "left")
    placed = table(
        spark,
        joined.select(
            "id", "line_no", *own,
            F.coalesce("root", "line").alias("line"),
            F.when(F.col("root").isNull(), F.col("second")).otherwise(0).alias("second"),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        ),
    )
    drop(spark, near)
    shared = table(
        spark,
        placed.groupBy("line", "second")
        .agg(F.min(F.struct("id", "line_no", *own)).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("line").alias("c"), F.col("second").alias("d"), "first"),
    )
    first = F.coalesce(F.col("first"), F.struct("id", "line_no", *own))
    same = [first[c] == F.col(c) for c in ["line_no", *own]]
    return placed.join(shared, (F.col("line") == F.col("c")) & (F.col("second") == F.col("d")), "left").select(
        F.col("id").alias(key),
        "line_no",
        first["id"].alias("class_key"),
        first["line_no"].alias("class_line_no"),
        "n_links",
        reduce(and_, same, first["id"].eqNullSafe(F.col("id"))).alias("kept"),
        *own,
    )


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", reach: Reach = Reach()) -> DataFrame:
    """``docs`` with only the kept lines of each text, and all its columns; blank lines stay, and so do null texts.

    Rows of one key (or without one) lose their own lines only; rows with the same key and text are taken for one.
    """
    gone = (
        line_classes(spark, docs, key, text, reach, by_text=True)
        .where("NOT kept")
        .groupBy(F.col(key).alias("_gone_key"), F.col("text_hash").alias("_gone_hash"), F.col("text_hash2").alias("_gone_hash2"))
        .agg(F.collect_set("line_no").alias("_gone"))
    )
    one, two = text_hashes(text)
    here = F.col(f"`{key}`").eqNullSafe(F.col("_gone_key")) & (one == F.col("_gone_hash")) & (two == F.col("_gone_hash2"))
    left = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    new = F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(left).alias(text)
    # hashed, as one side is every text: nothing is sorted, and the plan is the same at every size
    return docs.join(table(spark, gone).hint("shuffle_hash"), here, "left").select(
        *[new if c == text else F.col(f"`{c}`") for c in docs.columns]
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("class_key", "class_doc_id")
