"""Byte-level BPE that speculates and verifies.

Words come from a vectorised form of the usual byte-level split and are encoded once each per Python worker. A trie
walk over all new words at once proposes longest-match tokens; a proposal is the true encoding if and only if every
adjacent pair of tokens is stable, that is, if encoding the two together gives the two again. Pairs are tested together
as arrays along the merge history at their seam; only words with an unstable pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bytesvec import U64, HashIndex, fmix, pieces, ragged, raw, spans_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Splitter:
    """Token spans of whole texts: contractions, letters, numbers, the rest (each with one blank before it), blanks."""

    _class = None
    _of = ((LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s")))

    @classmethod
    def classes(cls, points: np.ndarray) -> np.ndarray:
        if cls._class is None:
            cls._class = np.zeros(0x110000, np.uint8)
        out = cls._class[points]
        if not out.all():
            for p in np.unique(points[out == 0]).tolist():
                cls._class[p] = next((k for k, r in cls._of if r.match(chr(p))), OTHER)
            out = cls._class[points]
        return out

    @classmethod
    def spans(cls, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Begin of each token, as byte places, in order; edges: byte places at which a new text begins."""
        if not len(data):
            return np.zeros(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        kind = cls.classes(points)
        cut = np.zeros(n + 1, bool)
        cut[np.searchsorted(at, edges)] = True
        cut[0] = cut[n] = True
        begin = cut.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(begin[:n])
        to = np.append(run[1:], n)
        blank = (kind[run] == SPACE) & ~cut[to]
        last = to[blank] - 1
        start = begin
        start[last] = True
        start[to[blank][points[last] == 32]] = False
        mark = run[(points[run] == 39) & (to - run == 1) & ~cut[to] & start[run] & (kind[run] == OTHER)]
        mark = mark[kind[mark + 1] == LETTER]
        if len(mark):
            c1 = points[mark + 1]
            nxt = np.minimum(mark + 2, n - 1)
            c2 = np.where((mark + 2 < n) & ~cut[np.minimum(mark + 2, n)], points[nxt], 0)
            one = np.isin(c1, [ord(c) for c in "stmd"])
            two = (np.isin(c1, [ord("r"), ord("v")]) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            size = np.where(one, 1, np.where(two, 2, 0))
            hit = size > 0
            start[mark[hit] + 1] = False
            start[mark[hit] + 1 + size[hit]] = True
        return at[np.flatnonzero(start[:n])]


class Bpe:
    """A byte-level BPE vocabulary with unique merges, as arrays."""

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocab = {k: v for k, v in model["model"]["vocab"].items() if k not in self.special}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for t, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.rank[made] = np.arange(len(merges))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.left[made], self.right[made] = left, right
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges give the same token")
        self.made = made
        self.pairs = HashIndex(18)
        self.pairs.add(self._pair_key(left, right))
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        sound = np.ones(n, bool)
        sound[made] = self._stable(left, right, np.arange(len(merges)))
        for i in made.tolist():
            sound[i] = sound[i] and sound[self.left[i]] and sound[self.right[i]]
        self._trie([(self.bytes[i], i) for i in vocab.values() if sound[i]])
        lens = np.array([len(b) for b in self.bytes], np.int64)
        self.body = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size, self.first = lens, np.cumsum(lens) - lens
        self.seen_pairs, self.seen_ok = HashIndex(18), np.zeros(1 << 16, bool)

    @staticmethod
    def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return fmix((a.astype(U64) << U64(32)) | b.astype(U64))

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.find(self._pair_key(a, b)).astype(np.int64)
        return np.where(r < 0, _NEVER, r)

    def _stable(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Is there no merge across the seam of a and b before either side has absorbed its edge token?

        On the left side the tokens that touched the seam are a, its right part, that one's right part and so on, each
        gone at the rank of the token that holds it; on the right side likewise. Equal ranks go to the left place first.
        until: the rank at which a and b themselves are merged.
        """
        ok = np.ones(len(a), bool)
        row = np.arange(len(a))
        x, x_gone = a, np.full(len(a), _NEVER) if until is None else until
        while len(row):
            y, y_gone, at, xx, xg = b[row], (np.full(len(row), _NEVER) if until is None else until[row]), row, x, x_gone
            while len(at):
                rank = self._merge_rank(xx, y)
                bad = (rank < xg) & (rank <= y_gone) & (rank < _NEVER)
                if until is not None:
                    bad &= rank < until[at]
                ok[at[bad]] = False
                down = ~bad & (self.rank[y] >= 0)
                at, xx, xg = at[down], xx[down], xg[down]
                y, y_gone = self.left[y[down]], self.rank[y[down]]
            down = ok[row] & (self.rank[x] >= 0)
            row, x, x_gone = row[down], self.right[x[down]], self.rank[x[down]]
        return ok

    def _trie(self, tokens: list[tuple[bytes, int]]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for t, i in tokens:
            at = 0
            for c in t:
                nxt = nodes.get((at, c))
                if nxt is None:
                    nxt = nodes[(at, c)] = len(token)
                    token.append(-1)
                at = nxt
            token[at] = i
        self.node_token = np.array(token, np.int64)
        keys = np.array([(a << 8) | c for a, c in nodes], U64)
        self.edges = HashIndex(18)
        self.edges.add(fmix(keys))  # the k-th edge leads to node k + 1

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of each span: (span, token) in order of the spans."""
        span = np.arange(len(starts))
        p, end = starts.copy(), ends
        node = np.zeros(len(starts), np.int64)
        best, best_end = np.full(len(starts), -1, np.int64), starts.copy()
        got_span, got_token, got_at = [], [], []
        while len(span):
            inside = p < end
            step = np.where(inside, data[np.minimum(p, len(data) - 1)], 0).astype(U64)
            nxt = self.edges.find(fmix((node.astype(U64) << U64(8)) | step)).astype(np.int64) + 1
            nxt[~inside] = 0
            on = nxt > 0
            token = self.node_token[nxt]
            hit = on & (token >= 0)
            p = p + on
            best = np.where(hit, token, best)
            best_end = np.where(hit, p, best_end)
            node = nxt
            if not on.all():
                off = ~on
                got_span.append(span[off])
                got_token.append(best[off])
                got_at.append(best_end[off])
                p = np.where(off, best_end, p)
                best = np.where(off, -1, best)
                alive = ~off | (best_end < end)
                span, p, end, node, best, best_end = (v[alive] for v in (span, p, end, node, best, best_end))
        if not got_span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, t, at = (np.concatenate(v) for v in (got_span, got_token, got_at))
        order = np.lexsort((at, s))
        return s[order], t[order]

    def stable_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self._pair_key(a, b)
        at = self.seen_pairs.find(keys)
        if (at < 0).any():
            new = np.flatnonzero(at < 0)
            _, pick = np.unique(keys[new], return_index=True)
            new = new[pick]
            if self.seen_pairs.size > 1 << 20:
                self.seen_pairs, self.seen_ok = HashIndex(18), np.zeros(1 << 16, bool)
                new = np.unique(keys, return_index=True)[1]
            base = self.seen_pairs.size
            self.seen_pairs.add(keys[new])
            if base + len(new) > len(self.seen_ok):
                self.seen_ok = np.concatenate([self.seen_ok, np.zeros(len(self.seen_ok) + len(new), bool)])
            self.seen_ok[base : base + len(new)] = self._stable(a[new], b[new])
            at = self.seen_pairs.find(keys)
        return self.seen_ok[at]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        ids = [int(self.byte_id[c]) for c in word]
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        ranks = self._merge_dict

        def rank(i: int, j: int) -> int:
            return ranks.get((ids[i], ids[j]), -1)

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self._made_list[r]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (q := rank(i, nxt[i])) >= 0:
                    heapq.heappush(heap, (q, i, ids[i], ids[nxt[i]]))
            if prv[i] >= 0 and (q := rank(prv[i], i)) >= 0:
                heapq.heappush(heap, (q, prv[i], ids[prv[i]], ids[i]))
        return [t for t, a in zip(ids, alive) if a]

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words at once, one merge a word and round: ids one after the other, and their counts."""
        size = ends - starts
        count = np.zeros(len(starts), np.int64)
        tok = self.byte_id[data[ragged(starts, size)]]
        word = np.repeat(np.arange(len(starts)), size)
        ended = []
        while len(tok):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank = np.full(len(tok), _NEVER)
            rank[:-1] = self._merge_rank(tok[:-1], tok[1:])
            rank[np.append(first[1:], len(tok)) - 1] = _NEVER
            place = np.arange(len(tok))
            low = np.minimum.reduceat((rank << np.int64(22)) | (place - np.repeat(first, np.diff(np.append(first, len(tok))))), first)
            more = (low >> np.int64(22)) < _NEVER
            own = np.repeat(more, np.diff(np.append(first, len(tok))))
            if not more.all():
                ended.append((word[~own], tok[~own]))
            at = first[more] + (low[more] & np.int64((1 << 22) - 1))
            tok[at] = self.made[low[more] >> np.int64(22)]
            own[at + 1] = False
            tok, word = tok[own], word[own]
        word, tok = (np.concatenate(x) for x in zip(*ended)) if ended else (word, tok)
        count = np.bincount(word, minlength=len(starts))
        return tok[np.argsort(word, kind="stable")], count

    @property
    def _merge_dict(self) -> dict:
        if "_md" not in self.__dict__:
            self._made_list = self.made.tolist()
            self._md = {
                (a, b): k for k, (a, b) in enumerate(zip(self.left[self.made].tolist(), self.right[self.made].tolist()))
            }
        return self._md

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each span, one after the other, and how many each has."""
        span, token = self.propose(data, starts, ends)
        same = np.flatnonzero(span[1:] == span[:-1])
        ok = self.stable_pairs(token[same], token[same + 1]) if len(same) else np.ones(0, bool)
        bad = np.unique(span[same[~ok]])
        count = np.bincount(span, minlength=len(starts))
        if not len(bad):
            return token.astype(np.uint32), count
        first = np.cumsum(count) - count
        new_count = count.copy()
        long = bad[(ends - starts)[bad] > 64]
        bad = bad[(ends - starts)[bad] <= 64]
        redone, new_count[bad] = self.merge_many(data, starts[bad], ends[bad])
        singly = [self.merge(data[starts[k] : ends[k]].tobytes()) for k in long.tolist()]
        new_count[long] = [len(r) for r in singly]
        out = np.zeros(int(new_count.sum()), np.uint32)
        new_first = np.cumsum(new_count) - new_count
        good = np.ones(len(starts), bool)
        good[bad] = good[long] = False
        out[ragged(new_first[good], count[good])] = token[ragged(first[good], count[good])]
        out[ragged(new_first[bad], new_count[bad])] = redone
        out[ragged(new_first[long], new_count[long])] = np.array([i for r in singly for i in r], np.uint32)
        return out, new_count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return self.body[ragged(self.first[ids], self.size[ids])]


class Memo:
    """Ids of the words met so far, by a 64-bit hash of the word; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 2_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex(16)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def look(self, keys: np.ndarray, encode) -> np.ndarray:
        """Numbers of the words; ``encode(places)`` gives ids and counts of those that are new."""
        at = self.index.find(keys)
        if (at < 0).any():
            if self.index.size > self.most:
                self.clear()
                at[:] = -1
            fresh = np.flatnonzero(at < 0)
            _, pick = np.unique(keys[fresh], return_index=True)
            fresh = fresh[pick]
            ids, count = encode(fresh)
            base = self.index.size
            self.index.add(keys[fresh])
            if base + len(fresh) > len(self.first):
                more = len(self.first) + len(fresh)
                self.first = np.concatenate([self.first, np.zeros(more, np.int64)])
                self.count = np.concatenate([self.count, np.zeros(more, np.int64)])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)])
            self.first[base : base + len(fresh)] = self.used + np.cumsum(count) - count
            self.count[base : base + len(fresh)] = count
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            at = self.index.find(keys)
        return at


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        self.bpe, self.memo = Bpe(path), Memo()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode_texts(self, text) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more than texts)."""
        data, off = raw(text)
        edges, special = off, {}
        body = data.tobytes()
        for t, i in self.bpe.special.items():
            mark, at = t.encode(), body.find(t.encode())
            while at >= 0:
                if np.searchsorted(off, at, "right") == np.searchsorted(off, at + len(mark), "left"):
                    special[at] = (i, at + len(mark))
                at = body.find(mark, at + 1)
        if special:
            edges = np.unique(np.concatenate([off, [*special], [e for _, e in special.values()]]))
        starts = Splitter.spans(data, edges)
        if special:  # a special token is one span, whatever lies in it
            inside = np.zeros(len(data) + 1, bool)
            for at, (_, e) in special.items():
                inside[at + 1 : e] = True
            starts = starts[~inside[starts]]
        ends = np.append(starts[1:], len(data))
        keys = spans_hash(data, starts, ends)
        ours = np.isin(starts, [*special]) if special else np.zeros(len(starts), bool)
        keys[ours] = [special[s][0] for s in starts[ours].tolist()]

        def encode(places: np.ndarray):
            ids, count = self.bpe.encode(data, starts[places], ends[places])
            if ours[places].any():
                parts = np.split(ids, np.cumsum(count)[:-1])
                parts = [np.array([special[int(starts[p])][0]], np.uint32) if ours[p] else x for p, x in zip(places, parts)]
                ids, count = np.concatenate(parts), np.array([len(x) for x in parts])
            return ids, count

        at = self.memo.look(keys, encode)
        count = self.memo.count[at]
        ids = self.memo.ids[ragged(self.memo.first[at], count)]
        before = np.append(0, np.cumsum(count))
        return ids, before[np.searchsorted(starts, off)]


def bpe_digest(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each whole text; with ``full`` also ``ids`` and ``decoded``.

    Null texts are empty and have no tokens; the strings of special tokens are their ids, as by the vocabulary's own
    library; repeated rows and null keys are carried; no rows give no rows; other columns of the input play no part.
    One scan, no exchange; a worker keeps at most two million words.
    """

    def run(batches):
        codec = Codec.of(vocab)
        for b in pieces(batches, "text", 1 << 20):
            ids, first = codec.encode_texts(b.column(1))
            spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
            body = codec.bpe.decode(ids)
            stop = np.append(0, np.cumsum(codec.bpe.size[ids]))[first].tolist()
            wide = ids.astype("<u4")
            plain = [body[a:z].tobytes().decode(errors="replace") for a, z in zip(stop, stop[1:])]
            columns = [
                b.column(0),
                pa.array(np.diff(first)),
                pa.array([hashlib.sha256(wide[a:z]).hexdigest() for a, z in spans]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in plain]),
            ]
            if full:
                columns += [pa.array([ids[a:z].astype(np.int32) for a, z in spans], pa.list_(pa.int32())), pa.array(plain)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return (
        docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(run, schema)
        .withColumnRenamed("id", key)
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
