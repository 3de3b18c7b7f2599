"""Operators of the llm subpackage against brute-force versions, and on awkward input."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import bpe, components, embedding_dedup, fingerprint, language_id, line_dedup, packing, quality, simhash, substring_dedup, url_filter
from cuelake.llm.bytesvec import HashIndex, spans_hash

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, line string, chunk string, id string, run string, fp string, label string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward_texts():
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60)) for _ in range(6)]
    long = " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(12_000)) + " " + "x" * 9000
    texts = [None, "", " \t\n", "a", "Straße İstanbul 漢字 😀 don't\n\nx  y", long, *base, base[0], base[0] + " tail", base[1][:200] + "\n" + base[1], "same same " * 50, "12 !! 34"]
    return list(enumerate(texts)) + [(6, base[0]), (None, "nobody knows my key at all, at all"), (None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, None if k is None or k % 3 == 0 else "en", "s", None, *["clash"] * 7) for k, t in awkward_texts()]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


# ---------------------------------------------------------------- parts


def test_hash_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64))
    rng.shuffle(keys)
    ix = HashIndex(4)
    for part in np.array_split(keys, 7):
        assert (ix.find(part) == -1).all()
        ix.add(part)
    assert (ix.find(keys) == np.arange(len(keys))).all()


def test_spans_hash():
    data = np.frombuffer(b"abcdefghijklmnop|abcdefghijklmnop|abcdefghijklmnoq|" + b"z" * 100, np.uint8)
    s = np.array([0, 17, 34, 0, 51, 60])
    e = np.array([16, 33, 50, 8, 100, 109])
    h = spans_hash(data, s, e)
    assert h[0] == h[1] and h[0] != h[2] and h[4] == h[5] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rnd = random.Random(3)
    links = [(rnd.randint(-50, 400), rnd.randint(-50, 400)) for _ in range(250)] + [(1000, k) for k in range(2000, 2100)] + [(k, k + 1) for k in range(5000, 5060)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.components(spark, spark.createDataFrame([(None, 1)], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 1 line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rnd, s, k):
    s = list(s)
    for _ in range(k):
        at, how = rnd.randint(0, max(0, len(s) - 1)), rnd.randint(0, 2)
        if how == 0 and s:
            s[at] = rnd.choice("abc")
        elif how == 1 and s:
            del s[at]
        else:
            s.insert(at, rnd.choice("abc"))
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3, 9])
def test_banded_within(most):
    rnd = random.Random(most)
    pairs = []
    for _ in range(1500):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        pairs.append((a, changed(rnd, a, rnd.randint(0, 5)) if rnd.random() < 0.8 else "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))))
    flat = [np.frombuffer(("".join(p[k] for p in pairs) + " ").encode("utf-32-le"), np.uint32) for k in (0, 1)]
    at = [np.cumsum([0] + [len(p[k]) for p in pairs]) for k in (0, 1)]
    got = line_dedup.banded_within(flat[0], at[0][:-1], at[0][1:], flat[1], at[1][:-1], at[1][1:], most)
    assert got.tolist() == [edits(a, b) <= most for a, b in pairs]
    each = np.array([rnd.randint(0, most) for _ in pairs])
    got = line_dedup.banded_within(flat[0], at[0][:-1], at[0][1:], flat[1], at[1][:-1], at[1][1:], each)
    assert got.tolist() == [edits(a, b) <= k for (a, b), k in zip(pairs, each.tolist())]


def brute_lines(docs, reach=line_dedup.Reach()):
    lines = [(k, i, x) for k, t in docs if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    distinct = sorted({x for *_, x in lines})
    root, links = {x: x for x in distinct}, Counter()
    letters = [np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 97, minlength=97) for x in distinct]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for j, b in enumerate(distinct[:i]):
            k = min(max(min(len(a), len(b)) // reach.per, reach.least), reach.most)
            close = min(len(a), len(b)) >= reach.shortest and abs(len(a) - len(b)) <= k and abs(letters[i] - letters[j]).sum() <= 2 * k
            if close and edits(a, b) <= k:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for k, i, x in sorted(lines, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        first.setdefault(find(x), (k, i))
    return {(k, i): (*first[find(x)], links[x], first[find(x)] == (k, i)) for k, i, x in lines}


def as_lines(df):
    return {(r["doc_id"], r["line_no"]): (r["class_key"], r["class_line_no"], r["n_links"], r["kept"]) for r in df.collect()}


def test_line_classes(spark, monkeypatch):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(10, 40))) for _ in range(50)]
    docs = [(i, "\n".join(changed(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 1, 2, 3])) for _ in range(rnd.randint(0, 8)))) for i in range(120)]
    docs += [(None, "aaaa bbbb cccc dddd eeee"), (500, None), (501, ""), (502, "\n\n  \nx"), (503, "aaaa bbbb cccc dddd eeef")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute_lines(docs)
    assert as_lines(line_dedup.line_classes(spark, df)) == expected
    for name, value in (("_BLOCK_LINES", 5), ("_BLOCK_BYTES", 200), ("_SLICE", 4000)):
        monkeypatch.setattr(line_dedup, name, value)
    assert as_lines(line_dedup.line_classes(spark, df)) == expected


@pytest.mark.parametrize("reach", [line_dedup.Reach(), line_dedup.Reach(1, 12, 9, 8), line_dedup.Reach(3, 30, 3, 20)])
def test_line_classes_of_long_lines(spark, reach):
    """Edits that grow with the line: near copies just within the reach, just beyond it, and over its steps."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé漢😀") for _ in range(rnd.randint(1, 7)))
    docs = []
    for n in (30, 79, 129, 191, 193, 200, 256, 330, 512, 655):
        base = " ".join(word() for _ in range(n))[:n]
        k = min(max(n // reach.per, reach.least), reach.most)
        docs += [base, *(changed(rnd, base, e) for e in (0, 1, k - 1, k, k, k + 1, k + 2)), base[k:], base[: n - k], base[: n // 2] + "z" * (k + 1) + base[n // 2 :]]
    docs = [(i, x) for i, x in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert as_lines(line_dedup.line_classes(spark, df, reach=reach)) == brute_lines(docs, reach)


def test_line_classes_awkward(spark, awkward):
    """Null and repeated keys, repeated rows: one row a line, whatever the keys; lines of one class stay together."""
    rows = line_dedup.line_classes(spark, awkward).collect()
    lines = [(k, i, x) for k, t in awkward_texts() if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    assert sorted(((r["doc_id"], r["line_no"]) for r in rows), key=str) == sorted(((k, i) for k, i, _ in lines), key=str)
    assert line_dedup.line_classes(spark, awkward.limit(0)).count() == 0
    want = brute_lines(sorted(awkward_texts(), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert all((r["class_key"], r["class_line_no"], r["n_links"]) in {v[:3] for v in want.values()} for r in rows)


def test_drop_repeated_lines(spark, awkward):
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark, awkward).collect() if r["doc_id"] is not None}
    kept = as_lines(line_dedup.line_classes(spark, awkward))
    for k, t in awkward_texts():
        if k is not None and t is not None:
            want = [x for i, x in enumerate(t.split("\n")) if not x.strip(" \t") or kept[(k, i)][3]]
            assert got[k] == "\n".join(want)
    assert line_dedup.drop_repeated_lines(spark, awkward).columns == awkward.columns


def test_drop_repeated_lines_by_row(spark):
    line = lambda k: f"line {k} {sha(str(k))}"
    docs = [(1, line(0)), (None, f"{line(1)}\n{line(0)}\n{line(2)}"), (None, f"{line(3)}\n{line(4)}\n{line(5)}"), (None, f"{line(6)}\n{line(7)}\n{line(5)}")]
    docs += [(9, f"{line(8)}\n{line(9)}"), (9, f"{line(0)}\n{line(10)}"), (9, None), (None, None)]
    got = line_dedup.drop_repeated_lines(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(docs)
    left = [x for r in got if r["text"] for x in r["text"].split("\n")]
    assert sorted(left) == sorted(line(k) for k in range(11))
    assert (9, f"{line(8)}\n{line(9)}") in [tuple(r) for r in got]


# ---------------------------------------------------------------- 2 substring dedup


def brute_substrings(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((k, len(w), len(gone), sha(" ".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(spark, documents, texts, small):
    size = {"chunk_bytes": 20_000, "bucket_bytes": 30_000} if small else {}
    got = substring_dedup.substring_dedup(spark, documents, **size)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute_substrings(texts.items())


def test_substring_dedup_awkward(spark, awkward):
    got = substring_dedup.substring_dedup(spark, awkward)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_substrings(awkward_texts())
    kept = substring_dedup.substring_dedup(spark, awkward, keep_text=True)
    assert {r["text"] for r in kept.where("n_removed = 0").collect()} <= {t or "" for _, t in awkward_texts()} | {None}
    assert substring_dedup.substring_dedup(spark, awkward.limit(0)).count() == 0


# ---------------------------------------------------------------- 3 SimHash


def test_trie_links():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    near = np.concatenate([a[:30] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(15)])
    a, b = np.unique(np.concatenate([a, near])), np.unique(near[::2] ^ np.uint64(4))
    for other in (None, b):
        got = [(int(i), int(j)) for x, y in simhash.trie_links(a, other, 2, width=64) for i, j in zip(x, y)]
        o = a if other is None else other
        want = {(i, j) for i in range(len(a)) for j in range(len(o)) if (other is not None or i < j) and int(a[i] ^ o[j]).bit_count() <= 2}
        assert len(got) == len(set(got)) and set(got) == want


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_simhash(docs):
    docs = list(docs)
    fp = [brute_fingerprint(t) for _, t in docs]
    label = np.arange(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                components.unite(label, np.array([i]), np.array([j]))
    least = defaultdict(lambda: None)
    for (k, _), c in zip(docs, label.tolist()):
        if k is not None:
            least[c] = k if least[c] is None else min(k, least[c])
    return sorted(((k, f"{f:016x}", least[c]) for (k, _), f, c in zip(docs, fp, label.tolist())), key=str)


def test_simhash(spark, documents, texts, awkward):
    assert sorted((tuple(r) for r in simhash.simhash_dedup(spark, documents).collect()), key=str) == brute_simhash(texts.items())
    assert sorted((tuple(r) for r in simhash.simhash_dedup(spark, awkward).collect()), key=str) == brute_simhash(awkward_texts())
    assert simhash.simhash_dedup(spark, awkward.limit(0)).count() == 0


# ---------------------------------------------------------------- 4 BPE, 7 packing


def odd_strings(n, seed):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABC'  \n\t'1234 .,!? éßñ漢字😀 stlrevmdİΣς́\x85\x1c　"
    fixed = ["a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|> <|endoftext|><|endoftext|> ", "<|endo", "'s 're'll'd'vex don't 'S", "'", "''s", "a\n\n b  \n", "   ", "a" * 300, "ź", "", "ab" * 3000]
    return fixed + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 100))) for _ in range(n)]


def test_bpe_is_exact():
    from tokenizers import Tokenizer

    lib, own, strings = Tokenizer.from_file(BYTES), bpe.Codec.of(BYTES), odd_strings(1500, 1)
    ids, first = own.encode_texts(pa.array(strings))
    for k, t in enumerate(strings):
        mine = ids[first[k] : first[k + 1]]
        assert mine.tolist() == lib.encode(t, add_special_tokens=False).ids
        assert own.bpe.decode(mine).tobytes().decode() == t == lib.decode(mine.tolist(), skip_special_tokens=False)
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in rng.integers(1, 40, 300)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    many, count = own.bpe.merge_many(data, end - np.array([len(w) for w in words]), end)
    assert many.tolist() == [i for w in words for i in own.bpe.merge(w)] and count.sum() == len(many)


def test_bpe_digest(spark, awkward):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    got = sorted((tuple(r) for r in bpe.bpe_digest(awkward, BYTES).collect()), key=str)
    want = []
    for k, t in awkward_texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or "")))
    assert got == sorted(want, key=str)
    full = bpe.bpe_digest(awkward, BYTES, full=True).where("doc_id = 4").first()
    assert full["decoded"] == awkward_texts()[4][1] and len(full["ids"]) == full["n_tokens"]
    assert bpe.bpe_digest(awkward.limit(0), BYTES).count() == 0


def test_word_ids():
    from tokenizers import Tokenizer

    lib, own, strings = Tokenizer.from_file(WORDS), packing.WordIds.of(WORDS), odd_strings(800, 3)
    ids, first = own.encode(pa.array(strings))
    for k, t in enumerate(strings):
        assert ids[first[k] : first[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids


def packed_well(rows, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    by_seq, by_doc, padding, total = defaultdict(list), defaultdict(list), 0, 0
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for k, t in docs:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            if r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()):
                at += r["length"]
        assert at == len(ids)
    return padding / total


def test_packing(spark, documents, texts, awkward):
    assert packed_well(packing.pack(documents, WORDS).collect(), texts.items()) < 0.01
    keyed = [(k, t) for k, t in awkward_texts() if k not in (6, None)]
    rows = packing.pack(awkward, WORDS).collect()
    packed_well(rows, keyed)
    assert len({r["doc_id"] for r in rows}) == len({k for k, _ in awkward_texts()})
    assert packing.pack(awkward.limit(0), WORDS).count() == 0


def test_step_groups(spark, documents, awkward):
    """Groups of one length and equal tokens over all tasks; one partial group a length."""
    for docs, step in ((documents.repartition(7), 1 << 14), (awkward, 4096), (awkward.limit(0), 4096)):
        packed = packing.table(spark, packing.pack(docs, WORDS))
        rows = packing.deal_steps(packed, step).collect()
        assert sorted((tuple(r)[:-1] for r in rows), key=str) == sorted(map(tuple, packed.drop("tier_no").collect()), key=str)
        groups, partial = defaultdict(dict), Counter()
        for r in rows:
            assert groups[r["step_group"]].setdefault(r["sequence_id"], r["tier"]) == r["tier"]
        for windows in groups.values():
            (tier,) = set(windows.values())
            assert tier * len(windows) <= max(step, tier)
            partial[tier] += tier * len(windows) < step - tier + 1
        assert all(n <= 1 for n in partial.values())


# ---------------------------------------------------------------- 5 fingerprints


def test_entropies():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 105, 300), np.full(100, 65), rng.integers(0, 256, 200)]).astype(np.uint8)
    got = fingerprint.entropies(x) / (64 * fingerprint._SCALE)
    for i in range(0, len(got), 7):
        p = np.bincount(x[i : i + 64]) / 64
        assert got[i] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum(), abs=1e-4)
    old, fingerprint._BLOCK = fingerprint._BLOCK, 90
    try:
        assert (fingerprint.entropies(x) / (64 * fingerprint._SCALE) == got).all()
    finally:
        fingerprint._BLOCK = old


def test_likeness():
    rnd = random.Random(9)
    a, b = (" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(800)) for _ in range(2))
    x, y, z, none = fingerprint.digests([a, a[: len(a) * 3 // 4] + b[: len(b) // 4], b, ""])
    assert fingerprint.likeness(x, x) == 1.0 and fingerprint.likeness(x, y) > 0.6 and fingerprint.likeness(x, z) < 0.1
    assert fingerprint.likeness(none, none) == 1.0 and fingerprint.likeness(none, x) == fingerprint.likeness(x, none) == 0.0
    back = fingerprint.read_back(fingerprint.spelled(x))
    assert (back[0] == x[0]).all() and (back[1] == x[1]).all() and len(fingerprint.read_back("")[1]) == 0


def plain_digest(text):
    """Filters as whole numbers and the features in each, window by window, from the definition."""
    data, f = text.encode(), fingerprint
    n = len(data) - f.WINDOW + 1
    if len(data) < f.FULL:
        chosen = [(i, data[i : i + f.SHORT]) for i in range(max(1, len(data) - f.SHORT + 1))] if data else []
    else:
        table = [0] + [round(f._SCALE * c * np.log2(c)) for c in range(1, f.WINDOW + 1)]
        rank = []
        for i in range(n):
            e = (f.WINDOW * 6 * f._SCALE - sum(table[c] for c in Counter(data[i : i + f.WINDOW]).values())) / (f.WINDOW * f._SCALE)
            rank.append(511 if e < f.TRIVIAL else 510 - min(int(abs(e - f.USUAL) * 256), 510))
        popular = Counter(min(range(i, min(i + f.STRETCH, n)), key=lambda k: (rank[k], k)) for i in range(n))
        least = min(f.LEAST_POPULAR, max(popular.values()))
        chosen = [(i, data[i : i + f.WINDOW]) for i in sorted(popular) if popular[i] >= least]
    found = list(dict.fromkeys(w for _, w in chosen))
    out = []
    for at in range(0, len(found), f.PER_FILTER):
        bits = 0
        for w in found[at : at + f.PER_FILTER]:
            body = np.frombuffer(w, np.uint8)
            h = int(spans_hash(body, np.array([0]), np.array([len(w)]))[0])
            for k in range(f.BITS_EACH):
                bits |= 1 << (h >> (11 * k) & (f.FILTER_BITS - 1))
        out.append((bits, len(found[at : at + f.PER_FILTER])))
    return out


def plain_likeness(a, b):
    if (len(a), sum(n for _, n in a)) > (len(b), sum(n for _, n in b)):
        a, b = b, a
    if not a:
        return 0.0 if b else 1.0
    total = 0.0
    for x, n in a:
        best = 0.0
        for y, _ in b:
            chance = x.bit_count() * y.bit_count() / fingerprint.FILTER_BITS
            most = min(x.bit_count(), y.bit_count())
            best = max(best, min(1.0, max(0.0, ((x & y).bit_count() - chance) / max(most - chance, 1e-9))))
        total += best * n
    return total / sum(n for _, n in a)


def test_digests_are_as_defined(texts):
    some = [t for t in texts.values() if t and len(t) < 6000][:60] + [t or "" for _, t in awkward_texts() if len(t or "") < 5000]
    some += ["x" * 200, "ab" * 100, "The quick " * 40, "é漢😀 " * 60]
    got, want = fingerprint.digests(some), [plain_digest(t) for t in some]
    for t, (rows, held), plain in zip(some, got, want):
        assert [(int.from_bytes(r.tobytes(), "little"), n) for r, n in zip(rows, held.tolist())] == plain, t[:80]
    for i in range(0, len(some) - 1):
        assert fingerprint.likeness(got[i], got[i + 1]) == pytest.approx(plain_likeness(want[i], want[i + 1]), abs=1e-12)


def test_fingerprints_tell_edited_from_other(spark, documents):
    """Of whole documents of 400 characters or more, the edited text is found and the next document is not."""
    r = fingerprint.fingerprints(documents).where("n_chars >= 400").collect()
    assert sum(x["near_edited"] >= 0.3 for x in r) >= 0.98 * len(r)
    assert sum(x["near_next"] < 0.3 for x in r) >= 0.95 * len(r)


def test_every_text_has_a_feature():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    long = [" ".join(word() for _ in range(80)) for _ in range(40)]
    rising = "".join(chr(97 + i % (2 + i // 20)) for i in range(400))
    texts = [t[:n] for t in long for n in range(1, 200, 3)] + [rising[:n] for n in range(1, 401)] + [rising[::-1][:n] for n in range(1, 401)]
    for t, d in zip(texts, fingerprint.digests(texts)):
        assert len(d[1]) and d[1].sum() > 0 and fingerprint.spelled(d), (len(t), t)
    for n in (64, 70, 90, 110, 126):
        own = fingerprint.digests([t[:n] for t in long])
        copy = fingerprint.digests([t[: n - n // 4] + u[: n // 4] for t, u in zip(long, long[1:] + long[:1])])
        assert all(fingerprint.likeness(a, b) > 0.4 for a, b in zip(own, copy))
        assert all(fingerprint.likeness(a, b) < 0.3 for a, b in zip(own, own[1:]))


@pytest.mark.parametrize("run_bytes", [6 << 20, 2000, 30])
def test_fingerprints(spark, documents, texts, run_bytes):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(documents, run_bytes=run_bytes).collect()}
    order = sorted(texts)
    assert len(got) == len(order)
    for k, nxt in zip(order, [*order[1:], order[0]]):
        t = texts[k]
        edited = t[: len(t) - len(t) // 4] + texts[nxt][: len(t) // 4]
        own, new, other = fingerprint.digests([t, edited, texts[nxt]])
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.spelled(own), fingerprint.spelled(new))
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(own, new), fingerprint.likeness(own, other))


def test_fingerprints_awkward(spark, awkward):
    got = fingerprint.fingerprints(awkward).collect()
    assert len(got) == len(awkward_texts()) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprint.fingerprints(awkward.limit(0)).count() == 0
    one = fingerprint.fingerprints(awkward.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


# ---------------------------------------------------------------- 6 language ID, 10 quality


def test_language_id(spark, documents, awkward):
    r = language_id.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r)
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.97 * len(held) and all(0 <= x["score"] <= 1 for x in r)
    odd = {x["doc_id"]: x for x in language_id.language_id(awkward).collect()}
    assert [odd[k]["lang_pred"] for k in (0, 1, 2, 16)] == ["und"] * 4 and odd[3]["lang_pred"] == "en"
    assert language_id.language_id(awkward.limit(0)).count() == 0
    assert {x["lang_pred"] for x in language_id.language_id(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_language(docs, least=1e-4):
    """Language and score of each text, with exact sets of trigrams in the place of filters."""
    grams = lambda t: [w[i : i + 3] for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split() for w in [f" {w} "] for i in range(len(w) - 2)]
    count = defaultdict(Counter)
    for lang, t in {(lang, t) for k, t, lang in docs if lang and t is not None and zlib.crc32(str(k).encode()) % 4 != 2}:
        count[lang].update(grams(t))
    known = {lang: {g for g, n in c.items() if n >= least * c.total()} for lang, c in count.items()}
    usual = {lang: sum(c[g] for g in known[lang]) / c.total() for lang, c in count.items()}
    out = {}
    for k, t, _ in docs:
        own = grams(t)
        score = {lang: sum(g in known[lang] for g in own) / len(own) / usual[lang] for lang in known} if own else {}
        out[k] = (max(sorted(score), key=score.get), min(1.0, max(score.values()))) if own else ("und", 0.0)
    return out


def test_language_id_is_as_defined(spark, documents):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    want = plain_language(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(documents).collect()}
    assert sum(got[k][0] == want[k][0] for k in want) >= len(want) - 1
    assert max(abs(got[k][1] - want[k][1]) for k in want) < 0.05


def test_language_sample_counts_texts_once(spark):
    """A text that nearly all rows of a language share is one text of the sample."""
    one = "the same words in every row of this language and nothing else besides them"
    rows = [(k, one, "en", None, 0) for k in range(3000)] + [(5000 + k, f"quite other english sentence number {sha(str(k))}", "en", None, 0) for k in range(50)]
    rows += [(9000 + k, f"ein ganz anderer deutscher satz {sha(str(k))}", "de", None, 0) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.fit(docs, most_texts=100)
    assert model.predict(["other english sentence", "anderer deutscher satz"])[0] == ["en", "de"]


def test_language_filters():
    grams = {f"l{k:03d}": np.arange(k * 40, k * 40 + 60, dtype=np.uint64) for k in range(70)}
    m = language_id.Model(grams, dict.fromkeys(grams, 1.0))
    assert m.table.shape[0] == 2
    for k, lang in enumerate(m.langs):
        for at in language_id.slots(grams[lang], m.mask):
            assert ((m.table[k // 64][at] >> np.uint64(k % 64)) & np.uint64(1)).all()
    assert m.false.max() < 0.05


def test_quality(spark, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality.quality(docs, labels).join(labels, "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and x["predicted"] == (x["score"] >= 0.3) for x in r)
    assert sum(x["predicted"] == x["quality"] for x in held) >= 0.95 * len(held)
    some = spark.createDataFrame([(1, 0), (6, 1), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality(awkward, some).collect()
    assert len(got) == len(awkward_texts()) and all(0 <= x["score"] <= 1 for x in got)
    assert {x["score"] for x in quality.quality(awkward, some.limit(0)).collect()} == {0.5}
    assert quality.quality(awkward.limit(0), some).count() == 0


def plain_statistics(text):
    """The statistics of one text, counted one by one."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if x]
    chars, n = len(text or ""), len(words)
    share = lambda part, whole, more: (lambda p: math.log((p + 0.01) / (1.01 - p)))(part / (whole + more))
    marks = b".,;:'\"-?()"
    blank = b" \t\n\x0b\x0c\r"
    odd = lambda c: c < 128 and not chr(c).isalnum() and c not in marks and c not in blank
    capitals = sum(65 <= c <= 90 for c in data) + sum("À" <= c <= "Þ" for c in text or "")
    letters = sum(chr(c).isalpha() for c in data if c < 128) + sum(c > "\x7f" for c in text or "")
    size = [len(w) for w in words]
    mean = sum(size) / max(n, 1)
    spread = math.sqrt(max(0.0, sum(s * s for s in size) / max(n, 1) - mean * mean))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), math.log((len(set(words)) + 1) / (n + 1)) / max(1.0, math.log1p(n)),
        share(sum(a == b for a, b in zip(words, words[1:])), n, 20), share(sum(map(odd, data)), chars, 100), share(sum(c in marks for c in data), chars, 100),
        share(sum(48 <= c <= 57 for c in data), chars, 100), share(capitals, letters, 100), share(sum(odd(w[-1]) for w in words), n, 20),
        math.log1p(chars / max(len(lines), 1)), share(len(lines) - len(set(lines)), len(lines), 6), share(sum(c >= 128 for c in data), chars * 2, 100),
    ]


def plain_scores(rows, label, new):
    """Posterior of label 1 by two normal densities with shrunk covariances, solved without factors."""
    middle, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3)
    z, y = (rows - middle) / scale, (new - middle) / scale
    log = []
    for k in (0, 1):
        own = z[label == k]
        cov = np.cov(own, rowvar=False, bias=True)
        cov = 0.7 * (0.9 * cov + 0.1 * np.diag(np.diag(cov))) + 0.3 * np.eye(len(cov))
        d = y - own.mean(axis=0)
        log.append(-0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T) - 0.5 * np.linalg.slogdet(cov)[1] + math.log((label == k).sum() + 1))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def test_quality_is_as_defined(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    keys = sorted(text)
    x = {k: plain_statistics(text[k]) for k in keys}
    odd = [t for _, t in awkward_texts()]
    assert np.allclose(quality.statistics(pa.array(odd)), [plain_statistics(t) for t in odd], atol=1e-9)
    want = plain_scores(np.array([x[k] for k, _ in sorted(known)]), np.array([q for _, q in sorted(known)]), np.array([x[k] for k in keys]))
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels.union(labels)).collect()}
    assert np.allclose([got[k] for k in keys], want, atol=1e-6)


# ---------------------------------------------------------------- 8 embeddings


def brute_links(rows, least=0.98):
    ok = {}
    for n, (k, v, lab) in enumerate(rows):
        if k is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[n] = np.array(v, float)
    label, links = np.arange(len(rows)), [0] * len(rows)
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and float(ok[i] @ ok[j]) / (np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])) >= least:
                links[i] += 1
                links[j] += 1
                components.unite(label, np.array([i]), np.array([j]))
    least_key = {}
    for n in ok:
        c = int(label[n])
        least_key[c] = min(least_key.get(c, rows[n][0]), rows[n][0])
    return sorted(((r[0], links[n], least_key[int(label[n])] if n in ok else r[0]) for n, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("block", "fan"), [(4096, 64), (40, 8), (12, 3)])
def test_embeddings(spark, block, fan):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = []
    for k in range(400):
        v = centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.1, 0.3])
        rows.append((k, [float(np.float32(x * (3 if k % 7 == 0 else 1))) for x in v], int(rng.integers(3))))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [None] + [1.0] * 7, 1), (905, rows[0][1], None), (None, rows[0][1], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"vec": F.lit("x"), "rep": F.lit(1)}).repartition(3)
    got = embedding_dedup.embedding_dedup(spark, df, block_bytes=block * 64, fan=fan).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.embedding_dedup(spark, df.limit(0)).count() == 0


def test_embeddings_dense_and_tied(spark):
    """Cells that must link as a whole, visitors that link with all of a cell, vectors of one direction, ties at the bound."""
    rng = np.random.default_rng(7)
    a, b = np.eye(6)[:2]
    rows = [(k, (a * 3 + rng.normal(size=6) * 0.02).tolist(), 1) for k in range(120)]
    rows += [(k, (a * 3 + b * rng.choice([0.1, 0.3, 0.6]) + rng.normal(size=6) * 0.01).tolist(), 1) for k in range(200, 300)]
    rows += [(400 + k, (a * (k + 1)).tolist(), 2) for k in range(60)]
    rows += [(500 + k, (a * 49 + b * 7 * (k % 2)).tolist(), 3) for k in range(4)]
    turn = lambda t: [float(np.cos(t)), float(np.sin(t))]
    rows += [(600 + k, turn(k * np.arccos(0.98)), 4) for k in range(40)]
    rows += [(700, [0.98, 0.19899748742132398], 5), (701, [1.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for block, fan in ((4096, 64), (30, 4)):
        got = embedding_dedup.embedding_dedup(spark, df, block_bytes=block * 48, fan=fan).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_links(rows)


def test_embedding_groups_are_bounded(spark, monkeypatch):
    """Many labels, each larger than a block: every one is split, and no task gets more than its share."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    rows = [(k, (centres[k % 60] + rng.normal(size=16) * 0.05).tolist(), k % 20) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sizes = []
    leaf = embedding_dedup._leaf

    def spy(x, least, block):
        a, c = F.ceil(F.col("n") / block), F.ceil(F.when(F.col("closed"), F.col("v")).otherwise(F.col("n") + F.col("v")) / (2 * block))
        sizes.extend(r[0] for r in x.select(F.col("n") / a + F.col("v") / F.greatest(c, F.lit(1))).distinct().collect())
        return leaf(x, least, block)

    monkeypatch.setattr(embedding_dedup, "_leaf", spy)
    out = embedding_dedup.embedding_dedup(spark, df, block_bytes=50 * 128, fan=8)
    assert len(sizes) > 1 and max(sizes) <= 3 * 50
    assert out.count() == 4000


def test_cover_tree():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(500, 6))
    unit = embedding_dedup._unit(v)
    t = embedding_dedup.CoverTree(unit)
    for n in range(len(t.centre)):
        own = t.order[slice(*t.span[n])]
        assert (np.linalg.norm(unit[own] - unit[t.centre[n]], axis=1) <= t.radius[n] + 1e-7).all()
        if t.kids[n][1]:
            assert [t.span[n][0], t.span[n][1]] == [t.span[t.kids[n][0]][0], t.span[t.kids[n][1] - 1][1]]


# ---------------------------------------------------------------- 9 URL filters


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [None, "", "x", "http://", "http://a.org", "http://A.ORG/", "http://example.org/es/1", "https://www.Example.org/en/12?q=/es/", "http://badexample.org/es/", "ftp://x.com/fr/#a", "http://x.com/de/é", "http://com/de/", "a://b://org/", "http://x.org?y/", "http://ÄÖ.org/", "http://u@x.com:80/fr/", "http://org/\n", "http://.org/", "http://example.org./es/"]


def test_url_filter(spark, monkeypatch):
    urls = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5])] * 3 + [(7, URLS[7]), (8, "http://org/" + "y" * 70_000)]
    df = spark.createDataFrame([(*x, "h", "p", "r") for x in urls], "page_id long, url string, host string, entry string, probe string").repartition(3)
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    want = sorted(((i, *brute_url(u, url_filter.RULES)) for i, u in urls), key=str)
    assert sorted((tuple(r) for r in url_filter.url_filter(spark, df, rules).collect()), key=str) == want
    with monkeypatch.context() as m:
        m.setattr(url_filter, "MOST_LISTED", 0)
        assert sorted((tuple(r) for r in url_filter.url_filter(spark, df, rules).collect()), key=str) == want
    twice = rules.union(spark.createDataFrame([("block", "org", "/"), ("allow", "com", "/de/"), (None, "org", "/x"), ("allow", None, "/")], rules.schema))
    want = sorted(((i, *brute_url(u, [*url_filter.RULES[1:], ("block", "org", "/")])) for i, u in urls), key=str)
    assert sorted((tuple(r) for r in url_filter.url_filter(spark, df, twice).collect()), key=str) == want
    assert {r["verdict"] for r in url_filter.url_filter(spark, df, rules.limit(0), otherwise="block").collect()} == {"block"}
    assert url_filter.url_filter(spark, df.limit(0), rules).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 20_000])
def test_url_filter_of_many_shapes(spark, monkeypatch, most):
    """100,000 entries of some 500 shapes; a list that is sent whole, and one that is dealt out."""
    monkeypatch.setattr(url_filter, "MOST_LISTED", most)
    monkeypatch.setattr(url_filter, "_RANGE", 1 << 12)
    rnd = random.Random(12)
    host = lambda: ".".join(f"h{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 8)))
    path = lambda n: ("/" + "".join(rnd.choice("ab/") for _ in range(n)))[: n + 1]
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((host(), path(rnd.randint(0, 62))) for _ in range(100_000))}.values())
    urls = [f"http://{host()}{path(rnd.randint(0, 9))}" for _ in range(300)] + [f"x://{rnd.choice(['', 'w.', 'q.h3.'])}{h}{p}{rnd.choice(['', 'z', '?q'])}" for _, h, p in rnd.sample(rules, 300)]
    by = defaultdict(list)
    for r in rules:
        by[r[1]].append(r)
    some = lambda u: [r for k in range(len(u)) for r in by.get(u.split("://")[1].split("/")[0][k:], []) if k == 0 or u.split("://")[1][k - 1] == "."]
    want = sorted(((i, *brute_url(u, some(u))) for i, u in enumerate(urls)), key=str)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    out = url_filter.url_filter(spark, df, spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    few = url_filter.url_filter(spark, df, spark.createDataFrame(rules[: most // 50_000 + 1], "verdict string, host string, path string"))
    joins = lambda q: q._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    if most > 1 << 17:
        assert joins(out) == joins(few)
    assert joins(out) <= 6
    assert len({(r[1].count("."), len(r[2])) for r in rules}) > 450


def test_url_filter_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    assert sorted(map(tuple, url_filter.op9_url_filter(spark, DIR).collect()), key=str) == sorted(con.sql(url_filter.ORACLE).fetchall(), key=str)


def test_url_filter_runs_no_python(spark):
    plan = url_filter.op9_url_filter(spark, DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- pipeline


def test_stages_on_awkward_rows(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name == "packing":
            assert out.count() > 0
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), DIR).count() == 0


def test_language_stage(spark, documents):
    """Letters in no order of a learned language go, whatever the row's own columns are called; clean documents stay."""
    rnd = random.Random(3)
    junk = [" ".join("".join(rnd.choice("qxzkwvjy") for _ in range(7)) for _ in range(60)), "ąęśćżźń " * 30]
    extra = spark.createDataFrame([(10**9 + k, x, None, "s", len(x)) for k, x in enumerate(junk)], documents.schema)
    docs = documents.unionByName(extra).withColumns({"score": F.lit("mine"), "lang_pred": F.lit(7)})
    got = corpus_pipeline.known_language(spark, docs, DIR)
    assert got.columns == docs.columns and {(r["score"], r["lang_pred"]) for r in got.collect()} == {("mine", 7)}
    kept = {r["doc_id"] for r in got.collect()}
    assert kept == {r["doc_id"] for r in documents.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])}


def test_line_stage_by_row(spark):
    """Null and repeated keys, rows of one key with different texts, repeated rows: only repeated lines go."""
    docs = [(1, "xx line\nunique y"), (1, "zz line\nxx line"), (None, "p1\nq1"), (None, "r1\np1"), (None, "p1\nq1"), (2, ""), (3, None), (None, None)]
    df = spark.createDataFrame([(k, t, "s", len(t or "")) for k, t in docs], "doc_id long, text string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.line_dedup(spark, df, DIR).collect()
    assert len(got) == len(docs) and all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    left = Counter(x for r in got if r["text"] for x in r["text"].split("\n"))
    assert set(left) == {"xx line", "unique y", "zz line", "p1", "q1", "r1"} and left["unique y"] == left["zz line"] == left["r1"] == 1
    assert left["xx line"] == 1 and left["p1"] <= 2 and left["q1"] <= 2


def test_near_dedup_by_row(spark):
    rnd = random.Random(8)
    a, b, c, d, e, f = (" ".join(sha(str(rnd.random()))[:7] for _ in range(40)) for _ in range(6))
    docs = [(None, a), (None, b), (None, b), (None, c), (5, c), (6, c), (7, d), (7, e), (7, e), (8, f), (8, a)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), DIR).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(8, a), (None, b), (5, c), (7, d), (7, e), (8, f)], key=str)


def test_pipeline(spark, documents, texts):
    kept = documents
    want = {k: t for k, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    kept = corpus_pipeline.known_language(spark, kept, DIR)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    lines = brute_lines(sorted(want.items()))
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in lines or lines[(k, i)][3]) for k, t in want.items()}
    kept = corpus_pipeline.line_dedup(spark, kept, DIR)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    want = {k: want[k] for k, _, c in brute_simhash(want.items()) if k == c}
    kept = corpus_pipeline.near_dedup(spark, kept, DIR)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    kept = corpus_pipeline.repeated_passages(spark, kept, DIR)
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    for k, n, gone, digest in brute_substrings(want.items()):
        assert got[k] == want[k] if not gone else sha(got[k]) == digest
    assert packed_well(corpus_pipeline.packing(spark, kept, DIR).collect(), got.items()) < 0.02
