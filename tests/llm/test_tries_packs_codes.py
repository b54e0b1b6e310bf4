"""Prefix trie, retrieval packing and vector codes against plain programs."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import cases  # noqa: E402
from pvseries.llm import prefix_trie, retrieval_packing as packing, vector_codes as codes  # noqa: E402
from pvseries.llm.common import tokenizer_path  # noqa: E402
from pvseries.sources.tables import materialise  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, shard long, n1 long, first string, pos int, depth string"


# -- prefix trie --------------------------------------------------------------------

def plain_trie(turns):
    """Every node of the trie of rebuilt conversations, from (conv, turn, role, text) without ties in turn."""
    own = defaultdict(list)
    for c, t, r, x in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0)):
        own[c].append((r or "", x or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        size = len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * size
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == n).encode()).hexdigest()) for n, m in members.items()]


def some_turns():
    rng = random.Random(5)
    out = []
    for c in [*range(0, 60), *range(-12, -3), 71, 72]:
        for t in range(rng.randrange(0, 14)):
            out.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "bot", None]),
                        rng.choice([None, "", "same", "same", f"own {c}", "é" * 9])))
    out += [(c, 1, "user", "hello there") for c in range(100, 140)]   # one very common conversation
    out += [(200, t, "user", f"turn {t % 3}") for t in range(500)]    # a very long one, and one that shares its start
    out += [(201, t, "bot", "short") for t in range(3)] + [(None, 1, "user", "of nobody"), (None, None, None, None)]
    return out


@pytest.mark.parametrize("shard_rows", [1 << 18, 11])
def test_prefix_trie(spark, shard_rows):
    turns = some_turns()
    rows = [(*t, 7, 8, "f", 1, "d") for t in turns]
    df = materialise(spark.createDataFrame(rows, TURNS).repartition(3), "turns")
    got = prefix_trie.prefix_trie(df, shard_rows=shard_rows).drop("n1", "n2").collect()
    assert Counter(map(tuple, got)) == Counter(plain_trie(turns))


def test_prefix_trie_of_repeated_rows_and_empty_tables(spark):
    twice = [(5, 1, "user", "a")] * 2 + [(5, 1, "bot", "b")]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*t, 7, 8, "f", 1, "d") for t in twice], TURNS))
    assert sorted(r["depth"] for r in got.collect()) == [0, 1, 2, 3]
    empty = prefix_trie.trie_report(materialise(spark.createDataFrame([], TURNS), "no-turns"))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"


def test_turns_with_equal_numbers_are_ordered_by_role_and_text(spark):
    rng = random.Random(8)
    turns = [(c, rng.choice([None, 1, 2]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", None, "é", f"own {c % 3}"]))
             for c in range(25) for _ in range(rng.randrange(1, 9))]
    rng.shuffle(turns)
    df = materialise(spark.createDataFrame([(*t, 7, 8, "f", 1, "d") for t in turns], TURNS).repartition(3), "tied-turns")
    got = prefix_trie.trie_report(df).collect()
    # The plain program keeps the order of rows that are equal in turn.
    assert Counter(map(tuple, got)) == Counter(plain_trie(sorted(turns, key=lambda t: (t[2] or "", t[3] or ""))))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, (5000, 2)), axis=0)
    table = prefix_trie.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert (table.stored[table.slots(keys)] == keys).all()
    assert (table.slots(keys + 1) == -1).all() and len(table.slots(keys[:0])) == 0


def test_digests_of_prefixes_do_not_depend_on_cuts():
    bases = prefix_trie.lane_bases(0)
    assert prefix_trie.powers(np.array([0, 1, 5, 10**6]), bases).tolist() == [[pow(int(b), e, prefix_trie.PRIME) for b in bases]
                                                                                for e in (0, 1, 5, 10**6)]


# -- packing ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def gpt(spark):
    return packing.encoder(tokenizer_path("byte_bpe_50k.json"))


def test_ids_are_the_librarys(gpt):
    rng = random.Random(3)
    letters = ["a", "B", " ", "  ", "\n", "\t", "'s", "’", "é", "ß", "的", "١", "½", " ", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "<|", "1", "-", "_",
               "́", "ŉ", "ǅ", "don't", "I'LL", "‍", "﻿", "\r\n"]
    assert gpt.fast is not None
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        assert gpt.encode(text).tolist() == gpt.library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in (" " * 30_000, "x" * 30_000, "\n" * 5000 + "a"):
        assert gpt.encode(text).tolist() == gpt.library.encode(text, add_special_tokens=False).ids


def check_packing(df, got, gpt, window, padded_at_most):
    ids = defaultdict(list)
    for r in df.collect():
        ids[r["doc_id"]].append(gpt.library.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got.collect():
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, texts in ids.items():
        by_size = defaultdict(list)
        for t in texts:
            by_size[len(t)].append(t)
        for size, same in by_size.items():  # documents of one id and size can only be told apart together
            found = pieces.pop((doc, size))
            assert sum(n for _, n, _ in found) == size * len(same)
            cover = Counter(k for s, n, _ in found for k in range(s, s + n))
            assert set(cover) == set(range(size)) and set(cover.values()) == {len(same)}
            allowed = {(s, n): {zlib.crc32(np.array(t[s:s + n], "<u4").tobytes()) for t in same} for s, n, _ in found}
            assert all(c in allowed[s, n] for s, n, c in found)
    assert not pieces
    short = 0
    for held in places.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end and n > 0
            end += n
        assert end <= window
        short += end < window
    assert short <= padded_at_most


@pytest.mark.parametrize("table,shard_units,part_ids", [("awkward", 4, 2000), ("awkward", 4096, 1 << 22), ("small", 50, 20_000), ("empty", 5, 10)])
def test_packing(spark, gpt, table, shard_units, part_ids):
    df = {"awkward": lambda: spark.createDataFrame(cases.awkward(), cases.SCHEMA).repartition(3),
          "small": lambda: spark.read.parquet(f"{SMALL}/documents.parquet"),
          "empty": lambda: spark.createDataFrame([], cases.SCHEMA)}[table]()
    df = materialise(df, "packed-docs")
    got = materialise(packing.pack_documents(df, tokenizer_path("byte_bpe_50k.json"), shard_units=shard_units, part_ids=part_ids), "packs")
    rest = sum((len(gpt.encode(r["text"] or "")) + 1) % 1024 for r in df.collect())
    check_packing(df, got, gpt, 1024, -(-rest // part_ids))
    if table == "empty":
        assert got.count() == 0


def test_scores_are_bm25():
    rng = np.random.default_rng(4)
    units = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(25)]
    n, total = len(units), sum(map(len, units))
    frequencies = {t: sum(t in u for u in units) for t in range(30) if any(t in u for u in units)}
    weight = packing.idf(n, frequencies)
    index = packing.Index(units, weight, total / n)
    for seed in (0, 7):
        want = []
        for u in units:
            score = 0.0
            for t in set(units[seed].tolist()):
                tf, f = int((u == t).sum()), frequencies[t]
                score += max(0.0, math.log((n - f + .5) / (f + .5))) * tf * 2.2 / (tf + 1.2 * (1 - .75 + .75 * len(u) / (total / n)))
            want.append(score)
        assert np.allclose(index.search(seed), want)
    scores, size = np.array(want), np.array([len(u) for u in units])
    for gap in (3, 20, 100):
        fit = [i for i in range(n) if want[i] > 0 and size[i] <= gap]
        assert packing.best_that_fits(scores, size, gap) == (min(fit, key=lambda i: (-want[i], i)) if fit else None)


def test_a_window_holds_the_best_neighbours():
    rng = np.random.default_rng(9)
    topic = [rng.integers(k * 100, k * 100 + 60, 30) for k in (1, 2, 3, 4) for _ in range(4)]
    units = [topic[i] for i in rng.permutation(16)]
    frequencies = Counter(t for u in units for t in set(u.tolist()))
    windows, left, _ = packing.pack(units, packing.idf(16, frequencies), 30.0, 120, True)
    assert not left and len(windows) == 4
    assert all(len({int(units[u][0]) // 100 for u, _, _ in w}) == 1 for w in windows)


# -- vector codes -------------------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = []
    for i, v, label in rows:
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    k = size // parts
    split = [[v[p * k:(p + 1) * k] for p in range(parts)] for _, v, _ in kept]
    books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]

    def nearest():
        return [[min(((sum((a - b) ** 2 for a, b in zip(s[p], e)), j) for j, e in enumerate(books[p]))) for p in range(parts)] for s in split]

    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [s[p] for s, f in zip(split, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = [], Counter()
    for (i, _, label), f in zip(kept, nearest()):
        out.append((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), label))
        by_label[label] += out[-1][2]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, c, e, by_label[label], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, label in out]


VECTORS = "vec_id long, embedding array<double>, label string, part int, entry int, error string, code int, of int"


@pytest.mark.parametrize("scale,many", [(1.0, 150), (4e5, 100), (3e12, 90), (1e300, 80)])
def test_vector_codes(spark, scale, many):
    """The larger scales take several limbs, then Python's integers."""
    rng = random.Random(int(math.log10(scale)))
    vectors = [(i, [rng.gauss(0, 1) * scale for _ in range(32)], rng.choice(["a", "b", None])) for i in range(many)]
    vectors += [vectors[3], vectors[3], (None, [0.25 * scale] * 32, "a"), (7, None, "a"), (8, [None] * 32, "b"), (9, [float("nan")] * 32, "b"),
                (10, [1.0] * 31 + [float("inf")], "a"), (11, [], "a"), (12, [1.0] * 17, "a"), (1000, [1.0] * 16, "a")]
    df = materialise(spark.createDataFrame([(*v, 1, 2, "e", 3, 4) for v in vectors], VECTORS).repartition(3), "vectors")
    want = plain_codes(vectors)
    got = [tuple(r) for r in codes.code_report(df).collect()]
    if scale > 1e12:  # errors that no long can hold
        assert any(e is None for _, _, e, _, _ in got)
        want = [(i, c, e if e < 1 << 63 else None, None, d) for i, c, e, _, d in want]
        got = [(i, c, e, None, d) for i, c, e, _, d in got]
    assert Counter(got) == Counter(want)


def test_vector_codes_of_an_empty_table(spark):
    assert codes.code_report(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("bits", [3, 7, 25])
def test_limbs(bits):
    rng = np.random.default_rng(bits)
    a, b = rng.integers(-(1 << 28), 1 << 28, (2, 9, 4)), rng.integers(-(1 << 28), 1 << 28, (2, 4, 5))
    parts = codes.limbs(a, bits)
    assert (sum(p.astype(np.int64) << (bits * k) for k, p in enumerate(parts)) == a).all()
    assert (codes.exact_products(a, b, bits) == a.astype(object) @ b.astype(object)).all()
    assert 2 ** (2 * codes.limb_bits(4)) * 4 <= 2 ** 53
