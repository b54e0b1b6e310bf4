"""Corpus operators against plain programs, on awkward rows, empty tables and the smallest tables."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
from pvseries.llm import (blocks, counting, decontaminate, pieces, pii, quality, recompress, repair, secret_scan,  # noqa: E402
                          sharding, simhash)
from pvseries.llm.components import components  # noqa: E402
from pvseries.llm.common import tokenizer_path  # noqa: E402
from pvseries.llm.queries import QUERIES  # noqa: E402
from pvseries.sources.tables import materialise  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PIECES, BPE = "piece_bpe_32k.model", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward rows, stored."""
    return materialise(spark.createDataFrame(cases.awkward(), cases.SCHEMA).repartition(3), "awkward")


@pytest.fixture(scope="module")
def empty(spark):
    return materialise(spark.createDataFrame([], cases.SCHEMA), "empty")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


@pytest.fixture(scope="module")
def sp():
    return counting.piece_model(tokenizer_path(PIECES))


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_repair(request, table):
    from tokenizers import Tokenizer
    df = request.getfixturevalue(table)
    tok, want, start = Tokenizer.from_file(tokenizer_path(BPE)), [], 0
    coded = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in pairs(df)]
    got = sorted(map(tuple, repair.encode_to_files(df, tokenizer_path(BPE)).collect()), key=lambda r: r[1])
    same([(r[0], r[2], r[3]) for r in got], [(i, len(x), zlib.crc32(x.tobytes())) for i, x in coded])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda k: (k is not None, k))
    for r in got:
        assert r[1] == start
        start += r[2]


def test_chunk_ids_are_the_librarys_for_any_text_and_after_forgetting(monkeypatch):
    import random
    from tokenizers import Tokenizer
    monkeypatch.setattr(repair, "_CHUNKS_KEPT", 300)
    rng, tok, encoder = random.Random(9), Tokenizer.from_file(tokenizer_path(BPE)), repair.ChunkEncoder(tokenizer_path(BPE))
    parts = ["a", "th", "ing", "The", "É", "é", "×", "İ", "Σ", "ŉ", "'s", "'", "é", "\u0301", "=", "\u0338", "1", "23", "½", "中", "ᄀ", "ᅡ", "\u00a0",
             "\u2003", "\x1c", " ", " ", " ", "\n", ".", ",", "...", "!?", ")", "—", "</w>", "<|endoftext|>", "<|"]
    for k in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(10)] + ["", ".", " . "]
        got = encoder.encode([t.encode() for t in texts], k)
        assert got == [np.array(tok.encode(t, add_special_tokens=False).ids + [k], "<u4").tobytes() for t in texts]


def test_a_word_is_encoded_once_whatever_mark_follows(monkeypatch):
    asked, library = [], repair.ChunkEncoder._library
    monkeypatch.setattr(repair.ChunkEncoder, "_library", lambda self, new, *a: asked.extend(new) or library(self, new, *a))
    words = ["pré", "señor", "1984", "tower"]
    texts = [f"{w}{m} {w}" for w in words for m in (".", ",", ";", ":", "!", "?")]
    encoder = repair.ChunkEncoder(tokenizer_path(BPE))
    for _ in range(2):
        encoder.encode([t.encode() for t in texts], 2)
    assert len(asked) == len(words) + 6


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    ids = np.r_[rng.integers(3, 12, 4000), 2, np.full(999, 5), 2, [2], rng.integers(3, 9, 50), 2].astype(np.uint32)
    symbols, rules = repair.compress(ids, 100, 2, least=4)
    grammar = repair.Grammar(rules, repair.rule_lengths(rules, 100), 100)
    assert len(symbols) < len(ids) and (grammar.expand(symbols) == ids).all()
    assert not any(2 in grammar.expand(np.array([100 + k]))[:-1] for k in range(len(rules)))
    for a, b in ((0, 1), (17, 4300), (4999, 5002), (len(ids) - 1, len(ids))):
        assert (grammar.window(symbols, a, b) == ids[a:b]).all()
    none, no_rules = repair.compress(np.zeros(0, np.uint32), 100, 2)
    assert not len(none) and not len(no_rules)


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_token_counts(request, sp, table):
    df = request.getfixturevalue(table)
    got = counting.token_counts(df, tokenizer_path(PIECES), over=50, limit=300, group=900).collect()
    same(map(tuple, got), [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for i, t in pairs(df)])


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_pieces(request, sp, table):
    df = request.getfixturevalue(table)
    got = pieces.digests(pieces.piece_ids(df, tokenizer_path(PIECES), block_bytes=20_000)).collect()
    want = []
    for i, t in pairs(df):
        ids = sp.encode(t or "") + [2]
        want.append((i, len(ids), cases.sha(" ".join(map(str, ids))), cases.sha(sp.decode(ids))))
    same(map(tuple, got), want)


def test_marked_words_in_any_blanks(sp):
    import random
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b", " ", "  ", "▁", "the", "\n", "\t", "é", "①", "<s>"]) for _ in range(rng.randint(0, 9)))
        found = pieces.marked_words(text.encode())
        assert [i for x in (pieces.segment(sp, found) if found else []) for i in x] == sp.encode(text)


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_virtual_slots(request, table):
    df = request.getfixturevalue(table)
    placed, slot_map = sharding.shard_documents(df)
    got = placed.collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got],
         [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(df)])
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    if table == "small":
        assert max(loads) - min(loads) <= max(r["size"] for r in got)
    versions = {v: {r["vslot"]: r["shard"] for r in slot_map.where(f"version = {v}").collect()} for v in (1, 2)}
    assert all(versions[2][s] in (versions[1][s], 8) for s in versions[1])
    if table == "small":
        grown = Counter()
        for r in got:
            grown[versions[2][r["vslot"]]] += r["size"]
        assert 0.8 < grown[8] / (sum(loads) / 9) < 1.2


def test_repeated_record_is_spread(spark):
    df = materialise(spark.createDataFrame([(1, "same")] * 400 + [(k, "other") for k in range(800)], "doc_id long, text string"), "hot")
    loads = [r["b"] for r in sharding.shard_documents(df)[0].groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(loads) == 8 and max(loads) < 1.1 * min(loads)


def test_slots_do_not_depend_on_the_reading(spark):
    """A table read in other partitions and another order has the same records in the same slots."""
    rows = [(1, "same")] * 300 + [(k, f"text {k % 7}") for k in range(500)] + [(None, None)] * 5 + [(1, None), (1, "")]
    first = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    second = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7, "doc_id")
    got = [Counter(map(tuple, sharding.slotted(df).select("doc_id", "text_crc32", "size", "vslot").collect())) for df in (first, second)]
    assert got[0] == got[1] and sum(got[0].values()) == len(rows)
    # A map made from one read places the other.
    _, slot_map = sharding.shard_documents(first)
    a, b = (Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.assign(
        materialise(sharding.slotted(df), "slotted"), slot_map, 2).collect()) for df in (first, second))
    assert a == b


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_secret_base(request, table):
    df = request.getfixturevalue(table)
    got = secret_scan.find_secrets(df).collect()
    want = [(i, cases.sha(cases.base(t, cases.SECRETS))) for i, t in pairs(df)]
    same([(r["doc_id"], r["base_sha256"]) for r in got], want)
    for r in got:
        kept = [s for s in r["spans"].split(",") if s and not s.startswith("literal")]
        assert cases.sha(",".join(kept)) == r["base_sha256"] and len(kept) == r["n_assign"] + r["n_access"] + r["n_hex"]


def test_literals_by_target_names():
    def found(text):
        return [text[s:e] for _, s, e in secret_scan.literal_spans(text, secret_scan.base_spans(text))]

    assert found('db_pwd = "Tr0ub4dor&3x"') == ["Tr0ub4dor&3x"]
    assert found('k = "Zx9!kd82Qm"\nprivate_key: k') == ["Zx9!kd82Qm"]
    assert found("part = 'Zx9!kd8'\nauth_token = ${part}") == []  # too short
    assert found('clientSecret := "ab!12" + "CD?34"') == ['ab!12" + "CD?34']
    assert found('password = "changeme"\ncolour = "Zx9!kd82Qm"') == []
    assert found("") == [] and found("a : b = c :: d => ") == []


LONG = "aB3$" * 3000
PEM = "-----BEGIN PRIVATE KEY-----\nMIIEvQ+abc/1\nXyZ09==\n-----END PRIVATE KEY-----"


@pytest.mark.parametrize("before, literal, after", [
    ("passphrase = '", LONG, "'"), ("passphrase = ", LONG, "\n"), ("x" * 300 + "_passphrase = '", "p@ss#w0rd!99", "'"),
    ("passphrase" + " " * 40 + "=" + " " * 40 + "'", "p@ss#w0rd!99", "'"), ("dbpassword = '", "p@ss#w0rd!99", "'"),
    ("authtoken = '", "p@ss#w0rd!99", "'"), ("clientsecret: '", "p@ss#w0rd!99", "'"), ("DBPASSWORD='", "p@ss#w0rd!99", "'"),
    ("privatekey = '", "p@ss#w0rd!99", "'"), ("passphrase: '", "correct horse battery staple", "'"),
    ('private_key = "', PEM, '"'), ("private_key: |\n  ", PEM, "\n"), ('passphrase = "', 'a\\"b#C9!x\\"zz7', '"'),
    ('passphrase = """', "a#1\nB$2 \ncc%3dd", '"""')])
def test_literals_of_any_length_and_form(before, literal, after):
    text = before + literal + after
    assert ("literal", len(before), len(before) + len(literal)) in secret_scan.literal_spans(text, [])


def test_lexer_is_linear_and_keeps_plain_names():
    from time import perf_counter
    for text in ("a=\"" * 60_000, "a " + " " * 300_000, "x" * 300_000, "k=\"\\\"" * 60_000, "a:-----BEGIN X-----\n" * 15_000, "k: \"\"\"\\" * 40_000):
        began = perf_counter()
        list(secret_scan.pairs(text))
        assert perf_counter() - began < 10
    assert not any(map(secret_scan.name_score, ("author", "secretary", "tokenizer", "monkey", "keyboard", "authority")))


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_personal_base(request, table):
    df = request.getfixturevalue(table)
    got = pii.find_personal_data(df).collect()
    same([(r["doc_id"], r["base_sha256"]) for r in got], [(i, cases.sha(cases.base(t, cases.PERSONAL))) for i, t in pairs(df)])


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"{cases.prose(20, k)} reach me +1 (415) 555-{1000 + k} today") for k in range(30)]
    rows += [(100, f"{cases.prose(20, 7)} reach me 4155550177 today"), (101, "serial number 4155550177 here")]
    df = materialise(spark.createDataFrame(rows, "doc_id long, text string"), "told")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert got[100]["n_context"] == 1 and got[101]["n_context"] == 0 and got[3]["n_phone"] == 1
    text = dict(rows)[100]
    start = text.index("4155550177")
    assert got[100]["spans"] == f"context:{start}:{start + 10}"
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(df).collect()}
    assert "<CONTEXT>" in masked[100] and "<PHONE>" in masked[3] and masked[101] == dict(rows)[101]


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_near_duplicates(request, table):
    df = request.getfixturevalue(table)
    rows = pairs(df)
    prints = [cases.simhash(t) for _, t in rows]
    roots = cases.components(prints, 4)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    got = simhash.near_duplicates(df).collect()
    same(map(tuple, got), [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots)])


def test_golay_keys_meet_for_every_small_change():
    low, high, change, count = simhash.golay_tables()
    assert sorted(set(count.tolist())) == [1, 6] and int(count.sum()) == 10_903
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, 5, replace=False).tolist():
            y ^= 1 << b
        f = np.array([x, y], np.uint64)
        keys = [set(), set()]
        for row, key in simhash.golay_keys(f):
            for r, k in zip(row.tolist(), key.tolist()):
                keys[r].add(k)
        assert keys[0] & keys[1]


def test_large_keys_lose_no_component(spark, monkeypatch):
    """Close groups larger than every limit, so that the search, block and second-round paths are taken."""
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 62, 3)
    prints = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 62, (120, 2))}
    prints = sorted(prints | {int(x) for x in rng.integers(0, 1 << 62, 60)})
    nodes = materialise(spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "nid long, f0 long"), "nodes")
    want = cases.components(prints, 4)
    monkeypatch.setattr(simhash, "_SMALL", 4)
    monkeypatch.setattr(simhash, "_DENSE", 20)
    for overflow in (1 << 18, 30):
        links = simhash.links(nodes, 4, overflow=overflow)
        label = {r["node"]: r["root"] for r in components(links).collect()}
        groups = {}
        for k in range(len(prints)):
            groups.setdefault(label.get(k, k), set()).add(k)
        expect = {}
        for k, r in enumerate(want):
            expect.setdefault(r, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    got = {}
    for r in components(links).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, got.values())) == [2, 301]


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_quality_counts(request, table):
    df = request.getfixturevalue(table)
    got = quality.quality_report(df).collect()
    want = []
    for i, t in pairs(df):
        q = cases.quality(t)
        want.append((i, *q, q[0] < 50 or 100 * q[4] > 50 * q[0]))
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
          for r in got], want)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_limits_follow_their_group(spark):
    """A source of short words keeps them; the same text in a source of usual words goes."""
    usual = [(k, " ".join(f"word{k % 9}ly{j}" for j in range(60)), "en", "a") for k in range(240)]
    short = [(1000 + k, " ".join(f"{chr(97 + (j * 7 + k) % 26)}{j % 10}" for j in range(60)), "en", "b") for k in range(240)]
    odd = [(5000, short[0][1], "en", "a")]
    df = materialise(spark.createDataFrame(usual + short + odd, "doc_id long, text string, lang string, source string"), "groups")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(df).collect()}
    assert not kept[5000] and all(v for k, v in kept.items() if k != 5000)


def test_every_metric_follows_its_source(spark):
    """The same text stays in a source full of its kind and goes in a clean one, for each metric."""
    import random
    rng = random.Random(8)

    def lines(k):
        return ["".join(rng.choice("abcdefgh") for _ in range(6)) + f" w{k}x{j} " + " ".join(
            "".join(rng.choice("ijklmnop") for _ in range(5)) for _ in range(4)) for j in range(16)]

    def dirty(metric, k):
        ls = lines(k)
        if metric == "word_length":
            return "\n".join(x.replace(" ", "longer ") for x in ls)
        if metric == "symbols":
            return "\n".join(x + " ###$" for x in ls)
        if metric == "dup_lines":  # short lines: no three-word window comes twice
            return "\n".join([*ls, *["ab cd", f"x{k} y"] * 8])
        return "\n".join([*ls, *[f"t{j} q{k} r{k} s{k} u{j}" for j in range(6)]])

    for metric in quality.METRICS:
        rows = [(k, "\n".join(lines(k)), "en", "clean") for k in range(300)] + [(1000, dirty(metric, 1000), "en", "clean")]
        rows += [(2000 + k, dirty(metric, k), "en", "dirty") for k in range(300)]
        df = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "metric")
        edges = {r["source"]: r for r in quality.limits(quality.sketches(quality._keyed(quality.measured(df), "lang", "source"))).collect()}
        assert edges["=clean"][f"{metric}_hi"] < edges["=dirty"][f"{metric}_hi"]
        kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(df).collect()}
        assert not kept[1000] and sum(kept[k] for k in range(300)) >= 290 and sum(kept[2000 + k] for k in range(300)) >= 290


@pytest.mark.parametrize("table", ["docs", "small", "empty"])
def test_passages(request, table):
    df = request.getfixturevalue(table)
    rows = pairs(df)
    got = recompress.repeated_passages(df, block_bytes=30_000).collect()
    same(map(tuple, got), [(i, *x) for (i, _), x in zip(rows, cases.repeated([t for _, t in rows], 35))])


def test_passages_with_runs(spark):
    """Runs and short periods at the borders of repeated windows, where symbols depend on what lies outside."""
    import random
    rng = random.Random(4)
    rows = []
    for k in range(60):
        core = " ".join(rng.choice(["a", "a", "b", "ab", "c"]) for _ in range(36))
        for side in range(2):
            around = [" ".join(rng.choice(["a", "b", "q"]) for _ in range(rng.randint(0, 12))) for _ in range(2)]
            rows.append((2 * k + side, f"{around[0]} {core} {around[1]}"))
    rows += [(500, "a " * 80), (501, "a b " * 40), (502, "b " * 36)]
    df = materialise(spark.createDataFrame(rows, "doc_id long, text string"), "runs")
    got = recompress.repeated_passages(df, block_bytes=500).collect()
    same(map(tuple, got), [(i, *x) for (i, _), x in zip(rows, cases.repeated([t for _, t in rows], 35))])


def test_leaks(spark, docs, empty, small):
    items = [(1, cases.prose(40, 90)), (2, "one"), (3, None), (4, ""), (5, cases.prose(12, 91)), (6, cases.prose(40, 90))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    w = items[0][1].split()
    edited = " ".join(w[:9] + ["new"] + w[10:20] + w[21:33] + ["Other", *w[34:]])
    rows = [(1, cases.prose(50, 1) + " " + items[0][1].upper() + " tail"), (2, cases.prose(30, 2) + ", " + edited), (3, cases.prose(200, 3)),
            (4, None), (5, ""), (6, items[4][1]), (6, items[4][1]), (None, "x " * 3000 + items[0][1])]
    df = materialise(spark.createDataFrame(rows, "doc_id long, text string"), "leaky")
    got = decontaminate.find_leaks(df, benchmark).collect()
    same([(r["doc_id"], r["item_id"]) for r in got], [(1, 1), (1, 6), (2, 1), (2, 6), (6, 5), (6, 5), (None, 1), (None, 6)])
    assert all((r["distance"] == 0) == (r["doc_id"] != 2) for r in got)
    same([r["doc_id"] for r in decontaminate.drop_leaks(df, benchmark).collect()], [3, 4, 5])
    assert decontaminate.find_leaks(df, benchmark.limit(0)).count() == 0 and decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.drop_leaks(docs, benchmark).columns == docs.columns
    # Every exact occurrence in the given tables.
    given = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = [(i, b" ".join(decontaminate.words_of(t.encode()))) for i, t in pairs(small)]
    want = {(i, r["item_id"]) for i, t in plain for r in given.collect()
            if b" ".join(decontaminate.words_of(r["text"].encode())) in t}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(small, given).collect()}


def test_fit_distance():
    assert decontaminate.fit_distance(b"abc", b"xxabcxx") == 0 and decontaminate.fit_distance(b"abc", b"xxabxx") == 1
    assert decontaminate.fit_distance(b"abc", b"") == 3 and decontaminate.fit_distance(b"kitten", b"a sitting b") == 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, empty, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    for df in (docs, empty):
        out = materialise(stage(spark, df, SMALL), "out")
        assert out.count() <= df.count()
        if not last:
            assert out.dtypes == df.dtypes
            same(set(map(str, out.drop("text", "n_chars").collect())) - set(map(str, df.drop("text", "n_chars").collect())), [])
    if name in ("personal_data", "piece_ids"):
        assert stage(spark, docs, SMALL).count() == docs.count()


def test_stages_decide(spark, docs, small):
    rows = pairs(docs)
    failed = Counter((i, t) for i, t in rows if (q := cases.quality(t))[0] < 50 or 100 * q[4] > 50 * q[0])
    kept = Counter(pairs(quality.keep_good(docs)))
    assert not kept & failed and kept <= Counter(rows)
    # One text of each near-duplicate group, the one with the least id.
    held = pairs(small)
    near = cases.components([cases.simhash(t) for _, t in held], 4)
    least = {}
    for (i, _), group in zip(held, near):
        least[group] = min(i, least.get(group, i))
    assert sorted(i for i, _ in pairs(simhash.keep_one(small))) == sorted(least.values())


def test_near_dedup_is_exact_at_the_distance(spark):
    """Texts with few and with many words exchanged, against all pairs of fingerprints by brute force."""
    from random import Random
    rng, texts = Random(3), []
    for _ in range(80):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        cut = rng.randrange(0, 9)  # words exchanged at the end
        texts += [" ".join(base), " ".join(base[:len(base) - cut] + [f"v{rng.randrange(10**6)}" for _ in range(cut)])]
    near = cases.components([cases.simhash(t) for t in texts], 4)
    want = {min(i for i, g in enumerate(near) if g == group) for group in set(near)}
    assert 85 < len(want) < 155
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {i for i, _ in pairs(simhash.keep_one(df))} == want


def test_pipeline(spark):
    got = QUERIES["pipeline"](spark, SMALL)
    assert got.count() and {"doc_id", "ids_sha256"} <= set(got.columns)


def test_blocks_keep_rows(spark, docs):
    packs = blocks.packed(docs.select("doc_id", "text"), 1000).collect()
    back = [(i, t.decode() if t is not None else None) for p in packs for i, t in zip(*blocks.unpack(p["blob"]))]
    same(back, pairs(docs))
