"""Operators against brute force on small fixtures: nulls, blanks, ties, repeats, empty tables, clashing names."""

import math
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from formweave.llm import byte_bpe, decontaminate, exact_topk, language_id, license_scan, line_dedup, quality, simhash_dedup, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long"
MULTI, PLAIN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    out += [out[0], out[0], out[1] + " tail", "", None, "   ", "x", "A  b\n\n c\t", "l1 same line here\nl2", "l1 Same, line HERE\nother", " ".join(words * 60)]
    return [(i, t) for i, t in enumerate(out)] + [(0, out[0])]


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    got = simhash_dedup.near_duplicates(frame(spark, texts)).collect()
    fp = {i: fingerprint(t) for i, t in texts}
    group = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == {(i, fp[i], group[i]) for i in fp} and len(got) == len(fp)
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_without_ids(spark, monkeypatch):
    prints = {1: 0, 2: 63, None: 7, 5: 2**40 - 1}
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, words: docs.select("doc_id", "fp"))
    rows = [(i, "", "en", "s", 0, fp, 2) for i, fp in prints.items()] + [(None, "", "en", "s", 0, 2**60 - 1, 2), (None, "", "en", "s", 0, 7, 2), (1, "", "en", "s", 0, 0, 2)]
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 1), (2, 63, 1), (None, 7, 1), (5, 2**40 - 1, 5), (None, 2**60 - 1, None)], key=str)


def test_components(spark):
    from formweave.llm.common import Scratch
    from formweave.llm.graph import connected_components

    rng = random.Random(9)
    star = [(0, k) for k in range(1, 700)] + [(700, k) for k in range(650, 1000)] + [(2000 + k, 2001 + k) for k in range(40)]
    star += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)] + [(5, 5), (None, 1)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in star:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            group[y] = x
    edges = spark.createDataFrame(star + star[:50], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark, "test")).collect()}
    want = {x: root(x) for x in group if any(root(y) == root(x) for y in group if y != x)}
    assert {**{x: x for x in want}, **got} == want
    both = edges.selectExpr("struct(src as x, 1 as k) as src", "struct(dst as x, 1 as k) as dst").where("src.x is not null")
    assert {r.node.x: r.component.x for r in connected_components(both, Scratch(spark, "test")).collect()} == got


def test_similar_documents(spark):
    rng = random.Random(12)
    voc = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(voc) for _ in range(n)] for n in (12, 30, 60, 120, 200, 400) for _ in range(6)]
    near = [[rng.choice(voc) if rng.random() < 0.012 else x for x in t] for t in base for _ in range(2)]
    half = [t[: len(t) // 2] + [rng.choice(voc) for _ in range(len(t) // 2)] for t in base]
    odd = [["A", "b"], ["a", "B"], ["a"], [], [], None, voc]
    rows = [(k, None if t is None else " ".join(t)) for k, t in enumerate(base + near + half + odd)] + [(None, " ".join(near[0])), (None, "alone x"), (3, " ".join(base[3]))]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    alike = [[a == b if not (a and b) else len(a & b) / len(a | b) for b in sets] for a in sets]
    found = {}
    for r in simhash_dedup.similar_documents(frame(spark, rows)).collect():
        found.setdefault(r.doc_id, set()).add(r.component_id)
    group = [next(iter(found[i])) if i is not None else None for i, _ in rows]
    for a in range(len(base + near + half + odd)):
        for b in range(a):
            if alike[a][b] >= 0.85 or not (sets[a] or sets[b]):
                assert group[a] == group[b]
            elif max(x for k, x in enumerate(alike[a]) if rows[k][0] != a) < 0.65:
                assert group[a] != group[b]
    assert found[None] == {group[len(base)], None}
    left = simhash_dedup.drop_similar(frame(spark, rows))
    assert left.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((i, t) for (i, t), g in zip(rows, group) if i == g is not None or t == "alone x"), key=str)
    assert simhash_dedup.similar_documents(frame(spark, [])).count() == 0 and simhash_dedup.drop_similar(frame(spark, [])).count() == 0


def test_byte_bpe(spark, texts):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})
    odd = [(900, "don't  stop 　 now\x1c \x85<|endoftext|>"), (901, "😀 日本語 ᾳ १२३ ½"), (902, " lead"), (903, "trail \n"), (904, "a" * 5000)]
    rows = texts + odd
    got = byte_bpe.encode(frame(spark, rows), MULTI, public_tokenizers.PATTERN, decode_too=True).collect()
    assert len(got) == len(rows)
    want = {i: (t or "") for i, t in rows}
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(want[r.doc_id])
        assert bytes(r.decoded).decode() == want[r.doc_id]
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0})
    capitals = r" ?\p{Lu}?\p{Ll}+|\s+|[^\s]"
    other = tiktoken.Encoding("other", pat_str=capitals, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})
    text = "a FooBar of camelCase  x"
    assert np.frombuffer(byte_bpe.ByteBPE.at(MULTI, capitals).encode(text), "<u4").tolist() == other.encode_ordinary(text)
    assert byte_bpe.encode(frame(spark, []), MULTI, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    tok, rows = Tokenizer.from_file(PLAIN), texts + [(905, "a <|endoftext|> b"), (None, "no id")]
    shards = token_files.write_token_files(frame(spark, rows), str(tmp_path), PLAIN, public_tokenizers.PATTERN, shards=3)
    got = token_files.read_token_files(spark, shards, with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows) and got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(i for i, _ in rows if i is not None)
    want, at = dict(rows), 0
    for r in got:
        ids = tok.encode(want[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.start, r.n_tokens) == (ids, at, len(ids))
        at += len(ids)
    shard = token_files.Shard(shards[0][0])
    assert [x.tolist() for x in shard.documents([0])[0]] == [tok.encode(want[0], add_special_tokens=False).ids + [2]] * 2
    path = shards[0][0].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        damaged = token_files.Shard(shards[0][0])
        [damaged.frame(k) for k in range(len(damaged.ids))]
    assert token_files.write_token_files(frame(spark, []), str(tmp_path / "none"), PLAIN, public_tokenizers.PATTERN) == []


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * rng.choice([0.1, 1, 30], size=(300, 1))
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1050, [float("nan")] * 8), (1100, [1.0, None]), (None, [1.0] * 8), (1150, []), (1200, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [rows[3]] + bad, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    q, want = np.floor(x * 256).astype(np.int64), []
    for i in range(0, 300, 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(best)]
    assert got == sorted(want)
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_long_vectors_and_repeated_ids(spark):
    rows = [(0, [2.0**40, 3.0]), (1, [-(2.0**45), 1.0]), (2, [2.0**50, 5.0]), (3, [1.0, 2.0]), (3, [4.0, 1.0]), (50, [1.0, 1.0]), (50, [0.0, -3.0]), (4, [2.0**60, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()}
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if max(map(abs, v)) < 2**54]
    for i in (0, 50):
        every = {(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), k) for j, q in whole if j == i for k, x in whole if k != i}
        assert {s for _, s in (got[i, k] for k in (1, 2, 3))} <= {s for s, _ in every} and got[i, 1] == sorted(every, key=lambda p: (-p[0], p[1]))[0][::-1]


def test_topk_excludes_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 8)) * 40
    x = np.concatenate([c + rng.normal(size=(60, 8)) for c in centre])
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 1)
    monkeypatch.setattr(exact_topk, "PAGE", 7)
    search, compared = exact_topk._search, []

    def count(pairs, blocks, queries, k):
        compared.append(pairs.count() / (blocks.count() * queries.count()))
        return search(pairs, blocks, queries, k)

    monkeypatch.setattr(exact_topk, "_search", count)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    q = np.floor(x * 256).astype(np.int64)
    want = []
    for i in range(0, len(x), 50):
        s = q @ q[i]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:5])]
    assert got == sorted(want)
    assert compared[-1] < 0.4


def line_fingerprint(norm):
    """One word after another: a polynomial of its bytes, mixed, modulo 2**64."""
    hashes = []
    for w in norm.split(" "):
        h = sum(c * pow(0x9E3779B97F4A7C15, k, 2**64) for k, c in enumerate(w.encode())) % 2**64
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * by % 2**64
        hashes.append(h ^ h >> 31)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_line_prints():
    rng = random.Random(3)
    odd = ["", "\n", " — \n\n", "É ß!x\n—\nŒ_1\r", "ΑΣ\nΣ b\u2028c\x85d", "१२ İ ²\u0301e", "😀 日本語。ok", "w " * 700 + "\n" + "only"]
    some = ["".join(rng.choice("ab É—1_\n.,日") for _ in range(rng.randrange(300))) for _ in range(200)]
    for text in odd + some:
        line, norms, sh = line_dedup.line_prints(text)
        want = [(k, n) for k, x in enumerate(text.split("\n")) if (n := line_dedup.normalise(x))]
        assert list(zip(line.tolist(), [n.decode() for n in norms])) == want
        assert sh.tolist() == [line_fingerprint(n) for _, n in want]


def test_lines_of_chunks(spark, monkeypatch):
    rows = [(i, "\n".join(f"row {i % 7} of {k} words" for k in range(i))) for i in range(40)]
    want = {tuple(r) for r in line_dedup.occurrences(frame(spark, rows)).collect()}
    monkeypatch.setattr(line_dedup, "CHUNK", 50)
    for texts in ([t for _, t in rows], [None, "", "x" * 200 + "\n\ny"]):
        got = []
        for text, at, no in line_dedup._chunks(texts):
            line, norms, _ = line_dedup.line_prints(text)
            got += zip(at[line].tolist(), no[line].tolist(), norms)
        assert got == [(k, n, line_dedup.normalise(x).encode()) for k, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if line_dedup.normalise(x)]
    assert len(want) == sum(range(40))


@pytest.mark.parametrize("tile", [line_dedup.TILE, 3])
def test_lines(spark, texts, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rows = texts[:-1]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    nodes = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if n := line_dedup.normalise(line):
                nodes.setdefault(n, []).append((i, k))
    keys = list(nodes)
    fps = [line_fingerprint(k) for k in keys]
    group = list(range(len(keys)))
    for _ in keys:
        for a in range(len(keys)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and line_dedup.similar(keys[a], keys[b]):
                    group[a] = group[b] = min(group[a], group[b])
    keep = {min(o for k, g in zip(keys, group) if g == c for o in nodes[k]) for c in set(group)}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not line_dedup.normalise(x) or (i, k) in keep) for i, t in rows}
    assert got == want
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    assert line_dedup.dedup_lines(frame(spark, texts)).columns == frame(spark, []).columns


def test_lines_with_changed_words(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 8)))
    lines = [[word() for _ in range(n)] for n in (10, 12, 20, 30, 40, 60) for _ in range(5)]
    near = [[*w[: len(w) // 2], word(), *w[len(w) // 2 + 1 :]] for w in lines]
    text = [" ".join(w) for w in lines + near]
    assert all(line_dedup.similar(a, b) for a, b in zip(text, text[30:]))
    got = line_dedup.dedup_lines(frame(spark, list(enumerate(text))), banded=True).collect()
    assert {r.doc_id for r in got if r.text} == set(range(30))


def test_long_lines_of_common_words(spark):
    """Long lines that share but their frequent words are no candidates, and each distinct word counts once."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common = [word() for _ in range(6)]
    lines = [" ".join(rng.choice(common) if rng.random() < 0.8 else word() for _ in range(300)) for _ in range(60)]
    near = lambda fps: sum((fps[a] ^ fps[b]).bit_count() <= 3 for a in range(60) for b in range(a))
    assert near([line_fingerprint(x) for x in lines]) > 20
    rows = {r.doc_id: r.sh % (1 << 64) for r in line_dedup._occurrences(frame(spark, list(enumerate(lines))), True).collect()}
    assert near(rows) == 0
    again = [x + " " + " ".join(rng.choice(x.split()) for _ in range(50)) for x in lines]
    assert {r.doc_id: r.sh % (1 << 64) for r in line_dedup._occurrences(frame(spark, list(enumerate(again))), True).collect()} == rows
    some = [[rng.choice("abc") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))] for _ in range(200)]
    alignment = [(" ".join(a), " ".join(b)) for a, b in zip(some, [a[:20] + b[:5] + a[22:] for a, b in zip(some, some[1:])])]
    assert all(line_dedup.edit_distance(a, b) <= line_dedup._word_bound(a, b, 10**6) for a, b in alignment)


def test_distances_together():
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcé日") for _ in range(rng.choice((0, 3, 63, 64, 65, 128, 130, 200))))
        b = list(a)
        for _ in range(rng.randrange(len(a) // 2 + 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(("", "a", "x"))
        pairs.append((a, "".join(b)))
    want = np.array([line_dedup.edit_distance(*p) for p in pairs])
    for more in (-1, 0, 5):
        most = np.maximum(want + more, 0)
        assert (line_dedup.within(pairs, most) == (want <= most)).all()


def test_lines_recall(spark):
    """Pairs of similarity 0.8 or more, found without fingerprints, among the lines of 600 documents."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no given tables")
    docs = spark.read.parquet(path).where("doc_id < 600")
    lines = sorted({n for r in docs.collect() for x in (r.text or "").split("\n") if (n := line_dedup.normalise(x))}, key=len)
    size = np.array([len(x) for x in lines])
    bags = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) & 31, minlength=32) for x in lines]).astype(np.int16)
    want = []
    for a in range(len(lines)):
        high = np.searchsorted(size, size[a] / 0.8 + 1)
        apart = bags[a + 1 : high] - bags[a]
        least = np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1))
        want += [(a, a + 1 + k) for k in np.flatnonzero(least <= 0.2 * size[a + 1 : high]).tolist()]
    most = np.array([len(lines[b]) - math.ceil(0.8 * len(lines[b])) for _, b in want], np.int64)
    want = [p for p, ok in zip(want, line_dedup.within([(lines[a], lines[b]) for a, b in want], most)) if ok]
    single = frame(spark, list(enumerate(lines)))
    left = {r.doc_id for r in line_dedup.dedup_lines(single, banded=True).collect() if r.text}
    group = list(range(len(lines)))
    for _ in range(20):
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    gone = {k for k, g in enumerate(group) if g != k}
    assert len(gone) > 10 and not (set(range(len(lines))) - gone) - left
    assert len(gone - left) >= 0.9 * len(gone)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(30)) for _ in range(12)] + ["two words"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(50, items[3]), (51, None), (None, "x")], "item_id long, text string")
    fill = lambda n: " ".join(word() for _ in range(n))
    near = items[2].split()
    near[-1] = "changed"
    rows = [(0, f"{fill(50)} {items[3].upper()}, {fill(40)}"), (1, fill(200)), (2, " ".join(near)), (3, f"say Two, words {fill(9)}"), (4, None), (5, ""), (6, " ".join(items[4].split()[:12]) + fill(40))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(0, 3), (2, 2), (3, 12)}
    assert got[0, 3].item_ids == [3, 50] and got[0, 3].start_word == 50 and got[2, 2].similarity >= 0.8
    left = decontaminate.remove_leaks(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 6] and left.columns == frame(spark, []).columns
    assert decontaminate.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_in_parts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(15)]
    items = [" ".join(common + [word() for _ in range(15)]) for _ in range(20)]
    rows = [*enumerate(items), *((100 + k, t.replace(" ", ", ").upper()) for k, t in enumerate(items))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    whole, parts = decontaminate.indexes(bench, 10**9), decontaminate.indexes(bench, 500)
    assert len(whole) == 1 < len(parts)
    swap = lambda t, n, at: " ".join([word() for _ in range(n)] + t.split()[n:at] + [word() for _ in range(30 - at)])
    for t in items + [swap(t, n, at) for t in items for n in (0, 5, 10, 15) for at in (24, 27, 30)]:
        want = [(i, ids, round(sim, 9), d, s) for i, ids, sim, d, s in whole[0].matches(t)]
        assert sorted((i, ids, round(sim, 9), d, s) for p in parts for i, ids, sim, d, s in p.matches(t)) == want
    assert all(ids == [i, 100 + i] for p in parts for t in items for i, ids, *_ in p.matches(t))


def test_labelled_sample(spark):
    from formweave.llm.common import Scratch, labelled_sample

    rows = [(1, "x" * 1000)] * 500 + [(1, "b"), (2, "y" * 700), (3, None), (None, "z")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (9, 1), (None, 1), (4, None)], "doc_id long, label int")
    take = lambda rows_, chars: labelled_sample(frame(spark, rows), labels, rows_, chars, Scratch(spark, "test"))
    assert take(100, 10_000) == [(1, "b", 0), (2, "y" * 700, 1), (3, "", 0)]
    assert take(100, 100) == [(1, "b", 0), (3, "", 0)]
    assert labelled_sample(frame(spark, []), labels, 10, 10, Scratch(spark, "test")) == []


def test_classifiers(spark):
    rng = random.Random(4)
    en, de = ["the", "and", "house", "with"], ["der", "und", "haus", "mit"]
    say = lambda words, n=30: " ".join(rng.choice(words) for _ in range(n))
    model = language_id.train([(k, say(en if k % 2 else de), "en" if k % 2 else "de") for k in range(60)])
    assert model.predict(say(en))[0] == "en" and model.predict(say(de))[0] == "de"
    got = {r.doc_id: r for r in language_id.identify(frame(spark, [(0, None), (1, "123 !"), (2, say(de))]), model).collect()}
    assert (got[0].lang_pred, got[1].lang_pred, got[2].lang_pred) == ("und", "und", "de")
    assert language_id.train([]).predict("word")[0] == "und"

    tox = toxicity.train([(k, f"{say(en)}. {say(de) + (' vilething' if k % 3 == 0 else '')}. {say(en)}.", int(k % 3 == 0)) for k in range(240)])
    bad, good = f"{say(en)}. {say(en)} vilething. {say(de)}.", say(en)
    assert tox.score(bad) >= 0.5 > tox.score(good)
    ((a, b, _),) = tox.locate(bad)
    assert "vilething" in bad[a:b]
    assert {r.doc_id for r in toxicity.detect(frame(spark, [(0, bad), (1, good), (2, None)]), tox).collect() if r.predicted} == {0}

    grade = {0: "### $$$ %%%", 1: "the house", 2: "and with haus", 3: "mit der und"}
    q = quality.train([(k, " ".join([grade[k % 4]] * 5), k % 4) for k in range(80)])
    assert list(q.thresholds) == sorted(q.thresholds)
    means = [q.expected(q.tails(" ".join([grade[g]] * 5))) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1
    assert quality.train([(0, "x", 1)]).grades == [1]
    kept = quality.rate(frame(spark, [(0, None), (1, "the house the house")]), q, columns=True)
    assert kept.columns == frame(spark, []).columns


def test_license(spark):
    rows = [(0, "Foo bar.\nReleased under the MIT License."), (1, None), (2, ""), (3, "He lost his driving license yesterday."), (4, "Distributed under the Quux Shareware License, all terms apply."), (5, "plain text")]
    got = {(r.doc_id, r.para_no): r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[0, 1].family == "mit" and got[0, 1].confirmed
    assert (3, 0) not in got and got[4, 0].family == "unknown" and not got[4, 0].confirmed
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_without_stem(spark):
    rows = [(0, "Foo bar.\nDistributed under the GPL v3."), (1, "CC BY-SA 4.0"), (2, "Chenein mit dem enauzu heitgete."), (3, "An \u00e8le."), (4, "Free software under the MIT license."), (5, None)]
    whole, gated = ({(r.doc_id, r.para_no): r for r in license_scan.scan(frame(spark, rows), gated=g).collect()} for g in (False, True))
    assert {k: whole[k].family for k in whole} == {(0, 1): "gpl-3.0", (1, 0): "cc-by-sa-4.0", (4, 0): "mit"}
    assert whole[0, 1].confirmed and whole[1, 0].confirmed
    assert set(gated) == {(4, 0)} and gated[4, 0] == whole[4, 0]


def test_words_by_a_call_of_their_own():
    from tokenizers import Tokenizer

    from formweave.llm.pretoken import PretokenEncoder

    asked = []
    cut = PretokenEncoder(public_tokenizers.PATTERN, lambda t: [*t.encode()], word=lambda t: asked.append(t) or np.array([*(" " + t).encode()], "<u4").tobytes())
    text = "One two \u00e9t\u00e9, two x1 \u00e9t\u00e9."
    assert np.frombuffer(cut.encode(text), "<u4").tolist() == [*text.encode()]
    assert asked == ["two", "\u00e9t\u00e9"]
    enc, tok = token_files.TokenizersEncoder(PLAIN, public_tokenizers.PATTERN), Tokenizer.from_file(PLAIN)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_word_bags_of_bounded_texts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    lines = [" ".join("".join(rng.choice("ab\u00e9") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    want, rooms, powers = line_dedup._word_bag(pa.array(lines)), [], line_dedup._powers
    monkeypatch.setattr(line_dedup, "CHUNK", 1000)
    monkeypatch.setattr(line_dedup, "_line_words", lambda text, plain=line_dedup._line_words: rooms.append(len(text)) or plain(text))
    assert (line_dedup._word_bag(pa.array(lines)) == want).all() and len(want) == 300
    assert max(rooms) < 1000 + max(map(len, lines)) + 1


def test_distance_of_unlike_texts_stops():
    rng = random.Random(4)

    def full(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for k in range(60):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 400)))
        b = "".join(rng.choice("abcd") if rng.random() < 0.02 * (k % 20) else c for c in a) + "x" * rng.randrange(30) if k % 3 else "".join(rng.choice("abcd") for _ in range(300))
        most, true = rng.randrange(1, 100), full(a, b)
        got = line_dedup.edit_distance(a, b, most)
        assert (got <= most) == (true <= most) and (got <= most or got <= true)


def test_cut_leaves_no_shuffle_files(spark):
    from formweave.llm.common import CLEANUP, Scratch

    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before, conf = files(), spark.conf.get(CLEANUP, None)
    rows = spark.range(1000).repartition(3).groupBy("id").count()
    got = Scratch(spark, "test").cut(rows)
    assert not files() - before
    assert got.count() == 1000 and spark.conf.get(CLEANUP, None) == conf


def test_distances_in_one_number():
    rng = random.Random(11)
    pairs = []
    for n in [1, 7, 8, 9, 63, 64, 65, 400, 900] * 6:
        a = "".join(rng.choice("abcdeé ") for _ in range(n))
        b = "".join(c if rng.random() < 0.8 else rng.choice(["", "x", c + "é"]) for c in a) or "x"
        pairs.append(tuple(sorted((a, b), key=len)))
    pairs.sort(key=lambda p: len(p[1]))
    assert line_dedup._packed(pairs).tolist() == [line_dedup.edit_distance(*p) for p in pairs]
    assert line_dedup._chars([x.encode() for p in pairs for x in p]).tolist() == [len(x) for p in pairs for x in p]


def test_tiles_of_the_same_lines_are_one(spark):
    """Two near copies share nearly all blocks and bands; they are to be compared once by blocks and once by bands."""
    from formweave.llm.common import Scratch

    rng = random.Random(5)
    lines = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
        lines += [" ".join(words), " ".join([*words[:-1], "changed"])]
    scratch = Scratch(spark, "test")
    nodes = line_dedup._occurrences(frame(spark, list(enumerate(lines))), True).select("key", "sh", *line_dedup._DEALT)
    marked = line_dedup._marked(nodes, line_dedup.RADIUS, line_dedup.SIMILARITY, scratch)
    tiles = {r.key: [(t.tile, t.number) for t in r["at"]] for r in line_dedup._wanted(marked).collect()}
    rows = {tuple(r) for r in marked.select("number", "tile", "key").collect()}
    # Runs at the ends of ranges are tiles of their own.
    assert len(rows) > 5 * 80 and len(tiles) == 80 and sum(map(len, tiles.values())) <= 2.25 * 80
    for key, at in tiles.items():
        assert all(n == min(m for m, u, k in rows if (u, k) == (t, key)) for t, n in at)
