"""Stages of the pipeline on small tables."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_without_ids(spark):
    rng = random.Random(3)
    text = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(4)]
    rows = [(1, text[0]), (2, text[1]), (3, text[0]), (None, text[0]), (None, text[2]), (None, text[3]), (None, text[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([rows[0], rows[1], *rows[4:]], key=key)


def _folder(spark, path, rows, labels, bench):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA + ", ids string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_whole_run(spark, tmp_path):
    """Good prose stays once, whatever repeats it; poor documents, leaks and copies go; ids decode to what is left."""
    import numpy as np
    import public_tokenizers

    from formweave.llm import byte_bpe

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    junk = lambda: "".join(rng.choice("#$%&*=~^ ") for _ in range(300))
    good = [prose(120) for _ in range(40)]
    poor = [junk() for _ in range(40)]
    item = prose(40)
    near = good[1].split(" ")
    near[60] = word()
    shared = "one line that two documents hold and only the first one keeps " + prose(6)
    rows = [*enumerate(good), *enumerate(poor, 100)]
    rows += [(200, good[0]), (201, " ".join(near)), (202, f"{prose(60)} {item} {prose(60)}"), (203, f"{prose(90)}\n{shared}"), (204, f"{prose(90)}\n{shared}\n{prose(80)}"), (None, prose(100)), (None, good[2]), (3, good[3])]
    labels = [(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(100, 140)]
    got = corpus_pipeline.run(spark, _folder(spark, tmp_path / "all", rows, labels, [(1, item), (2, None)])).collect()
    bpe = byte_bpe.ByteBPE.at(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    left = sorted(((r.doc_id, bpe.decode(r.ids).decode()) for r in got), key=str)
    texts = dict(rows)
    # The line stage takes repeated lines away first: copies are empty by then, and one empty text stays for their group.
    # Rows without an id come before all others there, so document 2 gives its line to one.
    want = {i: t for i, t in enumerate(good) if i != 2} | {203: texts[203], 204: texts[204].replace(f"\n{shared}", "")}
    kept = dict(x for x in left if x[1] and x[0] is not None)
    assert kept == want
    assert [t for i, t in left if i is None and t] == sorted(t for i, t in rows if i is None)
    assert not {i for i, _ in left} & set(range(100, 140)) and 202 not in {i for i, _ in left}
    assert sum(not t for _, t in left) <= 1
    assert all(r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in got)


def test_run_over_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path / "none", [], [], [])).count() == 0
    odd = [(1, None), (2, ""), (None, None), (3, "w " * 20_000), (3, "w " * 20_000)]
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path / "odd", odd, [], [])).count() <= len(odd)
