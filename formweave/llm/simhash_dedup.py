"""Operator 8: SimHash near-duplicates.

Whole texts get a 64-bit SimHash of their 3-word shingles. Distinct fingerprints are put
into tiles by the population counts of their four 16-bit words; a pair of tiles whose
counts differ by more than the radius in total cannot hold a link and is never formed.
The rest are compared exactly with numpy exclusive-or and bit counts. Each tile pair
reports a spanning forest of its links, so dense groups never come out as all pairs.

``similar_documents`` compares sets of shingles by a similarity instead: the radius it needs prunes
little by population counts, so tiles are of like sizes too, and candidates of the first 64 bits are
confirmed on fingerprints of 1,024. All pairs of a class of sizes are compared, so its time grows
with the square of the number of different texts of like size.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, lean
from .graph import connected_components
from .tiles import forest, near, near_in_pieces, tiles

PARTS, PART_BITS = 4, 16


def text_fingerprint(data: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of UTF-8 bytes: A-Z lowered, words between ASCII white space, shingles repeat."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    whole, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) < words:
        return h(whole, seed)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(tokens) - words + 1].tolist()
    hashes = np.array([h(whole[a:b], seed) for a, b in zip(start, end[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: fp is the fingerprint as a signed 64-bit number; null texts count as empty."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [text_fingerprint(t or b"", words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def cell(fp: F.Column) -> F.Column:
    """The four population counts of a fingerprint as one number."""
    out = F.lit(0)
    for k in range(PARTS):
        out = out * 17 + F.bit_count(F.shiftrightunsigned(fp, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1)))
    return out.cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, one of each pair of opposites."""
    return [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]


def _tile_pairs(t: DataFrame, reached: DataFrame) -> DataFrame:
    """``(a, b, same)``: items of each pair of tiles, ``reached(cell, sub, to)`` saying which cells' tiles a tile is compared with.

    Pairs are made of numbers alone; items join them once they are known to meet.
    """
    ids = t.select(F.col("cell").alias("to"), F.col("sub").alias("sub_b"))
    pairs = reached.join(ids, "to").where("cell <> to or sub <= sub_b")
    left = pairs.join(t.select("cell", "sub", F.col("items").alias("a")), ["cell", "sub"])
    right = t.select(F.col("cell").alias("to"), F.col("sub").alias("sub_b"), F.col("items").alias("b"))
    return left.join(right, ["to", "sub_b"]).select("a", "b", ((F.col("cell") == F.col("to")) & (F.col("sub") == F.col("sub_b"))).alias("same"))


def links(fps: DataFrame, radius: int, scratch: Scratch, tile: int = 2048) -> DataFrame:
    """``fps(fp)`` distinct -> ``(src, dst)``: links between fingerprints that connect the same groups as all links within the radius do."""
    t = scratch.cut(tiles(fps.withColumn("cell", cell(F.col("fp"))), "cell", "fp", F.col("fp"), tile), "tiles")
    digit = [F.floor(F.col("cell") / 17 ** (PARTS - 1 - k)) % 17 for k in range(PARTS)]
    moves = F.array(*[F.array(*map(F.lit, d)) for d in _offsets(radius)])
    left = t.select("cell", "sub", F.explode(moves).alias("d"))
    inside, other = F.lit(True), F.lit(0)
    for k in range(PARTS):
        at = digit[k] + F.col("d")[k]
        inside, other = inside & at.between(0, PART_BITS), other * 17 + at
    pairs = _tile_pairs(t, left.where(inside).select("cell", "sub", other.cast("int").alias("to")))

    def run(batches):
        for batch in batches:
            src, dst = [], []
            same = batch.column(2).to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy() for c in (0, 1))
                i, j = near(a.view(np.uint64), b.view(np.uint64), radius, bool(same[k]))
                if len(i):
                    both = np.concatenate([a, b])
                    i, j = forest(len(both), i, j if same[k] else j + len(a))
                    src.append(both[i])
                    dst.append(both[j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return pairs.mapInArrow(lean(run), "src long, dst long")


def _grouped(rows: DataFrame, node: str, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(doc_id, node, ...)`` with ``component_id``: the smallest doc_id of the nodes that links and repeated ids connect."""
    ids = rows.select("doc_id", F.col(node).alias("dst")).distinct()
    own = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("dst").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = connected_components(pairs.select("src", "dst").unionByName(ids.join(own.select("doc_id", "src"), "doc_id").select("src", "dst")), scratch)
    first = ids.groupBy(F.col("dst").alias("node")).agg(F.min("doc_id").alias("first"))
    first = first.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = first.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(first.select(F.col("node").alias(node), "component").join(best, "component").drop("component"), node)


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document.

    Null and blank texts have fingerprint zero and are linked like any other. Rows that repeat
    a doc_id are one document: their groups join, and equal rows come out once. A null doc_id
    links the texts near its own but never names a group (null where no row of the group has an
    id). No rows give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.cut(fingerprints(docs, words), "fps").distinct()
    pairs = links(rows.select("fp").distinct(), radius, scratch)
    return _grouped(rows, "fp", pairs, scratch).select("doc_id", "fp", "component_id")


# --- by similarity of shingle sets --------------------------------------------------------------

#: Bits of a long fingerprint; of its first 64, those that may differ before the whole is compared.
LONG_BITS, FIRST_RADIUS = 1024, 16
_TURNS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(LONG_BITS // 64)], np.uint64)


def long_fingerprint(data: bytes, words: int = 5, seed: int = 42) -> tuple[bytes, int]:
    """SimHash of ``LONG_BITS`` bits of the set of shingles, and their number (0 and no bit for no words)."""
    tokens = data.lower().split()
    if not tokens:
        return bytes(LONG_BITS // 8), 0
    whole, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = np.array([h(whole, seed)], np.uint64)
    else:
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(tokens) - words + 1].tolist()
        hashes = np.unique(np.array([h(whole[a:b], seed) for a, b in zip(start, end[words - 1 :].tolist())], np.uint64))
    ones = np.zeros(LONG_BITS, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] ^ _TURNS
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
        x ^= x >> np.uint64(31)
        # Eight counters to a number: up to 255 shingles are added at once.
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), len(hashes)


def long_radius(similarity: float) -> int:
    """Differing bits at which sets of this Jaccard similarity are still taken: their expected number and one deviation."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(LONG_BITS * share + np.sqrt(LONG_BITS * share * (1 - share)))


def _long_rows(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, th, node, n, bits)``: hashes of the text and of its long fingerprint, number of shingles, and the fingerprint."""

    def run(batches):
        for b in batches:
            got = [long_fingerprint(t or b"", words) for t in b.column(2).cast(pa.binary()).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(x, n) for x, n in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([n for _, n in got], pa.int64()), pa.array([x for x, _ in got], pa.binary())], ["doc_id", "th", "node", "n", "bits"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(lean(run), "doc_id long, th long, node long, n long, bits binary")


def similar_links(nodes: DataFrame, similarity: float, scratch: Scratch, tile: int = 1024) -> DataFrame:
    """``nodes(node, n, bits)`` distinct -> ``(src, dst)``: links that connect the same groups as all pairs do whose long fingerprints and numbers of shingles allow the similarity.

    Tiles are of a class of sizes, each as wide as the similarity allows, and of a class of
    population counts of the first 64 bits; others can't hold a link and are never formed.
    """
    size = F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(similarity)))).otherwise(-2).cast("int")
    counts = F.floor(F.bit_count(F.conv(F.hex(F.substring("bits", 1, 8)), 16, -10).cast("long")) / 4).cast("int")
    t = scratch.cut(tiles(nodes.withColumn("cell", size * 32 + counts), "cell", "node", F.struct("node", "n", "bits"), tile), "tiles")
    far = FIRST_RADIUS // 4 + 1
    moves = F.array(*[F.lit(32 * c + p) for c in (0, 1) for p in range(-far, far + 1) if c or p >= 0])
    pairs = _tile_pairs(t, t.select("cell", "sub", F.explode(F.transform(moves, lambda m: F.col("cell") + m)).alias("to")))
    most = long_radius(similarity)

    def run(batches):
        for batch in batches:
            src, dst = [], []
            for k in range(batch.num_rows):
                same, sides = batch.column(2)[k].as_py(), [batch.column(c)[k].values for c in (0, 1)]
                (na, sa, xa), (nb, sb, xb) = (
                    (v.field("node").to_numpy(), v.field("n").to_numpy(), np.frombuffer(b"".join(v.field("bits").to_pylist()), np.uint64).reshape(len(v), -1)) for v in sides
                )
                found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, j in near_in_pieces(xa[:, 0], xb[:, 0], FIRST_RADIUS, same):
                    fit = np.minimum(sa[i], sb[j]) >= similarity * np.maximum(sa[i], sb[j])
                    i, j = i[fit], j[fit]
                    # A piece of dense groups has many pairs, whose long fingerprints are compared some at a time.
                    for at in range(0, len(i), 1 << 14):
                        p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                        fit = np.bitwise_count(xa[p] ^ xb[q]).sum(1, dtype=np.int64) <= most
                        found[0].append(p[fit])
                        found[1].append(q[fit])
                i, j = map(np.concatenate, found)
                if len(i):
                    both = np.concatenate([na, nb])
                    i, j = forest(len(both), i, j if same else j + len(na))
                    src.append(both[i])
                    dst.append(both[j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return pairs.mapInArrow(lean(run), "src long, dst long")


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, th, component_id)``, a row for each document and text: groups of texts whose shingle sets have the Jaccard similarity or more.

    The similarity is that of SimHash fingerprints of ``LONG_BITS`` bits, which puts it within some
    0.03 of the exact one; the limit leans to taking pairs in. Texts without a word are equal to
    each other and to nothing else. Ids that are null or repeat count as in ``near_duplicates``;
    ``th`` is null for a null text.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    rows = scratch.cut(_long_rows(docs, words), "long")
    pairs = similar_links(rows.select("node", "n", "bits").dropDuplicates(["node"]), similarity, scratch)
    return _grouped(rows.select("doc_id", "th", "node").distinct(), "node", pairs, scratch).select("doc_id", "th", "component_id")


def drop_similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` of the document with the smallest id of each group of similar ones.

    Rows that repeat a doc_id are one document and stay or go together. Rows with a null doc_id go
    only if a document with an id is in their group.
    """
    found = similar_documents(docs, similarity, words, scratch)
    gone = found.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select(F.col("doc_id").alias("_fw_id"), F.col("th").alias("_fw_th"))
    keyed = docs.withColumns({"_fw_doc": F.col("doc_id").cast("long"), "_fw_text": F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(gone, F.col("_fw_doc").eqNullSafe(F.col("_fw_id")) & (F.col("_fw_text") == F.col("_fw_th")), "left_anti").select(*docs.columns)
