"""Operator 10: token-id files of independent zstandard frames with a trailing seek table.

Layout of a shard (integers little-endian; the public zstandard seekable format):

* a zstandard frame for each document, holding its ids as unsigned 32-bit integers;
* a skippable frame (magic 0x184D2A5D) with the documents' ids: signed 64-bit integers, one a frame;
* a skippable frame (magic 0x184D2A5E), the seek table: for each frame before it, compressed size,
  decompressed size and checksum (low 32 bits of XXH64, seed 0, of the decompressed bytes), then the
  number of frames, a descriptor byte (0x80: checksums present) and the magic 0x8F92EAB1.

Any zstandard tool can decompress a shard as a whole. ``Shard`` reads the table first and then only
the frames of the documents asked for, and checks each against its checksum.

Rows are range-partitioned by doc_id and a hash of the text, so shard k holds no greater ids than
shard k + 1, and an id that many rows share spreads over shards; a shard is
written under a name of its own for each attempt and then moved into place, so a task that runs
again leaves the same file. Only one summary row per shard reaches the driver.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, lean
from .pretoken import WORDS, PretokenEncoder

#: Fixed values of the zstandard seekable format.
SKIP_INDEX, SKIP_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Stands for a null doc_id in a shard's index.
NULL_ID = -(1 << 63)


class TokenizersEncoder:
    """Ids of the tokenizers library, added special tokens recognised as it does, none appended."""

    _made: dict[tuple[str, str], "TokenizersEncoder"] = {}

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = lambda text: self.tok.encode(text, add_special_tokens=False).ids
        before = self.tok.pre_tokenizer
        plain = self.tok.normalizer is None and type(before).__name__ == "ByteLevel" and type(self.tok.model).__name__ == "BPE"
        # The shortcut is that of the byte-level splitter's own expression, without a space put in front.
        plain = plain and pattern == WORDS and before.use_regex and not before.add_prefix_space
        tokenize, chars = self.tok.model.tokenize, self._byte_chars()
        space = chars[32]

        def shown(t: str) -> str:
            return t.encode().decode("latin-1").translate(chars)

        def word(t: str) -> bytes:
            # Of a space and ASCII letters, only the space has another character.
            return array("I", [x.id for x in tokenize(space + (t if t.isascii() else shown(t)))]).tobytes()

        self.cut = PretokenEncoder(pattern, lambda t: [x.id for x in tokenize(shown(t))], word=word) if plain else None

    @staticmethod
    def _byte_chars() -> str:
        """The byte-level alphabet, by byte: printable bytes stand for themselves, the rest follow from 256 on."""
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        after = {b: 256 + k for k, b in enumerate(hidden)}
        return "".join(chr(after.get(b, b)) for b in range(256))

    @classmethod
    def at(cls, path: str, pattern: str) -> "TokenizersEncoder":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode(self, text: str) -> bytes:
        if self.cut is None or any(s in text for s in self.special):
            return array("I", self.whole(text)).tobytes()
        return self.cut.encode(text)


class ShardWriter:
    def __init__(self, stream, level: int = 3):
        import zstandard

        self.out, self.zip = stream, zstandard.ZstdCompressor(level=level)
        self.table, self.ids = array("I"), array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.table.extend((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(NULL_ID if doc_id is None else doc_id)

    def close(self) -> None:
        index = struct.pack("<II", SKIP_INDEX, 8 * len(self.ids)) + self.ids.tobytes()
        self.out.write(index)
        self.table.extend((len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        n = len(self.table) // 3
        self.out.write(struct.pack("<II", SKIP_SEEK, 12 * n + 9) + self.table.tobytes() + struct.pack("<IBI", n, CHECKSUMS, SEEK_MAGIC))
        self.out.close()


class Shard:
    """Reader of a shard: the table first, then only the frames asked for."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = pafs.FileSystem.from_uri(uri)
        size = fs.get_file_info(path).size
        self.file = fs.open_input_file(path)
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or descriptor != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.ids = np.frombuffer(self.file.read_at(8 * (n - 1), int(self.at[n - 1]) + 8), "<i8")
        self.unzip = zstandard.ZstdDecompressor()
        #: Ids before each document in this shard.
        self.start = np.concatenate([[0], np.cumsum(self.table[: n - 1, 1].astype(np.int64) // 4)])

    def frame(self, k: int) -> bytes:
        """The ids of the k-th document; ValueError where the checksum differs."""
        raw = self.file.read_at(int(self.table[k, 0]), int(self.at[k]))
        data = self.unzip.decompress(raw, max_output_size=max(1, int(self.table[k, 1])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.table[k, 2]):
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, doc_ids) -> dict[int, list[np.ndarray]]:
        """The ids of the documents asked for, by doc_id: an array for each row with that id."""
        out: dict[int, list[np.ndarray]] = {}
        for d in doc_ids:
            lo, hi = np.searchsorted(self.ids, [d, d], "left")[0], np.searchsorted(self.ids, d, "right")
            out[d] = [np.frombuffer(self.frame(k), "<u4") for k in range(lo, hi)]
        return out


def _uri(folder: str) -> str:
    """The folder as the workers' file systems name it; ValueError for one they don't know."""
    kind, sep, rest = folder.partition(":")
    if not sep or "/" in kind:
        return f"file://{folder}"
    known = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}
    if kind not in known:
        raise ValueError(f"token files can't be written to {kind}:")
    return f"{known[kind]}://{rest.removeprefix('//')}" if kind != "file" else f"file:///{rest.lstrip('/')}"


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = 2, shards: int | None = None) -> list[tuple[str, int, int]]:
    """Encode whole texts, append ``end_id``, write shards in ascending doc_id order.

    Returns ``[(uri, documents, tokens)]`` by shard. Null doc_ids come first, a null text counts as
    empty (its frame holds the end id alone), rows that repeat a doc_id are neighbours in the order
    of their texts. No rows give no shards.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    uri = _uri(folder)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th", "text").drop("th")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        part = TaskContext.get().partitionId()
        enc, end = TokenizersEncoder.at(path, pattern), array("I", [end_id]).tobytes()
        own, out, docs_n, tokens = f"{root}/.{part:06d}-{uuid.uuid4().hex}", None, 0, 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = ShardWriter(fs.open_output_stream(own, compression=None))
                ids = enc.encode(t) + end
                out.add(d, ids)
                docs_n += 1
                tokens += len(ids) // 4
        if out is not None:
            out.close()
            name = f"{root}/shard-{part:06d}.zst"
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"shard": [part], "docs": [docs_n], "tokens": [tokens]}, pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    done = rows.mapInArrow(lean(run), "shard long, docs long, tokens long").collect()
    return [(f"{uri}/shard-{r.shard:06d}.zst", r.docs, r.tokens) for r in sorted(done)]


def read_token_files(spark: SparkSession, shards: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, and ``ids`` binary if asked for, read back from the shards.

    ``start`` is the number of ids of all documents before it, ``ids_crc32`` the unsigned crc32 of
    the document's ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    before, rows = 0, []
    for uri, _, tokens in shards:
        rows.append((uri, before))
        before += tokens
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(uri)
                for at in range(0, len(s.ids), 2000):
                    cols = [[], [], [], [], []]
                    for k in range(at, min(at + 2000, len(s.ids))):
                        data = s.frame(k)
                        row = (None if s.ids[k] == NULL_ID else int(s.ids[k]), base + int(s.start[k]), len(data) // 4, zlib.crc32(data), data if with_ids else None)
                        for c, v in zip(cols, row):
                            c.append(v)
                    types = [pa.int64()] * 4 + [pa.binary()]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                    m = 4 + with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:m], types)], names[:m])

    return spark.createDataFrame(rows, "uri string, base long").repartitionByRange(len(rows), "uri").mapInArrow(lean(run), schema)
