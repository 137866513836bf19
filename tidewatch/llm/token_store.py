"""Token files: one wavelet matrix per shard, with random access, counting and occurrence lookup on the compressed bit-planes."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tidewatch.llm.bpe_automaton import WordCache, byte_letters
from tidewatch.session import scratch_path

SHARD_TOKENS = 1 << 22
CACHE_WORDS = 400_000      # words remembered by a worker, twice over
BLOCK = 512                # bits between two entries of a rank directory
# In texts of these characters lower-casing and the split into words do not depend on the Unicode version; others go to the library whole.
# The word pattern of the vocabulary, with the letters and digits of this range spelled out.
SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa0-įıĲ-ſ]*")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


class WordEncoder:
    """Ids of whole texts by the tokenizers library; words seen before are looked up, as the vocabulary encodes each word by itself."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [a["content"] for a in json.loads(self.library.to_str())["added_tokens"]]
        letter = {b: c for c, b in byte_letters().items()}
        tokenize = self.library.model.tokenize
        self.ids_of = WordCache(lambda w: [t.id for t in tokenize(w if w.isascii() else "".join(letter[b] for b in w.encode()))], CACHE_WORDS)

    def encode(self, text: str) -> np.ndarray:
        if not SIMPLE.fullmatch(text) or any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, WORDS.findall(text.lower()))), "<u4")


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WaveletMatrix:
    """A token sequence as bit-planes, the highest bit first; each plane is kept in the order of a stable sort by the bits above it."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little").tobytes())
            low = a[~one]
            zeros.append(len(low))
            a = np.concatenate([low, a[one]])
        return cls(len(ids), planes, zeros)

    def to_array(self) -> np.ndarray:
        """All tokens, by undoing the sorts from the lowest plane up."""
        a = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, plane in enumerate(reversed(self.planes)):
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            z = self.zeros[len(self.planes) - 1 - b]
            up = np.empty_like(a)
            up[~one] = a[:z]
            up[one] = a[z:] | a.dtype.type(1 << b)
            a = up
        return a

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a plane and its rank directory: ones before every BLOCK bits."""
        if level not in self._bits:
            raw = np.frombuffer(self.planes[level], np.uint8)
            padded = np.zeros(-(-len(raw) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[:len(raw)] = raw
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            self._bits[level] = raw, np.concatenate([[0], np.cumsum(ones)])
        return self._bits[level]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        raw, ranks = self._plane(level)
        block = i // BLOCK
        at = block * (BLOCK // 8)
        total = int(ranks[block]) + int(np.bitwise_count(raw[at:i // 8]).sum())
        return total + (int(raw[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else total

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        token = 0
        for level, z in enumerate(self.zeros):
            raw, _ = self._plane(level)
            one = int(raw[i // 8]) >> i % 8 & 1
            token = token << 1 | one
            ones = self._ones(level, i)
            i = z + ones if one else i - ones
        return token

    def _bit(self, token: int, level: int) -> int:
        return token >> (len(self.planes) - 1 - level) & 1

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before position ``i``."""
        if token >> len(self.planes):
            return 0
        start = 0
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, i)
            start, i = (z + a, z + b) if self._bit(token, level) else (start - a, i - b)
        return i - start

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence of ``token``, counted from 0; -1 if there are fewer."""
        if token >> len(self.planes) or k < 0 or k >= self.rank(token, self.n):
            return -1
        start, path = 0, []
        for level, z in enumerate(self.zeros):
            path.append(start)
            a = self._ones(level, start)
            start = z + a if self._bit(token, level) else start - a
        at = start + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = self._bit(token, level)
            want = at - self.zeros[level] if one else at          # how many equal bits stand before it in its plane
            lo, hi = 0, self.n
            while lo < hi:                                        # the rank directory makes each step short
                mid = (lo + hi) // 2
                before = self._ones(level, mid + 1)
                if (before if one else mid + 1 - before) <= want:
                    lo = mid + 1
                else:
                    hi = mid
            at = lo
        return at


def encode_shards(docs: DataFrame, vocab: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of ``docs`` in ascending id order: ``part, shard, n_tokens, doc_ids, ends, zeros, planes``.

    Texts are dealt by id range and sorted, then encoded where they lie; a task closes a shard as soon as it holds ``shard_tokens`` ids,
    so its memory does not follow the size of its range.  A document is never divided between shards."""
    bits = max(1, (Tokenizer.from_file(vocab).get_vocab_size() - 1).bit_length())

    def shard(part, no, ids, tokens):
        ends = np.cumsum([len(t) for t in tokens])
        w = WaveletMatrix.build(np.concatenate(tokens), bits)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([w.n], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                           pa.array([ends.astype("<i8").tobytes()], pa.binary()), pa.array([w.zeros], pa.list_(pa.int64())), pa.array([w.planes], pa.list_(pa.binary()))],
                                          ["part", "shard", "n_tokens", "doc_ids", "ends", "zeros", "planes"])

    def scan(batches):
        part, no, ids, tokens, size = TaskContext.get().partitionId(), 0, [], [], 0
        encoder, end = word_encoder(vocab), np.asarray([end_id], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                tokens.append(np.concatenate([encoder.encode(text or ""), end]).astype(np.uint16 if bits <= 16 else np.uint32))
                size += len(tokens[-1])
                if size >= shard_tokens:
                    yield shard(part, no, ids, tokens)
                    no, ids, tokens, size = no + 1, [], [], 0
        if ids:
            yield shard(part, no, ids, tokens)

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
            .mapInArrow(scan, "part INT, shard INT, n_tokens BIGINT, doc_ids ARRAY<BIGINT>, ends BINARY, zeros ARRAY<BIGINT>, planes ARRAY<BINARY>"))


def write_tokens(docs: DataFrame, vocab: str, path: str | None = None, **options) -> DataFrame:
    """Writes the shards (compressed columns, a file a task) to ``path`` or below the shared folder, and gives them as read back."""
    shards = encode_shards(docs, vocab, **options)
    path = path or scratch_path(docs.sparkSession, "tokens")
    shards.write.option("compression", "zstd").parquet(path)
    return read_shards(docs.sparkSession, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` (ids as little-endian unsigned 32-bit integers).

    ``start`` counts the ids of all documents before it: within its shard from the file, before that from the sums of the ranges, of
    which there is one a task."""
    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("part", "shard", "n_tokens", "doc_ids", "ends", "zeros", "planes")}
                ids = WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"]).to_array().astype("<u4")
                ends = np.frombuffer(row["ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * k, pa.int32()), pa.array([row["shard"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                                                  pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                                                 ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])
    docs = shards.mapInArrow(scan, "part INT, shard INT, doc_id BIGINT, at BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = sizes.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("within"))
    return (docs.join(inner.join(before, "part"), ["part", "shard"])
            .select("doc_id", (F.col("base") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
