"""Benchmark decontamination: winnowed fingerprints of texts and items are matched, and every hit is extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, cut, discard
from tidewatch.llm.wordhash import ALNUM, grams, slices, words

BLOCK_WORDS = 2_000_000     # benchmark words that one pass holds; a larger benchmark takes more passes
SCHEMA = "doc_id BIGINT, n_words BIGINT, n_hit BIGINT, n_items BIGINT, items_sha256 STRING, contaminated BOOLEAN"


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every run of ``window`` neighbours, the last one of equals (all positions where there are fewer).

    Which one is picked depends on the run alone, so equal runs pick alike."""
    n = len(h) - window + 1
    if n < 1:
        return np.arange(len(h))
    least, at = h[:n].copy(), np.arange(n)
    for j in range(1, window):
        later = h[j:j + n] <= least
        least[later] = h[j:j + n][later]
        at[later] = np.flatnonzero(later) + j
    return np.unique(at)


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``x`` are one of the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers ``first[i], first[i] + 1, ...``, ``many[i]`` of them, one after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


class Windows:
    """The distinct windows of one length: their sorted hashes, a place of each in the benchmark's words, and the items that hold them."""

    def __init__(self, bench_words: np.ndarray, places: np.ndarray, items: np.ndarray, length: int):
        gram = np.zeros(0, np.uint64)
        if len(places):
            gram = grams(bench_words, length)[places]
        order = np.lexsort((items, gram))
        gram, items, places = gram[order], items[order], places[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (items[1:] != items[:-1])              # a window that an item repeats counts once
        gram, self.items, places = gram[new], items[new], places[new]
        self.keys, self.first, self.many = np.unique(gram, return_index=True, return_counts=True)
        self.places, self.length, self.words = places[self.first], length, bench_words

    def look_up(self, gram: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places ``at`` in the words ``h``, with hash ``gram[at]``, those where a window occurs, and its number."""
        k = np.minimum(np.searchsorted(self.keys, gram[at]), len(self.keys) - 1)
        same = self.keys[k] == gram[at]
        at, k = at[same], k[same]
        for j in range(self.length):
            same = h[at + j] == self.words[self.places[k] + j]
            at, k = at[same], k[same]
        return at, k


class Benchmark:
    """A bounded block of items: the distinct windows of their words, and the fingerprints by which windows are found.

    ``span`` words in a row of an item are a window; an item of fewer words is one window as a whole.  Windows are found by the
    least hash of ``span - k + 1`` neighbouring ``k``-grams, which any two equal windows have in common; short items, for which a
    ``k``-gram may be too long, by the hash of all their words.  A fingerprint of a text that is one of the items' is extended to the
    windows around it, each looked up once, so the work does not grow with how often text or items repeat it."""

    def __init__(self, items: list[tuple[int, bytes]], span: int = 10, k: int = 5):
        self.span, self.k = span, k
        self.ids = [i for i, _ in items]
        bench_words, offs = words([t for _, t in items], ALNUM) if items else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        count = np.diff(offs)
        item = np.repeat(np.arange(len(items)), count)
        left = np.repeat(offs[1:], count) - np.arange(len(bench_words))           # words from here to the end of the item
        gram, prints = grams(bench_words, k), [np.zeros(0, np.uint64)]
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            if b - a >= span:
                part = gram[a:b - k + 1]
                prints.append(part[winnowed(part, span - k + 1)])
        self.prints = np.unique(np.concatenate(prints))
        whole = np.flatnonzero(left >= span)
        self.windows = [Windows(bench_words, whole, item[whole], span)]
        for n in np.unique(count[(count > 0) & (count < span)]).tolist():
            short = np.flatnonzero(count == n)
            self.windows.append(Windows(bench_words, offs[short], short, n))

    def find(self, h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
        """Per length of windows: the places in the words ``h`` where one occurs, and its number.  ``ends[i]`` is the end of word i's text."""
        for w in self.windows:
            if not len(w.keys) or len(h) < w.length:
                continue
            gram = grams(h, w.length)
            if w.length < self.span:
                at = np.flatnonzero(_among(gram, w.keys))
            else:
                parts = grams(h, self.k)
                at = winnowed(parts, self.span - self.k + 1)     # over text borders too: more fingerprints, never fewer in a text
                at = at[_among(parts[at], self.prints)]
                at = np.unique(at[:, None] - np.arange(self.span - self.k + 1))    # a window may begin so many words before its fingerprint
                at = at[(at >= 0) & (at < len(gram))]
            yield w, *w.look_up(gram, h, at[at + w.length <= ends[at]])


def hits(texts: list[bytes], bench: Benchmark) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Per text: its number of words, the sorted positions of hit words, the sorted indices of items found."""
    for lo, hi in slices(texts):
        h, offs = words(texts[lo:hi], ALNUM)
        count = np.diff(offs)
        doc = np.repeat(np.arange(hi - lo), count)
        change = np.zeros(len(h) + 1, np.int64)
        found: dict[int, list[np.ndarray]] = {}
        for w, at, number in bench.find(h, np.repeat(offs[1:], count)):
            change[:-1] += np.bincount(at, minlength=len(h))
            change += np.bincount(at + w.length, minlength=len(h) + 1)[:len(h) + 1] * -1
            order = np.lexsort((number, doc[at]))
            owner, number = doc[at][order], number[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
            owner, number = owner[new], number[new]
            begin = np.searchsorted(owner, np.arange(hi - lo + 1))
            for d in np.unique(owner).tolist():
                n = number[begin[d]:begin[d + 1]]
                found.setdefault(d, []).append(np.unique(w.items[_spread(w.first[n], w.many[n])]))
        hit = np.cumsum(change[:-1]) > 0                          # windows end inside their text, so no sum crosses a border
        for d in range(hi - lo):
            here = found.get(d)
            yield int(count[d]), np.flatnonzero(hit[offs[d]:offs[d + 1]]), np.unique(np.concatenate(here)).tolist() if here else []


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``limit`` words, streamed to the driver one partition at a time."""
    block, size = [], 0
    for i, t in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        b = t.encode()
        if block and size + len(b) // 2 > limit:
            yield block
            block, size = [], 0
        block.append((i, b))
        size += len(b) // 2 + 1
    if block:
        yield block


def _digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in ids)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  span: int = 10, k: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  ``n_hit`` words lie in an occurrence of some item's
    window.  Null text has no words; items that are null or have no words have no windows; repeated rows each get their own result;
    items with the same id count once; further columns are ignored; without documents there are no rows, without items no hits.

    The items are a query set: they are gone through in blocks of at most ``block_words`` words, each of which goes to the tasks, so
    what is broadcast is bounded however large the benchmark is.  One block, the usual case, takes one pass without a shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, item_col, "text", block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)

        def one_pass(batches):
            bench = Benchmark(shared.value, span, k)
            for batch in batches:
                out = [(n, len(hit), bench, items) for n, hit, items in hits(bytes_of(batch["text"]), bench)]
                ids = [sorted({str(bench.ids[i]) for i in items}) for _, _, _, items in out]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([len(x) for x in ids], pa.int64()), pa.array([_digest(x) for x in ids], pa.string()),
                                                  pa.array([o[1] > 0 for o in out], pa.bool_())],
                                                 ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
        return rows.mapInArrow(one_pass, SCHEMA)
    return _in_blocks(rows, [first, second], blocks, span, k)


def _in_blocks(rows: DataFrame, ready: list, rest: Iterator, span: int, k: int) -> DataFrame:
    """More than one block: each pass writes the hits of its items, and the passes meet by row."""
    spark = rows.sparkSession
    keyed = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = []

    def blocks():
        yield from ready
        yield from rest

    for block in blocks():
        shared = spark.sparkContext.broadcast(block)

        def one_pass(batches, shared=shared):
            bench = Benchmark(shared.value, span, k)
            for batch in batches:
                out = list(hits(bytes_of(batch["text"]), bench))
                yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"].cast(pa.int64()), pa.array([o[0] for o in out], pa.int64()),
                                                  pa.array([o[1].tolist() for o in out], pa.list_(pa.int64())),
                                                  pa.array([[str(bench.ids[i]) for i in o[2]] for o in out], pa.list_(pa.string()))],
                                                 ["row", "doc_id", "n_words", "hit", "items"])
        parts.append(cut(keyed.mapInArrow(one_pass, "row BIGINT, doc_id BIGINT, n_words BIGINT, hit ARRAY<BIGINT>, items ARRAY<STRING>"), "hits"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = (every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                      F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    out = found.select("doc_id", "n_words", F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))
    out = cut(out, "contamination")
    for part in [keyed, *parts]:
        discard(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", span: int = 10, k: int = 5,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no word is hit: the filter form of ``contamination``, one pass per block of items.

    Passes are apart, with what the last one kept written between them, so a task holds one block at a time."""
    out, written = docs, None
    for i, block in enumerate(_blocks(benchmark, item_col, "text", block_words)):
        if i:
            kept = cut(out, "clean")
            if written is not None:
                discard(written)
            out = written = kept
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            bench = Benchmark(shared.value, span, k)
            for batch in batches:
                clean = [not len(hit) for _, hit, _ in hits(bytes_of(batch[text_col]), bench)]
                yield batch.filter(pa.array(clean, pa.bool_()))
        out = out.mapInArrow(keep, docs.schema)
    return out
