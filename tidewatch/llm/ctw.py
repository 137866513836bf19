"""LM scoring: context-tree weighting over bytes, and a word baseline, both with statistics of the whole training part."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, cut, discard, release
from tidewatch.llm.wordhash import NOT_BLANK, mix, slices, words

SLOT_BITS = (8, 16, 20, 20, 21)     # context bytes 0 to 4, and the counters that ``Model`` has for each
BLOCK_BITS = 17
EDGE = 0xFF                         # stands before and after a text; no UTF-8 text holds this byte
KNOWN_WORDS = 300_000               # most frequent words that tasks hold; all others are looked up by a join
KNOWN_GRAMS = 400_000               # the same for bytes with their contexts
CACHE_BITS = 20                     # byte contexts whose code length a worker remembers


def _offsets() -> list[int]:
    return [sum(1 << b for b in SLOT_BITS[:d]) for d in range(len(SLOT_BITS) + 1)]


def _slots(grams: np.ndarray, depth: int, level: int) -> np.ndarray:
    """Counter of the node ``level`` bits down in the tree of the byte, under the ``depth`` bytes before it.

    A gram holds the byte lowest and its context above, the nearest byte first.  Depths 0 and 1 have a counter for every node; deeper
    ones share theirs by hash, which keeps the model of one size: nodes that meet in a counter are predicted as one."""
    byte = grams & np.uint64(255)
    node = (byte >> np.uint64(8 - level)) | np.uint64(1 << level)
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    key = context << np.uint64(8) | node
    if depth > 1:
        key = mix(key + np.uint64(depth) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS[depth])
    return key.astype(np.int64) + _offsets()[depth]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts and the end of each, with the bytes before it; and where each text's grams begin."""
    deep = len(SLOT_BITS) - 1
    pad = bytes([EDGE]) * deep
    buf = np.frombuffer(pad + pad.join(t + b"\xff" for t in texts), np.uint8).astype(np.uint64)
    out = buf[deep:].copy()
    for d in range(1, deep + 1):
        out |= buf[deep - d:-d] << np.uint64(8 * d)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(size + deep) - size - deep
    keep = np.ones(len(out), bool)
    for d in range(deep):
        keep[begin[1:] - 1 - d] = False
    return out[keep], np.cumsum(size) - size


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma by Stirling's series, after a shift to where it is exact to double precision."""
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 9
        shift = shift - np.where(low, np.log(x), 0)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


class Model:
    """A tree of fixed size, for texts in one process: Krichevsky-Trofimov estimates of all nodes, and how much of each node's mixture is
    its own estimate.  ``scores`` doesn't use it: its tree is exact (:func:`code_lengths`)."""

    def __init__(self, p: np.ndarray, own: np.ndarray):
        self.p, self.own = p, own            # own < 0: never seen
        self.keys = np.full(1 << CACHE_BITS, 2**64 - 1, np.uint64)
        self.bits = np.zeros(1 << CACHE_BITS)

    @classmethod
    def weighted(cls, zeros: np.ndarray, ones: np.ndarray, above: np.ndarray) -> Model:
        """Weights from the deepest level up: half the prior on a node's own estimate, half on its longer contexts together."""
        offs, n = _offsets(), len(zeros)
        p, own, inner = np.full(n, 0.5, np.float32), np.full(n, -1, np.float32), np.zeros(n)
        for d in range(len(SLOT_BITS) - 1, -1, -1):
            for lo in range(offs[d], offs[d + 1], 1 << 18):
                at = slice(lo, min(lo + (1 << 18), offs[d + 1]))
                a, b = zeros[at].astype(np.float64), ones[at].astype(np.float64)
                seen = a + b > 0
                kt = _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1)
                p[at] = (b + 0.5) / (a + b + 1)
                if d == len(SLOT_BITS) - 1:
                    both, share = kt, np.ones(len(a))
                else:
                    both = np.logaddexp(kt, inner[at]) - math.log(2)
                    share = np.exp(kt - math.log(2) - both)
                own[at] = np.where(seen, share, -1)
                if d:
                    np.add.at(inner, above[at][seen], both[seen])
        return cls(p, own)

    def code_length(self, grams: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each gram: eight binary decisions, each mixed over all depths.

        A context that was never seen predicts like the longest one that was."""
        out = np.zeros(len(grams))
        for level in range(8):
            one = (grams >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
            q, known = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
            for d in range(len(SLOT_BITS) - 1, -1, -1):
                s = _slots(grams, d, level)
                p, own = self.p[s].astype(np.float64), self.own[s].astype(np.float64)
                q = np.where(own < 0, q, np.where(known, own * p + (1 - own) * q, p))
                known |= own >= 0
            out -= np.log2(np.where(one, q, 1 - q))
        return out

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text and its end; contexts met before are looked up."""
        grams, begin = _grams(texts)
        at = (mix(grams) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        bits, hit = self.bits[at], self.keys[at] == grams
        if not hit.all():
            new, back = np.unique(grams[~hit], return_inverse=True)
            cost = self.code_length(new)
            bits[~hit] = cost[back]
            slot = (mix(new) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[slot], self.bits[slot] = new, cost
        return np.add.reduceat(bits, begin) if len(begin) else np.zeros(0)


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Counter:
    """Counts of 64-bit keys in bounded memory: a full buffer is emptied by whoever adds to it."""

    def __init__(self, room: int):
        self.room, self.keys, self.counts, self.size = room, [], [], 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > 2 * self.room:
            k, c = self.take()
            if len(k) > self.room:
                return k, c
            self.keys, self.counts, self.size = [k], [c], len(k)
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, c = _tally(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        return k, c


def _node_blocks(grams: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Counter updates of some grams, in blocks: slots, zeros, ones, and the slot of the node with one context byte less."""
    offs = _offsets()
    for d in range(len(SLOT_BITS)):
        g, c = _tally(grams & np.uint64((1 << 8 * (d + 1)) - 1), counts)
        zeros, ones, above = np.zeros(1 << SLOT_BITS[d], np.int64), np.zeros(1 << SLOT_BITS[d], np.int64), np.zeros(1 << SLOT_BITS[d], np.int32)
        for level in range(8):
            s = _slots(g, d, level) - offs[d]
            bit = (g >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
            ones += np.bincount(s[bit], c[bit], minlength=len(ones)).astype(np.int64)
            zeros += np.bincount(s[~bit], c[~bit], minlength=len(zeros)).astype(np.int64)
            if d:
                above[s] = _slots(g, d - 1, level)
        used = np.flatnonzero(zeros + ones)
        block = (used + offs[d]) >> BLOCK_BITS
        for b in np.unique(block).tolist():
            u = used[block == b]
            yield b, (u + offs[d]).astype("<i4").tobytes(), zeros[u].astype("<i8").tobytes(), ones[u].astype("<i8").tobytes(), above[u].astype("<i4").tobytes()


def _learn(rows: DataFrame) -> DataFrame:
    """One pass over all texts: counts of words in training texts, and of byte grams in training texts (even) and held-out ones (odd)."""
    names = ["word", "many", "gram", "times"]

    def out(k, c, at):
        two = [pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))]
        none = [pa.nulls(len(k), pa.int64())] * 2
        return pa.RecordBatch.from_arrays(two + none if at == 0 else none + two, names)

    def scan(batches):
        counters = _Counter(500_000), _Counter(1_000_000)
        for batch in batches:
            texts, held = bytes_of(batch["text"]), batch["held_out"].to_pylist()
            for lo, hi in slices(texts):
                train = [t for t, h in zip(texts[lo:hi], held[lo:hi], strict=True) if h is False]
                rest = [t for t, h in zip(texts[lo:hi], held[lo:hi], strict=True) if h is not False]
                found = [(0, words(train, NOT_BLANK)[0])] if train else []
                found += [(1, _grams(some)[0] << np.uint64(1) | np.uint64(odd)) for odd, some in enumerate((train, rest)) if some]
                for at, keys in found:
                    full = counters[at].add(keys)
                    if full:
                        yield out(*full, at)
        for at, counter in enumerate(counters):
            yield out(*counter.take(), at)
    return rows.mapInArrow(scan, "word BIGINT, many BIGINT, gram BIGINT, times BIGINT")


# ------------------------------------------------------------------------------------------------ the exact tree, by subtrees
def _weigh(zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some nodes: estimate of a one, its share in the node's mixture (below 0: never seen), and log probability of the mixture.
    ``inner`` is the log probability of the longer contexts together; the deepest nodes have none."""
    kt = _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - math.log(math.pi) - _lgamma(zeros + ones + 1)
    both = kt if inner is None else np.logaddexp(kt, inner) - math.log(2)
    share = np.ones(len(kt)) if inner is None else np.exp(kt - math.log(2) - both)
    return (ones + 0.5) / (zeros + ones + 1), np.where(zeros + ones > 0, share, -1), both


def _nodes(grams: np.ndarray, depth: int) -> np.ndarray:
    """Name of the node that each gram passes on each of its eight levels: context, then the bits before."""
    byte, context = grams & np.uint64(255), (grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return np.stack([context << np.uint64(8) | byte >> np.uint64(8 - level) | np.uint64(1 << level) for level in range(8)])


def _subtrees(grams: np.ndarray, counts: np.ndarray):
    """Weights of the nodes of depths 4 and 3, from all grams below some contexts of three bytes.

    Returns for either depth the estimates and shares and each gram's nodes; and names, zeros, ones and inner sums of the nodes of depth 2."""
    bit = np.stack([grams >> np.uint64(7 - level) & np.uint64(1) for level in range(8)]).astype(bool).ravel()
    many = np.tile(counts.astype(np.float64), 8)
    found, below = [], None
    for depth in (4, 3, 2):
        names, at = np.unique(_nodes(grams, depth).ravel(), return_inverse=True)
        zeros, ones = (np.bincount(at[b], many[b], len(names)) for b in (~bit, bit))
        inner = None
        if below is not None:
            up = np.zeros(len(below[0]), np.int64)
            up[below[1]] = at
            inner = np.bincount(up, np.where(below[2], below[3], 0), len(names))
        if depth == 2:
            return found, (names, zeros, ones, inner)
        p, own, both = _weigh(zeros, ones, inner)
        found.append((p, own, at.reshape(8, -1)))
        below = names, at, own >= 0, both


def _bits(grams: np.ndarray, steps) -> np.ndarray:
    """Code length of each gram; ``steps`` gives estimates, shares and the grams' nodes from the deepest context up.

    A context that was never seen predicts like the longest one that was."""
    out = np.zeros(len(grams))
    for level in range(8):
        q, known = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for p, own, at in steps:
            x, share = p[at[level]], own[at[level]]
            q = np.where(share < 0, q, np.where(known, share * x + (1 - share) * q, x))
            known |= share >= 0
        out -= np.log2(np.where((grams >> np.uint64(7 - level) & np.uint64(1)).astype(bool), q, 1 - q))
    return out


def _by_context(batches, size: int = 250_000) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows in chunks that end where ``c3`` changes, so that a context of three bytes (65,536 grams at most) is never divided."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        cols = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
        held = {c: np.concatenate([held[c], x]) for c, x in cols.items()} if held else cols
        if len(held["c3"]) >= size:
            end = np.flatnonzero(held["c3"] != held["c3"][-1])
            if len(end):
                yield {c: x[:end[-1] + 1] for c, x in held.items()}
                held = {c: x[end[-1] + 1:] for c, x in held.items()}
    if held and len(held["c3"]):
        yield held


def code_lengths(grams: DataFrame) -> DataFrame:
    """(gram, times, bits): what the weighted tree of all training grams needs for each gram of ``grams`` (gram, trained, times).

    Every node has counters of its own.  Nodes of depths 4 and 3 lie below one context of three bytes, so tasks work them out from the
    grams of whole contexts; of depth 2 they are sums over tasks, shuffled and joined by context; depths 1 and 0 have at most 65,535 nodes."""
    spark = grams.sparkSession
    context = F.shiftright("gram", 8)
    sorted_grams = grams.select("gram", "trained", "times", context.bitwiseAND(0xFFFF).alias("c2"), F.lit(1).alias("kind"), context.bitwiseAND(0xFFFFFF).alias("c3"))

    def up(batches):
        for x in _by_context(batches):
            _, (names, zeros, ones, inner) = _subtrees(x["gram"].view(np.uint64), x["trained"])
            seen = zeros + ones > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (names.view(np.int64), zeros, ones, inner)], ["node", "zeros", "ones", "inner"])
    sums = (sorted_grams.repartition("c2").sortWithinPartitions("c2", "c3").mapInArrow(up, "node BIGINT, zeros DOUBLE, ones DOUBLE, inner DOUBLE")
            .groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "inner")]))

    def weighed(batches):
        for batch in batches:
            made = _weigh(*[batch[c].to_numpy() for c in ("zeros", "ones", "inner")])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], [*batch.schema.names, "p", "own", "both"])
    second = cut(sums.mapInArrow(weighed, "node BIGINT, zeros DOUBLE, ones DOUBLE, inner DOUBLE, p DOUBLE, own DOUBLE, both DOUBLE"), "nodes")
    first = second.groupBy(F.col("node").bitwiseAND(0xFFFF).alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "both")]).toArrow()
    node = first["node"].to_numpy()
    top = {d: np.zeros((3, 1 << 8 * (d + 1))) for d in (1, 0)}                  # zeros, ones and inner sums by node
    top[1][:, node] = [first[c].to_numpy() for c in ("zeros", "ones", "both")]
    p1, own1, both1 = _weigh(*top[1])
    top[0][:] = [x.reshape(256, 256).sum(0) for x in (top[1][0], top[1][1], np.where(own1 >= 0, both1, 0))]
    p0, own0, _ = _weigh(*top[0])
    few = spark.sparkContext.broadcast((p1, own1, p0, own0))

    def down(batches):
        p1, own1, p0, own0 = few.value
        last = np.zeros((3, 0))
        for x in _by_context(batches):
            is_node = x["kind"] == 0
            near = np.concatenate([last, [x[c][is_node] for c in ("gram", "p", "own")]], axis=1)
            near = near[:, np.argsort(near[0])]                                 # names below 2^24, so doubles hold them
            last = near[:, near[0].astype(np.int64) >> 8 == x["c2"][-1]]
            g = x["gram"][~is_node].view(np.uint64)
            if len(g):
                steps, _ = _subtrees(g, x["trained"][~is_node])
                names, want = near[0].astype(np.uint64), _nodes(g, 2)
                at = np.searchsorted(names, want)
                hit = names[np.minimum(at, len(names) - 1)] == want if len(names) else np.zeros(want.shape, bool)
                steps += [(np.append(near[1], 0.5), np.append(near[2], -1), np.where(hit, at, len(names))),
                          (p1, own1, _nodes(g, 1).astype(np.int64)), (p0, own0, _nodes(g, 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(x["times"][~is_node]), pa.array(_bits(g, steps))], ["gram", "times", "bits"])
    nodes = second.select(F.col("node").alias("gram"), F.lit(0).cast("bigint").alias("trained"), F.lit(0).cast("bigint").alias("times"),
                          F.shiftright("node", 8).alias("c2"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("c3"), "p", "own")
    both = nodes.unionByName(sorted_grams.withColumns({"p": F.lit(0.0), "own": F.lit(0.0)}))
    out = cut(both.repartition("c2").sortWithinPartitions("c2", "kind", "c3").mapInArrow(down, "gram BIGINT, times BIGINT, bits DOUBLE"), "bits")
    discard(second)
    return out


def held_out_ids(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    """Whether a document is kept out of training: by CRC-32 of its id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


class WordTable:
    """log10 frequencies of the frequent words by hash: most are found in their own slot, the few that share one by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.bits = keys, values, max(4, len(keys).bit_length() + 2)
        self.slot = np.zeros(1 << self.bits, np.int32)
        at = self._at(keys)
        self.slot[at] = np.arange(len(keys))
        self.clash = np.zeros(1 << self.bits, bool)
        self.clash[at[self.slot[at] != np.arange(len(keys))]] = True

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the table, and the place of each that is."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        slot = self._at(h)
        at = self.slot[slot].astype(np.int64)
        again = np.flatnonzero((self.keys[at] != h) & self.clash[slot])
        at[again] = np.minimum(np.searchsorted(self.keys, h[again]), len(self.keys) - 1)
        return self.keys[at] == h, at


_kept: dict[str, object] = {}


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Both models learn from the rows that are not held out.  ``base_score`` adds up log10 of smoothed word frequencies, words between
    blanks with A-Z lower-cased and one end a text.  ``score`` is log10 of the probability that the weighted context tree gives to the
    bytes of the text and its end.  Null text counts as empty; repeated rows are scored each; further columns are ignored; an empty
    table gives no rows, and without training rows every byte costs eight bits.

    Words are told apart by a 64-bit hash, bytes and their contexts by themselves: every node of the tree has counters of its own.  Of
    words and of bytes in context the most frequent ones, a bounded list, go to every task; the rest, of any number, are joined.  What
    tasks send for training is proportional to what they read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    learned = cut(_learn(rows.select("text", "held_out")), "learned")
    ends = rows.where(~F.col("held_out")).count()
    counts = cut(learned.where(F.col("many").isNotNull()).groupBy("word").agg(F.sum("many").alias("many")), "words")
    n, v = counts.agg(F.coalesce(F.sum("many"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    grams = cut(learned.where(F.col("gram").isNotNull()).groupBy(F.shiftright("gram", 1).alias("gram")).agg(
        F.sum(F.when(F.col("gram").bitwiseAND(1) == 0, F.col("times")).otherwise(0)).alias("trained"), F.sum("times").alias("times")), "grams")
    bits = code_lengths(grams)
    discard(grams)
    common = bits.orderBy(F.desc("times"), "gram").limit(KNOWN_GRAMS).select("gram", "bits").toArrow()
    gram_hash = mix(common["gram"].to_numpy().view(np.uint64))
    by_hash = np.argsort(gram_hash)
    often = counts.orderBy(F.desc("many"), "word").limit(KNOWN_WORDS).toArrow()
    known, times = often["word"].to_numpy().view(np.uint64), often["many"].to_numpy()
    order = np.argsort(known)
    below = n + 0.5 * (v + 1)
    shared = spark.sparkContext.broadcast((gram_hash[by_hash], common["bits"].to_numpy()[by_hash], known[order], np.log10((times[order] + 0.5) / below)))
    del common, gram_hash, often, known, times
    release(spark)
    run = uuid.uuid4().hex
    end_score = math.log10((ends + 0.5) / below)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "bits", "n_bytes", "word", "gram", "times"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def some_of(**given):
        size = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names)

    def scan(batches):
        if _kept.get("run") != run:                # a worker keeps what it has looked up from task to task
            gram, cost, hot, value = shared.value
            _kept.update({"run": run, "grams": WordTable(gram, cost), "table": WordTable(hot, value)})
        tree, table, row = _kept["grams"], _kept["table"], TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = bytes_of(batch["text"])
            for lo, hi in slices(texts):
                some, k = texts[lo:hi], hi - lo
                g, begin = _grams(some)
                found, at = tree.find(mix(g))
                bits = np.zeros(len(g))
                bits[found] = tree.values[at[found]]
                doc = np.repeat(np.arange(k), np.diff(np.append(begin, len(g))))
                pairs, times = np.unique(doc[~found].astype(np.uint64) << np.uint64(40) | g[~found], return_counts=True)
                yield some_of(row=(pairs >> np.uint64(40)).astype(np.int64) + row, gram=(pairs & np.uint64((1 << 40) - 1)).astype(np.int64), times=times)
                h, offs = words(some, NOT_BLANK)
                doc = np.repeat(np.arange(k), np.diff(offs))
                found, at = table.find(h)
                base = np.bincount(doc[found], table.values[at[found]], k) if found.any() else np.zeros(k)
                yield some_of(row=np.arange(row, row + k), doc_id=batch["doc_id"][lo:hi], held_out=batch["held_out"][lo:hi], n_tokens=np.diff(offs) + 1,
                              n_known=np.bincount(doc[found], minlength=k) + (1 if ends else 0), base=base + end_score,
                              bits=np.add.reduceat(bits, begin), n_bytes=[len(t) for t in some])
                yield some_of(row=doc[~found] + row, word=h[~found].view(np.int64))
                row += k
    scored = cut(rows.mapInArrow(scan, "row BIGINT, doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, base DOUBLE, bits DOUBLE, n_bytes BIGINT, word BIGINT, gram BIGINT, times BIGINT"), "scored")
    discard(learned)
    rare = scored.where(F.col("word").isNotNull()).select("row", "word").join(counts, "word", "left")
    each = F.log10((F.coalesce("many", F.lit(0)) + 0.5) / below)
    rare = rare.groupBy("row").agg(F.sum(each).alias("rest"), F.count("many").alias("rest_known"))
    seldom = (scored.where(F.col("gram").isNotNull()).select("row", "gram", F.col("times").alias("here")).join(bits.select("gram", F.col("bits").alias("cost")), "gram")
              .groupBy("row").agg(F.sum(F.col("here") * F.col("cost")).alias("more")))
    whole = (scored.where(F.col("n_tokens").isNotNull()).drop("word", "gram", "times").join(rare, "row", "left").join(seldom, "row", "left")
             .withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0))))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
                        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (-F.col("bits") * math.log10(2)).alias("score"),
                        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
