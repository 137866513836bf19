"""Suffix dedup: byte strings of 50 that also start in an earlier document are found by a difference cover and removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, cut, discard, release
from tidewatch.llm.wordhash import _hash_runs, mix, slices

LENGTH = 50
# A perfect difference cover: of any two positions, one shift below PERIOD brings both onto COVER.  Fixed values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
CORE = LENGTH - PERIOD + 1          # bytes that every two equal strings of LENGTH share from such a pair of positions on
SIDE = PERIOD - 1                   # bytes on either side of a core that the strings through it can reach
LOT = 700_000                     # samples that a task gathers before it sends them
BLOCK_SAMPLES = 1_200_000           # samples, on average, that meet in one task
BLOCK_NAMES = 700_000             # the same for named contexts and for contexts with their bytes
BLOCK_CONTEXTS = 250_000
BLOCK_BYTES = 300_000_000         # text, on average, whose pieces meet in one task
REACH = 64                        # bytes on either side among which a border of pieces has the largest hash; a power of 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COVERED = np.isin(np.arange(PERIOD), COVER)


def _eight(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    view = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at]).view("<u8").ravel()


def _cores(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the CORE bytes at each position."""
    h = mix(_eight(buf, at) * _A + _B)
    h = mix((h ^ _eight(buf, at + 8)) * _A)
    return mix((h ^ _eight(buf, at + CORE - 8)) * _A)


class Samples:
    """Cover positions of a slice of texts: which text, where in it, and the hash of the core there."""

    def __init__(self, texts: list[bytes], places: list[np.ndarray] | None = None):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        if places is None:
            count = np.maximum(self.size - CORE + 1, 0)
            rel = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            keep = _COVERED[rel % PERIOD]
            self.text = np.repeat(np.arange(len(texts)), count)[keep]
            self.rel = rel[keep]
        else:
            self.text = np.repeat(np.arange(len(texts)), [len(x) for x in places])
            self.rel = np.concatenate(places).astype(np.int64)
        self.core = _cores(self.buf, self.rel + self.begin[self.text])

    def undecided(self, whole: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which samples a string goes through that does not lie in one of its text's ranges ``whole`` (their begins and ends)."""
        strings = np.maximum(self.size - LENGTH + 1, 0)
        change = np.zeros(len(self.buf) + 1, np.int32)
        for begin, (a, b) in zip(self.begin.tolist(), whole, strict=True):
            long = b - a >= LENGTH
            np.add.at(change, begin + a[long], 1)
            np.add.at(change, begin + b[long] - LENGTH + 1, -1)
        left = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) == 0)])
        begin = self.begin[self.text]
        low, high = np.maximum(self.rel - SIDE, 0), np.minimum(self.rel + 1, strings[self.text])
        return left[begin + high] > left[begin + low]

    def contexts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes on both sides of the chosen cores, zero where the text ends, and how many there are on the left and on the right."""
        padded = np.concatenate([np.zeros(SIDE, np.uint8), self.buf, np.zeros(LENGTH, np.uint8)])
        view = np.lib.stride_tricks.as_strided(padded, (len(padded) - SIDE - LENGTH + 1, SIDE + LENGTH), (1, 1))
        text, rel = self.text[chosen], self.rel[chosen]
        whole = view[rel + self.begin[text]]
        out = np.concatenate([whole[:, :SIDE], whole[:, SIDE + CORE:]], axis=1)
        left, right = np.minimum(rel, SIDE), np.minimum(self.size[text] - rel - CORE, SIDE)
        place = np.arange(2 * SIDE)
        out[(place < SIDE - left[:, None]) | (place >= SIDE + right[:, None])] = 0
        return out, left.astype(np.uint8), right.astype(np.uint8)


def _blocks_of(core: np.ndarray, n: int) -> np.ndarray:
    return ((core >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def _borders(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin, end and name of every two neighbouring pieces of each text.

    A piece ends where the hash of four bytes is the largest of those near, so what two texts have in common is cut alike in both."""
    gap = bytes(REACH + 4)
    buf = np.frombuffer(gap + b"".join(x for t in texts for x in (t, gap)), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = len(gap) + np.cumsum(size + len(gap)) - size - len(gap)
    h = np.ndarray(len(buf) - 3, np.dtype("<u4"), buf, strides=(1,)) * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    most, step = h, 1                                                # of the hashes from each place on
    while step < REACH:
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    mid = np.arange(REACH, len(h) - REACH)
    mid = mid[(h[REACH:-REACH] > most[:len(mid)]) & (h[REACH:-REACH] >= most[REACH + 1:REACH + 1 + len(mid)])]
    text = np.searchsorted(begin, mid, side="right") - 1
    ok = (text >= 0) & (mid > begin[text]) & (mid < begin[text] + size[text])
    edge, text = np.concatenate([mid[ok], begin, begin + size]), np.concatenate([text[ok], np.arange(len(texts)), np.arange(len(texts))])
    order = np.lexsort((edge, text))
    edge, text = edge[order], text[order]
    one = np.flatnonzero(text[1:] == text[:-1])
    name, text, edge = _hash_runs(buf, edge[one], edge[one + 1]), text[one], np.stack([edge[one], edge[one + 1]])
    pair = np.flatnonzero(text[1:] == text[:-1])
    alone = np.flatnonzero(np.bincount(text, minlength=len(texts))[text] == 1)
    who, start, end = (np.concatenate(x) for x in ((text[pair], text[alone]), (edge[0][pair], edge[0][alone]), (edge[1][pair + 1], edge[1][alone])))
    return who, start - begin[who], end - begin[who], np.concatenate([mix(mix(name[pair] * _A) ^ name[pair + 1]), name[alone]])


def _copied(rows: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, tag, at, value): begins and ends of the neighbouring pieces of a document that an earlier document has too.

    A lot sends a name for its earliest document only and settles the others, so what many documents have does not meet in one task."""
    names = ["block", "name", "done", "docs", "tags", "who", "at", "to"]

    def send(batches):
        parts, who, held = [], [], 0

        def lot():
            ids, tags = (np.concatenate(x) for x in zip(*who, strict=True))
            row, at, to, name = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, order = ids[row], np.argsort(name)
            first = _borders(name[order])
            done = np.zeros(len(name), bool)
            done[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
            block = np.where(done, (mix(name + row.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32), _blocks_of(name, blocks))
            order = np.argsort((block.astype(np.uint64) << np.uint64(33)) | (done.astype(np.uint64) << np.uint64(32)) | row.astype(np.uint64))
            edge = _borders(block[order])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                o = order[a:b]
                live = o[~done[o]]
                *lists, place = _who(ids, tags, row[o])
                yield pa.RecordBatch.from_arrays([pa.array(block[o[:1]]), pa.array([name[live].tobytes()], pa.binary()), pa.array([len(o) - len(live)], pa.int64()), *lists,
                                                  *[pa.array([x], pa.binary()) for x in (place, at[o].astype("<i4").tobytes(), to[o].astype("<i4").tobytes())]], names)
        for batch in batches:
            texts, ids, tags = bytes_of(batch["text"]), batch["doc_id"].to_numpy(zero_copy_only=False), batch["tag"].to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                text, *rest = _pieces(texts[lo:hi])
                parts.append((text + sum(len(x[0]) for x in who), *rest))
                who.append((ids[lo:hi], tags[lo:hi]))
                held += len(text)
                if held >= LOT // 3:
                    yield from lot()
                    parts, who, held = [], [], 0
        if held:
            yield from lot()

    def meet(table: pa.Table) -> pa.Table:
        live, out = [], []
        for row in table.to_pylist():
            mine = (*_of(row), np.frombuffer(row["to"], "<i4"))
            n = len(mine[0]) - row["done"]
            out.append([x[n:] for x in mine])
            live.append((np.frombuffer(row["name"], "<u8"), *[x[:n] for x in mine]))
        name, *mine = (np.concatenate(x) for x in zip(*live, strict=True))
        if len(name):
            order = np.argsort(name)
            first = _borders(name[order])
            doc = mine[0][order]
            later = order[doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(order))))]
            out.append([x[later] for x in mine])
        return _table(*[np.concatenate(x) for x in zip(*out, strict=True)])
    return (rows.mapInArrow(send, "block INT, name BINARY, done BIGINT, docs ARRAY<BIGINT>, tags ARRAY<BIGINT>, who BINARY, at BINARY, to BINARY").groupBy("block")
            .applyInArrow(meet, "doc_id BIGINT, tag BIGINT, at INT, value INT"))


_NONE = np.zeros(0, np.int64)


def _ints(column: pa.Array, i: int) -> np.ndarray:
    """A row's list of numbers; null counts as empty."""
    return column[i].values.to_numpy().astype(np.int64) if column[i].is_valid else _NONE


def _shared_cores(rows: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, key): the sampled cores of each document, as 32 bits of their hash, that another document has too; samples whose strings
    all lie in copied pieces are left out.

    A task sorts its samples and sends each core once for all of its own documents that have it; those are known to share it.  So at most
    one sample a lot comes together for a core, however many documents have it."""
    def sample(batches):
        parts, starts, size = [], [0], 0

        def lot():
            core = np.concatenate([p[0] for p in parts])
            ids, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            doc = np.concatenate([place[a:b][p[2]] for p, a, b in zip(parts, starts[:-1], starts[1:], strict=True)])   # numbers in the order of ids
            order = np.argsort(core)
            core, doc = core[order], doc[order]
            first = _borders(core)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(core))))
            local = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))[group]
            head = np.zeros(len(core), bool)
            head[first] = True
            block = _blocks_of(core, blocks)
            block[~head] = (mix(core[~head] + doc[~head].astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)     # only passed on, so dealt evenly
            send = head | local
            known = local & ~head                                     # the head's own share is found where all heads meet, or here
            core, doc, known, block, lead = (x[send] for x in (core, doc, known, block, head & local))
            order = np.argsort((block.astype(np.uint64) << np.uint64(40)) | (known.astype(np.uint64) << np.uint64(39)) | doc.astype(np.uint64))
            core, doc, known, block, lead = (x[order] for x in (core, ids[doc], known, block, lead))
            edge = _borders(block)
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(block)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(block[a:b][:1]), pa.array([int(np.searchsorted(known[a:b], True))], pa.int64()),
                                                  pa.array([np.diff(doc[a:b], prepend=0).astype("<i8").tobytes()], pa.binary()),
                                                  pa.array([core[a:b].astype("<u4").tobytes()], pa.binary()), pa.array([np.packbits(lead[a:b]).tobytes()], pa.binary())],
                                                 ["block", "open", "docs", "keys", "lead"])
        for batch in batches:
            texts, ids = bytes_of(batch["text"]), batch["doc_id"].to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                s = Samples(texts[lo:hi])
                here = [(_ints(batch["begins"], i), _ints(batch["ends"], i)) for i in range(lo, hi)]
                keep = s.undecided(here) if any(len(a) for a, _ in here) else slice(None)
                parts.append((s.core[keep], ids[lo:hi], s.text[keep]))
                starts.append(starts[-1] + hi - lo)
                size += len(parts[-1][0])
                if size >= LOT:
                    yield from lot()
                    parts, starts, size = [], [0], 0
        if size:
            yield from lot()

    def meet(table: pa.Table) -> pa.Table:
        doc, key, known, lead = [], [], [], []
        for d, k, n, m in zip(*[table[c].to_pylist() for c in ("docs", "keys", "open", "lead")], strict=True):
            k = np.frombuffer(k, "<u4")
            key.append(k)
            doc.append(np.cumsum(np.frombuffer(d, "<i8")))
            known.append(np.arange(len(k)) >= n)
            lead.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool))
        doc, key, known, lead = (np.concatenate(x) for x in (doc, key, known, lead))
        o = np.flatnonzero(~known)
        o = o[np.argsort(key[o])]
        first = _borders(key[o])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(o))))
        shared = known | lead
        if len(o):
            shared[o] |= (np.minimum.reduceat(doc[o], first) != np.maximum.reduceat(doc[o], first))[group]
        return pa.Table.from_arrays([pa.array(doc[shared], pa.int64()), pa.array(key[shared].view(np.int32))], ["doc_id", "key"])
    return (rows.mapInArrow(sample, "block INT, open BIGINT, docs BINARY, keys BINARY, lead BINARY").groupBy("block")
            .applyInArrow(meet, "doc_id BIGINT, key INT"))


def _who(ids: np.ndarray, tags: np.ndarray, row: np.ndarray) -> tuple[pa.Array, pa.Array, bytes]:
    """Documents of some samples, given by their numbers in a lot, as a short list and a place in it for each."""
    each, place = np.unique(row, return_inverse=True)
    return (pa.array([ids[each].tolist()], pa.list_(pa.int64())), pa.array([tags[each].tolist()], pa.list_(pa.int64())),
            place.astype("<u4" if len(each) > 65535 else "<u2").tobytes())


def _of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, tag and position of the samples in a sent row."""
    place = np.frombuffer(row["who"], "<u4" if len(row["docs"]) > 65535 else "<u2")
    return np.array(row["docs"], np.int64)[place], np.array(row["tags"], np.int64)[place], np.frombuffer(row["at"], "<i4")


def _table(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(at.astype(np.int32)), pa.array(value.astype(np.int32))], ["doc_id", "tag", "at", "value"])


def _lots(batches, pick, size: int):
    """Samples of texts, chosen by ``pick``, in lots of about ``size``: the lot's ids and tags, then for each sample its core, the number
    of its document in the lot, its position and its context."""
    parts, who, held = [], [], 0
    lot = lambda: (*[np.concatenate(x) for x in zip(*who, strict=True)], *[np.concatenate(x) for x in zip(*parts, strict=True)])
    for batch in batches:
        texts, ids, tags = bytes_of(batch["text"]), batch["doc_id"].to_numpy(zero_copy_only=False), batch["tag"].to_numpy(zero_copy_only=False)
        for lo, hi in slices(texts):
            s, chosen = pick(texts[lo:hi], batch, lo)
            parts.append((s.core[chosen], s.text[chosen] + sum(len(x[0]) for x in who), s.rel[chosen], *s.contexts(chosen)))
            who.append((ids[lo:hi], tags[lo:hi]))
            held += len(chosen)
            if held >= size:
                yield lot()
                parts, who, held = [], [], 0
    if held:
        yield lot()


COVERED, OPEN = 1, 2


def _same_contexts(rows: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, tag, at, value) for samples with shared cores.  COVERED: an earlier document has the core with the very bytes on both
    sides, so all strings through it.  OPEN: the core also stands in other surroundings, so its strings must be compared one by one.

    Contexts go by name, cores by 32 bits of theirs (two that share these only make samples OPEN).  A context that several documents of a
    lot have is sent for the earliest, and settled for the others."""
    names = ["block", "core", "name", "done", "docs", "tags", "who", "at"]

    def shared(texts, batch, lo):
        s = Samples(texts)
        edge, low = np.searchsorted(s.text, np.arange(len(texts) + 1)), s.core.astype(np.uint32)
        return s, np.concatenate([edge[i] + np.flatnonzero(np.isin(low[edge[i]:edge[i + 1]], batch["keys"][lo + i].values.to_numpy().view(np.uint32))) for i in range(len(texts))])

    def send(batches):
        for ids, tags, core, row, at, ctx, left, right in _lots(batches, shared, LOT // 3):
            name, doc = _context_names(core, ctx, left, right), ids[row]
            del ctx
            order = np.argsort(name)
            first = _borders(name[order])
            done = np.zeros(len(core), bool)
            done[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
            block = np.where(done, (mix(name + row.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32), _blocks_of(core, blocks))
            order = np.argsort((block.astype(np.uint64) << np.uint64(33)) | (done.astype(np.uint64) << np.uint64(32)) | row.astype(np.uint64))
            edge = _borders(block[order])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                o = order[a:b]
                live = o[~done[o]]
                *lists, who = _who(ids, tags, row[o])
                yield pa.RecordBatch.from_arrays([pa.array(block[o[:1]]), pa.array([core[live].astype("<u4").tobytes()], pa.binary()), pa.array([name[live].tobytes()], pa.binary()),
                                                  pa.array([len(o) - len(live)], pa.int64()), *lists, pa.array([who], pa.binary()), pa.array([at[o].astype("<i4").tobytes()], pa.binary())], names)

    def meet(table: pa.Table) -> pa.Table:
        live, out = [], []
        for row in table.to_pylist():
            mine = _of(row)
            n = len(mine[0]) - row["done"]
            out.append((*[x[n:] for x in mine], np.full(row["done"], COVERED)))
            live.append((np.frombuffer(row["core"], "<u4"), np.frombuffer(row["name"], "<u8"), *[x[:n] for x in mine]))
        core, name, doc, tag, at = (np.concatenate(x) for x in zip(*live, strict=True))
        order = np.lexsort((name, core))
        core, name, doc, tag, at = core[order], name[order], doc[order], tag[order], at[order]
        if len(core):
            group, sort = _borders(core), _borders_of_two(core, name)
            later = doc > np.repeat(np.minimum.reduceat(doc, sort), np.diff(np.append(sort, len(doc))))
            several = (np.minimum.reduceat(name, group) != np.maximum.reduceat(name, group)) & (np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group))
            value = np.where(later, COVERED, np.where(np.repeat(several, np.diff(np.append(group, len(doc)))), OPEN, 0))
            out.append((doc[value > 0], tag[value > 0], at[value > 0], value[value > 0]))
        return _table(*[np.concatenate(x) for x in zip(*out, strict=True)])
    return (rows.mapInArrow(send, "block INT, core BINARY, name BINARY, done BIGINT, docs ARRAY<BIGINT>, tags ARRAY<BIGINT>, who BINARY, at BINARY").groupBy("block")
            .applyInArrow(meet, "doc_id BIGINT, tag BIGINT, at INT, value INT"))


def _same_strings(rows: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, tag, at, value) for OPEN samples: bit k is set if the string that begins k bytes before also starts in an earlier document."""
    names = ["block", "core", "around", "left", "right", "docs", "tags", "who", "at"]

    def still_open(texts, batch, lo):
        s = Samples(texts, [batch["open"][lo + i].values.to_numpy() for i in range(len(texts))])
        return s, np.arange(len(s.core))

    def send(batches):
        for ids, tags, core, row, at, ctx, left, right in _lots(batches, still_open, LOT // 8):
            block = _blocks_of(core, blocks)
            order = np.argsort(block, kind="stable")                  # neighbours in a text, which share most of their surroundings, stay so
            edge = _borders(block[order])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                o = order[a:b]
                *lists, who = _who(ids, tags, row[o])
                yield pa.RecordBatch.from_arrays([pa.array(block[o[:1]]), *[pa.array([x.tobytes()], pa.binary()) for x in (core[o], ctx[o], left[o], right[o])], *lists,
                                                  pa.array([who], pa.binary()), pa.array([at[o].astype("<i4").tobytes()], pa.binary())], names)

    def meet(table: pa.Table) -> pa.Table:
        parts = [(*_of(r), np.frombuffer(r["core"], "<u8"), np.frombuffer(r["left"], np.uint8), np.frombuffer(r["right"], np.uint8), np.frombuffer(r["around"], np.uint8).reshape(-1, 2 * SIDE))
                 for r in table.to_pylist()]
        doc, tag, at, core, left, right, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
        mask = _earlier(core, doc, left, right, ctx)
        return _table(*[x[mask > 0] for x in (doc, tag, at, mask)])
    return (rows.mapInArrow(send, "block INT, core BINARY, around BINARY, left BINARY, right BINARY, docs ARRAY<BIGINT>, tags ARRAY<BIGINT>, who BINARY, at BINARY").groupBy("block")
            .applyInArrow(meet, "doc_id BIGINT, tag BIGINT, at INT, value INT"))


def _borders_of_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def _context_names(core: np.ndarray, ctx: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for a context: its core, the bytes around it and how many of them are text."""
    h = core ^ (left.astype(np.uint64) * _A) ^ (right.astype(np.uint64) * _B)
    padded = np.zeros((len(ctx), -(-ctx.shape[1] // 8) * 8), np.uint8)
    padded[:, :ctx.shape[1]] = ctx
    parts = padded.view("<u8")
    for j in range(parts.shape[1]):
        h = mix((h ^ parts[:, j]) * _A)
    return h


def _earlier(core: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Per sample the strings through it that also start in an earlier document: equal strings have equal cores k bytes on.

    For each k the strings are sorted by name, and neighbours with one name are compared by document; only cores that several documents
    have are looked at."""
    masks = np.zeros(len(core), np.int64)
    order = np.argsort(core)
    first = _borders(core[order])
    if not len(first):
        return masks
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    rows = order[(np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first))[group]]
    if not len(rows):
        return masks
    core, doc, left, right, ctx = core[rows], doc[rows], left[rows], right[rows], ctx[rows]
    found = np.zeros(len(rows), np.int64)
    ahead = [core]                                   # names of the core and 0, 1, ... bytes behind it
    for j in range(SIDE):
        ahead.append(mix((ahead[-1] ^ ctx[:, SIDE + j]) * _A))
    back = core * _B
    for k in range(PERIOD):
        if k:
            back = mix((back ^ ctx[:, SIDE - k]) * _A)
        name = back ^ (ahead[SIDE - k] * _B)
        ok = np.flatnonzero((left >= k) & (right >= SIDE - k))
        o = ok[np.argsort(name[ok], kind="stable")]
        first = _borders(name[o])
        if len(first):
            later = doc[o] > np.repeat(np.minimum.reduceat(doc[o], first), np.diff(np.append(first, len(o))))
            found[o[later]] |= 1 << k
    masks[rows] = found
    return masks


def _starts(size: int, whole: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Where the strings to remove begin: all through the COVERED samples, and the marked ones through the others."""
    bits = np.arange(PERIOD)
    some = (at[:, None] - bits)[(mask[:, None] >> bits & 1).astype(bool)]
    every = (whole[:, None] - bits).ravel()
    return np.unique(np.concatenate([some, every[(every >= 0) & (every + LENGTH <= size)]]))


def _kept(text: bytes, starts: np.ndarray, begins: np.ndarray = _NONE, ends: np.ndarray = _NONE) -> tuple[bytes, int]:
    """What is left when the strings of LENGTH from the starts on are gone, and all ranges of that length at least, and the number of
    maximal gaps."""
    change = np.zeros(len(text) + 1, np.int32)
    long = ends - begins >= LENGTH
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long], -1)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and with ``keep_text`` the bytes that stay, ``kept``).

    Every byte goes that lies in a 50-byte string which also starts in a document of smaller id; strings are judged on the input.  Null
    text counts as empty; a row without an id is never earlier than another nor has an earlier one, so it stays whole; rows repeated
    with one id do not count as earlier than each other; further columns are ignored; an empty table gives no rows.

    Suffixes need only be told apart by their first 50 bytes, so the cover has a period of 31 rather than 3, one round of names is enough,
    and 6 of 31 positions are sorted at all.  1. Texts are cut into pieces by their content; strings in two neighbouring pieces that an
    earlier document has too are settled, which spares long copies the steps below: the earliest document with a string has its samples
    still.  2. Cores of 20 bytes at cover positions are named and sorted; those that several documents have remain.  3. All other strings
    of 50 are merged in by the cover position that any two equal ones have in common: samples with equal cores are first named with all
    bytes around them, which settles them where a copy goes on on both sides; at the ends of copies they are sorted by each string through
    them, and neighbours with equal names compared.  4. The bytes are cut."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    able = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    n_bytes = able.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    samples = n_bytes * len(COVER) // PERIOD
    copied = _copied(able.select("doc_id", "tag", "text"), max(1, -(-n_bytes // BLOCK_BYTES)))
    copied = cut(copied.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("begins"), F.collect_list("value").alias("ends")), "pieces")
    release(spark)
    shared = _shared_cores(able.join(copied, ["doc_id", "tag"], "left").select("doc_id", "text", "begins", "ends"), max(1, -(-samples // BLOCK_SAMPLES)))
    shared = cut(shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "cores")
    release(spark)
    many = shared.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    same = _same_contexts(able.join(shared, "doc_id").select("doc_id", "tag", "text", "keys"), max(1, -(-many // BLOCK_NAMES)))
    pick = lambda v: F.collect_list(F.when(F.col("value") == v, F.col("at")))
    found = cut(same.groupBy("doc_id", "tag").agg(pick(COVERED).alias("whole"), pick(OPEN).alias("open")), "samples")
    discard(shared)
    release(spark)
    unsure = found.where(F.size("open") > 0)
    many = unsure.agg(F.coalesce(F.sum(F.size("open")), F.lit(0))).first()[0]
    masks = cut(_same_strings(able.join(unsure.select("doc_id", "tag", "open"), ["doc_id", "tag"]), max(1, -(-many // BLOCK_CONTEXTS))), "strings")
    release(spark)
    masks = masks.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("mask"))
    found = found.select("doc_id", "tag", "whole").join(masks, ["doc_id", "tag"], "left").where((F.size("whole") > 0) | F.col("at").isNotNull())
    found = found.join(copied, ["doc_id", "tag"], "full")

    def finish(batches):
        for batch in batches:
            out = []
            for i, text in enumerate(bytes_of(batch["text"])):
                whole, at, mask, begins, ends = (_ints(batch[c], i) for c in ("whole", "at", "mask", "begins", "ends"))
                if len(whole) or len(at) or len(begins):
                    kept, spans = _kept(text, _starts(len(text), whole, at, mask), begins, ends)
                else:
                    kept, spans = text, 0
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [batch["doc_id"], *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                columns.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, columns)
    schema = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING" + (", kept BINARY" if keep_text else "")
    return rows.join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "whole", "at", "mask", "begins", "ends").mapInArrow(finish, schema)
