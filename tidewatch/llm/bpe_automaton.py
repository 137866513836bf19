"""BPE as a deterministic automaton over tokens, made merge by merge, that encodes pre-split words by its transitions."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# In texts of these characters the split into words is the same for every Unicode version; other texts are split by the tokenizer's
# own pre-tokenizer.  Fixed values: the pattern of the byte-level pre-tokenizer, with the letters and digits of this range spelled out.
SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa0-ſ]*")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
CACHE_WORDS = 200_000      # words remembered by a worker, twice over


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Accepts exactly the token sequences that the merges make of some word.  Its state is the last token read.

    The automaton without merges reads any bytes.  ``add_merge`` then puts in the gadget of one merge ``left right -> whole`` of rank k:
    the arc ``right`` goes from the state behind ``left``; ``whole`` may be read wherever ``left`` could be, and from the state behind it
    whatever could follow ``right`` at that time may follow.  An arc is worked out from the gadgets it passes through when it is first
    taken and kept in the transition table, so only arcs that texts take are ever stored."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.left, self.right, self.rank = {}, {}, {}
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        self.label = {i: b for b, i in tokens.items()}
        made = {w for _, _, w in merges}
        self.words = {b: i for b, i in tokens.items() if i not in made and len(b) == 1}
        for k, (u, v, w) in enumerate(merges):
            self.add_merge(k, u, v, w)
        self.longest = max(map(len, self.words), default=1)

    def add_merge(self, k: int, u: int, v: int, w: int) -> None:
        reachable = self.label[u] in self.words and self.label[v] in self.words and self._open(u, v, k)
        self.cut.setdefault((u, v), k)
        self.left[w], self.right[w], self.rank[w] = u, v, k
        if reachable:                       # else the merge never applies, and no arc is labelled with its token
            self.words[self.label[w]] = w

    def _open(self, s: int, t: int, before: int) -> bool:
        """Whether the arc t leaves state s when only merges of rank below ``before`` are in."""
        while True:
            if self.cut.get((s, t), before) < before:
                return False
            ks, kt = self.rank.get(s, -1), self.rank.get(t, -1)
            if ks < 0 and kt < 0:
                return True
            if kt > ks:                     # the arc was made with t, along the arc ``left`` after that merge's own cut
                t, before = self.left[t], kt + 1
            elif ks > kt:                   # the state was made with s, as it stood behind ``right`` before that merge's cut
                s, before = self.right[s], ks
            else:
                s, t, before = self.right[s], self.left[t], ks

    def step(self, s: int, t: int) -> bool:
        key = s << 32 | t
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            known = self.arcs[key] = self._open(s, t, 1 << 60)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The one accepted sequence of arcs whose labels make up ``word``.

        Every prefix of the word has one accepted sequence too, so a position from which the end is out of reach need not be tried again."""
        whole = self.words.get(word)
        if whole is not None:
            return [whole]
        n, known, longest, step = len(word), self.words, self.longest, self.step
        path, starts, dead = [], [0], set()
        end = min(n, longest)
        while starts[-1] < n:
            pos = starts[-1]
            while end > pos:
                t = known.get(word[pos:end])
                if t is not None and end not in dead and (not path or step(path[-1], t)):
                    break
                end -= 1
            if end > pos:
                path.append(t)
                starts.append(end)
                end = min(n, end + longest)
            elif path:
                dead.add(pos)
                end = starts.pop() - 1
                path.pop()
            else:
                raise ValueError(f"no token sequence for {word!r}")
        return path


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class WordCache(dict):
    """Ids of words as little-endian bytes; the words of two generations are kept."""

    def __init__(self, encode, room: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.room, self.old = encode, room, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = _PACK[n](*found) if (n := len(found := self.encode(word))) < 16 else struct.pack(f"<{n}I", *found)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        letters = byte_letters()
        model = spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = Automaton({raw(t): i for t, i in ids.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.letters = letters
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        labels = dict(self.automaton.label) | {i: s.encode() for s, i in self.special.items()}
        self.length = np.zeros(max(labels) + 1, np.int64)
        for i, b in labels.items():
            self.length[i] = len(b)
        self.offset = np.cumsum(self.length) - self.length
        self.labels = np.frombuffer(b"".join(labels.get(i, b"") for i in range(len(self.length))), np.uint8)
        self.simple = WordCache(lambda w: self.automaton.encode(w.encode()))
        self.other = WordCache(lambda w: self.automaton.encode(bytes(letters[c] for c in w)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special tokens written in it count as such, as the library has it."""
        parts = []
        for i, piece in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                parts.append(np.asarray([self.special[piece]], "<u4").tobytes())
            elif SIMPLE.fullmatch(piece):
                parts.extend(map(self.simple.__getitem__, WORDS.findall(piece)))
            else:
                parts.extend(self.other[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs one after the other, read as UTF-8."""
        size = self.length[ids]
        total = int(size.sum())
        at = np.repeat(self.offset[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        return self.labels[at].tobytes().decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    """One codec a worker and file; building it takes a second."""
    return Codec(path)


def encoded(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and with ``keep_ids`` the ids, little-endian, and the decoded text).

    ``vocab`` is the path of a byte-level BPE file that every executor can read.  Null and empty texts have no tokens; a text of any
    length is encoded whole; ids may be null or repeated and come back as they are; further columns are ignored; an empty table gives no
    rows.  One pass without a shuffle; a word met before costs a lookup."""
    def scan(batches):
        c = codec(vocab)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch["text"].to_pylist()]
            back = [c.decode(x) for x in ids]
            raw = [x.tobytes() for x in ids]
            out = [batch["doc_id"].cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                   pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out += [pa.array(raw, pa.binary()), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)
    schema = "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING" + (", ids BINARY, decoded STRING" if keep_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
