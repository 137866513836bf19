"""Long copies are settled by pieces, not sample by sample."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import suffix_dedup


def brute(rows):
    first = {}
    for d, t in rows:
        for j in range(len(t) - 49):
            first[t[j:j + 50]] = min(d, first.get(t[j:j + 50], d))
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - 49):
            if first[t[j:j + 50]] < d:
                gone[j:j + 50] = True
        kept = "".join(c for c, g in zip(t, gone, strict=False) if not g)
        out[d] = (len(t) - len(kept), sum(1 for j in range(len(t)) if gone[j] and (not j or not gone[j - 1])), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_samples_of_long_copies_are_not_sent(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    own = [text(r.randint(60, 500)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(own * 5)]                                      # whole copies
    rows += [(100 + i, text(40) + t[60:] + text(30)) for i, t in enumerate(own[:6])]     # copies of a part
    rows += [(200, "a" * 700), (201, "b" + "a" * 400), (202, "x" * 49), (203, ""), (204, own[0][:49] + "!"), (205, own[0][7:57])]
    r.shuffle(rows)
    keys, cut = [], suffix_dedup.cut

    def counted(df, name="llm", *more):
        out = cut(df, name, *more)
        if name == "cores":
            keys.append(out.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0])
        return out
    monkeypatch.setattr(suffix_dedup, "cut", counted)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    got = {x.doc_id: (x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute(rows)
    samples = sum(len(t) for _, t in rows) * len(suffix_dedup.COVER) / suffix_dedup.PERIOD
    assert 0 < keys[0] < samples / 10                 # were nearly all of them
