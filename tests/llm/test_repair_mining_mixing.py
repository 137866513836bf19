"""Conversation repair, hard-negative mining and source mixing against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat_repair, mixing, negatives

LAW = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit) over all edits with at most two insertions in a gap; rows: (initial, fault)."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for initial, fault in rows:
        extra = 3 * (fault == chat_repair.CUT)
        keep = [] if fault in (chat_repair.BLANK, chat_repair.DUPLICATE) else [(extra, "K", initial), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
        choices.append([(4, "D", ""), *keep])
    for edits in itertools.product(*choices):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            made = "".join(g + e[2] for g, e in zip(filled, [*edits, (0, "", "")], strict=True))
            if LAW.fullmatch(made):
                audit = "".join("I" * len(g) + e[1] for g, e in zip(filled, [*edits, (0, "", "")], strict=True))
                found = (sum(e[0] for e in edits) + 3 * sum(map(len, filled)), audit)
                best = min(best or found, found)
    return best


def symbols(rows):
    return ["X" if f in (chat_repair.BLANK, chat_repair.DUPLICATE) else (c if c in "sua" else "o").upper() if f == chat_repair.CUT else c if c in "sua" else "o" for c, f in rows]


def test_parse_finds_the_cheapest_edits():
    r = random.Random(1)
    for _ in range(60):
        rows = [(r.choice("suaaut"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(1, 3))]
        cell = chat_repair.parsed("".join(symbols(rows)))
        assert min(cell[q] for q in chat_repair.ENDS if cell[q]) == cheapest(rows), rows


def test_spans_parse_like_the_whole():
    r = random.Random(2)
    for n in (1, 2, 5, 40, 300):
        row = "".join(r.choice("suaaoXUA") for _ in range(n))
        whole = chat_repair.parsed(row)
        cuts = sorted(r.sample(range(1, n), min(n - 1, 6)))
        pieces = [row[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        cells = [chat_repair.parsed(p) for p in pieces]
        cost, audit, path = chat_repair.best_path(cells)
        assert (cost, audit) == min(whole[q] for q in chat_repair.ENDS if whole[q])
        assert "".join(c[p * 4 + q][1] for c, (p, q) in zip(cells, path, strict=True)) == audit
        assert path[0][0] == chat_repair.START and all(x[1] == y[0] for x, y in itertools.pairwise(path))


TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, h STRING, salt STRING, n STRING, part INT, fault STRING, _damage INT"


def expected(rows):
    """Reports of (conv, turn, role, text) rows by a left-to-right search over the states."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, items in convs.items():
        key = {i: hashlib.sha256(f"{'none' if conv is None else conv}:{len(i[1])}:{i[1]}{i[2]}".encode()).digest() for i in items}
        items.sort(key=lambda i: (i[0] is not None, i[0] or 0, i[1], key[i]))
        seen, counts, now = set(), Counter(), {0: (0, "", [])}

        def inserted(now):
            for _ in range(4):
                for (p, c), q in chat_repair.STEPS.items():
                    if p in now and c != "s":
                        new = (now[p][0] + 3, now[p][1] + "I", [*now[p][2], chat_repair.ROLES[c] + ":"])
                        now[q] = min(now.get(q, new), new, key=lambda x: x[:2])
            return now
        now = inserted(now)
        for _, role, text in items:
            body = text.rstrip(" \t\n\v\f\r")
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            ways = {p: (c + 4, a + "D", o) for p, (c, a, o) in now.items()}
            for (p, c), q in chat_repair.STEPS.items():
                for cost, edit, name in [(0, "K", role)] * (c == role[:1]) + [(3, "R", chat_repair.ROLES.get(c))] * (c != "s"):
                    if p in now and fault in (0, 3):
                        new = (now[p][0] + cost + fault, now[p][1] + edit, [*now[p][2], f"{name}:{text}"])
                        ways[q] = min(ways.get(q, new), new, key=lambda x: x[:2])
            now = inserted(ways)
        cost, audit, lines = min((now[q] for q in (0, 3) if q in now), key=lambda x: x[:2])
        turns = [t for t, _, _ in items if t is not None]
        illegal = sum((a[1][:1] or " ") + (b[1][:1] or " ") not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk():
    r = random.Random(5)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn * r.choice([1, 1, 1, 2]) if r.random() > 0.1 else None, r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]),
                         r.choice(["Hi.", "Hi.", "Yes!", "no", "so? \n", "", " \t", None, "é" * 50 + ".", f"{turn}."])))
    rows += [(40, t, "user" if t % 2 == 0 else "assistant", f"{t}." if t % 50 else "Same.") for t in range(1500)]          # many spans
    rows += [(41, 3, "user", "Again.")] * 700                                                                             # one row many times
    rows += [(42, None, None, "x" * 200_000 + "."), (43, 7, "assistant", ".")]
    return [(*x, "!", "!", "!", 1, "!", 2) for x in rows]


def test_repair_of_conversations(spark, talk, monkeypatch):
    monkeypatch.setattr(chat_repair, "SPAN", 16)
    turns = spark.createDataFrame(talk, TURNS).repartition(5)
    got = chat_repair.repair_digests(turns.select("conv_id"), *chat_repair.repair(turns)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected(talk) and len(got) == 45
    assert chat_repair.repair_digests(turns.select("conv_id"), *chat_repair.repair(turns.where("conv_id < 0"))).where("cost = 0 AND audit = '' AND gaps = 0").count() == 45
    reports, edited = chat_repair.repair(turns.where("conv_id = 41"))
    assert reports.first()["duplicate"] == 699 and edited.where("edit = 'D'").count() >= 699


def test_damage_follows_the_checksum(spark, talk):
    import zlib
    turns = spark.createDataFrame(talk, TURNS)
    want = Counter()
    for conv, turn, role, text, *_ in talk:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if d == 4 else " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        want[conv, turn, role, text] += 0 if d == 0 else 2 if d == 3 else 1
    assert Counter(tuple(r) for r in chat_repair.damaged(turns).collect()) == +want


VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, slot INT, akey STRING, w STRING, low STRING, score STRING"


def mined(rows):
    """(anchor, positive, rank, negative, scores) by scoring every pair."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, lab, v in good:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, m) for j, m, w in good if j != i), key=lambda x: x[:3])
        for s, no, j, _ in [x for x in scored if x[3] == lab][:5]:
            window = [x for x in scored if x[3] != lab and -80 * s <= -100 * x[0] <= -100 * s][:5]
            for rank, (t, none, k, _) in enumerate(window, 1):
                out[i, None if no else j, rank, None if none else k, -s, -t] += 1
    return out


@pytest.mark.parametrize("rows_in_block", [32_768, 7])
def test_hard_negatives(spark, monkeypatch, rows_in_block):
    for name, value in (("ROWS", rows_in_block), ("BATCH", 3), ("ANCHORS", 2)):
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(7)
    centres = [[r.gauss(0, 1) for _ in range(20)] for _ in range(3)]
    rows = [(i, [x + r.gauss(0, 0.6) for x in r.choice(centres)], r.randrange(4)) for i in range(0, 1200, 5)]
    rows += [(i, [1.0] * 20, 1 + (i % 3 == 0)) for i in range(1, 80, 4)]                                                   # many ties
    rows += [(2000, [1.0] * 20, 1), (2000, [1.0] * 20, 1), (2100, [], 2), (2200, [0.5, 0.25], 3), (2300, [-1.0] * 20, 9), (2400, None, 1), (2500, [1.0] * 20, None), (None, [1.0] * 20, 2),
             (2600, [math.nan] * 20, 1), (2700, [1.0, math.inf] * 10, 1), (2800, [None, 1.0] * 10, 1), (7, [1000.5] * 20, 0)]
    rows = [(*x, 1, "!", "!", "!", "!") for x in rows]
    vectors = spark.createDataFrame(rows, VECTORS)
    rows = [(i, v, lab) for i, v, lab, *_ in vectors.collect()]
    got = negatives.mine(vectors, "vec_id", F.col("label"), "embedding", F.col("vec_id") % 100 == 0)
    assert Counter(tuple(x) for x in got.collect()) == mined(rows)
    assert negatives.mine(vectors.limit(0), "vec_id", F.col("label"), "embedding", F.col("vec_id") % 100 == 0).count() == 0


def test_candidates_keep_every_pair_that_reaches():
    import numpy as np
    g = np.random.default_rng(3)
    x, q = g.normal(size=(300, 24)) * np.geomspace(100, 1, 24), g.normal(size=(9, 24)) * np.geomspace(100, 1, 24)
    rest, q_rest = negatives._rest_norms(x), negatives._rest_norms(q)
    scores = q @ x.T
    for least in (np.full(9, 0.0), np.full(9, 15_000.0), np.linspace(0, 40_000, 9), np.full(9, 1e9)):
        a, p = negatives.candidates(x, rest, q, q_rest, least)
        assert set(zip(*np.nonzero(scores >= least[:, None]), strict=True)) <= set(zip(a, p, strict=True))
        assert len(a) <= scores.size


DOCS = "doc_id BIGINT, text STRING, source STRING, key STRING, n INT, size STRING, units STRING, leaf INT, p STRING, target STRING"


def corpus():
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(["big"] * 5 + ["a", "b", "é", "", None])) for i in range(600)]
    rows += [(1000, "twice the same text", "big")] * 2 + [(1001, "hot row", "b")] * 3000 + [(None, "no id", "a"), (1002, None, "c"), (1003, " \n\t", "none but blanks"), (1004, "one\x0btwo\x85three", "small")]
    return [(*x, "!", 1, "!", "!", 1, "!", "!") for x in rows]


def test_mixing_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs.repartition(7)).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((x[0], sizes[x[0]]) for x in rows)
    totals = Counter()
    for i, _, s, *_ in rows:
        totals[s] += sizes[i]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, target, free, left = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names), sum(totals.values())
    while free:
        share = (left - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * totals[s]}
        target |= {s: 3 * totals[s] for s in over} if over else {s: share * weight[s] for s in free}
        free = free - over if over else set()
    assert sum(target.values()) == pytest.approx(left)
    source = {x[0]: x[2] for x in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(target[s])
        copies = target[s] / totals[s] if totals[s] else 0
        assert r["taken"] in ({math.floor(copies + 1e-9) * r["size"], math.ceil(copies - 1e-9) * r["size"]})
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max((sizes[i] for i in sizes if source[i] == s), default=0) / 2 + 1e-6
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixing_is_fair_and_holds_on_little(spark):
    import pandas as pd
    unit = pd.DataFrame({"src": 0, "leaf": 0, "doc_id": range(12), "size": [5, 40, 1, 9, 9, 9, 100, 3, 7, 7, 2, 60], "source_size": 1, "target": 1.0, "taken": 0, "n": 1, "p": 0.3})
    times = [0.0] * 12
    for seed in range(3000):
        for i, taken, _, p in mixing._pivot(unit, 0, seed):
            times[i] += 1 if taken else p
    assert all(abs(t / 3000 - 0.3) < 0.04 for t in times)
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "!", 1, "!", "!", 1, "!", "!")], DOCS)
    assert [tuple(r) for r in mixing.mix(blank).collect()] == [(1, 0, 0, 0.0, 0)]
