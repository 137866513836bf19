"""Time-ordered operators against brute force, with hot keys and runs over many buckets."""
import random
import statistics

from pyspark.sql import functions as F

from tidewatch.operators import components, correlate
from tidewatch.operators import ordered as O

HOUR = 3600


def rows(seed, n=400, keys=("hot", "hot", "hot", "a", "b"), span=6 * HOUR, step=1):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(0, span, step) * 1_000_000, f"e{i:04d}", rng.choice("xy")) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k STRING, ts_us BIGINT, event_id STRING, kind STRING").repartition(3)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def brute_runs(data, gap_s, same=False):
    out = {}
    for evs in by_key(data).values():
        head = prev = None
        for r in evs:
            if prev is None or r[1] - prev[1] > gap_s * 1_000_000 or (same and r[3] != prev[3]):
                head = r
            out[r[2]] = head[2]
            prev = r
    return out


def test_split_runs_equals_brute_force(spark):
    for seed, gap in ((1, 30), (2, 90), (3, 600)):
        data = rows(seed)
        got = {r.event_id: r.run_event for r in O.split_runs(frame(spark, data), ["k"], gap).collect()}
        assert got == brute_runs(data, gap)


def test_split_runs_spans_many_buckets_and_keeps_same_columns(spark):
    data = [("hot", i * 60 * 1_000_000, f"e{i:05d}", "x") for i in range(0, 2000)]      # one run over 33 hours
    got = {r.run_event for r in O.split_runs(frame(spark, data), ["k"], 60).collect()}
    assert got == {"e00000"}
    data = rows(5, step=20)
    got = {r.event_id: r.run_event for r in O.split_runs(frame(spark, data), ["k"], 120, same=("kind",)).collect()}
    assert got == brute_runs(data, 120, same=True)


def test_prev_row_and_numbers(spark):
    data = rows(7, n=200, span=40 * HOUR, step=60)
    want_prev, want_no = {}, {}
    for evs in by_key(data).values():
        for i, r in enumerate(evs):
            want_prev[r[2]] = evs[i - 1][2] if i else None
            want_no[r[2]] = i + 1
    d = frame(spark, data)
    assert {r.event_id: (r.prev.event_id if r.prev else None) for r in O.prev_row(d, ["k"], ["event_id"]).collect()} == want_prev
    assert {r.event_id: r.rn for r in O.number_rows(d, ["k"]).collect()} == want_no


def test_peak_in_window_counts_and_anchor(spark):
    for seed, win in ((11, 10), (12, 300)):
        data = rows(seed, step=5)
        want = {}
        for k, evs in by_key(data).items():
            best, at, lo = 0, None, 0
            for hi, r in enumerate(evs):
                while r[1] - evs[lo][1] > win * 1_000_000:
                    lo += 1
                if hi - lo + 1 > best:
                    best, at = hi - lo + 1, r
            want[k] = (best, at[1])
        got = {r.k: (r.peak, r.peak_us) for r in O.peak_in_window(frame(spark, data), ["k"], win).collect()}
        assert got == want
    ties = [("t", 0, "a", "x"), ("t", 5_000_000, "b", "x"), ("t", 5_000_000, "c", "x")]
    r = O.peak_in_window(frame(spark, ties), ["k"], 10).first()
    assert (r.peak, r.peak_event) == (3, "c")
    edge = [("t", 0, "a", "x"), ("t", 10_000_000, "b", "x"), ("t", 20_000_000, "c", "x")]
    assert O.peak_in_window(frame(spark, edge), ["k"], 10).first().peak == 2          # the bound is inclusive


def test_exact_quantiles(spark):
    import numpy as np
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice([rng.uniform(-5, 1e6), 7.0, 0.0])) for _ in range(501)]
    d = spark.createDataFrame(data, "k STRING, v DOUBLE")
    got = {r.k: (r.q1, r.q2, r.q3) for r in O.exact_quantiles(d, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for k in "ab":
        vals = [v for kk, v in data if kk == k]
        assert np.allclose(got[k], np.percentile(vals, [25, 50, 75]))
        assert abs(got[k][1] - statistics.median(vals)) < 1e-9


def test_top_k_and_first_ids(spark):
    data = rows(21, n=500)
    d = frame(spark, data)
    got = {r.k: r.event_ids for r in O.first_ids(d, ["k"], 7).collect()}
    assert got == {k: [r[2] for r in evs[:7]] for k, evs in by_key(data).items()}
    ranks = sorted((r.k, r["rank"]) for r in O.top_k(d, ["k"], [F.desc("event_id")], 3, "event_id").collect())
    assert ranks == sorted((k, i) for k in by_key(data) for i in (1, 2, 3))


def brute_components(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        p[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(p)}


def test_components_with_chains_and_hubs(spark):
    rng = random.Random(9)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]                        # a long chain
    edges += [("hub", f"s{i:03d}") for i in range(60)] + [(f"s{rng.randrange(60):03d}", f"q{i}") for i in range(20)]
    d = spark.createDataFrame(edges, "src STRING, dst STRING")
    want = brute_components(edges)
    assert {r.node: r.component for r in components.connected_components(d).collect()} == want


def test_match_incidents_equals_sequential_greedy(spark):
    rng = random.Random(4)
    clusters = [(f"c{i}", rng.randint(3, 9)) for i in range(12)]
    members, old = [], []
    for c, n in clusters:
        for j in range(n):
            e = f"{c}-{j}"
            members.append(("w", c, e))
            for _ in range(rng.randint(0, 2)):
                old.append(("w", f"i{rng.randrange(8)}", e))
    old = sorted(set(old))
    cand = spark.createDataFrame([("w", c, n, 0.5, 0, c) for c, n in clusters],
                                 "website_id STRING, cluster_event STRING, event_count BIGINT, max_confidence DOUBLE, first_us BIGINT, cluster_id STRING")
    m = spark.createDataFrame(members, "website_id STRING, cluster_event STRING, event_id STRING")
    x = spark.createDataFrame(old, "website_id STRING, incident_id STRING, event_id STRING")
    got = {r.cluster_event: r.incident_id for r in correlate.match_incidents(cand, m, x).collect()}
    sets = {}
    for _, i, e in old:
        sets.setdefault(i, set()).add(e)
    free, want = dict(sets), {}
    for c, n in sorted(clusters, key=lambda cn: (-cn[1], cn[0])):
        ids = {e for _, cc, e in members if cc == c}
        best = max(((len(ids & s), i) for i, s in free.items()), default=(0, None))
        if best[0] > 0:
            want[c] = best[1]
            free.pop(best[1])
    assert got == want
