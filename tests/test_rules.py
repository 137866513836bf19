"""Rules on generated event series, against plain evaluations of the same definitions."""

import dataclasses
import random
import statistics
import string
from collections import defaultdict
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from conftest import HEADLESS, findings_of
from tidewatch.functions.signals import SIGNALS
from tidewatch.operators import rules as R
from tidewatch.operators import sessions as S
from tidewatch.params import PROBE_PATHS, RULES, Detection
from tidewatch.plans.analyse import detect

P = dataclasses.replace(Detection(), burst_min=3, multi_min=4, multi_users=3, burst_gap_s=20, multi_gap_s=20, success_lookback_s=90, rate_min=3, rate_window_s=5, nav_views=3)
ID, SITE, _, US, KIND, IP, SID, UID, EP, STATUS, UA, ATTRS = range(12)


def series(mk, seed, n=260):
    """Random events of a few addresses and sessions, with quiet gaps so that runs end."""
    r = random.Random(seed)
    out, t = [], 0.0
    for _ in range(n):
        t += r.choices([0.0, 0.4, 1, 2, 5, 20, 20.5, 65], [2, 4, 4, 3, 2, 1, 1, 1])[0]
        kind = r.choices(["login_failure", "login_success", "page_view", "http_request", "interaction", "waf_alert"], [12, 3, 4, 6, 1, 1])[0]
        path = r.choice([*PROBE_PATHS[:4], "/a", "/b/c", "/d?e=1"])
        out.append(mk.ev(kind, t, ip=r.choice(["192.0.2.1", "192.0.2.2", None]), sid=r.choice(["s1", "s2", None]), uid=r.choice(["u1", "u2", "u3", None]), ep=path,
                         ua=HEADLESS if r.random() < 0.04 else "Mozilla/5.0", attrs=r.choice(['{}', '{"webdriver":true}', '{"clicks":1}', '{"clicks":0}']), status=r.choice([200, 401])))
    r.shuffle(out)
    return out


def by(rows, key):
    groups = defaultdict(list)
    for e in sorted(rows, key=lambda e: (e[US], e[ID])):
        if key(e) is not None:
            groups[key(e)].append(e)
    return groups


def entity(e):
    return e[IP] or (e[SID] and "sid:" + e[SID])


def session(e):
    return e[SID] or (e[IP] and "ip:" + e[IP]) or "unknown"


def runs(rows, gap_s):
    for who, events in by([e for e in rows if e[KIND] == "login_failure"], entity).items():
        run = []
        for e in events:
            if run and e[US] - run[-1][US] > gap_s * 1e6:
                yield who, run
                run = []
            run.append(e)
        yield who, run


def found(mk, make, rows, p=P):
    return findings_of(R.finding_envelope(make(mk.frame(rows), p), p))


@pytest.mark.parametrize("seed", [1, 2])
def test_login_rules_like_a_plain_scan(mk, seed):
    rows = series(mk, seed)
    bursts, many, after = set(), set(), set()
    for who, run in runs(rows, P.burst_gap_s):
        users = {e[UID] for e in run if e[UID]}
        if len(run) >= P.burst_min:
            grown = min(1, (len(run) - P.burst_min) / (4 * P.burst_min))
            bursts.add((who, run[-1][ID], len(run), round(P.burst_confidence + (P.burst_confidence_max - P.burst_confidence) * grown, 3)))
            for e in rows:
                if e[KIND] == "login_success" and entity(e) == who and 0 < e[US] - run[-1][US] <= P.success_lookback_s * 1e6:
                    after.add((who, e[ID], len(run) + 1, P.success_match_confidence if e[UID] in users else P.success_confidence))
        if len(run) >= P.multi_min and len(users) >= P.multi_users:
            many.add((who, run[-1][ID], len(run), P.multi_confidence))
    assert bursts and (many or after)
    for make, want in ((R.auth_burst, bursts), (R.auth_multi_account, many), (R.success_after_burst, after)):
        got = found(mk, make, rows)
        assert {(f["subject"], f["event_id"], f["cited_events"], f["confidence"]) for f in got} == want
        assert all(len(f["event_ids"]) == f["cited_events"] and f["event_id"] in f["event_ids"] for f in got)


@pytest.mark.parametrize("seed", [3, 4])
def test_session_rules_like_a_plain_scan(mk, seed):
    rows = series(mk, seed)
    requests = {"page_view", "http_request", "api_access", "sensitive_endpoint_access"}
    rate, robots, quiet, probes = {}, {}, {}, {}
    for who, events in by(rows, session).items():
        asked = [e for e in events if e[KIND] in requests]
        peak = max((sum(1 for x in asked if 0 <= e[US] - x[US] <= P.rate_window_s * 1e6) for e in asked), default=0)
        if peak >= P.rate_min:
            rate[who] = peak
        kinds = [(e[UA] == HEADLESS, "webdriver\":true" in e[ATTRS]) for e in events]
        if any(a or b for a, b in kinds):
            robots[who] = (sum(a or b for a, b in kinds), P.automation_two if any(a for a, _ in kinds) and any(b for _, b in kinds) else P.automation_one)
        views = [e for e in events if e[KIND] == "page_view"]
        used = sum(e[KIND] == "interaction" and e[ATTRS] == '{"clicks":1}' for e in events)
        gaps = [(b[US] - a[US]) / 1e6 for a, b in zip(views, views[1:])]
        if len(views) >= P.nav_views and not used and statistics.median(gaps) <= 30:
            quiet[who] = len(views)
        hit = {p.lower() for p in P.recon_paths for e in asked if (e[EP].split("?")[0].lower() + "/").startswith(p.lower() + "/")}
        if len(hit) >= P.recon_distinct:
            probes[who] = ",".join(sorted(hit))
    assert rate and robots and probes
    assert {f["subject"]: f["cited_events"] for f in found(mk, R.request_rate, rows)} == rate
    assert {f["subject"]: (f["cited_events"], f["confidence"]) for f in found(mk, R.automation, rows)} == robots
    assert {f["subject"]: f["cited_events"] for f in found(mk, R.non_human_navigation, rows, dataclasses.replace(P, nav_gap_s=30))} == quiet
    assert {f["subject"]: f["observed"]["probe_paths_requested"] for f in found(mk, R.recon_paths, rows)} == probes


# one text of own making for every pattern of the bank
SAMPLES = {
    "union_select": "7 uNioN\tall  select x", "boolean_tautology": "k and  'zz' = 'zz'", "stacked_statement": "4 ;truncate t", "drop_table": "to drop   table t9", "time_delay_function": "pg_sleep (3)",
    "information_schema": "from information_schema.x", "quote_then_comment": "o' -- z", "script_tag": "<  Script src=q", "javascript_uri": "JavaScript :f()", "event_handler_attr": "z onfocus =g",
    "embedding_tag": "< object data=q", "dot_dot_slash": "q..\\w", "sensitive_system_file": "z/etc/shadow", "internal_address_url": "gopher://172.20.3.4:70/x", "file_scheme": "v=file://srv/share",
}


def test_every_pattern_is_found_plain_and_encoded(mk):
    assert set(SAMPLES) == {s for bank in SIGNALS.values() for s in bank}
    rows, want = [], {}
    for rule, bank in SIGNALS.items():
        for name in bank:
            for text in (quote(SAMPLES[name]), quote(quote(SAMPLES[name])), quote(SAMPLES[name]).replace("%20", "+")):
                rows.append(mk.ev("http_request", len(rows), ep=f"/find/it?v={text}"))
                want[rows[-1][ID]] = (rule, name)
    got = defaultdict(set)
    for f in found(mk, R.attack_patterns, rows):
        got[f["event_id"]] |= {(f["rule_id"], s) for s in f["observed"]["matched_signals"].split(",")}
    assert all(pair in got[i] for i, pair in want.items())


def test_random_words_are_no_attacks(mk):
    r = random.Random(9)
    letters = string.ascii_lowercase + string.digits
    targets = ["/" + "/".join("".join(r.choices(letters, k=5)) for _ in range(r.randint(1, 4))) + "?" + "&".join(f"{r.choice(letters)}={quote(' '.join(''.join(r.choices(letters, k=4)) for _ in range(3)))}"
                                                                                                             for _ in range(3)) for _ in range(150)]
    outside = "/" + quote(SAMPLES["internal_address_url"])            # an address in the path is not fetched
    assert found(mk, R.attack_patterns, [mk.ev("http_request", i, ep=t) for i, t in enumerate([*targets, outside])]) == []


@pytest.mark.parametrize("seed", [5, 6])
def test_multi_vector_like_a_plain_scan(mk, seed):
    r = random.Random(seed)
    texts = {rule: quote(SAMPLES[next(iter(bank))]) for rule, bank in SIGNALS.items()}
    rows, t = [], 0
    for _ in range(40):
        t += r.choice([1, 100, 290, 600, 900])
        rows.append(mk.ev("http_request", t, ip=r.choice(["192.0.2.7", "192.0.2.8"]), sid=None, ep=f"/x?v={texts[r.choice(list(texts))]}"))
    kind = {e[ID]: next(rule for rule, x in texts.items() if e[EP].endswith(x)) for e in rows}
    want = {}
    for who, events in by(rows, entity).items():
        best = max((len({kind[x[ID]] for x in events if e[US] - P.vector_window_s * 1e6 <= x[US] <= e[US]}), -e[US], e[ID]) for e in events)
        if best[0] >= P.vector_categories:
            want[who] = (best[0], best[2])
    assert want
    assert {f["subject"]: (f["derived"]["distinct_categories"], f["event_id"]) for f in found(mk, R.multi_vector, rows)} == want


def test_all_rules_do_not_depend_on_order_or_on_other_tenants(mk):
    rows = series(mk, 8, 150)
    first = {f["finding_id"]: f for f in findings_of(R.evaluate_rules(mk.frame(rows), P))}
    both = findings_of(R.evaluate_rules(mk.frame(rows[::-1] + [(e[ID], "web_other", *e[2:]) for e in rows]), P))
    mine = {f["finding_id"]: f for f in both if f["website_id"] == rows[0][SITE]}
    assert {i: (f["subject"], f["event_ids"]) for i, f in mine.items()} == {i: (f["subject"], f["event_ids"]) for i, f in first.items()}
    assert len(both) == 2 * len(first) and {f["rule_id"] for f in first.values()} <= set(RULES)
    ids = {str(e[ID]) for e in rows}
    assert all(set(f["event_ids"]) <= ids and f["thresholds"] and 0 <= f["confidence"] <= 1 for f in first.values())
    some = {f["rule_id"] for f in first.values()}
    off = dataclasses.replace(P, disabled=frozenset(sorted(some)[:2]))
    assert {f["rule_id"] for f in findings_of(R.evaluate_rules(mk.frame(rows), off))} == some - off.disabled


def test_batches_that_span_weeks_end_where_one_run_ends(mk, spark):
    rows = series(mk, 12, 120)
    spread = [(e[ID], e[SITE], e[2], e[US] * 40, *e[4:]) for e in rows]           # weeks instead of hours
    frame = mk.frame(spread)
    p = dataclasses.replace(P, burst_gap_s=800, multi_gap_s=800, success_lookback_s=3600, rate_window_s=200, nav_gap_s=3000, lookback_hours=None)
    key = lambda f: (f["rule_id"], f["subject"], f["event_id"], f["cited_events"])
    full = {key(f) for f in findings_of(R.evaluate_rules(frame, p))}
    touched = {(e[SID], e[IP]) for e in spread[:60]}
    new = frame.where(F.col("event_id").isin([e[ID] for e in spread[:60]]))
    got = {key(f) for f in findings_of(R.detect_incremental(new, frame, p=p))}
    assert got <= full and len(touched) > 3
    names = {x for sid, ip in touched for x in (sid, ip, sid and "sid:" + sid, ip and "ip:" + ip)} | {"unknown"}
    assert {k for k in full if k[1] in names} <= got


@pytest.mark.parametrize("parts", [1, 3])
def test_session_summary_like_plain_counts(mk, parts):
    rows = series(mk, 21, 120)
    got = {r.session_key: r for r in S.session_summary(mk.frame(rows).repartition(parts)).collect()}
    want = by(rows, session)
    assert set(got) == set(want)
    for who, events in want.items():
        r = got[who]
        views = [e[US] for e in events if e[KIND] == "page_view"]
        assert (r.event_count, r.page_views, r.login_failures, r.inferred) == (len(events), len(views), sum(e[KIND] == "login_failure" for e in events), events[0][SID] is None)
        assert r.distinct_failed_users == len({e[UID] for e in events if e[KIND] == "login_failure" and e[UID]})
        assert r.median_page_gap_s == (pytest.approx(statistics.median((b - a) / 1e6 for a, b in zip(views, views[1:]))) if len(views) > 1 else None)


def test_later_steps_read_every_citation(mk, spark):
    from tidewatch.operators import correlate as C
    rows = mk.failures(620, step=0.05, ip="192.0.2.77", users=["a"], sid="long")
    events = mk.frame(rows)
    findings, cited = detect(events, model=None)
    f = findings.collect()
    assert [(len(x.event_ids), x.cited_events, x.event_ids_truncated) for x in f] == [(500, 620, True)]
    assert R.suspicious_events(findings, cited).count() == C.seed_events(findings, events, cited).count() == 620
    assert {r.n for r in R.detection_counters(events, findings, cited).where("metric = 'suspicious_events'").collect()} == {620}
    assert C.clusters(events, findings, cited).where("is_seed").count() == 620


def test_a_run_is_stored_once_however_many_findings_cite_it(mk):
    """Fifty successes after one burst: what is stored grows with their sum, what is cited with their product."""
    rows = mk.failures(300, step=0.1, ip="192.0.2.78", users=["a", "b"], sid="run") + [mk.ev("login_success", 40 + i, ip="192.0.2.78", sid="run", uid="a") for i in range(50)]
    found, cited = detect(mk.frame(rows), model=None)
    by_rule = {f.rule_id: f for f in found.collect()}
    after = [f for f in found.collect() if f.rule_id == "R-AUTH-003"]
    assert len(after) == 50 and {f.cited_events for f in after} == {301} and {len(f.event_ids) for f in after} == {301}
    assert cited.members.count() < 2 * 350 and cited.pairs().where(F.col("finding_id").isin([f.finding_id for f in after])).count() == 50 * 301
    assert cited.events().count() == 350 and by_rule["R-AUTH-001"].cited_events == 300
    tags = found.select("website_id", "finding_id", F.lit("x").alias("tag"))
    assert cited.tagged(tags).count() == 350
