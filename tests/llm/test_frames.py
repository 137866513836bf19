"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import bpe_automaton, chat, ctw, decontaminate, exact_dedup, extract, jaccard_join, quality, suffix_dedup, token_store

CLASHING = ("norm", "h", "chars", "best", "group_size", "node", "gram", "n", "pos", "block", "root", "tag", "keys", "at", "mask", "row", "word", "bits", "host", "path", "kept",
            "part", "shard", "ends", "_slice", "_hot", "many", "evidence", "check", "counts")
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, " + ", ".join(f"{c} STRING" for c in CLASHING)


def documents():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(80)]

    def prose(n):
        return " ".join(r.choices(words, k=n))
    base, passage = prose(200), prose(30)
    rows = [(0, base), (1, base), (2, "  ".join(base.split())), (3, None), (4, ""), (5, " \n\t"), (6, "Ünïcode é 日本"), (7, "one two"), (8, "ONE two"), (9, "one two three four"),
            (10, prose(3000)), (11, "x" * 4000), (12, "y" + "x" * 4000), (13, passage), (14, prose(40) + " " + passage + " " + prose(40)), (15, passage.upper())]
    for i in range(16, 46):
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, prose(r.randint(1, 90))) for i in range(46, 70)]
    return [*rows, (50, rows[50][1]), (None, base), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, request):
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if i != 9 else None, len(t or ""), *["!"] * len(CLASHING)) for i, t in documents()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())


def test_exact_groups(docs, nothing):
    rows = documents()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    want = Counter()
    for (i, t), x in zip(rows, norm, strict=True):
        same = [(-len(u or ""), j is None, j or 0) for (j, u), y in zip(rows, norm, strict=True) if x == y]
        _, none, keep = min(same)
        keep = None if none else keep
        want[(i, keep, len(same), i == keep, hashlib.sha256(x.encode()).hexdigest())] += 1
    assert by_row(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm)) == kept.select(exact_dedup.without_blanks(F.col("text"))).distinct().count()


def shingles(t):
    w = tokens(t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(docs, nothing):
    rows = documents()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows))
    assert by_row(jaccard_join.near_copies(docs), "doc_id", "n_shingles", "component_id") == want
    assert by_row(jaccard_join.near_copies(docs, digest_bits=3), "doc_id", "n_shingles", "component_id") == want      # most sets share a name
    assert jaccard_join.near_copies(nothing).count() == 0


def test_remove_repeats(docs, nothing):
    rows = documents()
    starts = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for j in range(len(b) - 49):
                starts[b[j:j + 50]] = min(d, starts.get(b[j:j + 50], d))
    want = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 49):
            if d is not None and starts[b[j:j + 50]] < d:
                gone[j:j + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        want[(d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert by_row(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_contamination_in_one_and_in_many_blocks(spark, docs, nothing):
    passage = documents()[13][1]
    items = spark.createDataFrame([(1, passage, "!"), (2, "one two", "!"), (3, None, "!"), (4, "  ", "!"), (5, "日本", "!"), (5, "日本", "!"), (6, passage.upper(), "!")], "item_id BIGINT, text STRING, doc_id STRING")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    one = by_row(decontaminate.contamination(docs, items), *names)
    assert by_row(decontaminate.contamination(docs, items, block_words=20), *names) == one
    got = {k[0]: k for k in one if k[0] is not None}
    assert got[7][2:4] == (2, 1) and got[8][2:4] == (2, 1) and got[9][2] == 2 and got[6][2] == 1 and got[3][1:4] == (0, 0, 0)
    assert got[13][2:4] == (30, 2) and got[14][2] >= 30 and got[14][4] == hashlib.sha256(b"1,6").hexdigest()
    clean = decontaminate.clean_documents(docs, items, block_words=20)
    assert clean.columns == docs.columns and by_row(clean, "doc_id") == Counter((k[0],) for k in one.elements() if not k[5])
    assert decontaminate.contamination(nothing, items).count() == 0
    assert by_row(decontaminate.contamination(docs, items.limit(0)), "n_hit", "contaminated") == Counter({(0, False): len(documents())})


def test_token_store(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, start = Counter(), 0
    for d, text in sorted(documents(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(d, start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    shards = token_store.write_tokens(docs, path, shard_tokens=1500)
    assert shards.count() > 3
    assert by_row(token_store.stored_documents(shards), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_store.stored_documents(token_store.write_tokens(nothing, path)).count() == 0


def test_encoded(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for d, text in documents():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert by_row(bpe_automaton.encoded(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe_automaton.encoded(nothing, path).count() == 0


def test_scores(docs, nothing, monkeypatch):
    monkeypatch.setattr(ctw, "KNOWN_WORDS", 20)          # most words then take the way of the join
    rows = documents()
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    got = sorted(ctw.scores(docs, ctw.held_out_ids(F.col("doc_id"))).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens))
    want = sorted(zip(rows, held, strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, len(tokens(x[0][1]))))
    assert len(got) == len(rows)
    for g, ((d, t), h) in zip(got, want, strict=True):
        w = [*tokens(t), None]
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (d, h, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(g.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert g.score < 0
    assert ctw.scores(nothing, ctw.held_out_ids(F.col("doc_id"))).count() == 0
    untrained = ctw.scores(docs, F.lit(True)).collect()
    assert all(math.isclose(r.score, -8 * (r.bits_per_byte and len((dict(rows).get(r.doc_id) or "").encode()) + 1) * math.log10(2)) for r in untrained if r.doc_id in (6, 7, 10))


def test_extract(spark):
    rows = [(1, "http://a/", "<article><p>Some text that is kept.</p></article><nav><a>x</a></nav>", "!"), (2, None, None, "!"), (None, "u", "", "!"), (1, "http://a/", "<p>a", "!")]
    got = by_row(extract.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING")), "page_id", "url", "text", "n_chars")
    assert got[(1, "http://a/", "Some text that is kept.", 23)] == 1 and got[(2, None, "", 0)] == 1 and got[(None, "u", "", 0)] == 1 and sum(got.values()) == 4


def test_chat_folds_and_reads_back(spark):
    log = [(1, 1, 1, "delta", "user", "He"), (1, 2, 1, "delta", None, "llo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 2, "regenerate", None, "go"), (1, 5, 2, "delta", None, "od"),
           (1, 6, 3, "delta", "user", "typo"), (1, 7, 3, "edit", None, None), (1, 8, 3, "delta", None, "fixed"), (None, 1, 1, "delta", "user", "n"), (2, 1, 1, None, None, None), (2, 2, 2, "x", "assistant", "</s>[a]\\0<")]
    events = spark.createDataFrame([(*r, "!") for r in log], "conv_id BIGINT, seq BIGINT, message BIGINT, kind STRING, role STRING, text STRING, place STRING")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(events))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "Hello"), ("assistant", "good"), ("user", "fixed")] and back[1].learned == ["good"]
    assert [(t.role, t.text) for t in back[2].turns] == [("", ""), ("assistant", "</s>[a]\\0<")] and back[2].learned == ["</s>[a]\\0<"]
    assert [(t.role, t.text) for t in back[None].turns] == [("user", "n")] and back[None].learned == []
    long = "ab[</s>\\ é" * 700
    turns = spark.createDataFrame([(5, k, "assistant" if k % 2 else "user", f"{k}{long}" if k == 301 else f"t{k}") for k in range(600)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    r = chat.digests(chat.render(chat.fold_events(chat.as_events(turns)))).collect()[0]
    said = "".join(f"{'assistant' if k % 2 else 'user'}\n{f'{k}{long}' if k == 301 else f't{k}'}\n" for k in range(600))
    loss = "".join(f"{k}{long}" if k == 301 else f"t{k}" for k in range(1, 600, 2))
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (600, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_site_posteriors_shrink_sparse_sites(spark):
    r = random.Random(1)
    rows = [(i, f"h{i % 4}", "p" if i % 8 < 4 else "q", (3.0 if r.random() < (0.7 if i % 4 == 0 else 0.1) else -3.0)) for i in range(400)] + [(1000, "lone", "p", 3.0), (1001, None, None, -3.0)]
    got = {x.doc_id: x for x in quality.site_posteriors(spark.createDataFrame(rows, "doc_id BIGINT, host STRING, path STRING, evidence DOUBLE")).collect()}
    assert len(got) == len(rows)
    p = {i: 1 / (1 + math.exp(-e)) for i, *_, e in rows}
    rate = (sum(p.values()) + 0.5) / (len(rows) + 1)

    def groups(key):
        out = {}
        for row in rows:
            out.setdefault(key(row), []).append(p[row[0]])
        return out

    def strength(members, mean):
        n = sum(map(len, members.values()))
        noise = sum(mean(g) * (1 - mean(g)) for g in members) / len(members)
        spread = sum(len(m) * (sum(m) / len(m) - mean(g)) ** 2 for g, m in members.items()) / n - len(members) * noise / n
        return min(max(noise / max(spread, 1e-9) - 1, 1), 1e6)
    hosts, paths = groups(lambda x: x[1]), groups(lambda x: (x[1], x[2]))
    k = strength(hosts, lambda g: rate)
    k2 = strength(paths, lambda g: (sum(hosts[g[0]]) + k * rate) / (len(hosts[g[0]]) + k))
    for i, h, path, e in rows:
        host_rate = (sum(hosts[h]) - p[i] + k * rate) / (len(hosts[h]) - 1 + k)
        path_rate = (sum(paths[h, path]) - p[i] + k2 * host_rate) / (len(paths[h, path]) - 1 + k2)
        odds = e + math.log(path_rate / (1 - path_rate)) - math.log(rate / (1 - rate))
        want = (host_rate, path_rate, 1 / (1 + math.exp(-odds)))
        assert (got[i].host_rate, got[i].path_rate, got[i].posterior) == pytest.approx(want, rel=1e-9)
    assert got[0].host_rate > 2 * got[1].host_rate
    assert got[1000].path_rate == pytest.approx(rate) and got[1000].posterior == pytest.approx(p[1000])       # the only row of its site


def test_quality_keeps_clean_and_drops_bad(spark, nothing):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]

    def text(i):
        w = r.choices(words, k=60)
        if i % 5 == 0:
            w = [x + "###" for x in w]
        if i % 5 == 1:
            w[r.randrange(60)] = "awful"
            w[r.randrange(60)] = "awful."
        return " ".join(w)
    rows = [(i, text(i), "en", f"s{i % 3}", 0, *["!"] * len(CLASHING)) for i in range(400)] + [(900, None, None, None, 0, *["!"] * len(CLASHING))]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 5 == 1)) for i in range(250)] + [(300, None, 1), (None, 1, 1), (301, 1, 0), (301, 0, 0)], "doc_id BIGINT, quality INT, toxic INT")
    model = quality.fit_text_model(docs, labels)
    found = quality.classify(docs, model, F.col("source"), F.col("lang")).collect()
    assert len(found) == 401 and all(x.kept == (x.doc_id % 5 > 1) for x in found if x.doc_id < 900)
    good = quality.good_documents(docs, labels, F.col("source"), F.col("lang"))
    assert good.columns == docs.columns and {x.doc_id for x in good.collect()} >= {i for i in range(250, 400) if i % 5 > 1}
    assert quality.classify(nothing, quality.fit_text_model(nothing, labels), F.col("source"), F.col("lang")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choices(words, k=n))
    clean = [prose(120) for _ in range(40)]
    item = prose(14)
    rows = list(enumerate(clean)) + [(100, clean[0]), (101, clean[1].replace(" ", "\n")), (102, " ".join([*clean[2].split()[:-1], "changed"])), (103, prose(30) + " " + item + " " + prose(30)),
                                     (104, prose(60) + " awful words awful"), (105, "### ".join(prose(60).split()))]
    rows += [(200 + i, prose(50) + " awful " + prose(9)) for i in range(20)] + [(300 + i, "### ".join(prose(50).split())) for i in range(20)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(200 + i, 1, 1) for i in range(20)] + [(300 + i, 0, 0) for i in range(20)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # of texts equal but for blanks the longest stays, then the least id; here all are of one length
    assert set(out) == set(range(40))
    assert out[5].decoded_sha256 == hashlib.sha256(clean[5].encode()).hexdigest()


def _exact_tree(train):
    """Code length of a text by the weighted tree of whole contexts, node by node in dictionaries."""
    nodes = [{} for _ in range(5)]

    def steps(text):
        for i, byte in enumerate(text + b"\xff"):
            before = (b"\xff" * 4 + text)[i:i + 4][::-1]
            for level in range(8):
                yield before, (1 << level) | byte >> (8 - level), byte >> (7 - level) & 1
    for text in train:
        for before, node, bit in steps(text):
            for d in range(5):
                nodes[d].setdefault((before[:d], node), [0, 0])[bit] += 1
    inner, weight = Counter(), [{} for _ in range(5)]
    for d in range(4, -1, -1):
        longer, inner = inner, Counter()
        for (context, node), (a, b) in nodes[d].items():
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            both = kt if d == 4 else np.logaddexp(kt, longer[(context, node)]) - math.log(2)
            weight[d][(context, node)] = (b + 0.5) / (a + b + 1), 1 if d == 4 else math.exp(kt - math.log(2) - both)
            if d:
                inner[(context[:-1], node)] += both

    def bits(text):
        total = 0
        for before, node, bit in steps(text):
            seen = [weight[d][(before[:d], node)] for d in range(4, -1, -1) if (before[:d], node) in weight[d]]
            q = seen[0][0] if seen else 0.5
            for p, own in seen[1:]:
                q = own * p + (1 - own) * q
            total -= math.log2(q if bit else 1 - q)
        return total
    return bits


def test_scores_by_a_tree_whose_nodes_share_no_counter(spark, monkeypatch):
    monkeypatch.setattr(ctw, "KNOWN_GRAMS", 300)                # most contexts then take the way of the join
    monkeypatch.setattr(ctw, "SLOT_BITS", (8, 16, 6, 6, 6))     # where nodes share counters by hash, very many meet in one
    small = ctw._by_context
    monkeypatch.setattr(ctw, "_by_context", lambda batches: small(batches, 50))
    rng = np.random.default_rng(4)
    rows = [(i, None if i == 3 else " ".join(rng.choice(["tree", "trees", "three", "où", "été", "x1", "\t"], rng.integers(0, 30)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    bits = _exact_tree([(t or "").encode() for i, t in rows if i % 4])
    got = {r.doc_id: r.score for r in ctw.scores(docs, F.col("doc_id") % 4 == 0).collect()}
    assert len(got) == 40
    for i, t in rows:
        assert math.isclose(got[i], -bits((t or "").encode()) * math.log10(2), rel_tol=1e-9, abs_tol=1e-9)
