"""The parts of the operators that need no session, against plain forms of the same thing."""

import math
import random
import time

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import ctw
from tidewatch.llm.bpe_automaton import Codec
from tidewatch.llm.decontaminate import Benchmark, hits, winnowed
from tidewatch.llm.extract import Cut, main_text
from tidewatch.llm.quality import text_features
from tidewatch.llm.suffix_dedup import COVER, PERIOD
from tidewatch.llm.token_store import WaveletMatrix, WordEncoder
from tidewatch.llm.wordhash import ALNUM, NOT_BLANK, shingle_sets, words

SPECIAL = ["", " ", "a", "\n\n \t", "<|endoftext|> x<|endoftext|>", "<|startoftext|>", "İSTANBUL ΣΑΣ", "日本語 の 文", "🎉🎉 don't I'LL 're", "\x85\xa0\x1c a", " " * 70, "=" * 90, "é́ ﬀ",
           "aaaa" * 200, "x" * 3000]
ALPHABETS = ["abc", "ab ", "the in ing er ", "0123456789 ", "AbC'\n\t ", "éèçàüß ñ", "一二あ a", "🎉a ", "=-_*#$%& "]


def texts(seed, n=400):
    r = random.Random(seed)
    return SPECIAL + ["".join(r.choice(a) for _ in range(r.randint(1, 80))) for a in r.choices(ALPHABETS, k=n)]


def test_automaton_encodes_and_decodes_like_the_library():
    c = Codec(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts(1):
        want = c.library.encode(t, add_special_tokens=False).ids
        got = c.encode(t)
        assert got.tolist() == want, t
        assert c.decode(got) == c.library.decode(want, skip_special_tokens=False) == t


def test_word_encoder_like_the_library():
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts(2):
        assert e.encode(t).tolist() == e.library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (7, 3), (1000, 40), (5000, 49408)])
def test_wavelet_matrix(n, top):
    r = np.random.default_rng(n)
    a = np.minimum(r.zipf(1.4, n), top) - 1 if n else np.zeros(0, np.int64)
    w = WaveletMatrix.build(a, 16)
    assert (w.to_array() == a).all()
    for i in r.integers(0, n, 40).tolist() if n else []:
        t = int(a[i])
        assert w.access(i) == t
        assert w.rank(t, i) == int((a[:i] == t).sum())
        assert w.select(t, w.rank(t, i)) == i
    assert w.rank(49999, n) == 0 and w.select(49999, 0) == -1


def test_difference_cover_is_perfect():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_word_hashes_tell_words_apart():
    some = [t.encode() for t in texts(3)]
    for kind, split in ((NOT_BLANK, lambda b: b.lower().split()),
                        (ALNUM, lambda b: bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in b.lower()).split())):
        h, offs = words(some, kind)
        plain = [w for t in some for w in split(t)]
        assert len(h) == len(plain) and offs[-1] == len(plain)
        assert len(set(h.tolist())) == len(set(plain)) == len(set(zip(h.tolist(), plain, strict=True)))


def test_shingle_sets_sizes():
    some = [b"", b"a b", b"A b", b"a b c d e", b"a b c d e f a b c d e f", b"\x0b \n"]
    s = shingle_sets(some)
    assert [len(x) for x in s] == [0, 1, 1, 1, 6, 0] and s[1].tolist() == s[2].tolist()


def test_word_hashes_of_long_words_of_two_letters():
    """Words on which sums of powers modulo a power of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    pair = [bytes(97 + b for b in bits), bytes(98 - b for b in bits)]
    for size in (8, 9, 16, 32, 64, 65, 128, 1024):
        h, _ = words([w[:size] for w in pair] + [pair[0][:size]], NOT_BLANK)
        assert h[0] != h[1] and h[0] == h[2], size
    h, _ = words([b"a" * n + b"\x00" * m for n in range(1, 70) for m in range(3)], NOT_BLANK)
    assert len(set(h.tolist())) == 69 * 3


def test_winnowing_picks_the_last_least_of_every_run():
    h = np.random.default_rng(5).integers(0, 50, 300).astype(np.uint64)
    want = {max(j for j in range(i, i + 6) if h[j] == h[i:i + 6].min()) for i in range(len(h) - 5)}
    assert set(winnowed(h, 6).tolist()) == want and winnowed(h[:4], 6).tolist() == [0, 1, 2, 3]


def test_hits_in_repetitive_texts():
    same = " ".join(["same"] * 800).encode()
    bench = Benchmark([(i, same) for i in range(50)] + [(50, b"same same"), (51, b"other same")])
    start = time.process_time()
    (n, hit, found), (m, none, few) = hits([b" ".join([b"same"] * 20_000), b"same"], bench)
    assert (n, len(hit), found) == (20_000, 20_000, list(range(51))) and (m, len(none), few) == (1, 0, [])
    assert time.process_time() - start < 5


def test_hits_like_plain_windows():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(vocabulary, k=k)).encode()) for i, k in enumerate((0, 1, 2, 3, 9, 10, 11, 25, 40))]
    docs = [b""] + [" ".join(r.choices(vocabulary, k=r.randint(1, 60))).encode() for _ in range(30)]
    docs += [b"zz " + items[7][1] + b" zz", items[5][1].upper(), b" ".join(items[8][1].split()[4:30])]
    bench = Benchmark(items)
    for d, (n, hit, found) in zip(docs, hits(docs, bench), strict=True):
        w = d.lower().split()
        want_hit, want_items = set(), set()
        for i, t in items:
            v = t.split()
            k = min(10, len(v))
            for a in range(len(v) - k + 1 if v else 0):
                for s in range(len(w) - k + 1):
                    if w[s:s + k] == v[a:a + k]:
                        want_hit |= set(range(s, s + k))
                        want_items.add(i)
        assert (n, set(hit.tolist()), {bench.ids[i] for i in found}) == (len(w), want_hit, want_items)


def test_cut_is_the_cheapest_labelling():
    r = random.Random(11)
    for _ in range(60):
        n = r.randint(1, 7)
        cost = [r.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, r.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6]
        g = Cut(n + 2)
        for i, c in enumerate(cost):
            g.join(n, i, c) if c > 0 else g.join(i, n + 1, -c)
        for a, b, w in edges:
            g.join(a, b, w, w)

        def price(side):
            return sum(abs(c) for c, s in zip(cost, side, strict=True) if (c > 0) != s and c) + sum(w for a, b, w in edges if side[a] != side[b])
        assert price(g.source_side(n, n + 1)[:n]) == min(price([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { x = "<p>no</p>" }</script></head><body>
<header><div class=logo>Site</div></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-banner"><p>We use cookies on this site, and you may say no to them at any time.</p></div>
<article><h1>A title</h1><p>First  paragraph &amp; more,\nwith a <a href="x?a>b">link</a> and some length to it.<p>Second, <b>bold<br>broken.
<aside><p>Read also this other long and winding piece about something else altogether.</p></aside><p>Caf&eacute; &#8211; end.</article>
<section id="comments"><p>Nice article, I liked it a lot and will come back again.</p></section>
<form><p>Leave your address here to get our weekly letter.</p></form><footer><p>&copy; 2020 Site, all rights reserved.</p></footer></body></html>"""


def test_main_text_of_odd_markup():
    prose = "A sentence of the article that is long enough to be kept as its text."
    for mark in ('<p title="a>b>c>d>e>f>g>h>i>j">', "<p title='one > two'>", '<p title = "it\'s > that" data-x=a>', "<p title=it's>", '<p title="not closed>'):
        assert main_text(f"<main>{mark}{prose}</p></main>") == prose, mark
    assert main_text(f"<form><input name=q><main><p>{prose}</p></main><button>Send</button></form>") == prose
    assert main_text(f"<div class=sidebar><article><p>{prose}</p></article></div><p>{prose}</p>") == prose
    got = main_text(f"<body><p>{prose}</p><ul><li>first short item</li><li>one more item</li><li>the third item</li></ul><p>{prose}</p></body>")
    assert got == "\n\n".join([prose, "first short item", "one more item", "the third item", prose])
    assert main_text(f"<main><p>{prose} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></main>") == f"{prose} x=2 holds."


def test_main_text():
    assert main_text(PAGE).split("\n\n") == ["A title", "First paragraph & more, with a link and some length to it.", "Second, bold broken.", "Café – end."]
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == ""
    assert main_text("<p>" * 20000 + "Deep down there is a sentence that is long enough to be kept.") != ""
    assert main_text("<!-- never closed <p>text</p>") == ""
    assert "plain words" in main_text("just plain words < 5 and no tags at all, in one line.")


def test_kt_block_probability():
    a, b = np.array([0.0, 1, 3, 200]), np.array([0.0, 0, 2, 17])
    got = ctw._lgamma(a + 0.5) + ctw._lgamma(b + 0.5) - math.log(math.pi) - ctw._lgamma(a + b + 1)
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(a, b, strict=True)]
    assert np.allclose(got, want, atol=1e-9)


def test_tree_predicts_a_distribution_and_learns():
    train = [b"the cat sat on the mat. " * 20, b"", "où été".encode()]
    grams, _ = ctw._grams(train)
    total = ctw._offsets()[-1]
    zeros, ones, above = np.zeros(total), np.zeros(total), np.zeros(total, np.int32)
    k, c = np.unique(grams, return_counts=True)
    for b, slots, z, o, up in ctw._node_blocks(k, c):
        at = np.frombuffer(slots, "<i4")
        zeros[at] += np.frombuffer(z, "<i8")
        ones[at] += np.frombuffer(o, "<i8")
        above[at] = np.frombuffer(up, "<i4")
    assert zeros[0:256].sum() + ones[0:256].sum() == 8 * len(grams)
    m = ctw.Model.weighted(zeros.astype(np.float32), ones.astype(np.float32), above)
    for context in (0, 0x746865206361, 0x6D6D6D6D):
        every = np.arange(256, dtype=np.uint64) | np.uint64(context << 8)
        assert abs((2.0 ** -m.code_length(every)).sum() - 1) < 1e-5
    good, bad = m.text_bits([b"the mat sat on the cat. ", b"zqxj vkwp zqxj vkwp zqx "])
    assert good < bad / 4
    assert np.allclose(m.text_bits([b"the cat", b"", b"zz"]), [m.code_length(ctw._grams([t])[0]).sum() for t in (b"the cat", b"", b"zz")])


def test_text_features_of_odd_texts():
    for t in (b"", b"\n", b"###", "ÄÖ".encode(), b"A" * 10000):
        distinct, shape = text_features(t)
        assert len(shape) == 6 and all(s.startswith(b"=") for s in shape)
