import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import html_extract, language, packing, pii, secrets, sentencepiece_scan as scan, url_filter


@pytest.fixture(scope="module")
def codec():
    return scan.Codec(scan.load())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=scan.MODEL)


def test_pair_equals_merging(codec):
    rng = np.random.default_rng(0)
    ids = rng.choice(list(codec.plain), (20_000, 2))
    for a, b in ids.tolist():
        x, y = codec.plain[a], codec.plain[b]
        assert codec._pair(x, y) == (codec.merged(x + y) == [x, y])


@given(st.text(max_size=80) | st.text(alphabet="aeinrst AB.\n▁é0", max_size=80))
@settings(max_examples=300, deadline=None)
def test_encode_equals_library_and_round_trips(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == text.replace("▁", " ")


@given(st.text(alphabet="aeinrst  .\né", min_size=1, max_size=400), st.sampled_from([17, 33, 64]))
@settings(max_examples=150, deadline=None)
def test_scan_equals_library(codec, library, text, size):
    text_ = "▁" + text.replace(" ", "▁")
    chunks, matrices = [], []
    for k in range(-(-len(text_) // size)):
        a, b = k * size, min(len(text_), (k + 1) * size)
        left = max(0, a - codec.longest)
        chunks.append((text_[left : b + codec.longest], a - left, b - left))
        matrices.append(codec.transfer(*chunks[-1], k == 0))
    states = scan.boundary_states(matrices)
    out = []
    for chunk, x, y in zip(chunks, states, states[1:]):
        out += codec.backtrace(*chunk, x, y)[0]
    assert out == library.encode(text)


def test_product_is_associative():
    rng = np.random.default_rng(1)
    made = [{(x, y): int(rng.integers(-5, 5)) for x in range(4) for y in range(4) if rng.random() < 0.6} for _ in range(3)]
    a, b, c = made
    assert scan.product(scan.product(a, b), c) == scan.product(a, scan.product(b, c))


def test_encode_frame_edges(spark, library):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b", 5), (4, "no blanks" + "x" * 5000, 5), (5, "word and word " * 2000, 5), (6, "né\u2028 \U0001f600" * 900, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = scan.encode(df, chunk=512).collect()
    assert len(got) == len(rows)
    texts = {(i, len(library.encode(t or ""))): t for i, t, _ in rows}
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id, r.n_tokens] or "") and r.round_trip
    assert scan.encode(df.limit(0)).count() == 0
    back = {(r.doc_id, r.text) for r in scan.decode(scan.encode(df, chunk=512)).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}


def brute_pack(lengths, sources, clusters, capacity, per_source):
    bins = []
    out = []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (c is None or c not in b["c"]) and (s is None or b["s"].count(s) < per_source)]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "c": set(), "s": []})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["c"].add(c)
        bins[i]["s"].append(s)
    return out


@given(st.lists(st.tuples(st.integers(1, 100), st.sampled_from([None, "a", "b"]), st.sampled_from([None, 1, 2, 3])), max_size=60), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_pack_is_best_fit(items, per_source):
    items.sort(key=lambda x: -x[0])
    lengths, sources, clusters = [x[0] for x in items], [x[1] for x in items], [x[2] for x in items]
    assert packing.pack(lengths, sources, clusters, 100, per_source) == brute_pack(lengths, sources, clusters, 100, per_source)


def test_packing_frame(spark):
    rows = [(i, "t" * (i % 90) + str(i), "hot" if i % 3 else f"s{i}", 1) for i in range(400)] + [(1000, "copy", "a", 1), (1001, "COPY", "b", 1), (1002, "x" * 1000, None, 1), (1003, None, None, 1), (None, "", "a", 1), (7, "r", "a", 1), (7, "r", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = packing.best_fit(df, capacity=128, per_source=2).collect()
    size = {}
    for r in got:
        assert 0 <= r.bin_offset and r.bin_offset + r.span_end - r.span_start <= 128
        size.setdefault(r.bin_id, []).append((r.bin_offset, r.span_end - r.span_start, r.doc_id))
    for spans in size.values():
        spans.sort(key=lambda x: x[:2])
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.span_end - r.span_start
    assert total[1002] == 1001 and total[1003] == 1 and total[7] == 2 * 2 + len("t" * 7 + "7") + 1
    where = {r.doc_id: r.bin_id for r in got}
    assert where[1000] != where[1001]
    source = {i: s for i, _, s, _ in rows}
    for spans in size.values():
        names = [source[d] for _, _, d in spans if source[d]]
        assert all(names.count(s) <= 2 for s in set(names))
    assert packing.best_fit(df.limit(0)).count() == 0
    unique = df.where("doc_id is not null and doc_id <> 7")
    plan = packing.best_fit(unique, capacity=128)
    written = packing.sequences(unique, plan).collect()
    whole = {}
    for r in sorted(plan.collect(), key=lambda r: r.span_start):
        sequence = next(w.sequence for w in written if w.bin_id == r.bin_id)
        whole[r.doc_id] = whole.get(r.doc_id, "") + sequence[r.bin_offset : r.bin_offset + r.span_end - r.span_start]
    assert all(len(w.sequence) <= 128 for w in written) and whole == {i: (t or "") + "\x03" for i, t, _, _ in rows if i not in (None, 7)}


PHRASES = {"en": "the and of that with this for are was", "de": "der und die das mit von ist auf ein", "fr": "le et les des que pour dans est une"}


def labelled(n):
    rng = np.random.default_rng(2)
    return [(i, " ".join(rng.choice(PHRASES[lang].split(), 12)), lang) for i in range(n) for lang in [["en", "de", "fr"][i % 3]]]


def test_language_frame(spark):
    rows = labelled(240) + [(900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (None, "the and of", "fr"), (903, "der und die " * 9000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.train(language.labelled_sample(df))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:240]}
    held = [i for i in truth if got[i].held_out]
    assert held and sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[903].lang_pred == "de" and got[None].lang_pred == "en" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.in_a_language(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language.identify(df.limit(0), model).count() == 0
    none = language.train([])
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}


def test_unlearned_languages_and_gibberish_go(spark):
    phrases = PHRASES | {"es": "el la los que de con por para una las"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(phrases[lang].split(), 12)), lang) for i in range(400) for lang in [sorted(phrases)[i % 4]]]
    draw = lambda n: " ".join("".join(rng.choice(list("bcdfghjkqvwxyz"), 6)) for _ in range(n))
    go = ["mieleni minun tekevi aivoni ajattelevi lahteani laulamahan", "litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic", "мой дядя самых честных правил когда не в шутку занемог", draw(12), draw(3000)]
    stay = [" ".join(phrases[x] for x in sorted(phrases)), " ".join(w for words in zip(*(phrases[x].split()[:8] for x in sorted(phrases))) for w in words), "the and of", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" the and of that']
    rows += [(1000 + i, t, None) for i, t in enumerate(go)] + [(2000 + i, t, None) for i, t in enumerate(stay)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.in_a_language(df, language.train(language.labelled_sample(df))).collect()}
    assert kept == set(range(400)) | {2000 + i for i in range(len(stay))}
    german = {r.doc_id for r in language.in_a_language(df, language.train(language.labelled_sample(df)), allowed=["de"]).collect()}
    assert german - {2000, 2001} == {i for i in range(400) if sorted(phrases)[i % 4] == "de"}


def test_features_in_blocks_change_nothing(monkeypatch):
    model = language.train([(lang, text) for _, text, lang in labelled(300)])
    texts = ["the and of " * 400, "der " + "x" * 3000 + " und", "", "le les des"]
    whole = model.label(texts, True)
    monkeypatch.setattr(language, "BLOCK_CHARS", 100)
    assert model.label(texts, True) == whole


def test_vocabularies_of_another_kind_are_refused(monkeypatch):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor(model_file=scan.MODEL)

    class Other:
        def __init__(self, model_file=None):
            self.__class__.made = self

        def __getattr__(self, name):
            return getattr(real, name)

    class Unigram(Other):
        def get_score(self, i):
            return real.get_score(i) / 7

    class Folding(Other):
        def encode(self, text):
            return real.encode(text.lower())

    for kind in (Unigram, Folding):
        monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", kind)
        with pytest.raises(ValueError):
            scan.load()


def test_posteriors_match_plain_forward_backward():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"])
    model.moves, model.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = np.array([1, 70, 33, 32, 5, 200])
    emit = rng.normal(size=(int(sizes.sum()), 3)) * 2
    got, moves = model.posteriors(emit, sizes, pairs=True)
    at, total = 0, np.zeros((3, 3))
    for n in sizes:
        e, step = np.exp(emit[at : at + n]), np.exp(model.moves)
        f = [np.exp(model.start) * e[0]]
        for i in range(1, n):
            f.append(f[-1] @ step * e[i] / f[-1].sum())
        b = [np.ones(3)]
        for i in range(n - 1, 0, -1):
            b.insert(0, step @ (e[i] * b[0]) / b[0].sum())
        q = np.array(f) * np.array(b)
        assert np.allclose(q / q.sum(axis=1, keepdims=True), got[at : at + n])
        for i in range(1, n):
            j = f[i - 1][:, None] * step * (e[i] * b[i])[None, :]
            total += j / j.sum()
        at += n
    assert np.allclose(total, moves)


def test_transitions_are_learned_and_switches_found():
    runs = [(lang, text) for _, text, lang in labelled(300)]
    model = language.train(runs)
    assert model.moves.trace() / 3 > (model.moves.sum() - model.moves.trace()) / 6
    mixed = "the and of that with der und die das mit von"
    chars, starts, _ = language.marked_words(language.codes(mixed))
    grams, lexicon = language.features(chars, starts)
    marg, _ = model.posteriors(model.emissions(grams, lexicon, starts), np.array([len(starts)]))
    assert [model.languages[i] for i in marg.argmax(axis=1)] == ["en"] * 5 + ["de"] * 6


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(s, e, k) for s, _, e, k in sorted(out)]


PIECES = ["password", "Secret", "ſecret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "zz", "\U0001f600"]


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_match_definition(text):
    assert secrets.base_spans(text) == brute_spans(text)


HEXES, ALNUM = "0123456789abcdef", secrets.ALNUM
WORDS = [a + b + c for a in ("inter", "over", "under", "2024-01-", "4111") for b in ("nation", "stand", "12", "11111111", "com") for c in ("ally", "ing", "al-use", "34", "-x/en/")]


def draw(rng, letters, n):
    return "".join(rng.choice(list(letters), n))


@pytest.fixture(scope="module")
def formats():
    rng = np.random.default_rng(0)
    labelled = [("assign", "key_" + draw(rng, ALNUM, 24)) for _ in range(120)] + [("hex", draw(rng, HEXES, 40)) for _ in range(120)]
    return secrets.learn(labelled + secrets.seeds(), WORDS)


def test_merging_makes_loops_that_know_unseen_lengths():
    rng = np.random.default_rng(1)
    automaton = secrets.Automaton([draw(rng, HEXES, 40) for _ in range(200)])
    assert len(automaton.table) < 5
    for n in (16, 33, 80, 500):
        assert automaton.bits(draw(rng, HEXES, n))[0] / n < 4.3
    assert automaton.bits(draw(rng, "ghijkl", 40))[0] / 40 > 8
    prefixed = secrets.Automaton(["key_" + draw(rng, ALNUM, 24) for _ in range(200)])
    assert prefixed.bits("key_" + draw(rng, ALNUM, 50))[0] + 15 < prefixed.bits(draw(rng, ALNUM, 54))[0]


def test_bare_credentials_of_seen_and_unseen_lengths_are_found(formats):
    rng = np.random.default_rng(2)
    bare = ["key_" + draw(rng, ALNUM, 24), "key_" + draw(rng, ALNUM, 33), draw(rng, HEXES, 20), "ghp_" + draw(rng, ALNUM, 36), "sk_live_" + draw(rng, ALNUM, 24), "xoxb-" + draw(rng, secrets.DIGITS, 12) + "-" + draw(rng, secrets.DIGITS, 12) + "-" + draw(rng, ALNUM, 24)]
    prose = ["internationally-standing", "2024-01-01T00-00-00Z", "4111111111111111", "key_short1", "understandinginternationally", "/en/overstanding/11/12"]
    text = "see " + " and ".join(x for pair in zip(bare, prose) for x in pair)
    assert secrets.base_spans(text) == []
    found = secrets.scored(text, [], formats)
    assert [text[s:e] for s, e, _, _, adds in found if adds] == bare
    assert [text[s:e] for s, e, _, _, _ in found] == [x for pair in zip(bare, prose) for x in pair if len(x) >= 16]
    assert secrets.learn([], WORDS).kinds == [] and secrets.scored(text, [], secrets.learn([], WORDS)) == []


def test_candidates_inside_base_spans_are_scored_and_add_nothing(formats):
    token = draw(np.random.default_rng(3), HEXES, 40)
    text = f'token = "{token}" and {token[:20]}'
    found = secrets.scored(text, secrets.base_spans(text), formats)
    assert [(text[s:e], adds) for s, e, _, _, adds in found] == [(token, False), (token[:20], True)]
    assert all(ahead >= secrets.MARGIN for _, _, _, ahead, _ in found)


def plain_added(text, formats):
    """Spans the method adds, scored step by step from the tables of probabilities."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_-]+", text):
        end = m.end()
        while end < len(text) and text[end] == "=" and end < m.end() + 2:
            end += 1
        word = text[m.start() : end]
        if m.end() - m.start() < 16 or any(s <= m.start() and e >= end for s, e, _ in brute_spans(text)):
            continue
        best = None
        for name, automaton, mean, most in formats.kinds:
            p, s = 1.0, 0
            for c in word:
                steps, unseen, _ = automaton.table[s]
                p *= 2.0 ** -(steps[c][1] if c in steps else unseen)
                s = steps[c][0] if c in steps else s
            whole = p * 2.0 ** -automaton.table[s][2]
            if best is None or whole > best[0]:
                best = (whole, p, mean, most)
        q = 1.0
        for a, b in zip("\n" + word, word + "\n"):
            q *= 2.0 ** -(formats.background.pairs.get((a, b)) or formats.background.others.get(a, np.log2(secrets.SYMBOLS)))
        if np.log2(best[0] / q) >= secrets.MARGIN and (-np.log2(best[1]) / len(word) - best[2]) * len(word) ** 0.5 <= best[3]:
            out.append((m.start(), end))
    return out


@given(st.lists(st.tuples(st.sampled_from([HEXES, ALNUM, "abcdeinrst", secrets.DIGITS]), st.integers(10, 48), st.sampled_from(["", "ghp_", "key_", "token=", "sk_live_", "AKIA"]), st.integers(0, 10**6), st.sampled_from([" ", "= ", ". ", "\u00e9"])), max_size=6))
@settings(max_examples=150, deadline=None)
def test_added_spans_match_plain_scoring(formats, drawn):
    text = "".join(start + draw(np.random.default_rng(seed), letters, n) + end for letters, n, start, seed, end in drawn)
    assert [(s, e) for s, e, _, _, adds in secrets.scored(text, brute_spans(text), formats) if adds] == plain_added(text, formats)


def test_secret_frame(spark):
    rows = [(1, None), (2, ""), (3, 'token = "' + "ab12" * 10 + '"'), (3, 'token = "' + "ab12" * 10 + '"'), (None, "x" * 100_000 + " secret: hunter22")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, spans string")
    automata = secrets.learn(*secrets.labelled_sample(df))
    got = secrets.scan(df, automata).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == by[2].base_sha256
    assert by[3].spans == "assign:0:49,hex:9:49" and (by[3].n_assign, by[3].n_access, by[3].n_hex) == (1, 0, 1)
    assert by[None].spans == "assign:100001:100017"
    assert secrets.scan(df.limit(0), automata).count() == 0


URLS = ["http://a.example.net/en/x?q#f", "https://EXAMPLE.net/en", "http://example.net", "http://x.net?/en/", "http://notexample.com/de/1", "http://w.example.com/de/", "org://org/fr/a", "http://b.org/frx/", None, "no scheme", "://example.com/de/#a", "a://b://c", "http://net/", "http://nett/", "http://example.com./de/", "http://u@example.com/de/"]


def brute_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best and best[0], best[1] if best else "allow"


def test_rules_are_literals_of_the_plan(spark):
    plan = url_filter.rules_table(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and url_filter.rules_table(spark, []).count() == 0


def test_only_shapes_that_occur_are_made(spark):
    rules = [("com", "/a/", "block"), ("x.y.example.org", "/" + "p" * 40, "allow")]
    urls = ["http://b.com/a/c", "http://x.y.example.org/" + "p" * 50, "http://example.org/" + "p" * 50, "http://com/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(df, url_filter.rules_table(spark, rules)).collect()}
    assert got == {0: "com/a/", 1: "x.y.example.org/" + "p" * 40, 2: None, 3: None}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_filter_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", limit)
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], "h"), (0, URLS[0], "h")] + [(100 + i, URLS[5], "h") for i in range(1500)] + [(3000 + i, "http://none.example.com/x", "h") for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.judge(df, url_filter.rules_table(spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute_judge(u))) for i, u, _ in rows)
    assert url_filter.judge(df.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, url_filter.rules_table(spark, [(None, "/", "block")])).collect()} == {"allow"}


PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ('<body><nav><a href="/">Home</a></nav><article><h1>T &eacute;</h1><p>one\n  two<br>three</p><script>var a="</p><p>no";</script><p>four<b>five</b></p></article><footer>f</footer></body>', "T é\none two three\nfourfive"),
    ("<article><p>a<p>b<div class='ad'>x</div><ul><li>c</ul></article>", "a\nb\nc"),
    ("<div class=sidebar><p>" + "side words " * 30 + "</p></div><div><p>" + "main words here " * 20 + "</p><p>end.</p></div><div id='comments'><p>" + "I agree fully " * 30 + "</p></div>", ("main words here " * 20).strip() + "\nend."),
    ("<!-- <p>no</p> --><main><p>yes</p></main><aside>no</aside>", "yes"),
    ("<article><p class='ad'>buy<p>kept<p>kept too <span class=ad>not <span>this</span> nor this</span>end</p></article>", "kept\nkept too end"),
    ("<article><div class='post-header'><h1>Head</h1><p>By us</p></div><p>body</p></article>", "Head\nbody"),
    ("<div class='header'><h1>Site</h1></div><div role=main><p>text</p><p style='display: none'>no</p><p>more</p></div>", "text\nmore"),
    ("<article><ul><li class='social'>share<li>item</ul><div hidden>h</div><p>p</p></article>", "item\np"),
    ("<title>t</title><p>unclosed <a href='x>y'>link", "unclosed link"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


LONG = "main words here " * 20
MARKED_PAGES = [
    ("<article><p>" + LONG + "</p></article><article><p>second part</p></article>", LONG.strip() + "\nsecond part"),
    ("<main><h1>Head</h1><article><p>" + LONG + "</p></article></main>", "Head\n" + LONG.strip()),
    ("<article><p>teaser</p></article>" + "<p><a href=x>link</a></p>" * 4 + "<div><p>" + LONG + "</p></div>", LONG.strip()),
    ("<article><p>" + LONG + "</p></article>" + "<p><a href=x>link</a></p>" * 4 + "<p>short</p>", LONG.strip()),
]


@pytest.mark.parametrize("page,text", MARKED_PAGES)
def test_windows_choose_the_text_of_marked_pages(page, text):
    assert html_extract.main_text(page) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<script>", "</script>", "<", ">", '"', "<!--", "-->", "a b", "&lt;", "<nav>", "</nav>", "<br/>"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_html_never_fails(page):
    text = html_extract.main_text(page)
    assert text == text.strip() and "  " not in text


def test_html_frame(spark):
    rows = [(i, f"u{i}", p, "t") for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p>" + "long words " * 20_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars) == (text, len(text))
    assert got[None].n_chars == len(("long words " * 20_000).strip())
    assert html_extract.extract(df.limit(0)).count() == 0


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pii_formats_links_and_validity(spark):
    rows = [
        (1, "mail ann.lee7@Mail.example.com, card 4111 1111 1111 1111 end"),
        (2, "ann.lee7@Mail.example.com 4111111111111111 4111111111111112"),
        (3, "+1 (415) 555-0132; (415) 555-0132; 415-555-0132"),
        (4, "born 1999-12-31, 31/12/1999, 12/31/1999, not 2023-02-30 or 1999-13-01 v1.2.3"),
        (5, "ip 97.51.17.173 and 300.1.1.1 and 1.2.3.4.5"),
        (6, "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE89370400440532013001"),
        (7, "123-45-6789"), (8, None), (9, ""), (None, "no private values"), (11, "x" * 100_000 + " 4111111111111111"),
    ]
    df = spark.createDataFrame([(i, t, "keep", "z", 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, m string, _x string, found int, kinds int, row int, between int")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "a key's \\ 'quotes'").collect()}
    t = {i: r.text for i, r in got.items()}
    mail = re.search(r"mail (\S+),", t[1])[1]
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@Mail\.example\.com", mail) and mail != "ann.lee7@Mail.example.com" and t[2].startswith(mail)
    card = re.search(r"card ([\d ]+) end", t[1])[1]
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", card) and luhn_ok(card.replace(" ", "")) and card.replace(" ", "") in t[2] and "4111 1111" not in t[1]
    assert "4111111111111112" in t[2] and t[11].endswith(card.replace(" ", ""))
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}); \((\d{3})\) (\d{3})-(\d{4}); (\d{3})-(\d{3})-(\d{4})", t[3])[0]
    assert phones[:3] == phones[3:6] == phones[6:] != ("415", "555", "0132")
    a, b, c = re.match(r"born (\d{4}-\d\d-\d\d), (\d\d/\d\d/\d{4}), (\d\d/\d\d/\d{4})", t[4]).groups()
    y, m, d = a.split("-")
    assert b == f"{d}/{m}/{y}" and c == f"{m}/{d}/{y}" and a != "1999-12-31" and t[4].endswith("not 2023-02-30 or 1999-13-01 v1.2.3")
    ip = re.match(r"ip (\S+) and 300.1.1.1 and 1.2.3.4.5$", t[5])[1]
    assert all(0 <= int(o) <= 255 for o in ip.split(".")) and ip != "97.51.17.173"
    for iban in re.match(r"(GB[\dA-Z ]+) and (DE\d+), not DE89370400440532013001", t[6]).groups():
        s = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", t[7]) and t[7] != "123-45-6789"
    assert t[8] is None and t[9] == "" and t[None] == "no private values"
    assert all((r.m, r._x, r.found, r.kinds, r.row, r.between) == ("keep", "z", 1, 2, 3, 4) for r in got.values())
    assert pii.pseudonymise(df, "k", counts=False).columns == df.columns
    assert (got[1].n_email, got[1].n_card, got[2].n_card, got[4].n_date, got[6].n_iban) == (1, 1, 1, 3, 2)
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


CARD = "4111 1111 1111 1111"
BESIDE = [
    ("4111 1111 1111 1111 12/25", CARD, 1), ("4111111111111111 123", "4111111111111111", 1), ("12 4111 1111 1111 1111", CARD, 1), ("pay 4111-1111-1111-1111 123 ok 1.", "4111-1111-1111-1111", 1),
    ("1234 4111 1111 1111 1111 5", CARD, 1), ("12345678 9012 4111 1111 1111 1111 x", CARD, 1), ("a@b.com 12 4111 1111 1111 1111, 4111 1111 1111 1111 and 12 4111 1111 1111 1111", CARD, 3),
    ("4111 1111 1111 1112 12/25", None, 0), ("1234567890123 1", None, 0),
]


def test_cards_beside_other_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(BESIDE)] + [(100, CARD)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    new = got[100].text
    for i, (text, card, n) in enumerate(BESIDE):
        want = text.replace(card, new if " " in card else new.replace(" ", "-" if "-" in card else "")) if card else text
        shown = got[i].text.replace(got[i].text.split("@")[0], text.split("@")[0], 1) if "@" in text else got[i].text
        assert (shown, got[i].n_card) == (want, n)


def test_pii_permutation_is_one_to_one(spark):
    rows = spark.range(20_000).selectExpr("lpad(cast(id as string), 5, '0') as x", "id")
    made = rows.selectExpr(f"{pii.permuted('x', chr(39) + 'k' + chr(39), 'one')} as y", f"{pii.permuted_number('id', 189, 773, chr(39) + 'k' + chr(39), 'one')} as z")
    seen = made.toPandas()
    assert seen.y.nunique() == seen.z.nunique() == 20_000 and seen.y.str.fullmatch(r"\d{5}").all() and seen.z.between(0, 146_096).all()
    other = rows.selectExpr(f"{pii.permuted('x', chr(39) + 'k' + chr(39), 'other')} as y").toPandas()
    assert (other.y == seen.y).mean() < 0.01
