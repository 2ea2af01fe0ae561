import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import streams
from tidemark.llm.leakage import Passages, leaked_passages, qgrams, search
from tidemark.llm.mixture import count_tokens, encoding, mix
from tidemark.llm.percentiles import Buffers, combine, percentiles, sketch, weighted
from tidemark.llm.repetition import Forest, repeated_content, statistics

WORD = re.compile(r"[^\W_]+")
VOCAB = [f"w{i}" for i in range(40)] + ["alpha", "Über", "naïve", "数据", "x2"]


# ---- words


@given(st.lists(st.text(alphabet="ab1_- .\n\r\té数Ω", max_size=30), max_size=6), st.booleans())
@settings(max_examples=300, deadline=None)
def test_words_against_a_pattern(texts, drop):
    cp, bounds = streams.points(texts)
    s, e, doc = streams.words(cp, bounds, drop)
    got = [[] for _ in texts]
    for a, b, d in zip(s, e, doc):
        got[d].append("".join(map(chr, cp[a:b])))
    for text, words in zip(texts, got):
        if drop:
            text = "\n".join(x for x in re.split(r"\r\n|\r|\n", text) if not x.startswith("-"))
        assert words == WORD.findall(text.lower())


# ---- leakage


def _leaks(docs, items, least=12):
    grams = {}
    for i, p in items:
        w = WORD.findall((p or "").lower())
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "a b c d e f g h i j k l"), (33, "one sentence. " * 6)]
    docs = []
    for d in range(200):
        t = text(rng.randrange(0, 80))
        if d % 3 == 0:
            w = (items[rng.randrange(30)][1]).split()
            a = rng.randrange(len(w))
            cut = w[a : a + rng.randrange(8, 30)]
            t += " ,;\n".join([""] + [x.upper() for x in cut]) + "! " + text(5)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, "A-b-c-d-e-f-g-h-i-j-k-l"), (503, "xa b c d e f g h i j k l"), (504, "x " * 300_000), (505, "one sentence. " * 9), (506, " ".join(f"{w}x" for w in items[0][1].split()))]
    docs.append(docs[0])
    got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, passage string"))
    exact = {(r["doc_id"], r["item_id"]) for r in got.where("exact").collect()}
    assert exact == _leaks(docs, items) and (502, 32) in exact and (503, 32) not in exact
    # a small filter and short pieces change nothing
    small = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), most_bits=1, piece=1, most_chars=3_000)
    assert {(r["doc_id"], r["item_id"]) for r in small.where("exact").collect()} == exact


def _near(text, window, k):
    """Whether ``window`` stands somewhere in ``text`` with at most ``k`` edits (Sellers)."""
    row = list(range(len(window) + 1))
    for c in text:
        last, row = row, [0] * (len(window) + 1)
        for j, w in enumerate(window, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != w))
        if row[-1] <= k:
            return True
    return False


@pytest.mark.parametrize("edits", [1, 2])
def test_near_matches_against_brute_force(spark, edits):
    """Recall and precision of near matches are 1: planted windows with 0 to 3 random edits, shared first sentences."""
    rng = random.Random(7)
    start = "every one of these begins with the same rather long sentence of words "
    items = [(i, (start if i % 3 == 0 else "") + " ".join(rng.choice(VOCAB) for _ in range(14))) for i in range(9)]
    flat = lambda t: " ".join(WORD.findall(t.lower()))
    docs = []
    for d in range(60):
        words = items[rng.randrange(9)][1].split()
        a = rng.randrange(max(1, len(words) - 12))
        cut = list(" ".join(words[a : a + 12]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(cut))
            kind = rng.randrange(3)
            cut[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice("abcxyz")]
        docs.append((d, f"{rng.choice(VOCAB)} {rng.choice(VOCAB)} {''.join(cut)} {rng.choice(VOCAB)}"))
    want = set()
    for i, p in items:
        w = flat(p).split()
        for d, t in docs:
            if any(_near(flat(t), " ".join(w[k : k + 12]), edits) for k in range(len(w) - 11)):
                want.add((d, i))
    got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), edits=edits).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 30


def test_one_edit_is_found():
    p = "the quick brown fox jumps over the lazy dog while nobody watches the river bank today"
    index = Passages([(1, p)], 12, 1)
    for changed, edits in ((p, 0), (p.replace("lazy", "lasy"), 1), (p.replace("lazy", "lzy"), 1), (p.replace("lazy", "lazyy"), 1)):
        short = " ".join(changed.split()[2:15])
        r = search(index, np.array([7]), [f"see: {short}."], 10_000)
        assert r["edits"].min() <= edits and len(r) == 1
    two = p.replace("jumps", "jmps").replace("dog", "dig").replace("river", "rvr")
    assert search(index, np.array([7]), [two], 10_000).empty


def test_qgrams_equal_iff_texts_equal():
    cp = np.array([ord(c) for c in "abcabcabdabc"], dtype=np.uint32)
    for q in (1, 2, 3, 5, 8):
        h = qgrams(cp, q)
        s = "abcabcabdabc"
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (s[i : i + q] == s[j : j + q])


def test_leak_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert leaked_passages(docs, items).count() == 0


# ---- repetition


def _share(t, gram=6):
    t = "\n".join(x for x in re.split(r"\r\n|\r|\n", t or "") if not x.startswith("-"))
    w = WORD.findall(t.lower())
    seen, hit = set(), [False] * len(w)
    for k in range(len(w) - gram + 1):
        g = tuple(w[k : k + gram])
        if g in seen:
            hit[k : k + gram] = [True] * gram
        seen.add(g)
    return len(w), sum(hit)


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", "\n", "- a b", "\r", "E"]), max_size=40).map(" ".join), max_size=6))
@settings(max_examples=200, deadline=None)
def test_share_against_brute_force(texts):
    got = statistics(texts)
    assert [(r.words, r.repeated_words) for r in got.itertuples()] == [_share(t) for t in texts]


def test_repetition_frame(spark):
    rng = random.Random(1)
    docs = []
    for d in range(300):
        w = [f"{rng.choice(VOCAB)}{rng.randrange(50)}" for _ in range(rng.randrange(0, 120))]
        if d % 11 == 0:
            w = w + w[: len(w) * rng.randrange(3, 10) // 10] * 2
        docs.append((d, " ".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "spam and eggs " * 20_000, "x"), (None, "a", "x"), (902, "spam", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, words string")
    got = {r["doc_id"]: r for r in repeated_content(df).collect()}
    assert set(got) == {d for d, _, _ in docs if d is not None}
    for d, t, _ in docs:
        if d is not None and d != 902:
            n, k = _share(t)
            assert (got[d]["words"], got[d]["repeated_words"]) == (n, k)
            assert got[d]["repetitive"] == (k > 0.3 * n)
    assert got[902]["repetitive"] and got[902]["words"] == 60_000
    assert repeated_content(df.limit(0)).count() == 0


def test_forest_ranks_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.05, (2000, 3)), [[1.0, 1.0, 0.0], [0.9, 0.0, 0.0]]])
    s = Forest(x, 100, 256, 1).score(x)
    assert s[-2] > np.quantile(s, 0.995) and s[-1] > np.quantile(s, 0.99)


def test_forest_dismisses_nothing_over_the_limit():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(0, 0.03, (3000, 3)))
    x[:60] += rng.uniform(0.2, 0.7, (60, 1))
    f = Forest(x, 60, 256, 2)
    beyond = rng.uniform(0.3, 1.0, (5000, 3))
    assert f.score(beyond).min() >= f.least_score(np.full(3, 0.3))
    assert (f.score(x) >= f.least_score(np.full(3, 0.3))).mean() < 0.5


# ---- mixture

TARGETS = "source string, target_share double, max_repeats int"


def _corpus(spark, sizes, seed=0):
    rng = random.Random(seed)
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(1, 60))), s, "clash"))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


def test_mix_meets_shares(spark):
    docs = _corpus(spark, {"big": 800, "mid": 300, "small": 60, "other": 50})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.15, 3), ("absent", 0.05, 2)], TARGETS)
    drawn, shares = mix(docs, targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert rows["absent"]["drawn_tokens"] == 0
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert rows[s]["actual_share"] == pytest.approx(w / 0.95, abs=0.005)
    held = drawn.collect()
    top = {"big": 1, "mid": 1, "small": 3}
    assert all(1 <= r["copies"] <= top[r["source"]] for r in held) and len({r["doc_id"] for r in held}) == len(held)
    enc = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["tokens"] == len(enc.encode_ordinary(text[r["doc_id"]])) for r in held)
    # a larger budget keeps what a smaller one drew
    few = {r["doc_id"]: r["copies"] for r in mix(docs, targets, total_tokens=5_000)[0].collect()}
    more = {r["doc_id"]: r["copies"] for r in mix(docs, targets, total_tokens=9_000)[0].collect()}
    assert all(more.get(d, 0) >= c for d, c in few.items())
    # too small for its share: drawn max_repeats times
    capped = {r["source"]: r for r in mix(docs, targets, total_tokens=200_000)[1].collect()}
    assert capped["small"]["drawn_tokens"] == 3 * capped["small"]["held_tokens"]


def test_mix_few_bits(spark):
    """Refinement over many levels ends in the same place."""
    docs = _corpus(spark, {"a": 200, "b": 200})
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], TARGETS)
    x, y = (sorted((r["doc_id"], r["copies"]) for r in mix(docs, targets, bits=b)[0].collect()) for b in (2, 12))
    assert x == y


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x", "a"), (3, "x", None), (4, "word " * 50_000, "a"), (4, "again", "a")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1), ("z", None, 1)], TARGETS)
    drawn, shares = mix(docs, targets)
    assert {r["doc_id"] for r in drawn.collect()} <= {1, 2, 4} and shares.count() == 1
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        drawn, shares = mix(d, t)
        assert drawn.count() == 0 and all(r["actual_share"] is None for r in shares.collect())


# ---- percentiles


def _within(values, got, share, err):
    v = np.sort(values)
    rank = max(int(np.ceil(share * len(v) - 1e-9)), 1)
    return np.searchsorted(v, got, "left") < rank + err and np.searchsorted(v, got, "right") >= rank - err


@given(st.integers(0, 1000), st.sampled_from([4, 16, 64]), st.integers(1, 5000))
@settings(max_examples=60, deadline=None)
def test_buffers_keep_their_bound(seed, k, n):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 1) if seed % 2 else rng.normal(size=n)
    whole = Buffers(k)
    for piece in np.array_split(x, rng.integers(1, 6)):
        b = Buffers(k)
        for part in np.array_split(piece, 3):
            b.add(part)
        whole.merge(*[np.asarray(v) if isinstance(v, list) else v for v in b.row()])
    n2, err, level, size, vals = whole.row()
    assert n2 == n and sum(s * (1 if lv < 0 else 2**lv) for lv, s in zip(level, size)) == n
    assert err <= max(np.log2(max(n / k, 1)) + 2, 0) * n / (2 * k) + 1
    for share, got in zip((0.0, 0.1, 0.5, 0.9, 1.0), weighted(level, size, vals, n, [0.0, 0.1, 0.5, 0.9, 1.0])):
        assert _within(x, got, share, err + 1e-9)


def test_percentiles_frame(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "a", "b"], 40_000, p=[0.9, 0.05, 0.05]), "x": rng.normal(size=40_000), "n": "clash"})
    pdf.loc[:50, "x"] = np.nan
    df = spark.createDataFrame(pdf).repartition(9)
    s = combine(sketch(df, ["g"], "x", k=128), ["g"], k=128, fan_in=2, pieces=9)
    rows = percentiles(s, ["g"], [0.05, 0.5, 0.95]).collect()
    assert len(rows) == 9
    for r in rows:
        x = pdf.loc[(pdf.g == r["g"]), "x"].dropna().to_numpy()
        assert r["n"] == len(x) and _within(x, r["value"], r["share"], r["rank_error"]) and r["rank_error"] < 0.05 * len(x)
    # days handled apart and combined later
    halves = sketch(df.where("x < 0"), ["g"], "x", k=128).unionByName(sketch(df.where("x >= 0"), ["g"], "x", k=128))
    again = {(r["g"], r["share"]): r for r in percentiles(combine(halves, ["g"], k=128, pieces=20), ["g"], [0.5]).collect()}
    x = pdf.loc[pdf.g == "hot", "x"].dropna().to_numpy()
    assert _within(x, again["hot", 0.5]["value"], 0.5, again["hot", 0.5]["rank_error"])
    assert percentiles(combine(sketch(df.limit(0), ["g"], "x"), ["g"]), ["g"], [0.5]).count() == 0
    one = percentiles(combine(sketch(spark.createDataFrame([(None, 3.0), (None, 4.0)], "g string, x double"), ["g"], "x"), ["g"]), ["g"], [0.5]).collect()
    assert [(r["g"], r["value"], r["n"]) for r in one] == [(None, 3.0, 2)]


def test_tokens_are_whole_texts(spark):
    docs = spark.createDataFrame([(1, "one two three " * 30_000, "s")], "doc_id long, text string, source string")
    n = count_tokens(docs, "doc_id", "text", "source", "/opt/tokenizers/byte_bpe_50k.tiktoken").first()["tokens"]
    assert n >= 90_000


# ---- figures, counts and repeatability


def test_forest_figures(spark):
    """The forest alone tells planted repetition on held-out rows (about fifty positives, so the figures are coarse)."""
    from tidemark.llm.repetition import best_cut, forest_figures

    rng = random.Random(2)
    docs = []
    for d in range(1500):
        w = [f"{rng.choice(VOCAB)}{rng.randrange(300)}" for _ in range(rng.randrange(40, 120))]
        docs.append((d, " ".join(w * (3 if d % 15 == 0 else 1))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    f = forest_figures(df).first()
    assert f["labelled"] == 1500 and f["held_out"] > 600 and f["recall"] >= 0.9 and f["precision"] >= 0.8
    none = forest_figures(df.limit(0)).first()
    assert none["labelled"] == 0 and none["precision"] is None
    assert best_cut(np.array([0.9, 0.5, 0.5, 0.1]), np.array([True, True, False, False])) == 0.5
    assert best_cut(np.array([0.9]), np.array([False])) == float("inf")


def test_ids_count_once_in_a_mix(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e f g", "x"), (2, "d", "y"), (3, "h", "y")], "doc_id long, text string, source string")
    n = {r["doc_id"]: (r["source"], r["tokens"]) for r in count_tokens(docs, "doc_id", "text", "source", "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert n == {1: ("x", 3), 2: ("x", 4), 3: ("y", 1)}
    shares = {r["source"]: r["held_tokens"] for r in mix(docs, spark.createDataFrame([("x", 0.5, 1), ("y", 0.5, 1)], TARGETS))[1].collect()}
    assert shares == {"x": 7, "y": 1}


def test_sketches_do_not_depend_on_arrival(spark):
    """Rows of a partition in another order, and sketches arriving in another order, give the same percentiles."""
    rng = random.Random(3)
    rows = [(i, "g", rng.random()) for i in range(3000)]
    mixed = [rng.sample(rows[k::3], 1000) for k in range(3)]
    again = [rng.sample(rows[k::3], 1000) for k in range(3)]

    def run(parts):
        df = None
        for p in parts:
            d = spark.createDataFrame(p, "id long, g string, x double").coalesce(1)
            df = d if df is None else df.union(d)
        s = sketch(df, ["g"], "x", order=["id"], k=64)
        return sorted((r["share"], r["value"], r["rank_error"]) for r in percentiles(combine(s, ["g"], k=64, fan_in=2, pieces=9), ["g"], [0.1, 0.5, 0.9]).collect())

    assert run(mixed) == run(again)
