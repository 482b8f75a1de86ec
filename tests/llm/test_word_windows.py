import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import minhash, ngrams, recompress, substring, words

WORD = re.compile("[^\x20\x09-\x0d]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x1c\x85 Z", max_size=12), max_size=5))
def test_word_counts(texts):
    hashes, counts = words.word_hashes([t.encode() for t in texts])
    assert counts.tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(1, 4))
def test_symbols_depend_on_their_context_only(texts, rounds):
    """Where the words of a symbol's context stand, the same symbol stands."""
    data = [" ".join("abc"[i] for i in t).encode() for t in texts]
    hashes, counts = words.word_hashes(data)
    s = recompress.rounds(hashes, counts, rounds)
    flat = [w for t in data for w in t.split()]
    ends = counts.cumsum().tolist()
    at = {(int(a), int(b)): int(n) for n, a, b in zip(s.name, s.start, s.end, strict=True)}
    for name, a, b, left, right, text in zip(*[x.tolist() for x in s], strict=True):
        low, high = ends[text] - counts[text], ends[text]
        if left < low or right > high:
            continue
        context = flat[left:right]
        for t, end in enumerate(ends):
            for i in range(end - counts[t], end - len(context) + 1):
                if flat[i : i + len(context)] == context:
                    assert at.get((i + a - left, i + b - left)) == name


def brute_removed(docs, width):
    seen, out = {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            if seen.setdefault(k, (i, j)) != (i, j):
                gone[j : j + width] = [True] * width
        out[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), sum(gone)
    return out


def planted(n=60, seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    shared = [[word() for _ in range(rng.randint(18, 60))] for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [[word() for _ in range(rng.randint(0, 30))], rng.choice(shared), [word() for _ in range(rng.randint(0, 30))]]
        docs.append((i, " ".join(w for p in parts for w in p)))
    docs += [(n, docs[0][1]), (n + 1, ""), (n + 2, None), (n + 3, "x " * 300), (n + 4, docs[3][1].replace(" ", "\n\t"))]
    return docs


def test_repeats_against_brute_force(spark):
    docs = planted()
    rows = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, n_words string, __block int")
    out = {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in substring.remove_repeats(rows).collect()}
    assert out == brute_removed(docs, substring.WIDTH)


def test_repeats_edge_rows(spark):
    text = " ".join(map(str, range(40)))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "a b")], "doc_id long, text string")
    out = sorted((r["doc_id"] or 99, r["n_removed"]) for r in substring.remove_repeats(rows).collect())
    assert out == [(1, 0), (1, 0), (99, 0), (99, 40)]
    assert substring.remove_repeats(rows.where("false")).collect() == []
    digest = substring.remove_repeats(rows.where("doc_id = 1"), into="d", digest=True).first()["d"]
    assert digest == hashlib.sha256(text.encode()).hexdigest()


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = [x.lower() for x in (text or "").split()]
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(80)]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs) * 3, " ".join(w)))
        base = w  # a chain: the next group starts from the last
    docs += [(1, docs[0][1].upper()), (2, docs[0][1]), (4, "one two"), (5, "One  two"), (7, ""), (8, None), (10, "one")]
    return docs


def test_components_against_all_pairs(spark):
    docs = near_copies()
    rows = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n long, rep string")
    out = {r["doc_id"]: r for r in minhash.near_duplicates(rows).collect()}
    want = brute_components(docs)
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(r["kept"] == (want[i] == i) for i, r in out.items())
    assert out[7]["n_shingles"] == out[8]["n_shingles"] == 0 and out[4]["component_id"] == out[5]["component_id"] == 4


def test_components_edge_rows(spark):
    long = " ".join(str(i) for i in range(30_000))
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z"), (9, long), (11, long + " x")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert out == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (9, 9, True), (11, 9, False)], key=str)
    assert minhash.near_duplicates(rows.where("false")).collect() == []
    assert sorted(r["doc_id"] or 0 for r in minhash.keep_one(rows).collect()) == [0, 0, 3, 3, 9]


def test_links_that_no_leader_sees(spark):
    """b and c are linked, a is near both but linked with neither."""
    base = [f"w{i}" for i in range(100)]
    b = base[:76] + [f"q{i}" for i in range(24)]
    c = base[:74] + [f"q{i}" for i in range(26)]
    docs = [(1, " ".join(base)), (2, " ".join(b)), (3, " ".join(c))]
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute_components(docs) == {1: 1, 2: 2, 3: 2}


def test_scores_against_brute_force(spark):
    import collections
    import math

    docs = planted(30)
    counts, total = collections.Counter(), 0
    split = {i: (t or "").split() for i, t in docs}
    for w in split.values():
        total += len(w)
        for k in (1, 2, 3):
            counts.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))

    def score(h, w):
        if not h:
            return math.log(counts[(w,)] / total)
        return math.log(counts[h + (w,)] / counts[h]) if counts[h + (w,)] >= 2 else math.log(0.4) + score(h[1:], w)

    out = {r["doc_id"]: r for r in ngrams.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, w in split.items():
        assert out[i]["log_score"] == pytest.approx(sum(score(tuple(w[max(0, j - 2) : j]), w[j]) for j in range(len(w))))
        assert (out[i]["mean_log_score"] is None) == (not w)
    assert ngrams.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_whose_hashes_begin_alike_are_counted_apart(spark):
    import math

    docs = [(1, "w1007886"), (2, "w13922327"), (3, "w5501693"), (4, "w19505050")]
    out = ngrams.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [r["log_score"] for r in out] == pytest.approx([math.log(1 / 4)] * 4)


def alternating(n):
    """Two words of n characters that polynomial hashes modulo a power of two can't tell apart."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_alternating_words_stay_apart(spark, n):
    import math

    a, b = alternating(n)
    tail = " ".join(f"t{i}" for i in range(19))
    docs = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, a), (4, b)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows).collect()} == brute_components(docs)
    single = {r["doc_id"]: r["log_score"] for r in ngrams.score(rows).collect()}
    assert single[3] == pytest.approx(math.log(2 / 42)) and single[4] == pytest.approx(math.log(2 / 42))
    import numpy as np

    pattern = np.array(words.word_hashes(f"{a[:32]}".replace("a", " xx").replace("b", " yy").encode().split(b"|"))[0])
    other = np.array(words.word_hashes(f"{b[:32]}".replace("a", " xx").replace("b", " yy").encode().split(b"|"))[0])
    for width in (5, 8, 16, 20, 32):
        assert words.window_hashes(pattern, width)[0] != words.window_hashes(other, width)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 21), st.sampled_from([0, 77]))
def test_window_hashes_are_equal_for_equal_words_only(flat, width, seed):
    hashes, _ = words.word_hashes([" ".join("abc"[i] for i in flat).encode()])
    found = words.window_hashes(hashes, width, seed).tolist()
    want = [tuple(flat[j : j + width]) for j in range(len(flat) - width + 1)]
    assert len(found) == len(want) and len(set(found)) == len(set(want)) == len(set(zip(found, want, strict=True)))


def test_higher_orders_against_brute_force(spark):
    import collections
    import math

    split = {i: (t or "").split() for i, t in planted(12)}
    counts = collections.Counter(tuple(w[j : j + k]) for w in split.values() for k in (1, 2, 3, 4) for j in range(len(w) - k + 1))
    total = sum(map(len, split.values()))

    def score(h, w, least):
        if not h:
            return math.log(counts[(w,)] / total)
        return math.log(counts[h + (w,)] / counts[h]) if counts[h + (w,)] >= least else math.log(0.4) + score(h[1:], w, least)

    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in split.items()], "doc_id long, text string")
    for order, least in ((4, 3), (1, 2), (2, 1)):
        out = {r["doc_id"]: r["log_score"] for r in ngrams.score(rows, order=order, min_count=least).collect()}
        for i, w in split.items():
            assert out[i] == pytest.approx(sum(score(tuple(w[max(0, j - order + 1) : j]), w[j], least) for j in range(len(w))))


def template_pages(n=90, seed=3):
    """Pages of one template: alike, but not linked, save for a few pairs that their group's smallest id doesn't see."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    template = [word() for _ in range(120)]
    docs = [(i, [*template, *[word() for _ in range(80)]]) for i in range(n)]
    for i in range(0, n, 9):
        docs[i + 4] = (i + 4, docs[i + 3][1][:-6] + [word() for _ in range(6)])
    return [(i, " ".join(w)) for i, w in docs]


@pytest.mark.parametrize("part_rows, part_shingles", [(512, 1_000_000), (7, 1_000_000), (512, 900)])
def test_parts_of_a_group_change_nothing(spark, part_rows, part_shingles):
    docs = template_pages()
    rows = spark.createDataFrame([*docs, (200, docs[3][1]), (200, docs[50][1]), (5, docs[61][1])], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows, part_rows=part_rows, part_shingles=part_shingles).collect()}
    assert out == brute_components([*docs, (200, docs[3][1]), (200, docs[50][1]), (5, docs[61][1])])
