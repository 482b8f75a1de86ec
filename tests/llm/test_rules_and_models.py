import collections
import random
import re
import tarfile
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quillon.llm import html_text, licenses, media, mixing, quality, toxicity

EMPTY = "doc_id long, text string, source string"


def test_measures_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a" * 5000, "x y\nx y\n\nx  y\nz", "a b c d e f g h " * 5 + "q", "é|# $% <&>*"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(30)]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], EMPTY)
    out = {r["doc_id"]: r for r in quality.judge(rows).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        n = collections.Counter(windows)
        covered = {j + k for j, x in enumerate(windows) if n[x] > 1 for k in range(8)}
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.judge(rows.where("false")).collect() == []


def test_hosts_shrink_and_spare_clean_documents(spark):
    clean = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    noisy = lambda k: " ".join(f"w{k}i{i}$$" for i in range(30))
    rows = [(i, noisy(i), "bad") for i in range(60)] + [(100 + i, clean(i), "good") for i in range(60)] + [(200, noisy(0), "good"), (201, clean(99), "bad"), (202, clean(98), None), (203, noisy(1), "tiny")]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, EMPTY)).collect()}
    assert not any(out[i]["kept"] for i in range(60)) and all(out[100 + i]["kept"] for i in range(60))
    assert out[200]["kept"] and out[201]["kept"] and out[202]["kept"]
    assert out[200]["host_excess"] < 1 < out[0]["host_excess"] and out[100]["host_excess"] is None


def test_prior_is_bounded():
    assert quality.beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)
    a, b = quality.beta_prior(100, 50, 2, 25.0)
    assert a == pytest.approx(b) and a + b == quality.PRIOR_WEIGHT[1]


def base_places(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for label, _, phrase in licenses.BASE:
        p = phrase.split()
        for j in range(len(w) - len(p) + 1):
            if w[j : j + len(p)] == p:
                at.append(j)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_rules(spark):
    texts = [None, "", "no words of that kind", "MIT License, mit  LICENSE\nmité license", "GNU General Public License, version 3 or later", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "3-Clause BSD License", "SPDX-License-Identifier: GPL-3.0-only", "GNU Lesser General Public License v2.1", "mit license " * 400, "x" * 20_000]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], EMPTY).withColumn("labels", F.lit("clash"))
    out = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(t)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert out[4]["labels"] == "gpl,gpl-3.0-or-later"
    assert out[5]["labels"] == "apache,apache-2.0" and out[6]["labels"] == "cc-by-nc-4.0" and out[7]["labels"] == "bsd-3-clause"
    assert "gpl-3.0-only" in out[8]["labels"] and out[9]["labels"] == "gpl,lgpl-2.1"
    assert licenses.scan(rows.where("false")).collect() == []


def shortest(pattern):
    """A text that a rule's pattern matches."""
    p = re.sub(r"\(\?[<!=]+(?:[^()]|\([^()]*\))*\)", "", pattern).replace("[cs]", "c").replace("(19|20)[0-9]{2}", "2020").replace("(?:19|20)[0-9]{2}", "2020").replace(".{1,80}?", "x").replace(".{1,60}?", "x")
    while (q := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], p)) != p:
        p = q
    return re.sub(r".\?", "", p)


def test_every_license_rule_finds_its_own_text(spark):
    rules = licenses.rules()
    assert len(rules) > 300
    rows = spark.createDataFrame([(i, shortest(r.pattern)) for i, r in enumerate(rules)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    for i, r in enumerate(rules):
        assert out[i]["detections"], (r, shortest(r.pattern))


def test_blocks_of_pages():
    prose = "the cat and the dog of a man is in it " * 8
    page = f"<head><title>t</title></head><body><nav><a href=x>menu</a></nav><header><h2>site</h2></header><article><h1>A &amp; B</h1><p>{prose}<br>more<p>Short.</p><aside>no</aside><div class='share-box'>no</div><section id=comments><p>{prose}</section></article><div class=ad>{prose}</div><form>no</form><script>var a='</p>'</script><footer>no</footer>"
    assert html_text.main_text(page) == "A & B\n\n" + " ".join(prose.split()) + " more\n\nShort."
    plain = f"<div><a href=x>one</a> | <a href=y>two</a></div><p>{prose}</p><p>Short one.</p><p>{prose}</p><p>tail</p>"
    assert html_text.main_text(plain).split("\n\n")[1] == "Short one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("<article><p a='1>2'>x&nbsp;&#233;</article><p>out") == "x é"


def labelled_page(rng, article, tagged):
    """A page of blocks whose labels are known: (html, the good texts)."""
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in", "is", "that", "it", "river", "stone", "walks", "green", "house", "letters"]) for _ in range(n)) + "."
    links = "".join(f"<li><a href='/{i}'>{rng.choice(['Home', 'News', 'About us', 'Contact'])}</a></li>" for i in range(5))
    title = prose(5)[:-1].capitalize()
    good, body = [title], [f"<h1>{title}</h1>"]
    for _ in range(rng.randint(1, 6)):
        text = prose(rng.choice([3, 8, 40, 120]))
        good.append(text)
        body.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<div><p><b>{text}</b></p></div>", f"<blockquote>{text}</blockquote>"]))
    inner = "".join(body)
    if article:
        inner = f"<article>{inner}</article>"
    around = f"<nav><ul>{links}</ul></nav><div class='cookie-notice'>{prose(30)}</div>"
    after = f"<aside>{prose(60)}</aside><section class=comments><p>{prose(80)}</p></section><form>{prose(9)}<input></form><footer>{prose(25)}</footer>"
    if not tagged:  # without any mark, only links and stop words tell
        around, after = f"<ul>{links}</ul>", f"<ul>{links}</ul><script>var x = '<p>{prose(9)}</p>'</script>"
    return f"<html><head><title>x</title></head><body>{around}{inner}{after}</body></html>", good


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize("tagged", [True, False])
def test_labelled_pages(article, tagged):
    rng = random.Random(6)
    first = collections.Counter()
    for _ in range(60):
        page, good = labelled_page(rng, article, tagged)
        assert html_text.main_text(page) == "\n\n".join(good)
        found = html_text.blocks(page)
        html_text.first_pass(found)
        first.update(b.first for b in found)
    assert first["good"] > 20 and first["prose"] + first["odd"] > 20  # both passes decide
    assert first["bad"] > 20 or tagged


def test_passes_decide_blocks_by_their_words():
    prose = "the cat and the dog of a man is in it " * 8
    odd = "lorem ipsum dolor amet consectetur " * 4
    link = "<p><a href=x>one two three</a> four</p>"
    text = lambda *parts: html_text.main_text("".join(parts)).split("\n\n")
    assert text(f"<p>{prose}</p><p>{odd}</p><p>{prose}</p>")[1] == odd.strip()
    assert odd.strip() not in text(link, f"<p>{odd}</p>", link, f"<p>{prose}</p>")
    assert text(f"<p>{odd}</p>") == [odd.strip()] and text("plain words without any tag " * 12)[0].startswith("plain")
    assert text("<p>a<b>b</b>c</p>") == ["abc"] and text("<body><p>Das ist gut.</p><p>Mehr nicht</p>") == ["Das ist gut.", "Mehr nicht"]
    assert text(f"<div><h2>Links</h2>{link}{link}{link}<p>{prose}</p><h2>Part</h2><p>{prose}</p></div>") == [prose.strip(), "Part", prose.strip()]
    assert text("<p class='ad'>Buy it now.</p><p>Stays here.</p><p title='class ad'>Stays too.</p>") == ["Stays here.", "Stays too."]
    assert text("a &lt; b <3 and x<y, 1 &amp; 2") == ["a < b <3 and x<y, 1 & 2"]


@pytest.mark.parametrize("part", ['<a "x', "<div>", '<a">"', "<svg>", "<!-- ", "</div ", "<p>&amp;a", "<p a='\"'>", "<", "<p class='x"])
def test_long_broken_pages_take_time_in_proportion(part):
    import time

    def seconds(n):
        page, begin = part * n + "end", time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(80_000) < 20 * seconds(8_000) + 1


def test_extract_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<article><p>a</p></article>", "y")], "page_id long, url string, html string, text string")
    out = sorted((r["text"], r["n_chars"]) for r in html_text.extract(rows).collect())
    assert out == [("", 0), ("a", 1)]
    assert html_text.extract(rows.where("false")).collect() == []


def test_media_round_trip(spark, tmp_path):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "long " * 40_000, "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit(1))
    folder = f"file://{tmp_path}/media"
    out = {r["doc_id"]: r for r in media.media_columns(rows, folder=folder).collect()}
    import hashlib

    for i, t in enumerate(texts):
        payload = media.pad((t or "").encode())
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["width"] * r["height"] == len(payload) and r["bits"] == 8
    assert [out[0][c] for c in ("media_sha256", "offset")] == [out[1][c] for c in ("media_sha256", "offset")] and out[2]["offset"] == out[7]["offset"]
    for path in (tmp_path / "media").iterdir():
        with tarfile.open(path) as tar:
            for member in tar:
                data = tar.extractfile(member).read()
                assert hashlib.sha256(media.from_png(data)).hexdigest() == member.name.removesuffix(".png")
    assert media.media_columns(rows.where("false"), folder=folder).collect() == []
    with pytest.raises(ValueError):
        media.png_header(b"no image")


def test_media_columns_against_direct_values(spark, tmp_path):
    import hashlib

    texts = [None, "", "abc", "abc", "é" * 500, " ".join(map(str, range(3000))), "abc"]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "abc", 1, "x")], "doc_id long, text string, digest int, feature string").repartition(4)
    out = media.media_columns(rows, folder=f"file://{tmp_path}/m").collect()
    assert len(out) == len(texts) + 1
    for r in out:
        payload = media.pad(("abc" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode())
        stored = media.to_png(payload)
        assert (r["length"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        counts = collections.Counter(payload)
        mean = sum(payload) / len(payload)
        top = sorted(counts, key=lambda b: (-counts[b], b))[:4]
        entropy = -sum(c / len(payload) * np.log2(c / len(payload)) for c in counts.values())
        assert r["feature"] == f"mean={mean:.4f};std={np.std(list(payload)):.4f};entropy={entropy:.4f};top={'/'.join(map(str, top))}"


def license_labels(text):
    """Labels and score by trying every rule at every place, then dropping places within others."""
    w = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    joined = " " + " ".join(w) + " "
    hits = []
    for r in licenses.rules():
        for m in regex.finditer(f"(?i)(?<= )(?:{r.pattern})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            hits.append((start, -(start + m[0].count(" ") + 1), -r.priority, r.label, r.confidence))
    kept = []
    for h in sorted(set(hits)):
        if not any(k[1] <= h[1] for k in kept):
            kept.append(h)
    base = {label for label, _, phrase in licenses.BASE if f" {phrase} " in re.sub("[A-Z]", lambda m: m[0].lower(), joined)}
    return ",".join(sorted({k[3] for k in kept} | base)), max((k[4] for k in kept), default=0.0)


def test_license_labels_against_every_rule_at_every_place(spark):
    rng = random.Random(4)
    rules = licenses.rules()
    texts = [None, "", "nothing here", "mit license " * 3000, "GPL-2.0-or-later or MIT license"]
    for _ in range(120):
        parts = [rng.choice([shortest(rng.choice(rules).pattern), "some words", "MIT License", "version 2.0", "the", "or later"]) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (out[i]["labels"], out[i]["score"]) == license_labels(t), t


def test_scores_are_the_machine_s_formula(spark):
    rows = toxic_corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    at = {int(b): i for i, b in enumerate(model.buckets)}
    from quillon.llm.words import term_hashes

    for i, text, _ in rows[:60]:
        own = sorted({at[int(h) >> (64 - toxicity.BUCKET_BITS)] for h in term_hashes(text.encode()) if (int(h) >> (64 - toxicity.BUCKET_BITS)) in at})
        total = model.w0 + sum(model.w[a] for a in own) + sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(own) for b in own[k + 1 :])
        assert out[i]["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9) and out[i]["predicted"] == int(total >= 0)


def test_repeated_ids_stay_within_the_training_bound(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most=20)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())


def test_balanced_pairs_are_learned(spark):
    """Neither word alone tells anything; both or none together do."""
    rng = random.Random(2)
    noise = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(20))
    rows = [(i, noise() + ("" if a else " alpha") + ("" if b else " bravo"), int(a != b)) for i, (a, b) in enumerate((i // 2 % 2, i % 2) for i in range(1600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, docs.select("doc_id", "toxic"))).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.9


def toxic_corpus(n=900, seed=1):
    rng = random.Random(seed)
    noise = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40))
    rows = []
    for i in range(n):
        kind = i % 4  # only insult and group together are toxic
        rows.append((i, noise() + {0: "", 1: " insult", 2: " group", 3: " insult group"}[kind], int(kind == 3)))
    return rows


def test_pairs_beyond_linear_weights(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("clash"))
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in out])
    assert len(out) > 100 and right > 0.95
    assert {r["held"] for r in out} == {True} and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out)


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(docs.where("false"), none).collect() == []


def test_mix_reaches_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(5000 + i, "same " * 10, "a") for i in range(1500)]
    docs = spark.createDataFrame(rows, EMPTY).withColumn("size", F.lit("clash"))
    out = mixing.mix(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = ["a", "b", "c", "d", None]
    weights, total, want, left = dict(zip(order, (3, 1, 2, 3, 1), strict=True)), 1.5 * sum(size.values()), {}, set(order)
    while True:
        rest, w = total - sum(want.values()), sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / w > 2 * size[s]]
        if not over:
            want |= {s: rest * weights[s] / w for s in left}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= set(over)
    for s in order:
        assert target[s] == pytest.approx(want[s], abs=1e-3) and abs(taken[s] - target[s]) <= 0.01 * target[s] + 80
    assert mixing.mix(docs.where("false")).collect() == []


def test_emit_repeats_rows(spark):
    rows = [(i % 40, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(120)] + [(None, "n n", "a")] * 3
    docs = spark.createDataFrame(rows, EMPTY)
    copies = sum(r["copies"] for r in mixing.mix(docs).collect())
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == copies


def test_short_names_whose_words_stand_apart(spark):
    texts = ["CC_BY_SA_4.0", "CC/BY 4.0", "CC  BY", "cc\nby-nc", "CC -- BY-ND 3.0", "acc by-law"]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i]["labels"] for i in range(6)] == ["cc-by-sa-4.0", "cc-by-4.0", "cc-by", "cc-by-nc", "cc-by-nd-3.0", ""]


def test_rules_find_their_text_whatever_parts_the_words(spark):
    rules = licenses.rules()
    rows = spark.createDataFrame([(i, re.sub(" ", "_\n/", shortest(r.pattern))) for i, r in enumerate(rules)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert [r for i, r in enumerate(rules) if not out[i]["detections"]] == []
