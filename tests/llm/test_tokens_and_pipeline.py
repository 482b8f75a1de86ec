import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import bpe
from quillon.llm.queries import WORD_VOCABULARY

PLAIN = Tokenizer.from_file(WORD_VOCABULARY)
CODEC = bpe.ChunkCodec(WORD_VOCABULARY, max_pieces=300, max_chunks=20)


def plain(text):
    ids = PLAIN.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), PLAIN.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB é́'stre $*.,\n\t\r\x0b\x1c\x85 İΣ日1<|>endoftext", max_size=400))
def test_any_text_encodes_as_whole(text):
    assert list(CODEC.encode([text.encode()])) == [plain(text)]


def test_long_and_shared_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(1, 9)))
    shared = " ".join(word() for _ in range(900))
    texts = [" ".join(word() for _ in range(50)) + " " + shared + "<|endoftext|>" + word() for _ in range(20)] + ["x" * 30_000, ""]
    reuse = bpe.ChunkCodec(WORD_VOCABULARY)
    assert list(reuse.encode([t.encode() for t in texts])) == [plain(t) for t in texts]
    assert reuse.reused_chunks > reuse.encoded_chunks and reuse.repaired > 0


def test_cuts_depend_on_content():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate((rng.integers(97, 123, 777).astype(np.uint8), body))
    a, b = bpe.cut_points(body, 8), bpe.cut_points(moved, 8) - 777
    assert set(a[a > 64]) == set(b[b > 64]) and 30 < len(a) < 200


def test_encode_decode_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")], "doc_id long, text string")
    out = bpe.encode(rows, WORD_VOCABULARY)
    back = bpe.decode(out.drop("decoded"), WORD_VOCABULARY).collect()
    for r in back:
        assert (r["n_tokens"], " ".join(map(str, r["ids"])), r["decoded"]) == plain(r["text"] or "")
    assert bpe.encode(rows.where("false"), WORD_VOCABULARY).collect() == []


def test_vocabulary_with_a_decoder():
    codec = bpe.ChunkCodec(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = t.encode("Hello  world\n", add_special_tokens=False).ids
    assert next(codec.encode([b"Hello  world\n"])) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        bad = i % 10 == 3
        text = " ".join(word() for _ in range(rng.randint(30, 90))) + (" insult insult" if bad else "") + (f"\n{passage}" if i % 15 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(400 + i, rows[i][1] + " tail", "en", "s0", 0) for i in (0, 1, 2)] + [(500, None, "en", None, 0), (501, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {r[0]: r[1] or "" for r in rows}


def test_pipeline_step_by_step(spark, tables, tmp_path):
    folder, given = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
        if name != "bpe":
            assert docs.columns == columns
    clean, unique, cut, mixed, ids = seen
    toxic = {i for i, t in given.items() if "insult" in t}
    held = {i for i in given if zlib.crc32(str(i).encode()) % 5 == 0}
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept & (toxic - held) == set() and set(given) - toxic <= kept and len(kept & toxic) <= 1
    assert {r["doc_id"] for r in unique.collect()} == kept - {400, 401, 402}
    texts = {r["doc_id"]: r for r in cut.collect()}
    assert set(texts) == {r["doc_id"] for r in unique.collect()}
    changed = {i for i, r in texts.items() if (r["text"] or "") != given[i]}
    assert changed == {i for i in texts if i % 15 == 0 and 0 < i < 300} and all(r["n_chars"] == len(r["text"] or "") for r in texts.values())
    n = {i: sum(r["doc_id"] == i for r in mixed.collect()) for i in texts}
    assert max(n.values()) <= 2 and mixed.count() > len(texts)
    for r in ids.collect():
        assert r["ids"] == PLAIN.encode(texts[r["doc_id"]]["text"] or "", add_special_tokens=False).ids and len(r["ids"]) == r["n_tokens"]


def test_run_equals_steps(spark, tables):
    folder, _ = tables
    a, b = (sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b


@pytest.mark.parametrize("letters", ["H̱", "T̈", "J̌", "W̊", "Y̊", "H̱.", "aH̱b T̈ END", "ÜBER J̌, Kelvin K"])
def test_decomposed_capitals_encode_as_whole(letters):
    text = f"A {letters} b"
    assert list(CODEC.encode([text.encode()])) == [plain(text)]


def test_joins_are_encoded_until_they_agree():
    """A chunk whose ids are not those of its words in the text can't be joined: the window grows, then the text is encoded whole."""
    codec = bpe.ChunkCodec(WORD_VOCABULARY)
    plan = ([b"one two three four five ", b" six seven eight nine ten"], [b"join ed"])
    own = codec._repair([plan])[0, 0]
    assert own[1] == plain("join ed")[1] and (codec.repaired, codec.widened) == (1, 0)
    codec.pieces[b"five"] = (1, "5", "x")
    assert codec._repair([plan])[0, 0] is None and codec.widened > 0
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(3000)).encode()
    insides, joints = codec.split(text)
    assert len(joints) > 3 and b"".join(x for p in zip(insides, [*joints, b""], strict=True) for x in p) == text
    codec.pieces[insides[1].split()[-1]] = (1, "5", "x")
    assert list(codec.encode([text])) == [plain(text.decode())] and codec.whole == 1


def test_stages_on_odd_tables(spark, tables, tmp_path):
    """Empty tables, null texts, ids and sources, repeated rows, and columns named like the operators' results."""
    folder, _ = tables
    full = spark.read.parquet(f"{folder}/documents.parquet")
    extra = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("score", "predicted", "N_words", "n_removed", "kept", "rep", "size", "copies", "__block")}
    odd = full.where("doc_id IN (0, 15, 400, 500, 501)").unionByName(full.where("doc_id = 7")).unionByName(full.where("doc_id = 7"))
    odd = odd.unionByName(full.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(full.where("doc_id = 11").withColumn("text", F.concat("text", F.expr("repeat(' long tail', 30000)"))))
    docs = odd.withColumns(extra)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for label, given in (("odd", docs), ("empty", docs.where("false"))):
            out = stage(spark, given, folder)
            out.write.parquet(f"{tmp_path}/{label}{n}")
            if label == "empty":
                assert spark.read.parquet(f"{tmp_path}/{label}{n}").count() == 0
        docs = spark.read.parquet(f"{tmp_path}/odd{n}")
        if name != "bpe":
            assert docs.columns == [*full.columns, *extra]
            for r in docs.collect():
                assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in extra)
    assert docs.count() > 0 and {r["n_tokens"] for r in docs.where("doc_id IN (500, 501)").collect()} <= {0}
    bare = str(tmp_path / "bare")
    full.where("false").write.parquet(f"{bare}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{bare}/labels.parquet")
    assert corpus_pipeline.run(spark, bare).collect() == []


def test_other_vocabularies_are_encoded_whole(tmp_path):
    """A vocabulary that keeps letter case gets the library's ids too."""
    steps = json.loads(Tokenizer.from_file(WORD_VOCABULARY).to_str())
    steps["normalizer"] = {"type": "NFC"}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(steps))
    text = "Upper CASE Words, e.g. U.S. and more  spaces\n" * 300
    library = Tokenizer.from_file(str(path))
    e = library.encode(text, add_special_tokens=False)
    (n, ids, decoded), = bpe.ChunkCodec(str(path)).encode([text.encode()])
    assert (n, ids, decoded) == (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))
