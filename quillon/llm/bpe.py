"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts every text at places that depend on
the content alone, so that a passage that many documents share falls into the
same chunks in each of them. A chunk's inside is encoded once and kept in a
table. The join of two chunks is repaired by re-encoding: a window from some
words before the cut to some words after it goes through the tokenizer, and
its ids have to begin and end with those that the two chunks have for these
words. Where they don't, the window grows until they do, and the text is
encoded whole if it never happens.

The tables belong to the Python worker, which serves many tasks: nothing is
shuffled, and a lost executor costs only its own tasks. Both tables are
bounded; a full one is emptied, which costs time but changes no result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import splitmix

#: Mean distance of two cuts is 2 ** CUT_BITS bytes; a cut looks at CUT_WINDOW bytes.
CUT_BITS = 10
CUT_WINDOW = 16
MAX_PIECES = 400_000
MAX_CHUNKS = 40_000

#: The normalizer and pre-tokenizer whose words may be encoded apart (fixed values of the vocabulary file); others are encoded whole.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_BLANK = b" \t\n\r"
#: ASCII signs at a word's end after a letter: the pre-tokenizer splits there in any case.
_TAIL = re.compile(rb"(?<=[A-Za-z])[!-&(-/:;=?@\[-`{-~]+(?=[ \n\t\r]|$)")
_GEAR = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(7_001)).astype(np.uint32)


def cut_points(data: np.ndarray, bits: int = CUT_BITS, window: int = CUT_WINDOW) -> np.ndarray:
    """Offsets in data (uint8) after which a chunk ends: a gear hash over the last window bytes."""
    if len(data) <= window:
        return np.empty(0, dtype=np.int64)
    value = _GEAR[data]
    span, total = 1, value
    while span < window:  # doubling: the hash of 2n bytes from two of n bytes
        longer = total.copy()
        longer[span:] += total[:-span] << np.uint32(span % 31)
        span, total = span * 2, longer
    hit = np.flatnonzero((total >> np.uint32(32 - bits)) == 0) + 1
    return hit[(hit > window) & (hit < len(data))]


class ChunkCodec:
    """Encodes whole texts and renders ids and tokens, with the two tables."""

    def __init__(self, vocabulary: str, max_pieces: int = MAX_PIECES, max_chunks: int = MAX_CHUNKS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        steps = json.loads(self.tokenizer.to_str())
        wordwise = self.tokenizer.decoder is None and all(steps[k] == v for k, v in _WORDWISE.items())
        self.joint = " " if wordwise else None
        self.max_pieces, self.max_chunks = max_pieces, max_chunks
        self.pieces: dict[bytes, tuple[int, str, str]] = {}
        self.chunks: dict[bytes, tuple[int, str, str]] = {}
        self.encoded_chunks = self.reused_chunks = self.repaired = self.widened = self.whole = 0

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for word, e in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                ids = e.ids
                self.pieces[word] = (len(ids), " ".join(map(str, ids)), " ".join(e.tokens))

    def _render(self, words: list[bytes]) -> tuple[int, str, str]:
        found = [p for p in map(self.pieces.__getitem__, words) if p[0]]
        return sum(p[0] for p in found), " ".join([p[1] for p in found]), " ".join([p[2] for p in found])

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """Parts whose encodings, one after the other, are the text's: fewer different ones than its words."""
        if b"<|" not in text:  # special tokens are matched before letters are folded
            text = _TAIL.sub(rb" \g<0>", text)
            # Letters are composed before they are folded: a capital may not compose where its small letter does.
            return text.lower().split() if text.isascii() else [w.lower() if w.isascii() else w for w in text.split()]
        return text.split()

    def split(self, text: bytes) -> tuple[list[bytes], list[bytes]]:
        """Chunk insides and the pieces across the cuts, one fewer than the insides.

        An inside begins and ends at white space (or the text's ends). A cut
        without white space on either side widens over the next chunk.
        """
        insides, joints, begin = [], [], 0
        for cut in cut_points(np.frombuffer(text, dtype=np.uint8)).tolist():
            if cut <= begin:
                continue
            left = max(begin, max(text.rfind(b, begin, cut) for b in _BLANK_BYTES) + 1)
            right = min((p for p in (text.find(b, cut) for b in _BLANK_BYTES) if p >= 0), default=len(text))
            insides.append(text[begin:left])
            joints.append(text[left:right])
            begin = right
        insides.append(text[begin:])
        return insides, joints

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of tokens, ids in decimal and the decoded text."""
        if self.joint is None:  # tokens may depend on more than a word: no parts to join
            yield from map(self._whole, texts)
            return
        plans, missing, insides_new = [], {}, {}
        if len(self.chunks) > self.max_chunks:
            self.chunks.clear()
        for text in texts:
            insides, joints = self.split(text)
            plans.append((insides, joints))
            for inside in insides:
                if inside in self.chunks or inside in insides_new:
                    self.reused_chunks += 1
                else:
                    insides_new[inside] = words = self.words(inside)
                    missing.update(dict.fromkeys(words))
        self._know(missing)
        self.encoded_chunks += len(insides_new)
        for inside, words in insides_new.items():
            self.chunks[inside] = self._render(words)
        repaired = self._repair(plans)
        for at, (text, (insides, joints)) in enumerate(zip(texts, plans, strict=True)):
            parts = [self.chunks[insides[0]]]
            for i, inside in enumerate(insides[1:]):
                parts.append(repaired[at, i])
                parts.append(self.chunks[inside])
            if None in parts:
                self.whole += 1
                yield self._whole(text)
                continue
            parts = [p for p in parts if p[0]]
            yield sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def _whole(self, text: bytes) -> tuple[int, str, str]:
        e = self.tokenizer.encode(text.decode(), add_special_tokens=False)
        return len(e.ids), " ".join(map(str, e.ids)), self.tokenizer.decode(e.ids, skip_special_tokens=False)

    def _know(self, words: dict[bytes, None]) -> None:
        new = [w for w in words if w not in self.pieces]
        if len(self.pieces) + len(new) > self.max_pieces:
            self.pieces.clear()
            new = list(words)
        if new:
            self._learn(new)

    def _repair(self, plans: list[tuple[list[bytes], list[bytes]]]) -> dict[tuple[int, int], tuple[int, str, str] | None]:
        """By text and join: what stands between the two chunks' own tokens; None where no window agrees."""
        out: dict[tuple[int, int], tuple[int, str, str] | None] = {}
        open_, k = [(at, i) for at, (_, joints) in enumerate(plans) for i in range(len(joints))], 1
        while open_:
            windows, sides, words = [], [], {}
            for at, i in open_:
                before, joint, after = plans[at][0][i], plans[at][1][i], plans[at][0][i + 1]
                rest = before.rsplit(None, k)
                tail = before[len(rest[0]) :] if len(rest) > k else before
                rest = after.split(None, k)
                head = after[: len(after) - len(rest[-1])] if len(rest) > k else after
                windows.append((tail + joint + head).decode())
                sides.append((self.words(tail), self.words(head), tail == before and head == after))
                words.update(dict.fromkeys([*sides[-1][0], *sides[-1][1]]))
            self._know(words)
            again = []
            for place, e, (tail, head, all_) in zip(open_, self.tokenizer.encode_batch(windows, add_special_tokens=False), sides, strict=True):
                self.repaired += 1
                (n_tail, tail_ids, _), (n_head, head_ids, _) = self._render(tail), self._render(head)
                ids, end = e.ids, len(e.ids) - n_head
                if n_tail <= end and " ".join(map(str, ids[:n_tail])) == tail_ids and " ".join(map(str, ids[end:])) == head_ids:
                    out[place] = (end - n_tail, " ".join(map(str, ids[n_tail:end])), " ".join(e.tokens[n_tail:end]))
                elif all_:
                    out[place] = None
                else:
                    self.widened += 1
                    again.append(place)
            open_, k = again, 4 * k
        return out


_BLANK_BYTES = [bytes([b]) for b in _BLANK]
_CODECS: dict[tuple[str, int, int], ChunkCodec] = {}


def codec(vocabulary: str, max_pieces: int = MAX_PIECES, max_chunks: int = MAX_CHUNKS) -> ChunkCodec:
    """The worker's own codec; it outlives a task."""
    key = (vocabulary, max_pieces, max_chunks)
    if key not in _CODECS:
        _CODECS[key] = ChunkCodec(*key)
    return _CODECS[key]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts as bytes (null: empty), in runs of bounded size; with each run its first row."""
    texts = batch.column(column).cast(pa.binary())
    first, run, held = 0, [], 0
    for i, value in enumerate(texts):
        value = value.as_py() or b""
        if run and held + len(value) > most_bytes:
            yield first, run
            first, run, held = i, [], 0
        run.append(value)
        held += len(value)
    if run:
        yield first, run


def encode(docs: DataFrame, vocabulary: str, text: str = "text", with_ids: bool = True, with_decoded: bool = True, max_pieces: int = MAX_PIECES, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Every row of docs (same columns) with n_tokens, ids (array<int>) and decoded.

    Texts of any length are encoded whole; a run of texts is held at a time.
    Null text counts as empty: 0 tokens, no ids, empty decoded text. Rows are
    independent, so repeated rows and ties give equal values, and an empty
    table gives an empty one. Columns of docs named like the results are
    replaced. with_ids=False gives ids_sha256 and decoded_sha256 instead
    of the sequences, without holding them as rows; with_decoded=False leaves
    out the decoded text. max_pieces and max_chunks bound a worker's tables (7 kB
    a chunk, .3 kB a piece); they change time and memory, never results.
    """
    drop = [c for c in docs.columns if c.lower() in {"n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"}]
    docs = docs.drop(*drop)
    results = {"n_tokens": ("long", pa.int64())}
    results |= {"ids": ("array<int>", pa.list_(pa.int32()))} if with_ids else {"ids_sha256": ("string", pa.string())}
    if with_decoded:
        results["decoded" if with_ids else "decoded_sha256"] = ("string", pa.string())
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *[f"{k} {t}" for k, (t, _) in results.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(vocabulary, max_pieces, max_chunks)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for first, run in slices(batch, text):
                rows = []
                for n, ids, decoded in use.encode(run):
                    rows.append((n, np.array(ids.split(), dtype=np.int32) if with_ids else digest(ids), decoded if with_ids else digest(decoded)))
                part = batch.slice(first, len(run))
                made = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(results.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *results])

    return docs.mapInArrow(work, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; null ids give an empty text."""
    encoded = encoded.drop(into)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        use = codec(vocabulary).tokenizer
        return pd.Series([use.decode([int(x) for x in v], skip_special_tokens=False) if v is not None else "" for v in column], dtype=object)

    return encoded.withColumn(into, text_of(F.col(ids)))
