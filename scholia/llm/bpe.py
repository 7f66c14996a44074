"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes cuts each text where its content says so, so copies and shared passages are cut alike wherever they
stand. A chunk that was met before is not encoded again. Its tokens hold only between two *seams* inside it: places where a
blank follows a printable character, at which every pre-tokenizer run ends whatever stands before or after. The bytes between the
last seam of one chunk and the first seam of the next are encoded anew, and widened by whole chunks until both sides agree exactly.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import keyed_texts, slices

CUT_BITS = 10  # chunks of 1024 bytes on average
ROLLING = 16
MEMO_BYTES = 16 << 20  # of each of two generations, in every Python worker
SEAM = re.compile(rb"(?<=[!-~])[ \n]")
# Bytes beyond ASCII text and U+00C0 to U+017F, and what may begin a special token.
UNUSUAL = re.compile(rb"[^\t\n -~\x80-\xbf\xc3-\xc5]|<\|")
# Fixed value: how byte-level BPE splits a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Byte strings by byte string, in two generations, so that what is used stays and the memory is bounded."""

    def __init__(self, most: int):
        self.most, self.size, self.new, self.old = most, 0, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.new[key] = value
        self.size += len(key) + len(value) + 200
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0


def cuts(raw: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Where chunks begin: the hash of the `ROLLING` bytes before has `bits` zeros, and a character begins."""
    if len(raw) <= ROLLING:
        return np.zeros(0, np.int64)
    h = raw.astype(np.uint32)
    h = (h + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    step = 1
    while step < ROLLING:  # h[i] covers bytes i-2*step+1 .. i
        h[step:] += h[:-step] * np.uint32(pow(0x01000193, step, 1 << 32))
        step *= 2
    at = np.flatnonzero(h[ROLLING - 1:-1] * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits) == 0) + ROLLING
    return at[(raw[at] & 0xC0) != 0x80]


class Encoder:
    """Encodes as the library does with the vocabulary file at `path`.

    Spans of ordinary characters, whose classes are alike in all versions of Unicode, go through the faster of two byte-pair
    implementations, with the ranks of the same file; spans with any other character or the mark of a special token go through
    the library itself.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pieces = pieces_of(path)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # The content of an added token must stay in one piece; without blanks in it, no seam is inside.
        assert not any(SEAM.search(t) or b"<|" not in t for t in added.values()), "an added token of another form"
        ranks = {p: i for i, p in enumerate(pieces) if i not in added}
        self.plain = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.pieces = pieces
        self.width = np.array([len(p) for p in pieces], dtype=np.int64)
        self.chunks = Memo(memo_bytes)

    def _spans(self, spans: list[bytes]) -> list[bytes]:
        """Ids of spans that begin and end at seams or ends of a text."""
        out, odd, plain = [], [], self.plain.encode_ordinary
        for i, span in enumerate(spans):
            if UNUSUAL.search(span):
                odd.append(i)
                out.append(b"")
            else:
                out.append(array("I", plain(span.decode())).tobytes() if span else b"")
        if odd:
            got = self.tokenizer.encode_batch_fast([spans[i].decode() for i in odd], add_special_tokens=False)
            for i, e in zip(odd, got):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _cores(self, chunks: list[bytes]) -> dict[bytes, tuple[int, int, bytes]]:
        """For each chunk its first and last seam and the ids between; first -1: no two places to join at."""
        out, fresh = {}, []
        for c in chunks:
            if c in out:
                continue
            if (found := self.chunks.get(c)) is not None:
                out[c] = (int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:16], "little"), found[16:])
                continue
            first = SEAM.search(c)
            last = -1
            if first:
                last = max(c.rfind(b" "), c.rfind(b"\n"))
                while not 33 <= c[last - 1] <= 126:
                    last = max(c.rfind(b" ", 0, last), c.rfind(b"\n", 0, last))
            out[c] = (first.start() if first else -1, last, b"")
            fresh.append(c)
        spans = [c[out[c][0]:out[c][1]] if out[c][0] >= 0 else b"" for c in fresh]
        for c, ids in zip(fresh, self._spans(spans)):
            a, b, _ = out[c]
            out[c] = (a, b, ids)
            self.chunks.put(c, a.to_bytes(8, "little", signed=True) + max(b, 0).to_bytes(8, "little") + ids)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole UTF-8 texts as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            at = [0, *cuts(np.frombuffer(t, np.uint8)).tolist(), len(t)]
            cut.append([t[a:b] for a, b in zip(at, at[1:])])
        cores = self._cores([c for parts in cut for c in parts])
        plans, strips = [], []
        for parts in cut:
            plan, strip = [], b""
            for c in parts:
                first, last, ids = cores[c]
                if first < 0:  # nothing inside to agree on: the strip grows by the whole chunk
                    strip += c
                    continue
                strips.append(strip + c[:first])
                plan += [len(strips) - 1, ids]
                strip = c[last:]
            strips.append(strip)
            plans.append([*plan, len(strips) - 1])
        joined = self._spans(strips)
        out = []
        for text, plan in zip(texts, plans):
            ids = b"".join([joined[x] if isinstance(x, int) else x for x in plan])
            # Both sides of every join agree when the tokens cover exactly the bytes of the text.
            if int(self.width[np.frombuffer(ids, "<u4")].sum()) != len(text):
                ids = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            out.append(ids)
        return out


# A Python worker runs many tasks; it loads the vocabulary for the first one and meets the same chunks again in the next.
@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(path: str) -> list[bytes]:
    """Bytes of each id: printable bytes stand for themselves in the vocabulary, the others follow from U+0100 on."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[ch] for ch in token) if all(ch in byte for ch in token) else token.encode()
    return out


def text_of(ids: bytes, pieces: list[bytes]) -> str:
    return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _encoded(part: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
    ids = encoder.encode(part.column("text").cast(pa.binary()).to_pylist())
    return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def _with_text(part: pa.RecordBatch, pieces: list[bytes]) -> pa.RecordBatch:
    texts = [text_of(ids, pieces) for ids in part.column("ids").to_pylist()]
    return pa.RecordBatch.from_arrays([*part.select(["doc_id", "ids"]).columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `ids` (binary: little-endian unsigned 32-bit) of every whole text. Null and empty texts have no ids; equal rows stay
    equal; other columns are ignored. `path` names a vocabulary file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _encoded(part, encoder_of(path))

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `ids` and the decoded `text`; bytes that are no UTF-8 become U+FFFD, as the library does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for part in slices(batches, "ids"):
            yield _with_text(part, pieces)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `decode` gives for the result of `encode`, in one Python worker a task, where the two in a row take two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _with_text(_encoded(part, encoder_of(path)), encoder_of(path).pieces)

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `n_tokens` and SHA-256 of ids and of the decoded text."""
    return encode_and_decode(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
