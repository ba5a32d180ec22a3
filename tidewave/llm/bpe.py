"""Byte-pair encoding and decoding with a merge-rank priority queue over a doubly linked symbol list."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm._common import lean, table, text_or_empty, worker_cache
from tidewave.llm.chunks import encode_parts, encode_slice, text_slices


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]

#: Longer pre-tokens are encoded each time they come.
REMEMBERED = 256


class BytePairCodec:
    """A byte-level vocabulary file (JSON with vocab, merges and added tokens) as encoder and decoder."""

    def __init__(self, path: str, cap: int = 150_000):
        import pyarrow as pa
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_id = [vocab[c] for c in letters]
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        self.left, self.right = [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        self.rank = {pair: r for r, pair in reversed([*enumerate(zip(self.left, self.right, strict=True))])}
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: b"".join(byte_of[c] for c in token) for token, i in vocab.items()} | {i: content.encode() for content, i in self.special.items()}
        self.strings = pa.array([strings.get(i, b"") for i in range(max(strings) + 1)], pa.binary())
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.whole = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pretoken = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.cap, self.young, self.old = cap, {}, {}

    def encode_word(self, word: str) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no adjacent pair has a rank.

        Symbols stand in an array with links to both neighbours. A queue entry is a rank and the place of its left symbol;
        when it comes up and the symbols there are no longer the pair of that rank, it is stale and skipped.
        """
        ids = list(map(self.byte_id.__getitem__, word.encode("utf-8")))
        n = len(ids)
        rank = self.rank.get
        queue = [r << 32 | i for i, r in enumerate(map(rank, zip(ids, ids[1:], strict=False))) if r is not None]
        if not queue:
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        left, right, made = self.left, self.right, self.made
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            entry = pop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] != left[r] or j < 0 or ids[j] != right[r]:
                continue
            new = ids[i] = made[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank((new, ids[k]))) is not None:
                    push(queue, x << 32 | i)
            h = before[i]
            if h >= 0 and (x := rank((ids[h], new))) is not None:
                push(queue, x << 32 | h)
        return [x for x in ids if x >= 0]

    def _known(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens, remembered for about `cap` of those last asked for, but for long ones: what is kept has a bound in bytes."""
        got = list(map(self.young.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    word = words[i]
                    if (x := self.old.get(word)) is None:
                        x = self.encode_word(word)
                    got[i] = x
                    if len(word) <= REMEMBERED:
                        self.young[word] = x
            if 2 * len(self.young) > self.cap:
                self.young, self.old = {}, self.young
        return got

    def _ragged(self, rows: list[list[int]]):
        import numpy as np

        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return size, np.fromiter(chain.from_iterable(rows), "<u4", int(size.sum()))

    def _segment(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        return [*chain.from_iterable(self._known(self.pretoken.findall(text)))]

    def _whole(self, text: str) -> bytes:
        """Ids of a text with special strings, which become their single ids."""
        import numpy as np

        ids = [[self.special[p]] if p in self.special else self._segment(p) for p in self.split_special.split(text) if p]
        return np.array([x for row in ids for x in row], "<u4").tobytes()

    def encode_keys(self, keys):
        """Ragged ids of the chunks named by distinct keys (Arrow strings); see `chunks`."""
        import numpy as np

        apart = lambda texts: self._ragged([self._segment(t) for t in texts])
        plain = lambda words: self._ragged(self._known(words.to_pylist()))
        spaced = lambda words: self._ragged(self._known(list(map(" ".__add__, words.to_pylist()))))
        return encode_parts(keys, np.array(self._segment("\n"), "<u4"), spaced, plain, lambda tails: apart(tails.to_pylist()), apart)

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow string array without nulls, little-endian unsigned 32-bit."""
        return encode_slice(texts, self.encode_keys, self.whole, self._whole)

    def decode(self, ids: bytes) -> str:
        """Concatenate the vocabulary strings of the ids; bytes that are not UTF-8 become U+FFFD."""
        import numpy as np
        import pyarrow as pa

        strings = self.strings.take(pa.array(np.frombuffer(ids, "<u4")))
        ends = np.frombuffer(strings.buffers()[1], np.int32)[: len(strings) + 1]
        return bytes(memoryview(strings.buffers()[2] or b"")[: ends[-1]]).decode("utf-8", errors="replace") if len(strings) else ""


def codec(path: str) -> BytePairCodec:
    return worker_cache(("codec", path), lambda: BytePairCodec(path))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts: doc_id, n_tokens, ids (binary, little-endian 32 bits), decoded (text).

    A map over rows without a shuffle. Null texts count as empty (no ids, empty text); other columns are not read; ids of
    any kind, null or repeated, pass through.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    @lean
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tidewave.llm import bpe

        c = bpe.codec(tokenizer)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in text_slices(texts):
                packed = c.encode(texts.slice(a, b - a))
                for at in range(a, b, 1000):
                    part = packed[at - a : min(at + 1000, b) - a]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(part)), pa.array([len(p) // 4 for p in part], pa.int64()), pa.array(part, pa.binary()), pa.array([c.decode(p) for p in part], pa.string())],
                        ["doc_id", "n_tokens", "ids", "decoded"],
                    )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    import public_tokenizers

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {"op6_bpe_codec": op6_bpe_codec}
SQL: dict[str, str] = {}
