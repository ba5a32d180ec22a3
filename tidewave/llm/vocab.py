"""Encoding whole texts with the tokenizers library at corpus speed: each distinct chunk (see `chunks`) goes to the library
once, and the ids of a text are those of its chunks. Texts that hold one of the tokenizer's special strings go to the
library whole."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from tidewave.llm._common import worker_cache
from tidewave.llm.chunks import SPACE, encode_parts, encode_slice, gather, text_slices

_SIMPLE = re.compile(f" ?[^{SPACE}]+")

class ChunkEncoder:
    """Encodes Arrow arrays of texts to packed unsigned 16-bit ids. Nothing is remembered from slice to slice."""

    def __init__(self, path: str):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        # Ids that begin a word (a letter for the space) or end one (a suffix): where the ids of joined words part.
        self.begins, self.finishes = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i], self.finishes[i] = token.startswith("\u0120"), token.endswith("</w>")
        line = self._ids("\n")
        self.line = line[0] if len(line) == 1 else None  # a line feed is a token of its own

    def _ids(self, text: str):
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def _apart(self, texts: list[str]):
        """Ragged ids of texts, each encoded by itself."""
        import numpy as np

        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.array([x for row in ids for x in row], "<u2")

    def _spaced(self, words):
        """Ragged ids of words of letters (Arrow strings), each after a space: thousands as one text, parted at word begins or ends."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, "<u2")]
        for at in range(0, len(words), 2000):
            group = words.slice(at, 2000)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group), " ")[0].as_py()
            flat = self._ids(" " + text)
            begin = np.flatnonzero(self.begins[flat])
            if not len(begin):
                begin = np.append(0, np.flatnonzero(self.finishes[flat]) + 1)[:-1]
            size = np.diff(np.append(begin, len(flat)))
            if len(begin) != len(group):  # a word that normalises to several
                size, flat = self._apart([" " + w for w in group.to_pylist()])
            sizes.append(size)
            flats.append(flat)
        return np.concatenate(sizes), np.concatenate(flats)

    def _lines(self, chunks):
        """Ragged ids of chunks without line feeds and without white space at their ends or, but for a first space, within.

        Where a line feed is a token of its own they are encoded as lines of one text."""
        import numpy as np

        if self.line is None:
            return self._apart(chunks.to_pylist())
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, "<u2")]
        texts = chunks.to_pylist()
        for at in range(0, len(texts), 2000):
            group = texts[at : at + 2000]
            ids = self._ids("\n".join(group))
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) != len(group):
                size, flat = self._apart(group)
            else:
                size, flat = np.diff(np.append(-1, ends)) - 1, ids[ids != self.line]
            sizes.append(size)
            flats.append(flat)
        return np.concatenate(sizes), np.concatenate(flats)

    def encode_keys(self, keys):
        """Ragged ids of the chunks named by distinct keys (Arrow strings)."""
        return encode_parts(keys, self._ids("\n"), self._spaced, self._lines, self._lines, self._rest)

    def _rest(self, texts: list[str]):
        """Ragged ids of any chunks: those with no white space but a single first space as lines, the others by themselves."""
        import numpy as np
        import pyarrow as pa

        simple = np.array([bool(_SIMPLE.fullmatch(t)) for t in texts], bool)
        one = self._lines(pa.array([t for t, s in zip(texts, simple, strict=True) if s], pa.string()))
        two = self._apart([t for t, s in zip(texts, simple, strict=True) if not s])
        place = np.zeros(len(texts), np.int64)
        place[simple], place[~simple] = np.arange(len(one[0])), len(one[0]) + np.arange(len(two[0]))
        return gather(np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), place)

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow string array without nulls, little-endian unsigned 16-bit."""
        return encode_slice(texts, self.encode_keys, self.special, lambda t: self._ids(t).tobytes())

    def encode_all(self, texts) -> Iterator[tuple[int, int, list[bytes]]]:
        """The ids of a long array, some MB of texts at a time: begin and end of the slice, ids of its texts."""
        for a, b in text_slices(texts):
            yield a, b, self.encode(texts.slice(a, b - a))


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary; workers live through many tasks."""
    return worker_cache(("encoder", path), lambda: ChunkEncoder(path))
