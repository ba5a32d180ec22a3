"""Texts as lists of chunks that tokenize apart, found and made distinct by Arrow.

Both vocabularies' patterns never match over a change from non-space to space, and what they match after one depends on
what follows only. So a text may be cut before every run of white space, and nowhere inside a run: a run of mixed white
space and the word after it are one chunk. Each distinct chunk is encoded once, and the ids of a text are those of its
chunks in order.

A chunk is named by a key: what follows a single space; a chunk that starts with a single line feed as it is; any other
one after the mark U+0001.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: White space of the Unicode standard, which the vocabularies' patterns mean by \s.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
MARK = "\x01"
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Texts with white space other than single spaces and line feeds between words, or with the mark.
_UNEVEN = f"[ \n][ \n]|[ \n]\\z|^[ \n]|[{SPACE.replace(' ', '').replace(chr(10), '')}{MARK}]"
_SLICE_BYTES = 12 << 20


def text_slices(texts, most: int = _SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of an Arrow string array that hold about `most` bytes (at least one text each)."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def chunk_text(key: str) -> str:
    """The chunk that a key names."""
    first = key[:1]
    return key[1:] if first == MARK else key if first == "\n" else " " + key


def chunk_key(chunk: str) -> str:
    """The key of a chunk."""
    second = chunk[1:2]
    if second and second not in SPACES and (chunk[0] == "\n" or (chunk[0] == " " and second != MARK)):
        return chunk if chunk[0] == "\n" else chunk[1:]
    return MARK + chunk


#: What is cut from the end of a word, if the word ends in a letter that stays one in every normal form.
PUNCTUATION = ".,;:!?*#$%&\"'()-"
_LAST = r"[A-Za-zß-öø-ÿ]\z"


def cut_tails(strings):
    """An Arrow string array as two: the strings without the PUNCTUATION at their ends, and that punctuation."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    word = pc.utf8_rtrim(strings, PUNCTUATION)
    many = np.asarray(pc.binary_length(strings)).astype(np.int64) - np.asarray(pc.binary_length(word))
    if not len(strings):
        return word, word
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset + 1 : strings.offset + 1 + len(strings)]
    source = np.repeat(ends - np.cumsum(many), many) + np.arange(int(many.sum()))
    letters = np.frombuffer(strings.buffers()[2], np.uint8)[source] if len(source) else np.zeros(0, np.uint8)
    cuts = np.append(0, np.cumsum(many)).astype(np.int32)
    return word, pa.StringArray.from_buffers(len(many), pa.py_buffer(cuts), pa.py_buffer(letters.tobytes()))


def key_parts(keys):
    """Which keys (Arrow strings) are one word of letters, and of those: head (line feed, mark or nothing), word and tail
    (punctuation). Both patterns match such a word apart from what stands before and after it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    led = pc.or_(pc.starts_with(keys, "\n"), pc.starts_with(keys, MARK))
    word, tail = cut_tails(pc.if_else(led, pc.utf8_slice_codeunits(keys, 1), keys))
    bare = np.asarray(pc.equal(tail, ""))
    plain = np.asarray(pc.utf8_is_alpha(word)) & (bare | np.asarray(pc.match_substring_regex(word, _LAST)))
    mask = pa.array(plain)
    head = pc.utf8_slice_codeunits(pc.if_else(led, keys, ""), 0, 1).filter(mask)
    return plain, head, word.filter(mask), tail.filter(mask)


def chunk_keys(texts):
    """Keys of the chunks of an Arrow string array without nulls: all keys in order (an Arrow array), chunks per text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.string())
    uneven = pc.match_substring_regex(texts, _UNEVEN)
    hard = np.flatnonzero(np.asarray(uneven))
    marked = pc.binary_join_element_wise(MARK, texts.filter(pc.invert(uneven)) if len(hard) else texts, "")
    lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
    if len(hard):
        more = pa.array([[chunk_key(c) for c in _CHUNK.findall(t.as_py())] for t in texts.take(pa.array(hard))], lists.type)
        place = np.empty(len(texts), np.int64)
        place[np.setdiff1d(np.arange(len(texts)), hard)] = np.arange(len(lists))
        place[hard] = len(lists) + np.arange(len(hard))
        lists = pa.concat_arrays([lists, more]).take(pa.array(place))
    return lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def gather(size, flat, index):
    """Rows `index` of a ragged array (row sizes, values) one after the other: their sizes and values."""
    import numpy as np

    many = size[index]
    ends = np.cumsum(many)
    source = np.repeat(((np.cumsum(size) - size)[index] - (ends - many)).astype(np.int64), many)
    source += np.arange(len(source))
    return many, flat[source]


def encode_parts(keys, line, spaced: Callable, bare: Callable, tails: Callable, rest: Callable):
    """Ragged ids of the chunks named by distinct keys (Arrow strings).

    `line`: ids of a line feed. The functions give ragged ids of distinct words after a space, words without one and tails
    (Arrow strings), and of a list of other chunks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain, head, word, tail = key_parts(keys)
    is_bare = pc.not_equal(head, "")
    words, bares, ends = word.filter(pc.invert(is_bare)).dictionary_encode(), word.filter(is_bare).dictionary_encode(), tail.dictionary_encode()
    other = [chunk_text(k) for k in keys.filter(pa.array(~plain)).to_pylist()]
    # One ragged table of all pieces: nothing, a line feed, words, words without space, tails, other chunks.
    pieces = [(np.array([0, len(line)]), line), spaced(words.dictionary), bare(bares.dictionary), tails(ends.dictionary), rest(other)]
    base = np.cumsum([0, *(len(size) for size, _ in pieces)])
    is_bare = np.asarray(is_bare)
    middle = np.zeros(len(word), np.int64)
    middle[~is_bare] = base[1] + np.asarray(words.indices)
    middle[is_bare] = base[2] + np.asarray(bares.indices)
    row = np.zeros((len(keys), 3), np.int64)
    row[plain] = np.stack([np.asarray(pc.equal(head, "\n")).astype(np.int64), middle, base[3] + np.asarray(ends.indices)], axis=1)
    row[~plain, 1] = base[4] + np.arange(len(other))
    many, flat = gather(np.concatenate([size for size, _ in pieces]), np.concatenate([x for _, x in pieces]), row.ravel())
    return many.reshape(-1, 3).sum(axis=1), flat


def encode_slice(texts, encode_keys: Callable, whole: re.Pattern | None, encode_whole: Callable[[str], bytes]) -> list[bytes]:
    """Packed ids of each text of an Arrow string array without nulls.

    `encode_keys` takes an Arrow array of distinct keys and returns a ragged array: number of ids per key and all ids. Texts
    that match `whole` (special strings) go to `encode_whole`.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if whole is not None:
        special = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, whole.pattern)))
        if len(special):
            rest = np.setdiff1d(np.arange(len(texts)), special)
            out: list[bytes] = [b""] * len(texts)
            for i, packed in zip(rest.tolist(), encode_slice(texts.take(pa.array(rest)), encode_keys, None, encode_whole), strict=True):
                out[i] = packed
            for i in special.tolist():
                out[i] = encode_whole(texts[i].as_py())
            return out
    if not len(texts):
        return []
    keys, per_text = chunk_keys(texts)
    coded = keys.dictionary_encode()
    index, (size, flat) = np.asarray(coded.indices), encode_keys(coded.dictionary)
    ends, out, at = np.cumsum(per_text), [], 0
    while at < len(ends):  # some hundred thousand chunks at a time
        begin = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + 400_000, side="right")))
        many, ids = gather(size, flat, index[begin : ends[stop - 1]])
        stream = ids.tobytes()
        cuts = (ids.itemsize * np.concatenate([[0], np.cumsum(many)])[np.concatenate([[begin], ends[at:stop]]) - begin]).tolist()
        out += [stream[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at = stop
    return out
