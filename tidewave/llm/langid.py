"""Language identification with segmentation-marginalised unigrams.

The pieces of a public vocabulary get a probability per language. The probability of a word in a language is the sum over
all ways to cut it into pieces of the product of their probabilities, by a forward algorithm; that of a text is the product
over its words. Pieces are learned from labelled texts: one expectation step from equal probabilities (forward and
backward sums give the expected use of each piece), added up per language.

A word is a run without white space in lower case, after a word-start mark, however long it is. Characters that no piece
covers have one small probability in all languages. Short words are summed as plain probabilities, many at a time; longer
ones as logarithms, a bounded stretch at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewave.llm._common import bound_batches, lean, table, worker_cache

START, UNKNOWN = "▁", 1e-7
SHORT = 32  # code points of words whose probability a double still holds
STRETCH = 20_000  # positions of a long word at a time


class PieceTable:
    """The vocabulary as hashed prefixes per length, so that pieces of many words are found at once."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = sorted({model.id_to_piece(i).lower() for i in plain})
        self.size = len(pieces)
        known: dict[int, dict[int, int]] = {}
        for n, piece in enumerate(pieces):
            h = 0
            for k, c in enumerate(piece, 1):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                at = known.setdefault(k, {})
                at[h] = n if k == len(piece) else at.get(h, -1)
        self.levels = []
        for k in sorted(known):
            keys = np.array(sorted(known[k]), np.uint64)
            self.levels.append((keys, np.array([known[k][int(x)] for x in keys], np.int64)))
        self.longest = len(self.levels)

    def edges(self, words: list[str]):
        """All pieces in all words: word, begin, end, piece (-1: an unknown character); and the words' lengths."""
        import numpy as np

        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(length)
        word = np.repeat(np.arange(len(words)), length)
        pos, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        left = stop[word] - pos
        found = []
        for k, (keys, ids) in enumerate(self.levels, 1):
            fits = left[pos] >= k
            pos, h = pos[fits], h[fits]
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[pos + k - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            pos, h, piece = pos[hit], h[hit], ids[at[hit]]
            if k == 1:
                missing = np.setdiff1d(np.arange(len(code)), pos[piece >= 0])
                found.append((missing, np.ones(len(missing), np.int64), np.full(len(missing), -1)))
            whole = piece >= 0
            found.append((pos[whole], np.full(whole.sum(), k), piece[whole]))
            if not len(pos):
                break
        pos, size, piece = (np.concatenate(v) for v in zip(*found, strict=True))
        begin = pos - (stop - length)[word[pos]]
        return word[pos], begin, begin + size, piece, length


def forward(edges, prob, backward: bool = False):
    """alpha[word, position, language]: summed probability of all segmentations up to the position (or from it on)."""
    import numpy as np

    word, begin, end, piece, length = edges
    alpha = np.zeros((len(length), int(length.max(initial=0)) + 1, prob.shape[1]))
    alpha[np.arange(len(length)), length if backward else 0] = 1.0
    _sweep(alpha, word, *((end, begin) if backward else (begin, end)), prob[piece], np.multiply, np.add, backward)
    return alpha


def _sweep(alpha, word, source, goal, p, along, joined, backward: bool) -> None:
    """Fill alpha position by position: what stands at the sources of all edges to a position, `along` p, `joined`."""
    import numpy as np

    order = np.lexsort((word, -goal if backward else goal))
    word, source, goal, p = word[order], source[order], goal[order], p[order]
    cut = np.flatnonzero(np.concatenate([[True], (goal[1:] != goal[:-1]) | (word[1:] != word[:-1])])) if len(goal) else np.zeros(0, np.int64)
    level = np.flatnonzero(np.concatenate([[True], np.diff(goal[cut]) != 0])) if len(cut) else cut
    for a, b in zip(level, [*level[1:], len(cut)], strict=True):
        rows = slice(cut[a], cut[b] if b < len(cut) else len(goal))
        flow = along(alpha[word[rows], source[rows]], p[rows])
        alpha[word[cut[a:b]], goal[cut[a]]] = joined.reduceat(flow, cut[a:b] - cut[a], axis=0)


def long_forward(pieces: PieceTable, word: str, prob, backward: bool = False, keep: bool = False):
    """Like `forward` for one word of any length, as logarithms: of the whole word, or with `keep` at every position.

    Stretches of the word are taken in turn; the last positions of one, as many as a piece is long, start the next.
    """
    import numpy as np

    n, reach, log = len(word), pieces.longest, np.log(prob)
    carry, all_ = np.zeros((1, prob.shape[1])), []  # what is known at the last positions, in order of the sweep
    for done in range(0, n, STRETCH):
        step, known = min(STRETCH, n - done), len(carry) - 1
        lo, hi = (done - known, done + step) if not backward else (n - done - step, n - done + known)
        w, begin, end, piece, _ = pieces.edges([word[lo:hi]])
        size = hi - lo
        alpha = np.full((1, size + 1, prob.shape[1]), -np.inf)
        if backward:
            alpha[0, size - known :] = carry[::-1]
            new = begin < size - known
            _sweep(alpha, w[new], end[new], begin[new], log[piece[new]], np.add, np.logaddexp, True)
            swept = alpha[0, ::-1]
        else:
            alpha[0, : known + 1] = carry
            new = end > known
            _sweep(alpha, w[new], begin[new], end[new], log[piece[new]], np.add, np.logaddexp, False)
            swept = alpha[0]
        if keep:
            all_.append(swept[known + (done > 0) :] if done else swept)
        carry = swept[-(reach + 1) :].copy()
    if not keep:
        return carry[-1]
    whole = np.concatenate(all_) if all_ else carry
    return whole[::-1] if backward else whole


def text_words(text: str) -> list[str]:
    return text.lower().split()


def pieces_of(path: str) -> PieceTable:
    return worker_cache(("pieces", path), lambda: PieceTable(path))


#: Longer words are scored each time they come.
REMEMBERED = 256


class WordScorer:
    """Log-probabilities of words per language, remembered for at most `cap` words, and for long ones only while a slice of texts is scored."""

    def __init__(self, pieces: PieceTable, prob, cap: int = 120_000):
        import numpy as np

        self.pieces, self.prob, self.cap = pieces, prob, cap
        self.memo, self.scores = {}, np.zeros((0, prob.shape[1]))

    def learn(self, words: list[str]) -> None:
        import numpy as np

        for at in range(0, len(words), 8_000):
            part = words[at : at + 8_000]
            marked = list(map(START.__add__, part))
            short = np.fromiter(map(len, marked), np.int64, len(part)) <= SHORT
            total = np.zeros((len(part), self.prob.shape[1]))
            edges = self.pieces.edges([w for w, s in zip(marked, short.tolist(), strict=True) if s])
            alpha = forward(edges, self.prob)
            total[short] = np.log(np.maximum(alpha[np.arange(len(edges[4])), edges[4]], 1e-300))
            for i in np.flatnonzero(~short).tolist():
                total[i] = long_forward(self.pieces, marked[i], self.prob)
            base = len(self.scores)
            self.memo.update(zip(part, range(base, base + len(part)), strict=True))
            self.scores = np.concatenate([self.scores, total])

    def texts(self, texts: list[str]):
        """Log-probability of each text in each language."""
        import numpy as np

        words = [text_words(t) for t in texts]
        seen: set[str] = set()
        for w in words:
            seen.update(w)
        if len(self.scores) + len(seen) > self.cap:
            self.memo, self.scores = {}, self.scores[:0]
        self.learn([w for w in seen if w not in self.memo])
        out = np.zeros((len(texts), self.prob.shape[1]))
        for i, w in enumerate(words):
            if w:
                out[i] = self.scores[np.fromiter(map(self.memo.__getitem__, w), np.int64, len(w))].sum(axis=0)
        for w in seen:
            if len(w) > REMEMBERED:
                del self.memo[w]
        return out


def expected_counts(pieces: PieceTable, counts: Counter) -> "object":
    """Expected use of each piece in words with these counts, all pieces being equally likely."""
    import numpy as np

    total = np.zeros(pieces.size + 1)
    prob = background(pieces)
    marked = [(START + w, n) for w, n in counts.items()]
    short = [(w, n) for w, n in marked if len(w) <= SHORT]
    for at in range(0, len(short), 8_000):
        flat = short[at : at + 8_000]
        edges = pieces.edges([u for u, _ in flat])
        word, begin, end, piece, length = edges
        alpha, beta = forward(edges, prob), forward(edges, prob, backward=True)
        z = alpha[np.arange(len(flat)), length, 0]
        weight = np.array([n for _, n in flat], float)
        use = alpha[word, begin, 0] * prob[piece, 0] * beta[word, end, 0] / np.maximum(z[word], 1e-300) * weight[word]
        np.add.at(total, piece, use)
    for w, n in marked:
        if len(w) > SHORT:
            alpha, beta = long_forward(pieces, w, prob, keep=True)[:, 0], long_forward(pieces, w, prob, backward=True, keep=True)[:, 0]
            for at in range(0, len(w), STRETCH):  # pieces that begin in this stretch
                _, begin, end, piece, _ = pieces.edges([w[at : at + STRETCH + pieces.longest]])
                mine = begin < STRETCH
                begin, end, piece = begin[mine] + at, end[mine] + at, piece[mine]
                np.add.at(total, piece, np.exp(alpha[begin] + np.log(prob[piece, 0]) + beta[end] - alpha[-1]) * n)
    return total


def background(pieces: PieceTable):
    """Probabilities of a text of no language: all pieces equally likely."""
    import numpy as np

    prob = np.full((pieces.size + 1, 1), 1.0 / pieces.size)
    prob[-1] = UNKNOWN
    return prob


def train(docs: DataFrame, vocabulary: str, sample_rows: int = 20_000) -> dict:
    """Languages and their piece probabilities, from rows of `docs` (doc_id, text, lang) with both text and lang.

    About `sample_rows` rows take part, chosen by a hash of doc_id. The driver sees one sum per language and piece. No
    labelled rows: a model without languages.
    """
    import numpy as np

    bound_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = max(1, rows.count())
    share = min(1 << 20, -(-sample_rows * (1 << 20) // total))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) < share).select("text", F.col("lang").cast("string").alias("lang"))

    @lean
    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm import langid

        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(langid.text_words(text))
        for lang, counts in words.items():
            use = np.rint(langid.expected_counts(langid.pieces_of(vocabulary), counts)[:-1] * 1e6).astype(np.int64)
            piece = np.flatnonzero(use)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(piece), "piece": pa.array(piece), "use": pa.array(use[piece])})

    used = sample.mapInArrow(count, "lang string, piece long, use long").groupBy("lang", "piece").agg(F.sum("use").alias("use")).collect()
    languages = sorted({r["lang"] for r in used})
    pieces = pieces_of(vocabulary)
    prob = np.full((pieces.size + 1, len(languages)), 0.1)
    for r in used:
        prob[r["piece"], languages.index(r["lang"])] += r["use"] / 1e6
    prob[:-1] /= prob[:-1].sum(axis=0)
    prob[-1] = UNKNOWN
    return {"languages": languages, "prob": prob, "vocabulary": vocabulary}


def predict(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """All columns of `docs` with three more: the language (string), its probability among the languages (0 to 1), and fit:
    how much more likely a character of the text is in that language than where all pieces are equally likely (mean logarithm).

    Columns of `docs` that have one of the `names` are replaced. `und` with score 0 and fit null where the text is null or has
    no letter, or nothing was learned. Only `text` is read to predict. Repeated rows get equal results; an empty table gives
    no rows.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).cast("double").alias(names[2])).schema
    schema = StructType([StructField(f.name, f.dataType) for f in schema])

    @lean
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewave.llm import langid
        from tidewave.llm._common import worker_cache
        from tidewave.llm.chunks import text_slices

        m = shared.value
        languages = m["languages"]

        def make():
            pieces = langid.PieceTable(m["vocabulary"])
            return langid.WordScorer(pieces, np.concatenate([m["prob"], langid.background(pieces)], axis=1))

        scorer = worker_cache(("scorer", hash(m["prob"].tobytes())), make)
        for batch in batches:
            column = batch.column("text").cast(pa.string()).fill_null("")
            for a, b in text_slices(column, 2 << 20):
                texts = column.slice(a, b - a).to_pylist()
                pred, score, fit = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                log = scorer.texts(texts)
                for i, text in enumerate(texts):
                    if languages and any(map(str.isalpha, text)):
                        row = log[i, :-1]
                        best = int(row.argmax())
                        pred[i], score[i] = languages[best], float(1.0 / np.exp(row - row[best]).sum())
                        fit[i] = float(row[best] - log[i, -1]) / len(text)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 on division by 3; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).where("doc_id is not null"), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
