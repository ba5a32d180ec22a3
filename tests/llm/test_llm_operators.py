"""Each operator against a brute-force version on small hand-made tables: nulls, empties, ties, repeats, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

RARE = [None, "", " ", "a", "a b", "x" * 3000, "It's  'S x<|endoftext|>y z", "tab\t x\xa0y\n\n z", "é ñ " * 50, "12,5 %%% don't!"]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "and", "ting", "onre", "sth", "edin", "her", "of", "thon", "whal", "nerst", "ouble"]
    return " ".join(rng.choice(words, n)) + "."


@pytest.fixture(scope="module")
def texts():
    base = [prose(80 + 7 * i, i) for i in range(12)]
    shared = prose(60, 99)
    return RARE + base + [base[0], base[1] + " more", base[2] + shared, shared + base[3], shared]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, ["en", "fr", None][i % 3], "s", len(t or ""), "clash", 1.5) for i, t in enumerate(texts)]
    rows += [(None, "a null id " * 20, "en", None, None, None, None), rows[12]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double").repartition(3)


def empty(df):
    return df.where("false")


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(name))


def test_token_files(spark, docs, tmp_path):
    from tidewave.llm import token_files

    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in token_files.read_tokens(token_files.write_tokens(plain, public.path("byte_bpe_50k.json"), str(tmp_path / "t"))).collect()}
    at, tok = 0, tokenizer("byte_bpe_50k.json")
    for r in sorted(plain.collect(), key=lambda r: r.doc_id):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (at, len(ids))
        assert got[r.doc_id].ids == np.array(ids, "<u4").tobytes()
        at += len(ids)
    everything = token_files.read_tokens(token_files.write_tokens(docs, public.path("byte_bpe_50k.json"), str(tmp_path / "u")))
    assert everything.count() == docs.count() and everything.where("doc_id is null").count() == 1
    assert token_files.read_tokens(token_files.write_tokens(empty(docs), public.path("byte_bpe_50k.json"), str(tmp_path / "v"))).count() == 0


ODD = [
    "a", "Be", "the", "Word", "\xa0", "\u2009", "\u3000", " ", "\n", "\t", "\r", "\x85", "\x1c", "\u200b", "\ufeff", "\x00", "\x01", "İ", "ÜYESİ", "İ.", "é", "e\u0301", "\u0301", "ß", "ẞ", "Ω", "ς", "Σ",
    "ǅ", "ﬁ", "ﬀ.", "ŉ", "ª.", "ʰ,", "Å", "K", ".", ",", "'s", "'", "'ll", "don't", "l'été", "12", "3", "½", "%%", "…", "—", "-", "(", "!", "ñ.", "ü,", "n.", "\n\n", "  ", "&nbsp;", "漢字", "한", "ไทย", "\U0001f600",
    "<|endoftext|>", "<|startoftext|>", "<|end",
]


def test_ids_of_odd_texts():
    """Both encoders give the library's ids on 100 000 texts of odd letters, marks, white space and special strings."""
    import random

    import pyarrow as pa

    from tidewave.llm import bpe, vocab

    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) if rng.random() < 0.6 else rng.choice([" ", "a", "\n", "."]) for _ in range(rng.randint(0, 14))) for _ in range(50_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok = tokenizer(name)
        tok.no_padding()
        tok.no_truncation()
        want = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        encode = vocab.ChunkEncoder(public.path(name)).encode
        for at in range(0, len(texts), 7000):
            assert [np.frombuffer(x, "<u2").tolist() for x in encode(pa.array(texts[at : at + 7000]))] == want[at : at + 7000]
        if name.startswith("byte"):
            codec = bpe.BytePairCodec(public.path(name), cap=2000)
            for at in range(0, len(texts), 7000):
                got = codec.encode(pa.array(texts[at : at + 7000]))
                assert [np.frombuffer(x, "<u4").tolist() for x in got] == want[at : at + 7000]
                assert [codec.decode(x) for x in got[:700]] == [tok.decode(x, skip_special_tokens=False) for x in want[at : at + 700]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_long_texts(name):
    import pyarrow as pa

    from tidewave.llm import vocab

    texts = [prose(30_000, 4) + "\n" + prose(10, 5), "x" * 20_000, " \n" * 5_000, "<|endoftext|>" + "a b " * 5_000]
    tok = tokenizer(name)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in vocab.ChunkEncoder(public.path(name)).encode(pa.array(texts))] == want


def test_token_files_hot_ids(spark, tmp_path):
    """Half of all rows share one id or have none, many of them are equal: all stay, in order, over several files."""
    from tidewave.llm import token_files

    rows = [(None, "same text"), (7, "same text"), (7, "other")] * 200 + [(i, f"text {i}") for i in range(100)] + [(-(2**63), "least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_tokens(docs, public.path("byte_bpe_50k.json"), str(tmp_path / "h"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert max(r.docs for r in manifest.collect()) < 400


def test_packing_hot_rows(spark):
    from tidewave.llm import packing

    docs = spark.createDataFrame([(None, "the same words")] * 3000 + [(i, "the same words") for i in range(50)], "doc_id long, text string")
    rows = packing.pack_documents(docs, public.path("word_bpe_49k.json"), 64).toPandas()
    assert len(rows) == 3050 and not rows.duplicated(["sequence_id", "offset"]).any()


def test_bpe_codec(docs):
    from tidewave.llm import bpe

    tok = tokenizer("byte_bpe_50k.json")
    rows = bpe.encode_documents(docs, public.path("byte_bpe_50k.json")).collect()
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = tok.encode(want[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(empty(docs), public.path("byte_bpe_50k.json")).count() == 0


def test_packing(docs):
    from tidewave.llm import packing

    tok = tokenizer("word_bpe_49k.json")
    rows = packing.pack_documents(docs, public.path("word_bpe_49k.json"), 64).toPandas()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {k: tok.encode(t, add_special_tokens=False).ids + [0] for k, t in text.items()}
    assert rows.length.sum() == sum(len(ids[r.doc_id]) for r in docs.collect())
    for r in rows.dropna(subset=["doc_id"]).itertuples():
        cut = ids[int(r.doc_id)][r.start : r.start + r.length]
        assert len(cut) == r.length and zlib.crc32(np.array(cut, "<u4").tobytes()) == r.ids_crc32
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 64
    assert rows.sequence_id.nunique() <= 1.1 * rows.length.sum() / 64 + 1
    assert packing.pack_documents(empty(docs), public.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_packing_plan(seed):
    from collections import Counter

    from tidewave.llm.packing import placements, plan_bins

    rng = np.random.default_rng(seed)
    histogram = Counter(rng.integers(1, 65, 400).tolist() + [64] * 20 + [rng.integers(1, 4)] * 100)
    plan = plan_bins(dict(histogram), 64)
    used = Counter()
    for lengths, bins in plan:
        assert sum(lengths) <= 64 and bins > 0
        for n in lengths:
            used[n] += bins
    assert used == histogram
    room = []  # plain best fit, longest first
    for n in sorted(histogram.elements(), reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((64 if fit is None else fit) - n)
    assert sum(b for _, b in plan) <= len(room) + 1
    assert sum(1 for _ in placements(plan)) == sum(len(lengths) for lengths, _ in plan)
    assert plan_bins({}, 64) == []


def test_warc(spark, tmp_path):
    from tidewave.llm import warc

    big, small = "<p>" + "é" * 200, "tiny"
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "v", None), (6, "w", big + "!"), (None, "n", big), (7, "x", ""), (6, "w", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, warc.archive_files(index)).collect()), key=str)
    want = []
    for page, _, html in rows:
        b = (html or "").encode()
        first = 1 if html == big and page != 1 else None
        want.append((page or 0, len(b), hashlib.sha256(b).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=str)
    for r in index.collect():
        record = warc.SeekableReader(r.file).record(r.frame, r.offset, r.length)
        assert record.startswith(b"WARC/1.1") and record.endswith(b"\r\n\r\n")
    none = warc.write_archives(empty(pages), str(tmp_path / "e"))
    assert none.count() == 0 and warc.read_archives(spark, warc.archive_files(none)).count() == 0


def test_seekable_frames(tmp_path):
    from tidewave.llm import warc

    path = str(tmp_path / "x.zst")
    writer = warc.SeekableWriter(warc.open_output(path), frame_bytes=100)
    places = [(writer.add(bytes([65 + i]) * (30 + i)), 30 + i, i) for i in range(20)]
    writer.close()
    reader = warc.SeekableReader(path)
    assert len(reader.frames) > 3
    for (frame, offset), n, i in places:
        assert reader.record(frame, offset, n) == bytes([65 + i]) * n


def test_top_k(spark):
    from tidewave.llm import bitslice

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 5)], "clash") for i in range(90)]
    rows += [(100 + i, rows[0][1], "tie") for i in range(40)] + [(200, None, ""), (201, [1.0, None, 0.0, 0.0, 0.0], ""), (202, [float("nan")] * 5, ""), (203, [float("inf")] * 5, ""), (None, [1.0] * 5, ""), (204, [0.5], ""), (205, [0.0] * 5, "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(4)
    got = [tuple(r) for r in bitslice.top_k(vectors.where("vec_id % 5 = 0"), vectors, k=7, block_rows=32, query_rows=4).orderBy("query_id", "rank").collect()]
    q = {i: np.array([int(np.floor(64 * x)) for x in v] + [0] * (5 - len(v))) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for a in sorted(q):
        if a % 5 == 0:
            best = sorted(((-int(q[a] @ q[b]), b) for b in q if b != a))[:7]
            want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
    assert got == want
    few = vectors.where("vec_id < 3")
    assert bitslice.top_k(few, few, k=7).count() == 6
    large = [(i, [float(x) for x in v]) for i, v in enumerate([(2e12, 1.0), (-3e12, 2.0), (1e15, -1e15), (1.0, 1.0), (5e17, 1.0), (1e300, 3.0), (0.5, 7.0), (1.5e308, -1e308)])]
    big = spark.createDataFrame(large, "vec_id long, embedding array<double>").repartition(2)
    got = [tuple(r) for r in bitslice.top_k(big, big, k=4, block_rows=3).orderBy("query_id", "rank").collect()]
    q = {i: [math.floor(64 * Fraction(x)) for x in v] for i, v in large}
    want = []
    for a in q:
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:4]
        want += [(a, n + 1, b, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, b) in enumerate(best)]
    assert got == want
    assert bitslice.top_k(empty(vectors), vectors).count() == 0 and bitslice.top_k(few, empty(vectors)).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fingerprints, radius=3):
    parent = {k: k for k in fingerprints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark, docs):
    from tidewave.llm import simhash

    known = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect() if r.doc_id is not None}
    label = brute_components(known)
    rows = simhash.near_components(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (format(known[r.doc_id], "016x"), label[r.doc_id])
    assert simhash.near_components(empty(docs)).count() == 0


@pytest.mark.parametrize("most", [2048, 4])
def test_near_links(spark, most):
    from tidewave.llm import simhash
    from tidewave.llm.graph import components

    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for c in list(values)[:6]:  # chains of near fingerprints
        for _ in range(25):
            for bit in rng.integers(0, 64, 3):
                c ^= 1 << int(bit)
            values.add(c)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)
    got = {r.node: r.label for r in components(links).collect()}
    want = brute_components({v: v % (1 << 64) for v in signed})
    assert {v: got.get(v, v) for v in signed} == want


def test_fingerprints(spark, docs):
    from tidewave.llm import fingerprints

    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in fingerprints.edited_likeness(plain).collect()}
    ordered = [(r.doc_id, r.text or "") for r in sorted(plain.collect(), key=lambda r: r.doc_id)]
    by_text = {}
    for i, (key, text) in enumerate(ordered):
        take = len(text) // 4
        edited = text[: len(text) - take] + ordered[(i + 1) % len(ordered)][1][:take]
        assert rows[key].n_chars == len(text) and rows[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(rows[key].fingerprint)
        assert 0 <= rows[key].near_edited <= 1 and 0 <= rows[key].near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())
    long = [rows[k] for k, t in ordered if len(t) > 600 and " " in t]
    assert np.mean([r.near_edited for r in long]) > 0.5
    assert fingerprints.edited_likeness(docs).count() == docs.count()
    assert fingerprints.edited_likeness(empty(docs)).count() == 0
    one = fingerprints.edited_likeness(plain.where("doc_id = 36")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_by_brute_force(spark, docs):
    """Fingerprints and likeness computed again in plain Python: terms of five word hashes, each the seed of the next."""
    import xxhash

    from tidewave.llm import fingerprints

    def chain(hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    def brute(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[ \t\n\r\x0b\f]+", text.lower()) if w]
        terms = [chain(h[i : i + 5]) for i in range(max(1, len(h) - 4))] if h else []
        return sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))

    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(r.doc_id, r.text or "") for r in sorted(plain.collect(), key=lambda r: r.doc_id)]
    rows = {r.doc_id: r for r in fingerprints.edited_likeness(plain).collect()}
    like = lambda a, b: max(0.0, math.cos((a ^ b).bit_count() * math.pi / 64))
    for i, (key, text) in enumerate(texts):
        after, take = texts[(i + 1) % len(texts)][1], len(text) // 4
        own, edited = brute(text), brute(text[: len(text) - take] + after[:take])
        assert rows[key].fingerprint == format(own, "016x") and rows[key].edited_fingerprint == format(edited, "016x")
        assert math.isclose(rows[key].near_edited, like(own, edited), abs_tol=1e-12) and math.isclose(rows[key].near_next, like(own, brute(after)), abs_tol=1e-12)


def test_order_with_hot_ids(spark):
    """Half of the rows share an id or have none: every row is followed by the next in the order, over many buckets."""
    from tidewave.llm import fingerprints

    rows = [(7, f"seven {i}") for i in range(120)] + [(None, f"none {i % 90}") for i in range(100)] + [(i, f"text {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = fingerprints.with_next(docs, buckets=12).where("own").collect()
    follows = Counter((r.text, r.next_text) for r in out)
    assert Counter(t for t, _ in follows.elements()) == Counter(n for _, n in follows.elements()) == Counter(t for _, t in rows)
    assert len({r.bucket for r in out if r.doc_id == 7}) > 1
    ids = {}
    for i, t in rows:
        ids.setdefault(t, i)
    order = sorted({i for i, _ in rows if i is not None})
    for a, b in follows:
        x, y = ids[a], ids[b]
        assert x == y or (x is None and y == order[0]) or (x == order[-1] and y is None) or (x is not None and order[order.index(x) + 1] == y)
    assert fingerprints.edited_likeness(docs).count() == len(rows)


def test_bucketed_order(spark):
    from tidewave.llm import fingerprints

    rows = [(int(i), f"text {i}") for i in np.random.default_rng(0).permutation(300)]
    out = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), buckets=20).where("own").collect()
    assert sorted((r.doc_id, r.next_text) for r in out) == [(i, f"text {(i + 1) % 300}") for i in range(300)]


def test_near_fingerprints(spark):
    from tidewave.llm import fingerprints

    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 20).tolist()
    values = sorted({*base, *[b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 60, (6, 2))]})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r.fp, r.near_fp) for r in fingerprints.near_fingerprints(df, df).collect()}
    want = {(a, b) for a in values for b in values if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and fingerprints.near_fingerprints(df, df).count() == len(want)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        out[key] = (len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("hot", "small"), [(2000, 2048), (1, 8)])
def test_suffixes(spark, docs, hot, small, monkeypatch):
    from tidewave.llm import suffixes

    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (100, hot, 2000, 1_000_000))
    monkeypatch.setattr(suffixes, "SMALL", small)
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text or "") for r in plain.collect()] + [(500, "ab" * 400), (501, "é" * 300), (502, "q" + "ab" * 90)]
    table = plain.select("doc_id", "text").union(spark.createDataFrame(rows[-3:], "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(table).collect()}
    assert got == brute_repeats(rows)
    assert suffixes.remove_repeats(docs).count() == docs.count()
    assert suffixes.remove_repeats(empty(docs)).count() == 0
    replaced = suffixes.remove_repeats(docs, replace_text=True)
    assert replaced.columns[: len(docs.columns)] == docs.columns


def test_long_text_in_chunks(monkeypatch):
    from tidewave.llm import suffixes

    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffixes.stretches(data)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    cut = suffixes.stretches(data)
    assert cut[2].sum() == whole[2].sum() == 4901
    at = lambda s: {(int(b) + i, int(p)) for p, b, w in zip(*s, strict=True) for i in range(w)}
    assert at(whole) == at(cut)


def test_language(spark):
    from tidewave.llm import langid

    rng = np.random.default_rng(0)
    words = {"en": ["the", "and", "of", "that", "with", "house"], "de": ["der", "und", "nicht", "straße", "für", "haus"], "fr": ["le", "et", "été", "dans", "où", "maison"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(rng.choice(list(words), 150).tolist())]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!! 456", None), (903, "x" * 5000, None), (None, "der und nicht", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(~langid.held_out()), public.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:150])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred in words
    assert langid.predict(docs, langid.train(empty(docs), public.path("piece_bpe_32k.model"))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty(docs), model).count() == 0
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows[:150])


def test_forward_sums_all_segmentations(monkeypatch):
    from tidewave.llm import langid

    pieces = langid.pieces_of(public.path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    known = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    rank = {p: n for n, p in enumerate(sorted(known))}
    prob = np.random.default_rng(0).random((pieces.size + 1, 2)) / 100

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in rank:
                total = total + prob[rank[word[:k]]] * brute(word[k:])
            elif k == 1:
                total = total + prob[-1] * brute(word[1:])
        return total

    def plain(word):  # the same sum in logarithms, position by position
        log, at = np.log(prob), [np.zeros(2)]
        for k in range(1, len(word) + 1):
            terms = [at[j] + log[rank[word[j:k]]] for j in range(max(0, k - pieces.longest), k) if word[j:k] in rank]
            if word[k - 1] not in rank:
                terms.append(at[k - 1] + log[-1])
            at.append(np.logaddexp.reduce(terms, axis=0))
        return np.array(at)

    long = "▁" + "".join(np.random.default_rng(3).choice(list("thequickbrown語é"), 5000))
    for stretch in (20_000, 700):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert np.allclose(langid.long_forward(pieces, long, prob, keep=True), plain(long)) and np.allclose(langid.long_forward(pieces, long, prob), plain(long)[-1])
        assert np.allclose(langid.long_forward(pieces, long, prob, backward=True), plain(long)[-1])
        use = langid.expected_counts(pieces, Counter({long[1:]: 2}))
        sizes = np.array([len(p) for p in sorted(known)] + [1])
        assert math.isclose((use * sizes).sum(), 2 * len(long), rel_tol=1e-6)  # every character is in one piece of each segmentation
    few = langid.expected_counts(pieces, Counter({"thequick": 3}))
    monkeypatch.setattr(langid, "SHORT", 2)
    assert np.allclose(few, langid.expected_counts(pieces, Counter({"thequick": 3})))
    words = ["▁the", "▁straße", "▁x", "▁日本語", "▁housing", "ab"]
    edges = pieces.edges(words)
    alpha = langid.forward(edges, prob)
    beta = langid.forward(edges, prob, backward=True)
    for i, w in enumerate(words):
        assert np.allclose(alpha[i, len(w)], brute(w)) and np.allclose(beta[i, 0], brute(w))


def test_quality(spark):
    from tidewave.llm import quality

    rng = np.random.default_rng(1)
    good = [prose(60, 200 + i) for i in range(120)]
    bad = [" ".join(f"{w}!!" for w in rng.choice(["ZAP", "BUY", "NOW"], 40)) for _ in range(40)]
    rows = list(enumerate(good + bad)) + [(700, None), (701, ""), (702, "   "), (None, good[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), 0 if i != 3 else None) for i in range(0, 160, 2)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.select(docs, labels).collect()}
    assert np.mean([got[i].keep for i in range(120)]) > 0.95 and not any(got[i].keep for i in range(120, 160))
    assert not any(got[i].keep for i in (700, 701, 702))
    assert quality.select(docs, empty(labels)).where("keep").count() == 161
    assert quality.select(empty(docs), labels).count() == 0


def test_quality_by_brute_force(spark):
    """Bucket counts, ratios, k and the kept rows, computed again from the definitions in plain Python."""
    import zlib as z

    from tidewave.llm import quality

    def buckets(text, bits=13):
        mask, words = (1 << 64) - 1, text.split()
        one, shape = [z.crc32(w.encode()) for w in words], [z.crc32(quality.word_shape(w).encode()) + (1 << 33) for w in words]
        first = 0x9E3779B97F4A7C15

        def pair(a, b):
            a, b = a * first & mask, b * first & mask
            return ((a ^ (b * 0xD6E8FEB86659FD93 & mask) ^ (b >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> (64 - bits)

        out = [(x * first & mask) >> (64 - bits) for x in one]
        out += [0 if a == b else pair(a, b) for a, b in zip(one, one[1:])]  # noqa: B905
        return out + [pair(a, b) for a, b in zip(shape, shape[1:])]  # noqa: B905

    texts = {i: prose(20 + i, 40 + i) if i % 3 else " ".join(f"X{j % 4}!" for j in range(12 + i)) for i in range(45)} | {50: "", 51: "one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = {i: (int(i % 3 > 0), int(i == 7)) for i in range(30)}
    table = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, table)
    target = {i for i, (q, t) in labels.items() if q and not t}
    raw, good = Counter(b for t in texts.values() for b in buckets(t)), Counter(b for i in target for b in buckets(texts[i]))
    total, aim = sum(raw.values()) + (1 << 13), sum(good.values())
    p = {b: (raw[b] + 1) / total for b in range(1 << 13)}
    ratio = [math.log((good[b] + 1000 * p[b]) / (aim + 1000) / p[b]) for b in range(1 << 13)]
    assert np.allclose(model["ratio"], ratio) and math.isclose(model["share"], len(target) / len(labels))
    logs = {i: sum(ratio[b] for b in buckets(t)) for i, t in texts.items()}
    rows = {r.doc_id: r for r in quality.select(docs, table).collect()}
    assert all(math.isclose(rows[i].log_ratio, x, abs_tol=1e-9) for i, x in logs.items())
    k = round(sum(min(1.0, model["share"] * math.exp(min(50.0, logs[i]))) for i, t in texts.items() if t))
    keys = {i: rows[i].sample_key for i, t in texts.items() if t}
    assert {i for i, r in rows.items() if r.keep} == set(sorted(keys, key=keys.get, reverse=True)[:k])


def test_shape_codes():
    import pyarrow as pa

    from tidewave.llm import quality

    words = ["the", "The", "THE", "I", "a1", "12", "x-y", "don't", "İ", "É.", "été,,", "漢字", "Ab!", "aB", "A.", "ß", "ABC!!", "...", "", "ǅa", "Ⅷ", "a²", "mail.x@y.com", "!a!", "Ω,"]
    assert quality.shape_codes(pa.array(words)).tolist() == [zlib.crc32(quality.word_shape(w).encode()) for w in words]
    assert len(quality.shape_codes(pa.array([], pa.string()))) == 0
    text, buckets = quality.ngram_buckets(pa.array(["", " a ", "a b\nc", "\n"]))
    assert text.tolist() == [1, 2, 2, 2, 2, 2, 2, 2] and len(buckets) == 8


CLASHES = ["doc", "score", "fit", "lang_pred", "n_removed", "n_bytes", "n_spans", "kept", "_key", "_spans", "_kept", "text_hash", "s", "fp", "label", "t", "n", "bucket", "at", "own", "length", "rank", "held_out"]


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Every stage leaves columns of any name alone and handles null ids, null texts, repeated rows and an empty table."""
    import corpus_pipeline

    texts = [prose(120, 500 + i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (20, None), (None, texts[4] + " more"), (None, "!!"), (21, prose(9000, 550)), (22, "")]
    more = [tuple(f"{c} {i}" for c in CLASHES) for i in range(len(rows))]
    kind = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *m) for (i, t), m in zip(rows, more, strict=True)], kind).repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given = {tuple(r[c] for c in CLASHES): r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, empty(docs), str(tmp_path)).count() == 0
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in rows}
            continue
        got = out.collect()
        assert out.columns == docs.columns and got
        for r in got:
            was = given[tuple(r[c] for c in CLASHES)]
            assert name == "suffix_array_dedup" or r.text == was


def test_kth_largest(spark):
    from tidewave.llm import quality

    values = [float(x) for x in np.random.default_rng(0).normal(size=400)] + [0.25] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 37, 250, 500):
        assert quality.kth_largest(df, "v", k, enough=10) == sorted(values, reverse=True)[k - 1]


def test_components(spark):
    from tidewave.llm.graph import components

    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (None, 3), (100, 105)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(150, 300 + i) for i in range(40)]
    texts += [texts[0], texts[1] + " end", None, "!!! 123", texts[2] + prose(40, 900), prose(40, 900) + texts[3]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id for r in docs.select("doc_id").collect()}.isdisjoint({42, 43})
    assert docs.count() > 30


def test_pipeline_near_duplicates(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts = {}
    for g in range(8):  # groups of edited copies, chained, of several lengths; few of their pairs are within 3 bits
        words = prose(40 + 40 * g, 7000 + g).split()
        for _ in range(15):
            for at in rng.integers(0, len(words), max(1, len(words) // 60)):
                words[at] = f"w{rng.integers(0, 10**6)}"
            texts[len(texts)] = " ".join(words)
    common = prose(30, 7100)
    texts |= {len(texts) + i: f"{common} {prose(60, 7200 + i)}" for i in range(30)}
    texts |= {len(texts) + i: t for i, t in enumerate(["", "one two", "One  two", texts[3].upper(), texts[140]])}
    sets = {}
    for k, t in texts.items():
        w = t.lower().split()
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    label = {k: k for k in texts}
    root = lambda k: k if label[k] == k else root(label[k])
    for a in texts:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    want = {root(k) for k in texts}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    from tidewave.llm import similar

    found = {r.doc_id: r.component_id for r in similar.near_components(docs, crowd=3, rounds=3).collect()}  # nearly all shingles come last
    assert found == {k: root(k) for k in texts}
    assert corpus_pipeline.simhash_near_dedup(spark, empty(docs), "").count() == 0


def test_common_windows_are_written_and_samples_bounded(spark, monkeypatch):
    from tidewave.llm import suffixes

    same = prose(60, 8000)
    texts = [f"{prose(50, 8001 + i)} {same} {prose(50, 8101 + i)}" for i in range(12)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, _key long, text string")
    names, write = [], suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, name: names.append(name) or write(df, name))

    def covered(**how):
        return {(r.doc, i) for r in suffixes.repeated_spans(docs, **how).collect() for i in range(r.begin, r.end)}

    seen, want = set(), set()
    for k, t in enumerate(texts):
        data = t.encode()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                want |= {(k, x) for x in range(i, i + 100)}
            seen.add(data[i : i + 100])
    assert covered(hot=0) == want and covered() == want
    assert "windows" in names
    long = spark.createDataFrame([(i, prose(4000, 8200 + i)) for i in range(6)], "_key long, text string")
    few, expected = suffixes._sampled_suffixes(long, 100, 1, 1000)
    assert 300 < len(few) < 1500 and expected > 2000


@pytest.mark.parametrize("small", [1, 4, 2048])
def test_multikey_sort(small, monkeypatch):
    from tidewave.llm import suffixes

    monkeypatch.setattr(suffixes, "SMALL", small)
    rng = np.random.default_rng(small)
    for n, top in ((0, 3), (1, 3), (2, 1), (500, 2), (700, 5), (300, 10**9)):
        words = rng.integers(0, top, (4, n))
        order, group = suffixes.multikey_sort(n, 4, lambda depth, rows, words=words: words[depth, rows])
        rows = [tuple(words[:, i]) for i in order]
        assert rows == sorted(tuple(x) for x in words.T) and sorted(order) == list(range(n))
        assert all((rows[i] == rows[i - 1]) == (group[i] == group[i - 1]) for i in range(1, n))


def test_suffixes_structured_strings(spark):
    """Texts of two letters in self-similar order, for which hashes of sums of powers agree far too often; one lead is very common."""
    from tidewave.llm import suffixes

    thue = lambda n, a, b: "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    texts = [thue(512, "a", "b"), thue(512, "b", "a"), thue(700, "a", "b"), "ab" * 200, "ba" * 200, "a" * 300]
    lead = "the same twenty leading bytes and more "
    texts += [lead + prose(12, 600 + i) + " " + lead + prose(9, 700 + i % 3) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_repeats(enumerate(texts))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()} == want
