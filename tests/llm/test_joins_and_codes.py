"""Product codes, spelling variants, the token-group join, and dedup by rows: each against a brute-force version, with odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


def words(n, seed, size=4000):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, size, n)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_label(texts, k, over, under, empties=False):
    sets, label = {d: shingles(t, k) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if (empties and not x and not y) or (x and y and under * len(x & y) >= over * len(x | y)):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {d: root(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def varied(seed, sizes=(30, 80, 200)):
    """Texts at all distances from a few bases: edits at their own places, cut ends, shared passages, copies, odd ones."""
    rng = np.random.default_rng(seed)
    out, passage = [], words(25, 999)
    for b, size in enumerate(sizes):
        base = words(size, seed * 10 + b)
        out.append(base)
        for share in (0.004, 0.01, 0.02, 0.03, 0.05, 0.08):
            for _ in range(6):
                w = list(base)
                for i in np.flatnonzero(rng.random(size) < share):
                    w[i] = f"own{rng.integers(1 << 30)}"
                out.append(w[: size - int(rng.integers(0, size // 8))])
        out.append(base[: size // 2] + passage + base[size // 2 :])
        out.append(base + base[:3])
    texts = [" ".join(w) for w in out] + [None, "", "   ", "one", "One two", "one two", "ONE TWO three", "é É", "x" * 5000]
    return {int(d): t for d, t in zip(rng.permutation(len(texts)) + 5, texts, strict=True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    from tidewave.llm import tokengroups

    texts = varied(seed)
    label, sizes = brute_label(texts, 3, 90, 100)
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, n string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in tokengroups.jaccard_components(docs).collect()}
    assert got == {d: (sizes[d], label[d]) for d in texts}
    odd = docs.union(docs.where("doc_id = 5")).union(docs.selectExpr("null", "text", "n").limit(3))
    rows = tokengroups.jaccard_components(odd).collect()
    assert len(rows) == len(texts) + 4 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == got
    assert tokengroups.jaccard_components(docs.where("false")).count() == 0


@pytest.mark.parametrize("stars", [0, 1])
def test_matrix_alone(spark, stars, monkeypatch):
    """All links come from the matrix when no star round goes before, with groups of few members."""
    from tidewave.llm import tokengroups

    monkeypatch.setattr(tokengroups, "MEMBERS", 4)
    monkeypatch.setattr(tokengroups, "SMALL", 0 if stars else 500_000)  # texts are found through a map of bits, or by a plain join
    monkeypatch.setattr(tokengroups.similar_sets, "__defaults__", (None, stars))
    texts = varied(3)
    label, _ = brute_label(texts, 3, 90, 100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in tokengroups.jaccard_components(docs).collect()} == label


def candidate_counts(spark, monkeypatch, texts, rule):
    """Pairs that pass the matrix and those that star rounds ask for."""
    from tidewave.llm import tokengroups

    counts = []
    real = tokengroups.possible

    def counting(pairs, known, rule):
        counts.append(pairs.count())
        return real(pairs, known, rule)

    monkeypatch.setattr(tokengroups, "possible", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, member = tokengroups.set_rows(docs, rule)
    assert rows.count() == len(texts) and member.select("label").distinct().count() == len(texts)  # none link
    monkeypatch.setattr(tokengroups, "possible", real)
    return counts


@pytest.mark.parametrize("share", [0.70, 0.75, 0.79])
def test_templates_give_no_pairs(spark, monkeypatch, share):
    """Texts that share most of a template but less than the similarity: candidates grow with the texts, not with their pairs."""
    from tidewave.llm.similar import NEAR

    size = 200
    own = round(size * (1 - 2 * share / (1 + share)))
    base = words(size - own, 77)
    totals = {}
    for n in (500, 2000):
        texts = [" ".join([f"a{i}x{j}" for j in range(own)] + base) for i in range(n)]
        totals[n] = sum(candidate_counts(spark, monkeypatch, texts, NEAR))
    assert totals[2000] <= 8 * max(totals[500], 500)


def test_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    same, other = " ".join(words(40, 1)), " ".join(words(40, 2))
    rows = [(1, same, "a"), (None, same, "b"), (None, other, "c"), (None, None, "d"), (7, "", "e"), (3, same + " end", "f"), (9, other + "x", "g"), (9, other + "x", "g")]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text, r.source) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())
    assert kept == [(1, same, "a"), (7, "", "e"), (9, other + "x", "g")]
    nulls = docs.where("doc_id is null").union(docs.where("doc_id is null"))
    assert sorted(str(r.text) for r in corpus_pipeline.simhash_near_dedup(spark, nulls, "").collect()) == sorted([same, other, "None"])


def brute_rows(rows, length=100):
    """Kept bytes of rows in their order."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        out.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def test_repeats_by_rows(spark):
    """Null and equal ids with different texts: each row is a text of its own and no unique byte goes."""
    from tidewave.llm import suffixes

    doubled, unique, passage = " ".join(words(60, 3)) * 2, " ".join(words(120, 4)), " ".join(words(30, 5))
    rows = [(None, doubled), (None, unique), (4, passage + " a"), (4, "b " + passage), (4, unique[:300]), (2, None), (9, unique), (9, unique)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, _key string")
    order = [(r.doc_id, r.text) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as h").orderBy("doc_id", "h").collect()]
    want = sorted((str(d), str(t), k) for (d, t), k in zip(order, brute_rows([t for _, t in order]), strict=True))
    got = sorted((str(r.doc_id), str(r.text if r.text else None), bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect())
    assert got == want and any(len(k) == len(unique) for _, t, k in got if t == unique)


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    ids = sorted(vectors)
    x = {v: [int(np.floor(4096 * float(c))) for c in vectors[v]] for v in ids}
    size = len(x[ids[0]]) // parts
    cut = lambda v, p: x[v][p * size : (p + 1) * size]
    books = [[cut(v, p) for v in ids[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in ids:
                of.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            for e, rows in of.items():
                books[p][e] = [sum(c) // len(rows) for c in zip(*rows, strict=True)]
    found = {v: [nearest(v, p) for p in range(parts)] for v in ids}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {v: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for v, f in found.items()}, digest


@pytest.mark.parametrize(("n", "scale"), [(300, 0.2), (40, 3e9), (9, 1.0), (200, 0.002)])
def test_codes(spark, n, scale):
    """Also with components that pass 64-bit sums, fewer vectors than entries, and many ties."""
    from tidewave.llm import codes

    rng = np.random.default_rng(n)
    vectors = {int(v): (rng.normal(size=16) + 4 * rng.integers(0, 3, 16)).astype(np.float32) * np.float32(scale) for v in rng.permutation(5 * n)[:n]}
    bad = [(-1, None, 1), (-2, [1.0] * 15 + [None], 1), (-3, [float("nan")] * 16, 1), (-4, [float("inf")] * 16, None), (-5, [], 2)]
    rows = [(v, [float(c) for c in x], int(v) % 3 or None) for v, x in vectors.items()]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(3)
    got, history = codes.train_codes(table)
    want, digest = brute_codes(vectors)
    rows = got.collect()
    assert {r.vec_id: (r.code, r.error) for r in rows} == {v: (c, min(e, 2**63 - 1)) for v, (c, e) in want.items()} and len(rows) == n
    assert codes.codebooks_digest(history) == digest
    assert codes.train_codes(table.where("false"))[0].count() == 0


def test_bounds_spare_distances():
    """Bounds give the nearest entries, ties to the lower one, and most distances are never measured; net displacement is what counts."""
    from tidewave.llm import codes

    rng = np.random.default_rng(5)
    centres = rng.integers(-40000, 40000, (16, 8))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-900, 900, (3000, 8))
    history = [[centres + rng.integers(-3000, 3000, centres.shape)]]
    state = (np.zeros(3000, np.int64), np.full(3000, np.inf, np.float32), np.zeros(3000, np.int64), np.zeros((3000, 16), np.float32), np.zeros((3000, 16), np.int64))
    spent = []
    for step in range(8):
        spent.append(codes.assign(x, state, history, 0))
        d = ((x[:, None] - history[-1][0][None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        (state,) = codes.unpack_state(codes.pack_state([state]).tobytes(), 3000, 16, 1)
        history.append([history[0][0] + (-1) ** step * 500])  # to and fro: drifts add up, net displacement does not
    assert spent[0] > 16 * 2900 and max(spent[1:]) < spent[0] / 8


def test_texts_of_a_few_sets_are_found_without_a_shuffle(spark, monkeypatch):
    """Where keys are too many to broadcast by themselves, a map of bits leaves the other texts out before any exchange."""
    from tidewave.llm import tokengroups
    from tidewave.llm._common import written

    texts = varied(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    keys = written(tokengroups._rows(docs).where("doc_id % 10 = 0").select("k"), "keys")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for small in (0, 500_000):
            monkeypatch.setattr(tokengroups, "SMALL", small)
            found = tokengroups.rows_with(docs, keys)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert not any("Exchange" in line and "Broadcast" not in line for line in plan.split("\n")), plan
            assert {d for d in texts if d % 10 == 0} <= {r.doc_id for r in found.collect()}
            assert found.count() < len(texts) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sets_of_a_slice_are_made_at_once():
    """Shingle sets of an Arrow slice are those of the words, and take less than half the time of hashing shingle by shingle."""
    from time import process_time

    import pyarrow as pa

    from tidewave.llm import simhash, tokengroups

    odd = ["", " ", "a", "A b", "a B c", " a  b\tc\x0bD\x0ce\r\nf ", "é\x85É\x1cß\u2003x y z", "[@`{ AZaz", "x" * 64, "X" * 65 + " " + "y" * 5000, "12345678 123456789 1234567", "a b c a b c a b", "", "ab c", "a bc"]
    texts = pa.array([*odd, *[t or "" for t in varied(4).values()]])
    lists = [t.encode().lower().split() for t in texts.to_pylist()]
    for width in (3, 5):
        sets = tokengroups.shingle_sets(texts, width)
        shingles = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in lists]
        assert [len(x) for x in sets] == [len(x) for x in shingles] and all((x[1:] > x[:-1]).all() for x in sets)
        assert len(np.unique(np.concatenate(sets))) == len(set().union(*shingles))
        names = {}
        for x, own in zip(sets, shingles, strict=True):
            for h in x.tolist():
                names[h] = names.get(h, own) & own
        assert all(len(own) for own in names.values())  # one hash stands for the same shingle in all texts
        for a, b in ((0, 1), (3, 9), (12, len(texts))):
            for x, y in zip(tokengroups.shingle_sets(texts.slice(a, b - a), width), sets[a:b], strict=True):
                assert x.tolist() == y.tolist()
    assert tokengroups.shingle_sets(texts.slice(0, 0), 3) == [] and [len(x) for x in tokengroups.shingle_sets(pa.array(["", ""]), 3)] == [0, 0]
    rng = np.random.default_rng(5)
    large = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 10**6, 500)) for _ in range(400)])
    spent = []
    for make in (lambda: [np.unique(simhash.shingle_hashes(t, 3)) for t in large.to_pylist()], lambda: tokengroups.shingle_sets(large, 3)):
        made = []
        for _ in range(3):
            begun = process_time()
            sets = make()
            made.append(process_time() - begun)
        assert sum(map(len, sets)) == 400 * 498
        spent.append(min(made))
    assert spent[1] < spent[0] / 2


def test_large_unlike_sets_are_told_apart_by_signatures(spark):
    """Of pairs of large sets those that are alike pass, of any sizes, and those that share half of their text do not."""
    from tidewave.llm import tokengroups
    from tidewave.llm._common import written

    rng = np.random.default_rng(8)
    texts = {}
    for f, size in enumerate((1000, 1030, 1080, 2000, 2060, 2150, 4300, 8000)):
        base = [f"w{k}" for k in rng.integers(0, 10**6, size)]
        other = [f"w{k}" for k in rng.integers(0, 10**6, size // 2)]
        texts |= {10 * f: base, 10 * f + 1: base[: size * 19 // 20], 10 * f + 2: [*base[: size - 10], "x"], 10 * f + 3: base[: size // 2] + other}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    for rule in (tokengroups.Rule(), tokengroups.Rule(5, 4, 5), tokengroups.Rule(3, 40, 100)):
        known = written(tokengroups.prefix_rows(tokengroups._rows(docs), (np.zeros(0, np.int64),) * 2, rule), "sets")
        name = {r.s: r.doc_id for r in known.collect()}
        pairs = known.select(F.col("s").alias("a")).crossJoin(known.select(F.col("s").alias("b"))).where("a < b")
        wide = known.where("wide is not null").select("s", "wide")
        assert all(2 * r.n <= 64 * len(r.wide) <= 4 * r.n for r in known.where("wide is not null").collect()) and known.where("wide is null and n > 1024").count() == 0
        got = tokengroups.likely(written(tokengroups.possible(pairs, known, rule), "pairs"), wide, rule).collect()
        got = {tuple(sorted((name[r.a], name[r.b]))) for r in got}
        sets = {d: {tuple(w[i : i + rule.shingle]) for i in range(len(w) - rule.shingle + 1)} for d, w in texts.items()}
        alike = {(a, b) for a in sets for b in sets if a < b and rule.under * len(sets[a] & sets[b]) >= rule.over * len(sets[a] | sets[b])}
        assert alike <= got and len(alike) >= 24
        assert got == alike or rule.under == 100 and rule.over == 40


def brute_spelling(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {w: (lambda v: v if v and n[v] >= 2 * n[w] else None)(min(by[w], key=lambda v: (-n[v], v), default=None)) for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n}


def test_spelling(spark, monkeypatch):
    from tidewave.llm import spelling

    rng = np.random.default_rng(11)
    stems = ["banana", "annnna", "Élysée", "maison", "ouvrage", "aaaaa", "aaaaaa", "letter", "lettre", "bettes", "ÿÿÀ×÷é"]
    pool = []
    for stem in stems:
        for k in range(14):
            w = list(stem)
            for _ in range(int(rng.integers(0, 3))):
                i = int(rng.integers(0, len(w)))
                w[i : i + 1] = [["", "a", "é", "n"][int(rng.integers(0, 4))], w[i]][: int(rng.integers(0, 3))]
            pool.append(("".join(w), int(200 / (1 + k) ** 1.3)))
    every = [w for w, c in pool for _ in range(c)]
    rng.shuffle(every)
    rows = [(i, " ".join(every[i * 40 : i * 40 + 40]) + ("\n1Banana2" if i % 2 else "")) for i in range(len(every) // 40)]
    rows += [(None, "banana maison " * 9), (3, None), (4, ""), (5, "x" * 70000), rows[0], rows[0]]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, word int").repartition(3)
    want = brute_spelling(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == want and any(r[1] != (r[0] or w) for w, r in want.items())  # some roots are more than a step away
    assert spelling.variants(docs.where("false")).count() == 0


def test_no_table_of_words_is_broadcast(spark, tmp_path):
    """A written table of words is small to Spark, and the keys made of it are sized like it."""
    from tidewave.llm import spelling

    spark.createDataFrame([(i, " ".join(["letter", "lettre", "lettere", "better"][: 1 + i % 4])) for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsList().size()
    assert {r.word: r.root for r in spelling.variants(spark.read.parquet(str(tmp_path / "d"))).collect()}["lettere"] == "letter"
    ran = plans.executionsList().drop(before)
    text = "\n".join(ran.apply(i).physicalPlanDescription() for i in range(ran.size()))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_pivots_are_the_lightest_disjoint_pair():
    from tidewave.llm import spelling

    rng = np.random.default_rng(0)
    for _ in range(300):
        places = sorted(rng.choice(12, int(rng.integers(3, 7)), replace=False).tolist())
        weights = rng.integers(1, 9, len(places)).tolist()
        i, j = spelling.pivots_of(places, weights)
        best = min(weights[a] + weights[b] for a in range(len(places)) for b in range(a) if places[a] - places[b] >= 2)
        assert places[j] - places[i] >= 2 and weights[i] + weights[j] == best


def test_pivots_meet_few_words_that_are_not_near(spark):
    """Thousands of words of few bigrams: a pivot alone is shared by hundreds, but little more than the near words meet."""
    from tidewave.llm import spelling

    rng = np.random.default_rng(3)
    some = {"".join(w) for w in rng.choice(list("abcd"), (3000, 12))}
    for w in sorted(some)[:300]:
        i = int(rng.integers(0, 12))
        some |= {w[:i] + w[i + 1 :], w[:i] + "abcd"[int(rng.integers(0, 4))] + w[i:], w[:i] + "e" + w[i + 1 :]}
    met = [tuple(sorted(r)) for r in spelling.met_words(spark.createDataFrame([(w,) for w in sorted(some)], "word string").repartition(3)).collect()]
    brute = set()
    for w in some:
        near = [w[:i] + w[i + 1 :] for i in range(len(w))] + [w[:i] + c + w[j:] for c in "abcde" for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w)]
        brute |= {tuple(sorted((w, v))) for v in near if v != w and v in some}
    assert len(brute) > 800 and brute <= set(met) and len(met) < 20 * len(brute)


def test_memory_of_long_words_is_bounded(monkeypatch):
    """Thousands of distinct words of 50 KB leave nothing behind in what workers remember."""
    import public_tokenizers

    from tidewave.llm import bpe, langid

    codec = bpe.BytePairCodec(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(codec, "encode_word", lambda word: [1] * len(word))
    for i in range(3000):
        codec._known([f"{i}" + "x" * 50_000, f"w{i}"])
    assert len(codec.young) + len(codec.old) >= 3000 and sum(map(len, [*codec.young, *codec.old])) < 100_000
    pieces = langid.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    prob = np.repeat(langid.background(pieces), 2, axis=1)
    scorer = langid.WordScorer(pieces, prob)
    monkeypatch.setattr(langid, "long_forward", lambda pieces, word, prob: np.zeros(prob.shape[1]))
    for i in range(3000):
        scorer.texts([f"{i}" + "x" * 50_000 + f" w{i}"])
    assert sum(map(len, scorer.memo)) < 100_000 and len(scorer.scores) <= scorer.cap


def test_ids_of_a_very_long_text():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidewave.llm import bpe

    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgé \n"), 120_000)) + "x" * 20_000 + " z" * 5000
    path = public_tokenizers.path("byte_bpe_50k.json")
    (ids,) = bpe.BytePairCodec(path).encode(pa.array([text]))
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
