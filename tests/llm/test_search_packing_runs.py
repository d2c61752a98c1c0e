"""Lexical search, packing and periodic runs against brute force, with odd rows, ties and long repetitive texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical_search, packing, periodic_runs
from ledgerloom.llm.queries import PACKED_VOCABULARY, vocabulary_file

#: extra columns clash with those of results and intermediates
SCHEMA = "doc_id bigint, text string, score double, rank int, n int, terms string, length int, piece int, sequence_id bigint, runs string, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, "x", 3, 4, 5, "y", 6) for i, t in rows], SCHEMA)


# ---- lexical search


def plain_search(docs, items, k):
    def terms(text):
        return lexical_search.TERM.findall((text or "").translate(lexical_search.LOWER))

    bags = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(terms(t))
    out = set()
    for i, asked in queries.items():
        scored = []
        for place, (d, b) in enumerate(bags):
            m = 10 + 90 * sum(b.values()) * N // L if L else 10
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in asked if t in b)
            if s > 0:
                scored.append((-s, d is None, d, place))
        out |= {(i, r + 1, d, -s) for r, (s, _, d, _) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


def test_term_bytes_agree_with_the_pattern():
    import pyarrow as pa

    texts = ["".join(map(chr, range(128))), "Ünï-cödé_x", "", None, "ÀB\u0080 c　d İI", "a1 b2,c3"]
    for chosen in (pa.array(texts), pa.array(["skip", *texts])[1:]):
        found = [[w for w in ws if w] for ws in lexical_search.term_lists(chosen).to_pylist()]
        assert found == [lexical_search.TERM.findall((t or "").translate(lexical_search.LOWER)) for t in texts]


@pytest.mark.parametrize("seed, k, terms_a_pass", [(1, 3, 200_000), (2, 10, 5), (3, 1, 1)])
def test_search_equals_brute_force(spark, seed, k, terms_a_pass):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É1", "the", "THE", "日本"]

    def text(n):
        return rng.choice([" ", ", ", "-"]).join(rng.choice(words[: rng.choice([4, 20, 64])]) for _ in range(n))

    docs = [(i, text(rng.randint(0, 30))) for i in range(300)] + [(300, None), (301, ""), (302, " .,!\x00"), (None, "w1 w2"), (None, "w1 w2 w3")]
    docs += docs[:5] + [(303, "w1 " * 20000)]  # repeated rows, a long text
    items = [(i, text(rng.randint(1, 12))) for i in range(8)] + [(8, None), (9, "nowhere"), (None, "w1"), (3, "w7 w8"), (10, "w1 w1 W1 the The")]
    found = lexical_search.search(table(spark, docs).repartition(5), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id bigint, text string, score string"), k=k, terms_a_pass=terms_a_pass)
    rows = found.collect()
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, rows)) == Counter(plain_search(docs, items, k))


def test_search_of_empty_tables(spark):
    docs, items = table(spark, [(1, "a")]), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in lexical_search.search(table(spark, [(1, None), (2, "")]), items).collect()] == []


def test_no_accumulators_once_the_rest_cannot_reach_the_best():
    # the rare term gives 100, the frequent one 5 at most: documents with the frequent one alone are never scored
    rows, gain = np.r_[0, 1, 2, np.arange(1000)], np.r_[100, 100, 100, np.full(1000, 5)]
    best = lexical_search.Best(2)
    row, score = lexical_search.rank_batch([np.arange(3), np.arange(3, 1003)], rows, gain, 1000, best)
    assert row.tolist() == [0, 1, 2] and score.tolist() == [105, 105, 105]
    best.add(score, row, np.zeros(3, bool))
    row, score = lexical_search.rank_batch([np.arange(3, 1003)], rows, gain, 1000, best)
    assert len(row) == 0


# ---- packing


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64, 64, 4096), (64, 5, 4096), (64, 64, 900), (64, 3, 1100)])
def test_every_capacity_holds(by, capacity):
    rng = np.random.default_rng(4)
    length = rng.integers(1, 30, 500)
    need = packing.needs(length)
    chosen, left = packing.best_fit(need, capacity, (1.0, 0.5, 0.25), by)
    for d in range(3):
        used = np.bincount(chosen, need[d], left.shape[1])
        assert (used <= capacity[d]).all() and (left[d] == capacity[d] - used).all()
    assert sorted(set(chosen.tolist())) == list(range(left.shape[1]))


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_chooses_what_a_plain_search_would(by):
    rng = np.random.default_rng(5)
    need = packing.needs(rng.integers(1, 40, 120))
    capacity, weights = (64, 4, 2500), (1.0, 0.5, 0.25)
    chosen, _ = packing.best_fit(need, capacity, weights, by)
    order = np.argsort(-sum(w * need[d] / c for d, (w, c) in enumerate(zip(weights, capacity))), kind="stable")
    bins = []
    for i in order:
        x = need[:, i]
        fits = [b for b in bins if (b["left"] >= x).all()]

        def measure(b):
            if by == "norm":
                return sum(w * ((b["left"][d] - x[d]) / c) ** 2 for d, (w, c) in enumerate(zip(weights, capacity)))
            return -sum(w * b["left"][d] * x[d] / c**2 for d, (w, c) in enumerate(zip(weights, capacity)))

        if not fits:
            bins.append({"left": np.array(capacity)})
            fits = bins[-1:]
        mine = next(b for b in bins if b["left"] is not None and (b["left"] >= x).all() and b["name"] == chosen[i]) if "name" in fits[0] else fits[0]
        mine.setdefault("name", chosen[i])
        assert mine["name"] == chosen[i]
        assert measure(mine) <= min(measure(b) for b in fits) + 1e-9
        mine["left"] = mine["left"] - x


def test_a_piece_over_a_capacity_raises():
    with pytest.raises(ValueError):
        packing.best_fit(packing.needs(np.array([50])), (64, 4, 100), (1, 1, 1))
    with pytest.raises(ValueError):
        packing.best_fit(packing.needs(np.array([5])), (64, 4, 100), (1, 1, 1), "worst")


ODD = ["", None, " ", "a", "A.b, It's <|endoftext|> <|EndOfText|>x", "É é́ ΣΑΣ İ ﬁ \x00\x85 ​ 日本語, 12 345", "x" * 5000, "word " * 9000, "<|startoftext|>.,a."]


def test_pieces_are_the_library_s_and_sequences_are_whole(spark):
    import tokenizers

    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(["a", "Be", "é", ".", ",", " ", "  ", "\n", "'S", "'ll", "<|", "7", "日", "<|endoftext|>"]) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id"), (3, "again"), (3, "again")]
    made = packing.pieces(table(spark, rows).repartition(3), "doc_id", "text", vocabulary_file(PACKED_VOCABULARY), with_ids=True)
    placed = packing.pack(made, block=64).collect()
    library = tokenizers.Tokenizer.from_file(vocabulary_file(PACKED_VOCABULARY))
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    by_sequence = {}
    for r in placed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in by_sequence.values():
        end = 0
        for offset, length, ids in sorted(parts):
            assert offset == end and len(ids) == 4 * length
            end += length
        assert end <= 2048
    fewest = math.ceil(sum(r.length for r in placed) / 2048)
    assert len(by_sequence) <= fewest + 2
    df = spark.createDataFrame(placed, made.schema.add("sequence_id", "long").add("offset", "long"))
    whole = {r.sequence_id: (bytes(r.ids), r.n_tokens, r.n_pieces) for r in packing.sequences(df).collect()}
    assert whole == {s: (b"".join(x[2] for x in sorted(p)), sum(x[1] for x in p), len(p)) for s, p in by_sequence.items()}


def test_packing_of_an_empty_table(spark):
    made = packing.pieces(table(spark, []), "doc_id", "text", vocabulary_file(PACKED_VOCABULARY))
    assert packing.pack(made).count() == 0


def test_vocabularies_that_join_across_white_space_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pieces(table(spark, [(1, "a")]), "doc_id", "text", vocabulary_file("byte_bpe_50k.json"))


# ---- periodic runs


def plain_runs(w, least=6, exponent=4):
    out = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def odd_words(rng, n):
    w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n + 1), rng.randint(1, max(1, n // 4))
        for i in range(a + p, min(n, a + rng.randint(0, n))):
            w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        docs = [odd_words(rng, rng.randint(0, 70)) for _ in range(rng.randint(0, 4))]
        least, exponent = rng.choice([(6, 4), (6, 4), (1, 4), (12, 5)])
        of, rows = periodic_runs.runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64), least, exponent)
        found = [[] for _ in docs]
        for o, r in zip(of.tolist(), rows.tolist()):
            found[o].append(tuple(r))
        assert found == [plain_runs(d, least, exponent) for d in docs]


def test_hashes_that_agree_on_unlike_words_decide_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mixed", lambda x: np.ones(len(x), np.uint64))
    w = [0, 1] * 6 + [2] + [0, 1] * 6 + [3, 4, 5] * 5
    _, rows = periodic_runs.runs(np.array(w), np.array([len(w)]))
    assert [tuple(r) for r in rows.tolist()] == plain_runs(w)


def test_wavelet_matrix():
    rng = np.random.default_rng(8)
    for n in (1, 2, 63, 64, 65, 300):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletMatrix(values)
        low = rng.integers(0, n, 50)
        high = low + rng.integers(0, n - low + 1)
        x = rng.integers(0, n, 50)
        assert tree.below(low, high, x).tolist() == [(values[a:b] < v).sum() for a, b, v in zip(low, high, x)]
        full = high > low
        k = rng.integers(0, np.maximum(high - low, 1))
        assert tree.nth(low[full], high[full], k[full]).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(low[full], high[full], k[full])]


def test_suffix_array():
    rng = random.Random(9)
    for _ in range(50):
        text = [rng.randrange(3) for _ in range(rng.randint(1, 40))] + [99]
        assert periodic_runs.suffix_array(np.array(text), lambda *_: None).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def digest_row(key, words):
    found = plain_runs(words)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    rng = random.Random(10)
    texts = [rng.choice([" ", "\n", " \t\x0b\x0c\r "]).join("wéxyz日klm"[x] for x in odd_words(rng, rng.randint(0, 90))) for _ in range(400)]
    rows = [*enumerate(texts + ["", None, "  ", "a a a a " * 5, "\x1c \x85 " * 8]), (None, "b " * 9), (5, texts[5]), (5, texts[5])]
    planted = periodic_runs.with_planted_runs(table(spark, rows).repartition(3), "doc_id", "text")
    found = periodic_runs.digests(periodic_runs.periodic_runs(planted, "doc_id", "text"), "doc_id")
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str("" if i is None else i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
        want[digest_row(i, w)] += 1
    assert Counter(map(tuple, found.collect())) == want
    assert found.limit(0).count() == 0 and periodic_runs.periodic_runs(table(spark, []), "doc_id", "text").count() == 0


@pytest.mark.parametrize("text", ["a " * 200_000, "a b " * 100_000, "a b c d e f g " * 30_000 + "x", " ".join(map(str, range(5000))) + " y" * 50_000])
def test_long_repetitive_texts(spark, text):
    start = time.time()
    row = periodic_runs.periodic_runs(table(spark, [(1, text)]), "doc_id", "text").select("n_words", F.size("runs").alias("n"), F.length("collapsed").alias("kept")).first()
    assert row.n_words == len(text.split()) and row.n == 1 and row.kept < 30_000
    assert time.time() - start < 30
