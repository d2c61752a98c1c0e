"""Text operators against brute force, exact round trips and held-out labels, on small fixtures with odd rows."""

import gzip
import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chat_format, decontaminate, language, license_scan, minhash, toxicity, warc
from ledgerloom.llm.common import crc_bucket
from ledgerloom.llm.components import components
from ledgerloom.llm.queries import vocabulary_file

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars int, ids string, decoded string, score double"


def documents(spark, texts, langs=None):
    """Rows with columns whose names clash with those of results, and one row of NULLs."""
    rows = [(i, t, langs[i] if langs else None, "s", None, "x", "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None,) * 8], DOCUMENTS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = ["", " ", "  a  b ", "a\tb\n\nc", "▁x ▁▁", "<s> </s> <0x0A> \x00 é 😀 ", "日本語" * 40, "a" * 3000, "ab" * 700 + " " * 33, "x"]


def test_bpe_equals_the_library(spark):
    import sentencepiece

    rng = random.Random(3)
    texts = ODD + ODD[:3] + ["".join(rng.choice("aehtnio s  \n.é日😀▁tre") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    reference = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file())
    df = documents(spark, texts)
    found = {r.doc_id: r for r in bpe.digests(df, "doc_id", "text", vocabulary_file()).collect()}
    assert len(found) == df.count()
    for i, t in [*enumerate(texts), (None, "")]:
        ids = reference.encode(t, add_bos=True, add_eos=True)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(reference.decode(ids).encode()).hexdigest()
    row = bpe.round_trip(df.where("doc_id = 2"), "doc_id", "text", vocabulary_file()).select(bpe.unpacked().alias("x"), "decoded").first()
    assert row.x == reference.encode(texts[2], add_bos=True, add_eos=True) and row.decoded == texts[2]
    assert bpe.digests(df.limit(0), "doc_id", "text", vocabulary_file()).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "etaoin", "aein", "ABCab-_/.=", "日本é▁the", "the"])
def test_long_words_equal_the_library(letters):
    import sentencepiece

    rng = random.Random(letters)
    reference = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file())
    vocabulary = bpe.load_vocabulary(vocabulary_file())
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(60, 900))) for _ in range(60)] + ["x " + letters * 40 + " y"]
    ids, starts = bpe.Encoder(vocabulary).encode(pa.array(texts))
    for t, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == reference.encode(t, add_bos=True, add_eos=True)


def test_a_very_long_word_takes_seconds():
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80_000))
    vocabulary = bpe.load_vocabulary(vocabulary_file())
    start = time.process_time()
    bpe.merge_words([word], vocabulary)
    assert time.process_time() - start < 5  # with one rank a round: over 15


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 2) for i in range(0, 40, 2)] + [(100, 7), (500, 500)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {k: v for k, v in root.items() if k != 500}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # several blocks of the same few documents
    rng = random.Random(8)
    texts = ["", " \t\n", "one two", "One  TWO", "one two three four five", "É one two", "é one two"]
    for group in range(6):
        base = words(rng, 150).split()
        for _ in range(30 if group == 0 else 4):
            copy = base[:]
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    texts += [words(rng, rng.randint(1, 60), 10**6) for _ in range(30)] + [words(rng, 6000)]
    texts += [texts[-1], texts[-1]]
    want = brute_components(texts)
    df = documents(spark, texts)
    found = minhash.near_duplicates(df).collect()
    assert len(found) == df.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    nulls = [r for r in found if r.doc_id is None]
    assert nulls and all(r.kept and r.component_id is None for r in nulls)
    assert len({c for _, c in want.values()}) < len(want)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_shared_keys_share_a_component(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()} >= {(1, 1), (2, 1)}


def test_decontamination(spark):
    rng = random.Random(4)
    items = [words(rng, n, 5000).replace("w", "t" + "abcdefghij"[n % 10]) for n in (30, 40, 25, 3, 0)]
    letters = lambda s: re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], s)
    items = [letters(x) for x in items]
    noise = lambda n: letters(words(rng, n, 9000))
    swapped = items[1].split()
    swapped = " ".join(swapped[20:] + ["zz", "yy"] + swapped[:20])
    texts = [noise(200) + " " + items[0] + " " + noise(5000), swapped, noise(50), items[0][: len(items[0]) // 4], items[3] + " " + noise(3), "", items[2].upper() + "!"]
    df = documents(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (None, "x"), (9, None)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (4, 3), (6, 2)}
    assert found[0, 0].n_tiles == 1 and found[0, 0].coverage == 1.0
    assert found[1, 1].n_tiles == 2 and found[1, 1].covered == 40
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def brute_tiles(item, text, least):
    """Greedy string tiling by looking at every pair of places."""
    a, b, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(item)), range(len(text))):
            n = 0
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and a[i + n] and b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
        if best[2] < least:
            return out
        out.append(best)
        i, j, n = best
        a[i : i + n], b[j : j + n] = [False] * n, [False] * n


def test_tiles_equal_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        item = [rng.randrange(1, 5) for _ in range(rng.randint(0, 25))]
        text = [rng.randrange(1, 6) for _ in range(rng.randint(0, 60))]
        found = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert found == brute_tiles(item, text, 3)


def test_windows_do_not_depend_on_their_place():
    w = np.random.default_rng(1).integers(1, 2**63, 40, dtype=np.uint64)
    for n in (1, 5, 8, 9, 20):
        assert decontaminate.windows(np.r_[w[7:], w], n)[33] == decontaminate.windows(w, n)[0]


def test_language_of_mixed_and_odd_texts(spark):
    rng = random.Random(2)
    stock = {"aa": "the of and that with from this".split(), "bb": "der die und nicht mit von das".split(), "cc": "и не на что он как это".split()}
    texts, langs = [], []
    for i in range(240):
        lang = rng.choice(sorted(stock))
        texts.append(" ".join(rng.choices(stock[lang], k=rng.randint(8, 60))))
        langs.append(lang)
    mixed = " ".join(stock["aa"] * 6 + stock["bb"] * 3)
    texts += [mixed, "", "123 !!", "日本語", "w"]
    langs += [None] * 5
    df = documents(spark, texts, langs)
    model = language.train(df.where(~language.held_out("doc_id")), "text", "lang", "doc_id")
    found = {r.doc_id: r for r in language.label_spans(df, "doc_id", "text", model).collect()}
    assert sum(found[i].lang_pred == langs[i] for i in range(240)) >= 238
    assert found[240].lang_pred == "aa" and [s.lang for s in found[240].spans] == ["aa", "bb"] and found[240].spans[1].n_words == 21
    assert found[241].lang_pred == found[242].lang_pred == found[None].lang_pred == "und"
    assert found[243].lang_pred in stock and found[243].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    none = language.train(df.where("lang = 'zz'"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in language.label_spans(df, "doc_id", "text", none).collect()} == {"und"}


def test_a_rare_language_is_learned_from_all_its_rows(spark):
    texts = ["the of and that with from"] * 400 + ["der die und nicht mit von"] * 400 + ["и не на что он как"] * 2
    df = documents(spark, texts, ["aa"] * 400 + ["bb"] * 400 + ["cc"] * 2)
    model = language.train(df, "text", "lang", "doc_id", max_rows=60)
    found = {r.doc_id: r for r in language.label_spans(df, "doc_id", "text", model).collect()}
    assert [found[i].lang_pred for i in (0, 400, 800)] == ["aa", "bb", "cc"] and found[800].score == 1


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 7):
        scores = rng.normal(size=(n, 3)).astype(np.float32)
        found = language.viterbi(scores, np.array([n, 0]), 0.7)
        value = lambda path: sum(scores[i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert abs(value(best) - value(found.tolist())) < 1e-4


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    texts, toxic = [], []
    for _ in range(1200):
        bad = rng.random() < 0.2
        w = [f"{'abcdefgh'[rng.randrange(8)]}{'aeiou'[rng.randrange(5)]}{'lmnprst'[rng.randrange(7)]}{'aeiou'[rng.randrange(5)]}" for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["Foulword!", "grubbish,", "nastyish"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 2] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    rows = toxicity.score(df, model).withColumn("held_out", crc_bucket("doc_id", 4) == 2).collect()
    assert len(rows) == df.count()
    held = [(r.score >= toxicity.THRESHOLD, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.train(df, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(df, nothing).collect()} == {0.0}


def test_toxicity_features_do_not_depend_on_partitions(spark):
    rng = random.Random(11)
    rows = [(" ".join(f"{'abcdefgh'[rng.randrange(8)]}{'aeiou'[rng.randrange(5)]}{'lmnprst'[rng.randrange(7)]}" for _ in range(12)) + (" foulword" if i < 30 else ""), int(i < 600)) for i in range(2100)]
    sample = spark.createDataFrame(rows, "text string, positive int")
    found = [toxicity.bucket_counts(sample.repartition(n), 768, 4.5) for n in (1, 200)]
    assert len(found[0]) and found[0].tolist() == found[1].tolist()



def test_chat_round_trip(spark):
    rng = random.Random(1)
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "", None, "a\nb", "<|", "<\\\\|x|>", "é😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole"]), rng.choice(said)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"{t} " * 20) for t in range(300)] + [(None, 0, "user", "x"), (3, None, "user", "y"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.render_turns(df, window_turns=16)).collect()}
    turns = {}
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert set(found) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert found[c].n_turns == len(own) and found[c].n_rewrites == 0
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[c].formatted_chars == len(chat_format.marked_turns(own))


@pytest.mark.parametrize("before, after", [("<|im_start|>", "<|im_end|>"), (">", "<"), ("aa", "aa"), ("", "\ue000")])
def test_loss_spans_stand_at_the_text(spark, before, after):
    """Texts that begin or end like the marks beside them: places are compared, not only characters."""
    said = ["<", "<<", "<|", ">", ">>", "a", "aaa", "", "\ue000", "x", "<|im_end|>"]
    rows = [(1, i, "assistant", t, 0, "clash") for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, loss_start int, rendered string")
    template = lambda turns: "".join(f"{before}{t}{after}\n" for _, t in turns)
    found = chat_format.render_turns(df, template, escaped=str).orderBy("n").collect()
    assert [(r.loss_start - r.span_start, r.loss_end - r.loss_start) for r in found] == [(len(before), len(t)) for t in said]
    marked = chat_format.render_turns(df).orderBy("n").collect()
    opening = len(chat_format.START + "assistant\n")
    assert [(r.loss_start - r.span_start, r.loss_end - r.loss_start) for r in marked] == [(opening, len(chat_format.escape(t))) for t in said]
    trimmed = chat_format.render_turns(df.limit(1).withColumn("text", F.lit(" x ")), lambda turns: "".join(f"[{t.strip()}]" for _, t in turns), escaped=str).first()
    assert trimmed.loss_start is None and trimmed.loss_end is None and trimmed.rendered == "[x]"


def test_templates_that_rewrite_history_are_marked(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(4)], "conv_id bigint, turn int, role string, text string")

    def only_last_thought(turns):
        return "".join(f"[{r}:{t if i == len(turns) - 1 else t.upper()}]" for i, (r, t) in enumerate(turns))

    found = chat_format.render_turns(df, only_last_thought, escaped=str).orderBy("n").collect()
    assert [r.rewrites_history for r in found] == [False, True, True, True]
    assert found[1].loss_start is None


def test_windows_give_what_whole_prefixes_give(spark):
    df = spark.createDataFrame([(c, i, "user" if i % 2 == 0 else "assistant", f"t{i} " * 3) for c, n in ((1, 150), (2, 5)) for i in range(n)], "conv_id bigint, turn int, role string, text string")

    def numbered(turns):
        return "".join(f"[{i} {r}:{t}]" for i, (r, t) in enumerate(turns))

    def strips_earlier(turns):
        return "".join(f"[{r}:{t if i > len(turns) - 20 else ''}]" for i, (r, t) in enumerate(turns))

    def drops_old(turns):
        return "".join(f"[{r}:{t}]" for r, t in turns[-100:])

    for template in (numbered, strips_earlier, drops_old):
        whole = chat_format.render_turns(df, template, escaped=str, window_turns=1000).orderBy("conv_id", "n").collect()
        assert chat_format.render_turns(df, template, escaped=str).orderBy("conv_id", "n").collect() == whole
        assert any(r.rewrites_history for r in whole) == (template is not numbered)
    whole = chat_format.render_turns(df, numbered, escaped=str, window_turns=1000).orderBy("conv_id", "n").collect()
    assert chat_format.render_turns(df, numbered, escaped=str, window_chars=100).orderBy("conv_id", "n").collect() == whole



@pytest.mark.parametrize("text", ["<|x", "<\\|", "a<\\\\||b", "<|im_start|>", "<", "|"])
def test_escape(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)


def test_warc_derivatives(spark, tmp_path):
    page = '<html><head><title>A &amp; b</title><script>x("</p>")</script></head><body><p>One  two<br>three &lt;</p><a href="/x?a=1&amp;b">l</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/b", page), (2, None, None), (3, "http://c d", ""), (3, "http://c d", "")], "page_id bigint, url string, html string")
    derived = warc.derive(warc.responses(pages)).collect()
    assert sorted((r.page_id, r.record_type) for r in derived) == sorted([(i, t) for i in (1, 2, 3, 3) for t in ("conversion", "metadata")])
    conversion = next(r for r in derived if r.page_id == 1 and r.record_type == "conversion")
    assert conversion.block == "One two\nthree <\nl" and conversion.source_digest_ok and conversion.n_links == 1
    headers, block = warc.parse_record(warc.response_record("1", "http://a/b", page.encode(), "1970-01-01T00:00:00Z"))
    assert conversion.refers_to == headers["warc-record-id"] and conversion.source_payload_digest == warc.digest(page.encode())
    assert warc.parse_http(block)[2] == page.encode()
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n"), (4, b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nx")], "page_id bigint, warc binary")
    assert sorted((r.page_id, r.record_type) for r in warc.derive(bad).collect()) == [(1, "error"), (2, "error"), (4, "error")]
    warc.write_records(warc.derive(warc.responses(pages.where("page_id = 1"))), str(tmp_path / "warc"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    kinds = []
    while data:
        headers, block = warc.parse_record(data)
        assert warc.digest(block) == headers["warc-block-digest"]
        kinds.append(headers["warc-type"])
        data = data[data.index(b"\r\n\r\n") + 4 + len(block) + 4 :]
    assert sorted(kinds) == ["conversion", "metadata"]


def http_record(body, uri="http://a", kind="text/html", **headers):
    lines = [b"HTTP/1.1 200 OK", f"Content-Type: {kind}".encode(), *(f"{k.replace('_', '-')}: {v}".encode() for k, v in headers.items())]
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", uri), ("WARC-Date", "2020-01-01T00:00:00Z")], b"\r\n".join(lines) + b"\r\n\r\n" + body)


def chunked(body, n=7):
    parts = [body[i : i + n] for i in range(0, len(body), n)]
    return b"".join(b"%x;q=1\r\n%s\r\n" % (len(x), x) for x in parts) + b"0\r\nTrailer: 1\r\n\r\n"


def test_warc_encodings_are_undone():
    page = "<title>Grüße</title><p>schöne Grüße aus Köln, schöne Grüße</p>"
    plain, want = page.encode(), "schöne Grüße aus Köln, schöne Grüße"
    raw = zlib.compressobj(wbits=-15)
    cases = [
        (gzip.compress(plain), {"Content_Encoding": "gzip"}), (gzip.compress(plain[:20]) + gzip.compress(plain[20:]), {"Content_Encoding": "x-gzip"}),
        (zlib.compress(plain), {"Content_Encoding": "deflate"}), (raw.compress(plain) + raw.flush(), {"Content_Encoding": "deflate"}),
        (chunked(plain), {"Transfer_Encoding": "chunked"}), (chunked(gzip.compress(plain)), {"Transfer_Encoding": "chunked", "Content_Encoding": "gzip"}),
        (gzip.compress(zlib.compress(plain)), {"Content_Encoding": "deflate, gzip"}), (plain, {"Content_Encoding": "identity"}),
        (b"\xef\xbb\xbf" + plain, {}), ("\ufeff".encode("utf-16-le") + page.encode("utf-16-le"), {}),
        (b"<meta charset='latin-1'>" + page.encode("latin-1"), {}), (b'<meta content="text/html; charset=ISO-8859-1">' + page.encode("latin-1"), {}),
        (b"<meta charset='no such'>" + plain, {}),
    ]
    for body, headers in cases:
        meta, text = warc.derivatives(http_record(body, **headers))
        assert text["block"] == want and json.loads(meta["block"])["html"]["title"] == "Grüße" and meta["error"] is None
        assert text["source_payload_digest"] == warc.digest(body)
    assert warc.derivatives(http_record(page.encode("latin-1"), kind="text/html; charset=latin-1"))[1]["block"] == want
    broken = [
        (plain, {"Content_Encoding": "gzip"}), (gzip.compress(plain)[:-9], {"Content_Encoding": "gzip"}), (plain, {"Content_Encoding": "br"}),
        (chunked(plain)[:-20], {"Transfer_Encoding": "chunked"}), (b"zz\r\n", {"Transfer_Encoding": "chunked"}),
    ]
    for body, headers in broken:
        (row,) = warc.derivatives(http_record(body, **headers))
        assert row["record_type"] == "metadata" and row["error"] and row["source_payload_digest"] == warc.digest(body)
    assert warc.derivatives(http_record(gzip.compress(bytes(5000)), Content_Encoding="gzip"), most=4999)[0]["error"]
    assert warc.derivatives(http_record(b"", Content_Encoding="gzip"))[1]["block"] == ""


@pytest.mark.parametrize("unit", ["<a ", "<title>", '<a "> "x', "<a x='>", '<a href="', "<!--", "<script ", "</title", "<", '<a =" ', "<meta "])
@pytest.mark.parametrize("end", ["", ">"])
def test_warc_page_of_malformed_tags_takes_linear_time(unit, end):
    start = time.time()
    page = unit * 60_000 + end
    warc.derivatives(http_record(page.encode()))
    assert time.time() - start < 5


def test_warc_tags():
    page = '<a title="a > b" href=/x>l</a> <!-- <p> --> 1 < 2 <p\n class=x>t<script>if (a<b) "</p>"</script >u<A HREF=\'y&amp;z\'></a><textarea>k</textarea><titles>'
    assert warc.read_page(page) == ("l 1 < 2\ntuk", None, ["/x", "y&z"])
    assert warc.read_page("a<title>x</titlex></title>b<title>z") == ("ab", "x</titlex>", [])


def test_warc_files_are_read(spark, tmp_path):
    records = [http_record(f"<p>page {i}</p>".encode() + b"\r\n\r\nWARC/1.0\r\n", uri=f"http://a/{i}") for i in range(300)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "d.warc").write_bytes(records[0] + b"noise")
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(records[0])[:-12])
    (tmp_path / "f.warc").write_bytes(b"")
    found = warc.read_records(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    rows = found.collect()
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        own = sorted((r.offset, r.warc) for r in rows if r.path == name)
        assert [warc.parse_record(x) for _, x in own] == [warc.parse_record(x) for x in records]
        assert [x for x, _ in own] == [sum(map(len, records[:i])) for i in range(300)]
    kinds = warc.derive(found.withColumn("id", F.concat_ws(":", "path", "offset")), "id").groupBy(F.split("id", ":")[0], "record_type").count().collect()
    odd = sorted(tuple(r) for r in kinds if r[0][0] in "def")
    assert odd == [("d.warc", "conversion", 1), ("d.warc", "error", 1), ("d.warc", "metadata", 1), ("e.warc.gz", "error", 1)]


def test_toxicity_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(4)
    signs = set()
    for _ in range(40):
        p, u = rng.integers(0, 2, (rng.integers(1, 9), 5)).astype(float), rng.integers(0, 2, (rng.integers(1, 20), 5)).astype(float)
        w, prior = rng.normal(size=6) * 2, rng.uniform(0.05, 0.9)

        def loss(z):
            return np.mean([math.log1p(math.exp(-x)) for x in z])

        def negative(w):
            return loss(-(u @ w[:-1] + w[-1])) - prior * loss(-(p @ w[:-1] + w[-1]))

        whole = lambda w: prior * loss(p @ w[:-1] + w[-1]) + negative(w)
        risk = whole if negative(w) >= 0 else lambda w: -negative(w)
        signs.add(negative(w) >= 0)
        steps = np.eye(6) * 1e-6
        assert np.allclose(toxicity.gradient(w, p, u, prior), [(risk(w + s) - risk(w - s)) / 2e-6 for s in steps], atol=1e-5)
    assert signs == {True, False}


def test_toxicity_sample_is_bounded_where_rows_repeat(spark):
    rows = spark.range(6000).selectExpr("if(id < 3000, 1, id) as key", "if(id < 2000, 'same', concat('t', id)) as text").withColumn("text", F.when(F.col("key") != 5000, F.col("text")))
    found = [sorted((r.text or "" for r in toxicity.drawn(rows.repartition(n), "drawn", 500, 6000).collect())) for n in (1, 40)]
    assert found[0] == found[1] and 300 < len(found[0]) <= 500 and len(set(found[0])) == len(found[0])
    assert len(toxicity.drawn(rows, "drawn", 500).collect()) == 500
    assert len(toxicity.drawn(rows, "drawn", 10_000, 6000).collect()) == 4001
    assert toxicity.drawn(rows.where("false"), "drawn", 5).count() == 0


def test_languages_are_bounded(spark):
    df = spark.range(400).selectExpr("id as doc_id", "if(id < 300, 'the of and that', 'der die und nicht') as text", "if(id < 300, 'aa', if(id < 390, 'bb', concat('x', id))) as lang")
    with pytest.warns(UserWarning, match="more than 2 languages"):
        model = language.train(df, "text", "lang", "doc_id", max_languages=2)
    assert model.languages == ["aa", "bb"]
    assert language.train(df, "text", "lang", "doc_id").languages[:2] == ["aa", "bb"]


@pytest.mark.parametrize("kinds", [1, 2, 30])
def test_tiling_of_few_kinds_of_words_takes_no_long(kinds):
    rng = np.random.default_rng(kinds)
    h = rng.integers(1, 1 << 62, kinds).astype(np.uint64)
    item, text = h[rng.integers(0, kinds, 4000)], h[rng.integers(0, kinds, 40_000)]
    start = time.time()
    found = decontaminate.tiles(item, text, 5)
    assert time.time() - start < 10
    marked = np.zeros(len(item), int)
    for i, j, n in found:
        assert n >= 5 and (item[i : i + n] == text[j : j + n]).all()
        marked[i : i + n] += 1
    assert marked.max() <= 1 and [n for _, _, n in found] == sorted((n for _, _, n in found), reverse=True)


def test_license_scan(spark):
    texts = [
        "Released under the MIT License.", "mit\n-- LICENSE mit  license x", "Licensed under the Apache License, Version 2.0.", "General-Public License", "", "smit license",
        "Licensed under CC BY-NC 4.0.", "no word of it", "mit " * 4000 + "license", "É mit license",
    ]
    df = documents(spark, texts)
    found = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert len(found) == df.count()
    for i, text in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = [(k, label) for k in range(len(w)) for phrase, label in license_scan.BASE if tuple(w[k : k + len(phrase)]) == phrase]
        r = found[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert found[2].labels == "apache,apache-2.0" and found[6].labels == "cc-by-nc-4.0" and found[7].labels == "" and found[7].score == 0
    assert license_scan.scan(df.limit(0)).count() == 0
    assert len(license_scan.RULES) > 300
    twice = license_scan.scan(df.where("doc_id = 0").union(df.where("doc_id = 0"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def shortest(parsed):
    """A text that a parsed pattern matches: first branches, least repetitions."""
    out = ""
    for kind, what in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(what)
        elif kind == "MAX_REPEAT":
            out += shortest(what[2]) * what[0]
        elif kind == "BRANCH":
            out += shortest(what[1][0])
        elif kind == "SUBPATTERN":
            out += shortest(what[3])
        elif kind == "IN":
            out += chr(what[0][1] if str(what[0][0]) == "LITERAL" else what[0][1][0])
        else:
            assert kind in ("ASSERT", "ASSERT_NOT")
    return out


def test_every_license_rule_finds_its_example(spark):
    examples = [shortest(re._parser.parse(r[4])) for r in license_scan.RULES]
    texts = [*examples, "Copyright (c) 2020 Acme Corp", "Copyright Acme", "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    found = {r.doc_id: r.labels.split(",") for r in license_scan.scan(documents(spark, texts)).collect()}
    assert [(t, r[1]) for i, (t, r) in enumerate(zip(examples, license_scan.RULES)) if r[1] not in found[i]] == []
    assert [found[len(examples) + i] for i in range(3)] == [["copyright"], ["copyright"], ["mit"]]


def branches(parsed):
    """Texts that a parsed pattern matches: every branch, least repetitions."""
    out = [""]
    for kind, what in parsed:
        kind = str(kind)
        if kind == "BRANCH":
            ends = [x for branch in what[1] for x in branches(branch)]
        elif kind == "MAX_REPEAT":
            ends = [x * what[0] for x in branches(what[2])] if what[0] else [""]
        elif kind == "SUBPATTERN":
            ends = branches(what[3])
        else:
            ends = [shortest([(kind, what)])]
        out = [a + b for a in out for b in ends]
    return out


def test_the_gate_of_names_lets_every_match_through():
    for _, _, _, keyword, pattern, names in license_scan.RULES:
        for text in branches(re._parser.parse(pattern)):
            assert any(w in text for w in names), (pattern, text, names)


def test_license_priority_and_containment_equal_brute_force(spark):
    rng = random.Random(12)
    rules = rng.sample(license_scan.RULES, 60)
    some = [t for r in rules for t in branches(re._parser.parse(r[4]))][:200]
    texts = [" ".join(rng.choice(some + ["x", "license", "the", "gpl", "version 2 0"]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    found = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        s = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())) + " "
        hits = [(m.start(), m.end(), p, n, label) for n, label, p, _, pattern, _ in license_scan.RULES for m in re.finditer(pattern, s)]
        labels, weight = set(), 0
        for a, b, p, n, label in hits:
            above = any(q > p and c <= a and d >= b for c, d, q, *_ in hits)
            beside = any(q == p and (c, -d, m) < (a, -b, n) and d >= b and (c, d, lab) != (a, b, label) for c, d, q, m, lab in hits)
            if not above and not beside:
                labels.add(label)
                weight = max(weight, license_scan.WEIGHT[p])
        base = set(found[i].base_labels.split(",")) - {""}
        assert set(found[i].labels.split(",")) - {""} == labels | base, text
        assert found[i].score == max(weight, 0.6 if base else 0)


def test_many_license_hits_in_one_text(spark):
    start = time.time()
    row = license_scan.scan(documents(spark, ["Licensed under the MIT License. x " * 16_000])).where("doc_id = 0").first()
    assert row.n_base == 16_000 and row.labels == "mit" and time.time() - start < 60


def test_numbers_are_no_letters(spark):
    from ledgerloom.llm.common import letters_only

    assert [letters_only(w) for w in ("²½①", "x²y", "Ⅷ", "日本3語", "ABC_d", "½")] == ["", "x y", "", "日本 語", "abc d", ""]
    model = language.train(documents(spark, ["the cat and the dog", "der Hund und die Katze"], ["en", "de"]), "text", "lang", "doc_id")
    found = {r.doc_id: r.lang_pred for r in language.label_spans(documents(spark, ["² ½ ①", "the dog ²"]), "doc_id", "text", model).collect()}
    assert found[0] == "und" and found[1] == "en"


def test_slices_cover_all_rows():
    from ledgerloom.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 900, 3)] + [None])], ["text"])
    assert [t for b in slices(iter([batch]), "text", 10) for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()
