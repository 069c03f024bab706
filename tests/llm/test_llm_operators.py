"""The training-data operators against brute force, on small and odd input."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from metaloom.llm import anchors, base, bpe, components, decontam, dom, fingerprint, fmindex, htmlcrf, linededup, lpf, simhash, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` int, `found` string, `doc` string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those inside the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(150)]
    passage = " ".join(r.choices(vocabulary, k=40))
    line = "A common line that is surely longer than forty characters, " + " ".join(r.choices(vocabulary, k=4))
    texts = [None, "", " \t\n", "one", "a b", "é" * 60]
    for k in range(60):
        t = " ".join(r.choices(vocabulary, k=r.randint(5, 120)))
        if k % 4 == 0:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if k % 3 == 0:
            t += "\n \t" + (line if k % 2 else line.upper()) + " \n" + t[:50]
        texts.append(t)
    texts += [texts[10], texts[10], texts[12] + " tail", texts[13].replace(" ", "  ", 3), "x" * 500, "x" * 400, "ab " * 200]
    return texts


def brute_windows(units, k, doc_of):
    first = {}
    for i, u in enumerate(units):
        for j in range(len(u) - k + 1):
            w = tuple(u[j : j + k])
            first[w] = min(first.get(w, doc_of[i]), doc_of[i])
    out = []
    for i, u in enumerate(units):
        gone = np.zeros(len(u), bool)
        for j in range(len(u) - k + 1):
            if first[tuple(u[j : j + k])] < doc_of[i]:
                gone[j : j + k] = True
        out.append(gone)
    return out


def test_fm_index_against_brute_force(spark, corpus):
    got = by_id(fmindex.deduplicated(docs(spark, corpus)))
    units = [(t or "").encode().split() for t in corpus]
    for i, (u, gone) in enumerate(zip(units, brute_windows(units, 13, range(len(units))), strict=True)):
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(u), gone.sum(), hashlib.sha256(kept).hexdigest())


def test_lpf_against_brute_force(spark, corpus):
    got = by_id(lpf.deduplicated(docs(spark, corpus)))
    units = [(t or "").encode() for t in corpus]
    for i, (u, gone) in enumerate(zip(units, brute_windows(units, 50, range(len(units))), strict=True)):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(u), gone.sum(), spans, hashlib.sha256(kept).hexdigest())


def test_windows_with_repeated_ids_and_rows(spark, corpus):
    text = corpus[20]
    ids = [5, 5, 5, 9, None]
    texts = [text, text, text + " more words", text, "short"]
    rows = lpf.deduplicated(docs(spark, texts, ids)).collect()
    assert len(rows) == 5
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] != 9)  # one document does not remove from itself
    assert next(r for r in rows if r["doc_id"] == 9)["n_removed"] == len(text.encode())


def test_slices_do_not_matter(corpus, monkeypatch):
    buffer = lpf.read([corpus[k].encode() for k in (20, 21, 20, 22)])
    windows = lambda: {w: (a, o) for a, f, c, o in zip(*[np.concatenate(x) for x in list(zip(*anchors.segments(lpf.KIND, buffer.symbols, buffer.lengths), strict=True))[:4]], strict=True) for w in range(f, f + c)}
    whole = windows()
    monkeypatch.setattr(anchors, "SLICE", 100)
    assert whole == windows()
    ends = np.cumsum(buffer.lengths)
    assert set(whole) == {w for e, n in zip(ends, buffer.lengths, strict=True) for w in range(e - n, e - 49)}


def test_lpf_array():
    r = random.Random(3)
    for data in [b"abaababaabb", b"aaaaaaaaaaaa", bytes(r.choices(b"ab", k=90)), bytes(r.choices(b"abc", k=60)) * 2]:
        n = len(data)
        brute = [max((k for j in range(i) for k in range(n - i + 1) if data[i : i + k] == data[j : j + k]), default=0) for i in range(n)]
        factor, source = lpf.longest_previous_factors(np.frombuffer(data, np.uint8), np.arange(n), 200)
        assert factor.tolist() == brute
        for i, (k, j) in enumerate(zip(factor, source, strict=True)):
            assert (k == 0 and j == i) or (j < i and data[i : i + k] == data[j : j + k])


def test_lpf_of_windows():
    r = random.Random(4)
    pieces = [bytes(r.choices(b"ab", k=r.randint(12, 30))) for _ in range(60)]
    counts = np.array([len(p) - 11 for p in pieces])
    first = {}
    for d, p in enumerate(pieces):
        for i in range(len(p) - 11):
            first.setdefault(p[i : i + 12], d)
    want = [first[p[i : i + 12]] for p in pieces for i in range(len(p) - 11)]
    assert lpf.earliest(pieces, counts, np.arange(60), 12).tolist() == want


def test_fm_index_statistics_and_places():
    r = random.Random(1)
    sequence = np.concatenate([[*(r.randint(1, 5) for _ in range(r.randint(6, 12))), 0] for _ in range(50)])
    index = fmindex.FMIndex(sequence, 12)
    starts = np.array([i for i in range(len(sequence) - 6) if 0 not in sequence[i : i + 6]])
    statistic, lo, hi = index.matching(sequence, starts, 6)
    assert len(index.samples) < len(sequence) / 2
    for s, k, a, b in zip(starts, statistic, lo, hi, strict=True):
        ends = lambda m: {i for i in range(len(sequence)) if (sequence[i : i + m].tolist() == sequence[s + 6 - m : s + 6].tolist())}
        assert k == max(m for m in range(7) if m == 0 or len(ends(m)) > 1)
        assert set(index.locate(np.arange(a, b))) == (ends(6) if k == 6 else set())


def test_fm_index_holders():
    r = random.Random(7)
    pieces = [[b"%d" % r.randint(0, 2) for _ in range(r.randint(5, 9))] for _ in range(200)]
    first, docs = {}, np.repeat(np.arange(100), 2)
    for d, p in zip(docs, pieces, strict=True):
        for i in range(len(p) - 4):
            first.setdefault(tuple(p[i : i + 5]), d)
    want = [first[tuple(p[i : i + 5])] for p in pieces for i in range(len(p) - 4)]
    assert fmindex.earliest([b" ".join(p) for p in pieces], np.array([len(p) - 4 for p in pieces]), docs, 5).tolist() == want


def test_line_dedup_against_brute_force(spark, corpus):
    blanks, low = " \t\n\x0b\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, lines = defaultdict(set), {}
    for i, t in enumerate(corpus):
        lines[i] = [(x, x.strip(blanks).translate(low)) for x in (t or "").split("\n")]
        for _, k in lines[i]:
            held[k].add(i)
    got = by_id(linededup.line_dedup(docs(spark, corpus)))
    dropped = 0
    for i, xs in lines.items():
        kept = [x for x, k in xs if not (len(k) >= 40 and len(held[k]) >= 5 and i < max(held[k]))]
        dropped += len(xs) - len(kept)
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (len(xs), len(xs) - len(kept))
        assert got[i]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert dropped > 0


def test_line_dedup_of_many_lines_and_repeated_ids(spark):
    line = "x" * 45
    texts = ["\n".join([line, "keep me"] * 100)] * 3 + [line] * 4
    rows = linededup.line_dedup(docs(spark, texts, [1, 1, 2, None, 3, 3, 4])).collect()
    gone = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"]) for r in rows)
    assert gone == [(0, 1, 1), (1, 200, 100), (1, 200, 100), (2, 200, 100), (3, 1, 1), (3, 1, 1), (4, 1, 0)]
    assert all(r["n_dropped"] == 0 for r in linededup.line_dedup(docs(spark, texts[:6], [1, 1, 2, None, 3, 3])).collect())
    assert linededup.keep_bitmaps(docs(spark, texts)).count() == 6


def test_simhash_against_brute_force(spark, corpus):
    def brute(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    base_text = corpus[8]
    texts = [*corpus, *(base_text + f" w{k}" for k in range(30))]
    fps = [brute(t) for t in texts]
    assert [simhash.simhash(t) for t in texts] == fps
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            label[i] = min(label[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    got = by_id(simhash.near_duplicates(docs(spark, texts), block=4))
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in fps]


def test_simhash_finds_all_links_of_three_bits():
    r = random.Random(3)
    a = r.getrandbits(64)
    fps = np.array([a, *(a ^ sum(1 << b for b in r.sample(range(64), 3)) for _ in range(200))], np.uint64)
    import pandas as pd

    keys = pd.concat(simhash._keys([pd.DataFrame({"fp": fps.view(np.int64)})]))
    met = {tuple(sorted((a, x))) for k, g in keys.groupby("key") for x in g["fp"].to_numpy().view(np.uint64) if np.uint64(a) in g["fp"].to_numpy().view(np.uint64) and g["own"].any()}
    assert {int(x) for pair in met for x in pair} >= {int(x) for x in fps}


def test_simhash_slices(monkeypatch, corpus):
    whole = [simhash.simhash(t) for t in corpus]
    monkeypatch.setattr(simhash, "SLICE", 20)
    monkeypatch.setattr(simhash.word_slices, "__defaults__", (20,))
    assert [simhash.simhash(t) for t in corpus] == whole


def test_one_of_each(spark, corpus):
    out = simhash.one_of_each(docs(spark, [corpus[10], corpus[10], corpus[20], None, ""], [4, 2, 7, 8, 9]))
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 7, 8]
    assert out.columns == docs(spark, []).columns


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 7), (3, 5), (5, 3)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3}


def test_decontamination_both_ways(spark, corpus):
    items = [(0, corpus[10][:200]), (1, " ".join((corpus[20] or "").split()[:20]).upper()), (2, "no such text is here at all or ever"), (3, None), (4, "a b"), (5, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    shingles = lambda t: decontam.shingles_of(decontam.words_of(t))
    want = {(d, i) for d, t in enumerate(corpus) for i, x in items if shingles(x) and len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x))}
    assert want
    for most in (1 << 20, 0):
        got = decontam.contaminated(docs(spark, corpus), table, most_sent=most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    left = {r["doc_id"] for r in decontam.decontaminated(docs(spark, corpus), table).collect()}
    assert left == set(range(len(corpus))) - {d for d, _ in want}


def test_decontamination_of_partial_items(spark):
    r = random.Random(2)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(44)]
    item = " ".join(words)
    cases = [" ".join(["x"] * 50 + words[:k] + ["y"] * 50) for k in range(5, 45)]
    got = decontam.contaminated(docs(spark, cases), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {k - 5 for k in range(5, 45) if k - 4 >= 0.8 * 40}


def test_fingerprints_of_documents(spark, corpus):
    got = by_id(fingerprint.fingerprinted(docs(spark, corpus)))
    for i, t in enumerate(corpus):
        t, after = t or "", corpus[(i + 1) % len(corpus)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprint.fingerprint(t)
        assert got[i]["edited_fingerprint"] == fingerprint.fingerprint(edited)
        assert got[i]["near_next"] == pytest.approx(fingerprint.likeness(fingerprint.fingerprint(t), fingerprint.fingerprint(after)))


def test_fingerprint_likeness():
    r = random.Random(4)
    a = "".join(r.choices("abcdefghij ", k=5000))
    b = "".join(r.choices("abcdefghij ", k=5000))
    fa, fb, fc = (fingerprint.fingerprint(x) for x in (a, b, a[:2500] + "zz" + a[2500:]))
    assert fingerprint.likeness(fa, fa) == 1 and fingerprint.likeness(fa, fb) == 0 and fingerprint.likeness(fa, fc) > 0.9
    assert fingerprint.likeness("3::", "3::") == 1 and fingerprint.likeness("3::", fa) == 0
    brute = lambda x, y: len(x) and len(y) and max(brute(x[1:], y), brute(x, y[1:]), (x[0] == y[0]) + brute(x[1:], y[1:]))
    for _ in range(30):
        x, y = ("".join(r.choices("abc", k=r.randint(0, 6))) for _ in range(2))
        assert fingerprint.common_letters(x, y) == (brute(x, y) or 0)


def test_fingerprint_of_one_row_and_ties(spark):
    one = fingerprint.fingerprinted(docs(spark, ["a single row"])).collect()[0]
    assert one["near_next"] == 1
    assert fingerprint.fingerprinted(docs(spark, ["b", "a", "a", None], [1, 1, 1, None])).count() == 4


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    tok, small = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path(), leaf=8)
    r = random.Random(6)
    bits = ["the", "ing", "é", "ß", "12", "  ", "\n\n", " ", "<|endoftext|>", "!!", "…", "zz", "'s", "漢字", "‍🙂"]
    texts = [*[t or "" for t in corpus], *("".join(r.choices(bits[: r.choice([6, 9, 15])], k=r.randint(0, 90))) for _ in range(200))]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert small.encode(t) == ids
        assert small.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    got = by_id(bpe.encoded(docs(spark, texts), with_ids=True))
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_tree_on_long_unsplit_text():
    from tokenizers import Tokenizer

    r = random.Random(8)
    text = "".join(r.choices("abcdeth", k=30_000))
    assert bpe.Codec(bpe.default_path()).encode(text) == Tokenizer.from_file(bpe.default_path()).encode(text).ids


def test_warc_round_trip(spark, tmp_path):
    htmls = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "x" * 700_000, "é\r\n\r\nWARC/1.1"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\nx", h, 1) for i, h in enumerate(htmls)], "page_id long, url string, html string, `last` int")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    rows = {r["page_id"]: r for r in warc.read_archives(spark, index).collect()}
    last = {h or "": i for i, h in enumerate(htmls)}
    for i, h in enumerate(htmls):
        data = (h or "").encode()
        r = rows[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert warc.fetch(index, i) == data
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_frames_are_read_alone(tmp_path):
    path = tmp_path / "b.zst"
    with path.open("wb") as f:
        w = warc.BundleWriter(f)
        at = [w.add(bytes([65 + k]) * 100_000) for k in range(6)]
        w.close()
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read() == b"".join(bytes([65 + k]) * 100_000 for k in range(6))
    with path.open("rb") as f:
        r = warc.BundleReader(f)
        assert len(r.frames) == 3
        for k, (frame, offset) in enumerate(at):
            assert r.frame(frame)[offset : offset + 100_000] == bytes([65 + k]) * 100_000


def test_html_held_out_accuracy():
    field = htmlcrf.default_field()
    right = total = 0
    for page in htmlcrf.labelled_pages(150, seed=77):
        found = dom.blocks(page)
        labels = field.decode(found)
        right += sum(a == htmlcrf.is_marked(b.chain) for a, b in zip(labels, found, strict=True))
        total += len(found)
    assert right / total > 0.97


def test_html_extraction(spark):
    page = """<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>A headline &amp; more</h1><p>First   paragraph with
a line break, long enough to be a sentence.<p><b>Second</b> paragraph, which is one too.</p></article><footer>&copy; someone</footer></body></html>"""
    rows = [(1, "u", page, "z"), (2, None, None, "z"), (None, "v", "", "z"), (1, "u", page, "z"), (4, "w", "<p>unclosed <b>a</i> b<!-- x", "z")]
    out = htmlcrf.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 5
    assert [r["text"] for r in out if r["page_id"] == 1] == ["A headline & more\nFirst paragraph with a line break, long enough to be a sentence.\nSecond paragraph, which is one too."] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["url"] != "u" and r["page_id"] != 4] == ["", ""]


def test_toxicity_learns_and_composes():
    r = random.Random(9)
    clean = ["".join(r.choices("aeiou", k=1)) + "".join(r.choices("bcdfgklm", k=3)) for _ in range(300)]
    texts, toxic = [], []
    for k in range(600):
        words = r.choices(clean, k=40)
        bad = k % 10 == 0
        if bad:
            words[r.randrange(40)] = "grumpf" + r.choice(["en", "er", "est"])
        texts.append(" ".join(words))
        toxic.append(float(bad))
    g = toxicity.fitted(texts, np.array(toxic))
    assert any("grumpfen".startswith(s) for s in g.stems)
    lexicon = g.lexicon()
    assert toxicity.score("you are an idiot", g, lexicon) > toxicity.score("he said you are not an idiot", g, lexicon) > toxicity.score("a fine day", g, lexicon)
    assert toxicity.score(None, g, lexicon) == toxicity.score("", g, lexicon) < 0.5
    marks = toxicity.patterns("you idiot. not an idiot. he said idiot", toxicity.Grammar().lexicon())
    assert {i for i, v in enumerate(marks) if v} == {toxicity.TARGETED, toxicity.NEGATED, toxicity.TARGETED | toxicity.REPORTED}


def test_toxicity_on_tables(spark):
    rows = [f"word{k} you idiot" if k % 5 == 0 else f"word{k} and so on" for k in range(60)] + [None, ""]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(60)] + [(None, 0, 1), (3, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    g = toxicity.train(d, labels)
    out = by_id(toxicity.scored(d, g))
    assert len(out) == 62 and all(out[k]["predicted"] == int(k < 60 and k % 5 == 0) for k in out)
    import zlib

    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in out)
    assert sorted(r["doc_id"] for r in toxicity.kept(d, labels).collect()) == [k for k in range(62) if k >= 60 or k % 5]
    assert toxicity.train(d, labels.limit(0)).stems == {}


@pytest.mark.parametrize("apply", [fmindex.deduplicated, lpf.deduplicated, linededup.line_dedup, simhash.near_duplicates, simhash.one_of_each, fingerprint.fingerprinted, bpe.encoded], ids=lambda f: f"{f.__module__}.{f.__name__}")
def test_empty_tables_and_null_ids(spark, apply):
    assert apply(docs(spark, [])).count() == 0
    assert apply(docs(spark, [None, "a text", "a text"], [None, 3, None])).count() >= 2


def test_saved_tables_can_be_discarded(spark):
    t = base.saved(spark.range(3).toDF("x"), "t")
    assert t.count() == 3
    base.discard(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(t._metaloom_path).count()
