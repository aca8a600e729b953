"""Operators of the training-data package against brute force and the public libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from helixframe.llm import class_lm, common, fuzzy_hash, language_id, ngram_join, packing, prefix_bpe, quality, segments, substring_dedup, token_counts, training_order, vocab

WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", None, " ", "\n\n", "word", "Äö ß\xa0x 　y", "a" * 3000, "x  y\n \n  z ", " \n\n foo  bar\t baz", "1234 ... <|endoftext|> <s> ▁ ﷽", " lead", "\x1c \x1d a", "ab " * 2000, "Ab " * 2000]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(spark, texts, extra=True):
    """Texts with ids, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 7, "clash") for i, t in enumerate(texts)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, row string")
    return df if extra else df.select("doc_id", "text")


@pytest.fixture(scope="module")
def mixed():
    """Near copies, shared passages and junk of a small vocabulary, and odd texts."""
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))] for _ in range(25)]
    texts = list(ODD)
    for _ in range(300):
        x = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            x[rnd.randrange(len(x))] = rnd.choice("xyzABC")
        texts.append(rnd.choice([" ", "\n", "  "]).join(x))
    return texts


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 4_000_000), (5, 80, 20_000), (2, 85, 4_000_000)])
def test_ngram_join(spark, mixed, monkeypatch, k, percent, block):
    monkeypatch.setattr(ngram_join, "MAX_BLOCK", block)
    sets = []
    for t in mixed:
        w = re.findall(WORD, lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = ngram_join.ngram_join(table(spark, mixed), k, percent).collect()
    assert len(got) == len(mixed) + 1
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


@pytest.mark.parametrize("block", [700, 6_000])
def test_large_blocks(spark, monkeypatch, block):
    """Families over many slices: one chain, one star, and copies that only links of others join."""
    monkeypatch.setattr(ngram_join, "MAX_BLOCK", block)
    rnd, texts = random.Random(8), []
    for f in range(3):
        words = [f"f{f}w{i}" for i in range(80)]
        for step in range(60):
            if f == 0:  # a chain: each differs from the one before by one word, ends are far apart
                words[(7 * step) % 80] = f"n{step}"
                texts.append(list(words))
            else:
                x = list(words)
                x[rnd.randrange(80 if f == 1 else 4)] = f"x{rnd.randrange(90)}"
                texts.append(x)
    rnd.shuffle(texts)
    sets = [{tuple(w[j : j + 4]) for j in range(77)} for w in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert len(set(root)) < 20
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    calls, across = [], ngram_join._across_slices
    monkeypatch.setattr(ngram_join, "_across_slices", lambda *a: calls.append(1) or across(*a))
    assert [c for _, c in sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_join(d).collect())] == root
    assert bool(calls) == (block == 700)


def test_t_occurrence_search():
    rnd = random.Random(1)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randint(1, 50)))) for _ in range(150)]
    index = ngram_join.Index(list(map(len, sets)), 60, 70)
    for i, s in enumerate(sets):
        index.add(i, s.tolist())
    for s in sets:
        want = [i for i, t in enumerate(sets) if 100 * (o := len({*s} & {*t})) >= 70 * (len(s) + len(t) - o)]
        assert index.search(len(s), s.tolist()) == want


@pytest.mark.parametrize(("span", "chunk"), [(20, 6 << 20), (6, 2000), (5, 300)])
def test_substring_dedup(spark, mixed, monkeypatch, span, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4 * chunk)
    monkeypatch.setattr(substring_dedup, "BLOCK_CELLS", chunk)
    seen, want = {}, {}
    for i, t in enumerate(mixed):
        w, gone = re.findall(WORD, t or ""), set()
        for s in range(len(w) - span + 1):
            if seen.setdefault(tuple(w[s : s + span]), (i, s)) != (i, s):
                gone.update(range(s, s + span))
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = substring_dedup.substring_dedup(table(spark, mixed), span).collect()
    assert len(got) == len(mixed) + 1
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(d).collect()} == {(None, None), (1, 1), (2, 1)}
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(d, 4).collect()} == {(None, 0), (1, 0), (2, 6)}


def test_fingerprints(spark, mixed, monkeypatch):
    monkeypatch.setattr(fuzzy_hash, "RANGE_ROWS", 40)
    d = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    rows = sorted(enumerate(mixed), reverse=True)
    want = {}
    for j, (i, t) in enumerate(rows):
        t, n = t or "", rows[(j + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (fuzzy_hash.fingerprint(x.encode()) for x in (t, e, n))
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, fuzzy_hash.likeness(a, b), fuzzy_hash.likeness(a, c))
    assert {r[0]: tuple(r)[1:] for r in fuzzy_hash.fingerprints(d).collect()} == want
    one = fuzzy_hash.fingerprints(d.limit(1)).first()
    assert one.near_next == 1.0


def test_likeness():
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(4000)).encode()
    a, b = fuzzy_hash.fingerprint(text), fuzzy_hash.fingerprint(text[:2000] + b"something else" + text[2000:])
    c = fuzzy_hash.fingerprint("".join(rnd.choice("klmnopq ") for _ in range(4000)).encode())
    assert fuzzy_hash.likeness(a, a) == 1 and fuzzy_hash.likeness(a, b) > 0.8 and fuzzy_hash.likeness(a, c) < 0.2
    for _ in range(200):
        x, y = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in "ab")
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy_hash.common_subsequence(x, y) == t[-1][-1]


def test_token_counts(spark, mixed, tmp_path):
    import sentencepiece

    path, cache = P.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(2):  # the second time from the cache alone
        got = token_counts.token_counts(table(spark, mixed), path, cache).collect()
        assert len(got) == len(mixed) + 1
        for r in got:
            t = mixed[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t)))
    assert spark.read.parquet(cache).count() == len({t or "" for t in mixed})


def test_byte_bpe(spark, mixed):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.read_ranks(path), special_tokens={})
    for r in prefix_bpe.encode_documents(table(spark, mixed), path).collect():
        t = mixed[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(t) and bytes(r.decoded) == t.encode()


def test_prefix_table_edits():
    bpe = prefix_bpe.PrefixBPE(vocab.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    rnd = random.Random(1)
    t = prefix_bpe.PrefixTable(bpe, b"thisisatestabcabcabcnationally" * 20)
    whole = 0
    for _ in range(200):
        a = rnd.randrange(len(t.piece))
        whole += t.edit(a, min(len(t.piece), a + rnd.randrange(4)), bytes(rnd.choices(b"abcthising", k=rnd.randrange(5)))) == len(t.piece) - a
        assert t.ids() == bpe.encode_piece(t.piece)
    assert whole < 150  # most edits stay near
    t.append(b"ization")
    assert t.ids() == bpe.encode_piece(t.piece)


def test_segments_forget(monkeypatch):
    monkeypatch.setattr(segments, "CACHE_SEGMENTS", 5)
    e = vocab.ByteLevelEncoder(P.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in [*filter(None, ODD), "many different words in one text are more than five of them"]:
        assert np.frombuffer(e.ids([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing(spark, mixed):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(table(spark, mixed), P.path("byte_bpe_50k.json"), limit=64).collect()
    by, docs = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(mixed[1:], 1):
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(docs[i], key=lambda r: r.piece)
        assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in got), []) == want
        assert all(r.length == 64 for r in got[1:]) and got[0].start == 0
    assert len(by) <= 1.05 * math.ceil(sum(r.length for r in rows) / 64) + 1
    assert packing.plan({}).empty


def test_training_order(spark, mixed, tmp_path, monkeypatch):
    """Slots are those of one permutation of all reserved places; reading goes on across shards."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(training_order, "SHARD_RANKS", 300)
    for n in (1, 2, 3, 100, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, 9).tolist()) == list(range(n))
    folder, key = f"file://{tmp_path}/shards", 77
    rows = [*enumerate(mixed), (0, mixed[0]), (None, "no id at all")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").selectExpr("*", "1 AS part", "'x' AS shard")
    manifest = training_order.materialise(docs, P.path("byte_bpe_50k.json"), folder, sequence=32, key=key).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    places, at = [], 0  # brute force: places in the order of the input's rows, then one permutation
    for doc, text in [(r.doc_id, r.text) for r in sorted(docs.selectExpr("doc_id", "text", "spark_partition_id() AS p", "monotonically_increasing_id() AS m").collect(), key=lambda r: r.m)]:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        places += [(at + k, -(2**63) if doc is None else doc, k, ids[32 * k : 32 * k + 32]) for k in range(-(-len(ids) // 32))]
        at += -(-(len((text or "").encode()) + 1) // 32)
    rank = training_order.feistel(np.array([p[0] for p in places]), at, key)
    want = [places[i][1:] for i in np.argsort(rank)]
    assert [(r.doc_id, r.piece) for r in sorted(manifest, key=lambda r: r.slot)] == [w[:2] for w in want]
    assert sorted(r.slot for r in manifest) == list(range(len(want)))
    shards = sorted({r.shard for r in manifest})
    assert len(shards) > 3
    resume = next(r for r in manifest if r.slot == len(want) // 2)
    read = [x for s in shards if s >= resume.shard for x in training_order.read_from(folder, s, resume.shard_slot if s == resume.shard else 0, sequence=32)]
    assert [(int(x["doc_id"]), int(x["piece"]), x["ids"][: x["length"]].tolist()) for x in read] == want[len(want) // 2 :]
    for r in manifest[:5]:
        x = training_order.read_from(folder, r.shard, r.shard_slot, sequence=32)[0]
        assert zlib.crc32(x.tobytes()) == r.record_crc32 and r.byte_offset == r.shard_slot * x.nbytes


def test_class_lm(spark, mixed, monkeypatch):
    want, c = [], Counter()
    tokens = lambda t: [*re.findall(WORD, lower(t)), ""]
    for i, t in [*enumerate(mixed), (0, mixed[0])]:
        if zlib.crc32(str(i).encode()) % 10:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = {i: (len(w := tokens(t)), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, t in enumerate(mixed)}
    for words, chunk in ((2000, 6 << 20), (15, 3000)):
        monkeypatch.setattr(class_lm, "CLUSTER_WORDS", words)
        monkeypatch.setattr(class_lm, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(class_lm, "BUCKET_BYTES", 4 * chunk)
        got = class_lm.score_documents(table(spark, mixed)).collect()
        assert len(got) == len(mixed) + 1
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
            assert r.base_score == pytest.approx(want[r.doc_id][2])


def test_class_scores_by_hand(spark, mixed, monkeypatch):
    """Score of each text from the words' classes, word by word."""
    monkeypatch.setattr(class_lm, "CLUSTER_WORDS", 12)
    monkeypatch.setattr(class_lm, "CHUNK_BYTES", 4000)
    texts = [re.sub("[A-Z]", "", t or "") for t in mixed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = docs.filter("doc_id % 3 <> 0")
    m = class_lm.fit(learned.select("text"), 3)
    number = {}
    for w in {w for t in texts for w in re.findall(WORD, t)}:
        raw = np.frombuffer(w.encode(), np.uint8)
        number[w] = int(common.word_hashes(raw, np.array([0, len(raw)]), True)[0][0])
    number[""] = int(class_lm.END)
    classes = {int(k): int(c) for k, c in zip(m.units.keys, m.of, strict=False)}
    rare = {}
    for r in m.classed.collect():
        rare |= dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), r["classes"], strict=True))
    of = lambda w: classes.get(number[w], rare.get(number[w] >> 7 << 7, int(m.of[-1])))
    tokens = {i: [*re.findall(WORD, t), ""] for i, t in enumerate(texts)}
    c, f, size = Counter(), np.zeros((class_lm.CLASSES,) * 2), np.full(class_lm.CLASSES, class_lm.UNSEEN)
    for i, t in tokens.items():
        if i % 3:
            c.update(t)
            for x, y in zip(["", *t], t, strict=False):
                f[of(x), of(y)] += 1
    for w, n in c.items():
        size[of(w)] += n + class_lm.UNSEEN
    step = class_lm.transitions(f)
    for r in class_lm.score_documents(docs, F.col("doc_id") % 3 != 0).collect():
        t = tokens[r.doc_id]
        want = sum(step[of(x), of(y)] + math.log10((c[y] + class_lm.UNSEEN) / size[of(y)]) for x, y in zip(["", *t], t, strict=False))
        assert r.score == pytest.approx(want) and r.perplexity == pytest.approx(10 ** (-want / len(t)))
    for row in class_lm.transitions(f):
        assert sum(10**row) == pytest.approx(1, abs=1e-6)


def test_class_lm_beats_the_base(spark):
    rows = class_lm.op5_class_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_exchange_beats_a_random_clustering():
    rnd = np.random.default_rng(0)
    truth = rnd.integers(0, 3, 30)
    b = rnd.poisson(np.where((truth[:, None] + 1) % 3 == truth[None, :], 20, 1)).astype(float)
    of = class_lm.exchange(b, classes=3)
    assert all(len(set(of[truth == k])) == 1 for k in range(3)) and len(set(of)) == 3


def test_words_outside_the_clustering_get_own_classes(spark, monkeypatch):
    """Rare words share one unit at first: their own neighbours tell them apart."""
    monkeypatch.setattr(class_lm, "CLUSTER_WORDS", 6)
    rnd = random.Random(2)
    x, y = ([f"{c}{i}end" for i in range(40)] + 40 * [f"{c}top"] for c in "xy")
    line = lambda a, b: " ".join(w for _ in range(6) for w in ("sun", rnd.choice(a), "day", "moon", rnd.choice(b), "night"))
    texts = [line(x, y) for _ in range(200)] + [line(x[:40], y[:40]) for _ in range(5)] + [line(y[:40], x[:40]) for _ in range(5)]
    got = {r.doc_id: r.score for r in class_lm.score_documents(table(spark, texts), F.col("doc_id") < 200).collect()}
    assert min(got[i] for i in range(200, 205)) > max(got[i] for i in range(205, 210)) + 3


def test_best_classes():
    rnd = np.random.default_rng(1)
    f, n = rnd.poisson(30, (5, 5)).astype(float), rnd.poisson(0.8, (40, 10))
    n[:, 7] += 1
    word, near = np.nonzero(n)
    own = rnd.integers(0, 5, 40)
    got = class_lm.best_classes(f, word, near, n[word, near], own)
    for w in range(40):
        gain = np.zeros(5)
        for k, g in enumerate((f, f.T)):
            prior = class_lm.PRIOR * (g.sum(0) + 0.5) / (g.sum() + 2.5)
            for b in range(5):
                mine = n[w, 5 * k : 5 * k + 5] * (b == own[w])
                total = n[w, 5:].sum() * (b == own[w])
                p = (np.maximum(g[b] - mine, 0) + prior) / (max(g[b].sum() - total, 0) + class_lm.PRIOR)
                gain[b] += n[w, 5 * k : 5 * k + 5] @ np.log(p)
        assert gain.argmax() == got[w]


def test_language_gradients():
    m = {k: v.astype(float) for k, v in language_id.new_model(3, hidden=4, seed=2).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 100, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = language_id._gradient(m, x, y)
    for name in m:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, ends = m[name][at], []
        for d in (1e-3, -1e-3):
            m[name][at] = was + d
            ends.append(language_id._gradient(m, x, y)[0])
        m[name][at] = was
        assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=1e-3)


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    rows = language_id.op4_language_id(spark, sf).join(common.documents(spark, sf).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    d = table(spark, [*ODD, "12 34 !!"])
    found = language_id.identify(d, None, []).collect()
    assert all(r["_lang_pred"] == "und" and r["_score"] == 0 for r in found) and len(found) == d.count()
    model = language_id.new_model(2)
    und = {r.doc_id: r["_lang_pred"] for r in language_id.identify(d, model, ["a", "b"]).collect()}
    assert und[0] == und[1] == und[2] == und[len(ODD)] == "und" and und[4] in "ab"


def test_quality_rules(spark, mixed):
    for r in quality.quality(table(spark, mixed)).collect():
        t = mixed[r.doc_id] or ""
        w = re.findall(WORD, t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p + j for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        q = r["_q"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r["_base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["_base_failed"] and r["_kept"])


def test_empty_tables(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ngram_join.ngram_join(d).count() == 0
    assert fuzzy_hash.fingerprints(d).count() == 0
    assert token_counts.token_counts(d, P.path("piece_bpe_32k.model"), f"file://{tmp_path}/c").count() == 0
    assert language_id.fit(d) == (None, [])
    assert class_lm.score_documents(d).count() == 0
    assert training_order.materialise(d, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/s").count() == 0
    assert prefix_bpe.encode_documents(d, P.path("byte_bpe_multi_50k.tiktoken")).count() == 0
    assert substring_dedup.substring_dedup(d).count() == 0
    assert quality.quality(d).count() == 0
    assert packing.pack(d, P.path("byte_bpe_50k.json")).count() == 0
    assert d.select(F.count("*")).first()[0] == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 1 << 50, 3000)).astype(np.uint64)
    assert substring_dedup.unpack_gaps(substring_dedup.pack_gaps(x)).tolist() == x.tolist()
    assert len(substring_dedup.unpack_gaps(b"")) == 0
    chunks = [rng.integers(0, 4000, 1500).astype(np.uint64) for _ in range(4)]
    true, width = Counter(np.concatenate(chunks).tolist()), 1 << 13
    above = {}
    for row in range(substring_dedup.ROWS):
        parts = [substring_dedup.chunk_sketch(c, row, width) for c in chunks]
        for (cells, _), bits in zip(parts, substring_dedup.merge_sketches(parts), strict=True):
            above |= {(row, c): b for c, b in zip(cells.tolist(), bits.tolist(), strict=True)}
    estimated = {w: all(above[row, int(substring_dedup.cells(np.array([w], np.uint64), row, width)[0])] for row in range(substring_dedup.ROWS)) for w in true}
    assert all(estimated[w] for w, n in true.items() if n > 1)
    assert sum(estimated[w] for w, n in true.items() if n == 1) < 0.3 * sum(n == 1 for n in true.values())


def slow_fingerprint(raw):
    """Byte by byte: a rolling hash over seven bytes, chunk ends at its multiples, a character a chunk."""
    import xxhash

    hashes = []
    for i in range(len(raw)):
        past = [raw[i - age] if i >= age else 0 for age in range(7)]
        shifted = 0
        for age, x in enumerate(past):
            shifted ^= x << 5 * age
        hashes.append((sum(past) + sum(x * (7 - age) for age, x in enumerate(past)) + shifted % 2**32 + 1) % 2**32)

    def signature(block):
        out, chunk = "", b""
        for x, h in zip(raw, hashes, strict=True):
            chunk += bytes([x])
            if h % block == 0 and len(out) < 63:
                out += fuzzy_hash.ALPHABET[xxhash.xxh64_intdigest(chunk) % 64]
                chunk = b""
        return out + (fuzzy_hash.ALPHABET[xxhash.xxh64_intdigest(chunk) % 64] if chunk else "")

    block = 3
    while block * 64 < len(raw):
        block *= 2
    while block > 3 and sum(h % block == 0 for h in hashes) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def slow_likeness(x, y):
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    if x == y:
        return 1.0

    def alike(a, b):
        if a == b:
            return 1.0
        k = min(4, len(a), len(b))
        if not k or not any(a[i : i + k] in b for i in range(len(a) - k + 1)):
            return 0.0
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = d[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(d[i - 1][j], d[i][j - 1])
        return 1 - d[-1][-1] / (len(a) + len(b))

    return max([alike(a, b) for p, a in ((int(bx), x1), (2 * int(bx), x2)) for q, b in ((int(by), y1), (2 * int(by), y2)) if p == q], default=0.0)


def test_fingerprints_byte_by_byte(spark, mixed, monkeypatch):
    monkeypatch.setattr(fuzzy_hash, "RANGE_ROWS", 7)
    texts = [*ODD, *mixed[40:70], "Grün ist ß " * 3000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "c", 2), (None, None, "c", 2), (5, "another text of one id", "c", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, part string, at int")
    order = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for j, (i, t) in enumerate(order):
        n = order[(j + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (slow_fingerprint(x.encode()) for x in (t, e, n))
        want.append((None if i < 0 else i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, slow_likeness(a, b), slow_likeness(a, c)))
    got = [tuple(r) for r in fuzzy_hash.fingerprints(d).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_language_network_position_by_position():
    m = {k: v.astype(float) for k, v in language_id.new_model(3, hidden=5, seed=7).items()}
    m["bias"] += [0.1, -0.2, 0.3]
    texts = [b"", b"x", "Grün und".encode() * 5, bytes(range(65, 91)) * 11]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    p, votes = language_id.pooled({k: v.astype(np.float32) for k, v in m.items()}, data, offsets)
    squash = lambda x: x / (1 + abs(x))

    def states(side, piece):
        h, out = np.zeros(5), []
        for x in piece:
            a, g = m[f"in_{side}"][x], h @ m[f"rec_{side}"]
            u, r = 0.5 + 0.5 * squash(a[:5] + g[:5]), 0.5 + 0.5 * squash(a[5:10] + g[5:10])
            h = h + u * (squash(a[10:] + r * g[10:]) - h)
            out.append(h)
        return out

    for i, t in enumerate(texts):
        probabilities = []
        for at in range(0, len(t), language_id.SEGMENT):
            piece = t[at : at + language_id.SEGMENT]
            padded = piece + b" " * (language_id.SEGMENT - len(piece))
            forwards, backwards = states("f", padded), states("b", padded[::-1])[::-1]
            for k in range(len(piece)):
                z = np.exp(forwards[k] @ m["out_f"] + backwards[k] @ m["out_b"] + m["bias"])
                probabilities.append(z / z.sum())
        if t:
            assert p[i] == pytest.approx(np.mean(probabilities, 0), abs=1e-4)
            assert votes[i] == pytest.approx(np.bincount(np.argmax(probabilities, 1), minlength=3) / len(t), abs=0.02)
    assert not p[0].any()


def test_language_of_one_document_and_many_languages(spark, monkeypatch):
    rows = [(i, f"wort{i} haus fluss stein", "de") for i in range(1, 30)] + [(100, "zzz qqq zzz qqq", "xx"), (None, "abc", "yy"), (101, "abc", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "STEPS", 3)
    monkeypatch.setattr(language_id, "SAMPLE", 3)
    assert zlib.crc32(b"100") % 5
    model, languages = language_id.fit(d)
    assert languages == ["de", "xx", "yy"] and len(model["bias"]) == 3
    assert language_id.identify(d, model, languages).count() == len(rows)


def test_repeated_ids_with_other_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    a, c = words, [f"v{i}" for i in range(60)]
    rows = [(5, " ".join(a)), (6, near(a, 59)), (5, " ".join(c)), (7, near(c, 59)), (5, " ".join(a)), (8, "alone here"), (5, "alone too")]
    for block in (4_000_000, 100):
        ngram_join.MAX_BLOCK, was = block, ngram_join.MAX_BLOCK
        try:
            got = sorted(tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
        finally:
            ngram_join.MAX_BLOCK = was
        assert got == sorted([(5, 57, 5), (6, 57, 5), (5, 57, 5), (7, 57, 5), (5, 57, 5), (8, 1, 8), (5, 1, 5)])


def test_null_ids_and_long_texts(spark, tmp_path):
    """Every operator returns rows of null ids and whole long texts; columns of its own names do no harm."""
    import sentencepiece
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "Größe", "\n"]) + str(rnd.randrange(3000)) for _ in range(60_000))
    rows = [(None, "a b c", "k", 1), (None, None, "k", 1), (1, long, "k", 1), (2, "", "k", 1), (2, "", "k", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest string, bucket int")
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(d, P.path("piece_bpe_32k.model"), f"file://{tmp_path}/c").collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got) == sorted((r[0] or 0, len(piece.encode(r[1] or ""))) for r in rows)
    got = class_lm.score_documents(d).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got) == sorted((r[0] or 0, len(re.findall(WORD, r[1] or "")) + 1) for r in rows)
    ids = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = {i: len(ids.encode(r[1] or "", add_special_tokens=False).ids) + 1 for i, r in enumerate(rows)}
    packed = packing.pack(d, P.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in packed) == sum(size.values()) and sum(r.length for r in packed if r.doc_id is None) == size[0] + size[1]
    written = training_order.materialise(d, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/s").collect()
    assert sum(r.length for r in written) == sum(size.values()) and {r.doc_id for r in written} == {-(2**63), 1, 2}
    assert sorted(len(r.ids) for r in prefix_bpe.encode_documents(d, P.path("byte_bpe_multi_50k.tiktoken")).collect())[:3] == [0, 0, 0]
    judged = quality.quality(d).collect()
    assert sorted(r["_q"].n_words for r in judged) == sorted(len(re.findall(WORD, r[1] or "")) for r in rows)
    assert language_id.identify(d, language_id.new_model(2), ["a", "b"]).count() == len(rows)
    assert sorted(r.n_words for r in substring_dedup.substring_dedup(d).collect()) == sorted(len(re.findall(WORD, r[1] or "")) for r in rows)
    assert sorted((r.doc_id or 0, r.n_shingles) for r in ngram_join.ngram_join(d).collect())[:2] == [(0, 0), (0, 1)]
