"""The corpus pipeline: each stage's decision against brute force, and its columns."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from helixframe.llm import common, language_id, quality

WORD = r"[^\x20\x09-\x0D]+"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group_id long, _key string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    """Prose of two languages, near copies, shared passages, junk, nulls, repeated ids and rows."""
    rnd = random.Random(8)
    english = "the of and to in a is that it for house river old green walked over under stone light morning".split()
    german = "der die das und ist ein nicht mit auf haus fluss alt gruen ging ueber unter stein licht morgen zeit".split()
    prose = lambda words, n: [rnd.choice(words) + rnd.choice(["", "", "s", "en", "ly"]) for _ in range(n)]
    passage = prose(english, 45)
    texts = []
    for i in range(40):
        w = prose(english if i % 2 else german, rnd.randint(60, 140))
        if i % 5 == 0:
            w[10:10] = passage
        texts.append((" ".join(w), "en" if i % 2 else "de"))
    out = [(i, t, lang, "s", len(t), 1, "k") for i, (t, lang) in enumerate(texts)]
    for i in range(0, 40, 4):  # near copies, some under ids of other texts
        w = texts[i][0].split()
        w[rnd.randrange(len(w))] = "changed"
        out.append((100 + i if i % 8 else 3, " ".join(w), texts[i][1], "s", 5, 2, "k"))
    out += [out[1], out[1], (500, out[2][1], "de", "other", 9, 3, None)]
    out += [(None, texts[5][0], "en", "s", 3, 1, "k"), (None, None, None, None, None, None, None), (600, None, "en", "s", 0, 1, "k"), (601, "", "en", "s", 0, 1, "k")]
    out += [(602, "12 34 ... !!", "en", "s", 1, 1, "k"), (603, "a " * 400, "en", "s", 1, 1, "k"), (604, "# $ % & " * 30, "en", "s", 1, 1, "k")]
    return out


def run(spark, name, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    out = STAGES[name](spark, d, "")
    return d, out, [tuple(r) for r in out.collect()]


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_language_stage(spark, rows):
    d, out, got = run(spark, "language ID", rows)
    assert out.columns == d.columns
    model, languages = language_id.fit(d)
    assert languages == ["de", "en"]

    def keep(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not any(map(str.isalpha, text or "")):
            return False
        return language_id.pooled(model, raw, np.array([0, len(raw)]))[0].max() >= 0.5 + 0.5 / 15 - 1e-6

    same(got, [r for r in rows if keep(r[1])])
    assert corpus_pipeline.least_score(1) <= 1 and corpus_pipeline.least_score(4) == pytest.approx(0.3, abs=1e-5)


def test_quality_stage(spark, rows):
    d, out, got = run(spark, "quality rules", rows)
    assert out.columns == d.columns

    def keep(text):
        w = re.findall(WORD, text or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            return False
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_lines": len(lines)}
        m |= {"n_dup_lines": len(lines) - len(set(lines)), "n_stop_words": sum(x.lower() in quality.STOP_WORDS for x in w)}
        return all(100 * m[a] >= p * m[b] if c == ">=" else 100 * m[a] <= p * m[b] for _, a, c, p, b in quality.RULES)

    same(got, [r for r in rows if keep(r[1])])


def test_near_duplicate_stage(spark, rows):
    d, out, got = run(spark, "n-gram Jaccard join", rows)
    assert out.columns == d.columns
    sets = []
    for r in rows:
        w = re.findall(WORD, lower(r[1]))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    linkable = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    group = {i: {i} for i in linkable}
    for i in linkable:
        for j in linkable:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] is not group[j]:
                group[i] |= group[j]
                for x in group[j]:
                    group[x] = group[i]
    groups = {id(g): g for g in group.values()}.values()
    alone = [r for i, r in enumerate(rows) if i not in group]
    assert len(got) == len(groups) + len(alone)
    assert [r for r in got if r[0] is None or r[0] in (600, 601)] and all(r in got for r in alone)
    for g in groups:
        least = min(rows[i][0] for i in g)
        assert sum(got.count(r) for r in {rows[i] for i in g if rows[i][0] == least}) == 1
        assert not [i for i in g if rows[i][0] != least and rows[i] in got]


def test_passage_stage(spark, rows):
    d, out, got = run(spark, "substring dedup", rows)
    assert out.columns == d.columns
    seen, gone = {}, [set() for _ in rows]
    order = sorted((r[0], s, i) for i, r in enumerate(rows) if r[0] is not None for s in range(len(re.findall(WORD, r[1] or "")) - 19))
    for doc, s, i in order:
        window = tuple(re.findall(WORD, rows[i][1])[s : s + 20])
        if seen.setdefault(window, (doc, s)) != (doc, s):
            gone[i].update(range(s, s + 20))
    want = []
    for r, g in zip(rows, gone, strict=True):
        text = " ".join(w for j, w in enumerate(re.findall(WORD, r[1])) if j not in g) if g else r[1] or ""
        want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    same(got, want)


def test_packing_stage(spark, rows):
    _, _, got = run(spark, "best-fit packing", rows)
    assert {r[0] for r in got} == {r[0] for r in rows}


def test_stages_keep_columns_and_clean_documents(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001").selectExpr("*", "1 AS _q", "'x' AS _kept", "2 AS r", "3 AS row_key", "4 AS carried", "5 AS chunk")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, docs, ""), "stage")
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stage_names():
    assert list(STAGES) == ["language ID", "quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
