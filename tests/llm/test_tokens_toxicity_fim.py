"""Token alignment, toxicity and fill-in-the-middle against plain versions, and on odd rows and tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrials.llm import fill_in_middle, token_alignment, toxicity

DOCS = "doc_id bigint, text string, lang string, n bigint, label int, pairs string, id string, row string, form string, output string, gram string, h0 string"
EXTRA = ("en", 1, 2, "p", "i", "r", "f", "o", "g", "h")


def rows_of(texts):
    return [(i, t, *EXTRA) for i, t in texts]


def odd_texts():
    rnd = random.Random(3)
    words = ["the", "thénd", "of", "on", "ñandú", "Straße", "x1", "don't", "<|endoftext|>", "</s>", "🙂", "日本語", "[INST]", "a▁b"]
    texts = [" ".join(rnd.choice(words[:13]) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    texts += [None, "", " ", "  two  spaces ", "\n\ntabs\tand\nlines \n", "a▁b", "<P>x", "y<S>", "<M>", "z" * 3000, "語" * 500, "ä́e" * 9, "a", texts[0], texts[0], "\x00nul \x01"]
    texts.append(" ".join(rnd.choice(words[:13]) for _ in range(20000)))
    return [*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(odd_texts()), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- fill in the middle

def plain_fim(i, text, units):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k: 8 * k + 8], 16) for k in range(4)]
    parts = units(text)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_cuts(docs):
    out = fill_in_middle.fill_in_middle(docs)
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter(plain_fim(i, t, list) for i, t in odd_texts())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in odd_texts())


def test_fill_in_middle_by_graphemes(docs):
    import regex
    got = Counter(tuple(r) for r in fill_in_middle.fill_in_middle(docs, unit=fill_in_middle.GRAPHEME).collect())
    assert got == Counter(plain_fim(i, t, lambda x: regex.findall(r"\X", x)) for i, t in odd_texts())


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.fill_in_middle(empty(spark)).collect() == []


# ---------------------------------------------------------------- token alignment

@pytest.fixture(scope="module")
def tokenizers():
    with open(f"{token_alignment.FOLDER}/byte_bpe_50k.json", encoding="utf-8") as f, open(f"{token_alignment.FOLDER}/piece_bpe_32k.model", "rb") as g:
        return token_alignment.Tokenizers.of(f.read(), g.read())


def plain_alignment(tokenizers, texts):
    """Every pair of tokens compared by its end, without windows, memo or anchors."""
    out, counts = [], Counter()
    for i, text in texts:
        a, b = (x[0] for x in tokenizers.encode([text or ""]))
        whole = (" " + (text or "")).encode()
        joined = [b"".join(side[x] for x in ids) for side, ids in ((tokenizers.bytes_a, a), (tokenizers.bytes_b, b))]
        if not text or joined != [whole, whole]:
            out.append((i, [], [], [], []))
            continue
        end, ends = 0, []
        for x in a:
            end += len(tokenizers.bytes_a[x])
            ends.append((end, x))
        end, other = 0, {}
        for x in b:
            end += len(tokenizers.bytes_b[x])
            other[end] = x
        links = [(x, other[e]) for e, x in ends if e in other]
        shared = [e for e, _ in ends if e in other]
        groups = []
        for lo, hi in zip([0, *shared], shared, strict=False):
            left = [str(x) for e, x in ends if lo < e <= hi]
            right = [str(other[e]) for e in sorted(other) if lo < e <= hi]
            groups.append(f"{','.join(left)}|{','.join(right)}")
        counts.update(links)
        out.append((i, a, b, groups, links))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = Counter((i, len(a), len(b), len(g), len(ln), sum(counts[p] == best[p[1]] for p in ln), sum(counts[p] for p in ln), ";".join(g),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, ln in out)
    return rows, Counter({(x, y, n, n == best[y]): 1 for (x, y), n in counts.items()})


def small(texts):
    return [(i, t if t is None or len(t) < 5000 else t[:1500]) for i, t in texts]


@pytest.mark.parametrize("max_pairs", [4_000_000, 0])
def test_alignment_against_all_pairs(spark, tokenizers, max_pairs, monkeypatch):
    monkeypatch.setattr(token_alignment, "MEMO_WINDOWS", 5)
    texts = small(odd_texts())
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(3)
    out, pairs = token_alignment.align(docs, max_pairs=max_pairs, keep_groups=True)
    want, want_pairs = plain_alignment(tokenizers, texts)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
    assert Counter(tuple(r) for r in out.select(*names).collect()) == want
    assert Counter(tuple(r) for r in pairs.collect()) == want_pairs
    assert {r.groups_sha256 for r in out.collect() if r.n_a == 0} == {""}


def test_alignment_of_a_long_text_and_of_nothing(spark, docs, tokenizers):
    text = odd_texts()[46][1]
    assert len(text) > 50_000
    out, _ = token_alignment.align(docs.where("length(text) > 50000"))
    row = out.collect()[0]
    a, b = tokenizers.encode([text])
    assert (row.n_a, row.n_b) == (len(a[0]), len(b[0])) and row.n_groups == row.n_links > 10_000
    assert token_alignment.align(empty(spark))[0].collect() == []


def test_links_are_suffixes(tokenizers):
    texts = small(odd_texts())
    _, pairs = plain_alignment(tokenizers, texts)
    for a, b, *_ in pairs:
        x, y = tokenizers.bytes_a[a], tokenizers.bytes_b[b]
        assert x.endswith(y) or y.endswith(x)
    assert len(pairs) < tokenizers.possible_pairs() < 4_000_000


# ---------------------------------------------------------------- toxicity

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def lowered(text):
    return (text or "").encode().lower()  # bytes.lower: A-Z only


def plain_grams(word):
    s = b"\x01" + word
    return [s[max(0, i - toxicity.ORDER + 1): i + 1] for i in range(1, len(s))]


def packed(gram):
    return int.from_bytes(gram, "big")


def plain_models(texts, labels, min_count):
    """(ratio of each kept gram, ratio of other symbols by context) from dictionaries."""
    d, top, counts = toxicity.DISCOUNT, set(), [Counter(), Counter()]
    for i, text in texts:
        words = set(WORD.findall(lowered(text)))
        for w in words:
            top.update(plain_grams(w))
        if i in labels:
            for w in words:
                counts[labels[i]].update(plain_grams(w))
    kinds = {n: Counter(g[1:] for g in {g[-n - 1:] for g in top if len(g) > n}) for n in range(1, toxicity.ORDER)}

    def shared(g):
        p = 1 / 256
        for n in range(1, len(g) + 1):
            mine = {x: c for x, c in kinds[n].items() if x[:-1] == g[-n:-1]}
            if mine:
                total = sum(mine.values())
                p = max(mine.get(g[-n:], 0) - d, 0) / total + d * len(mine) / total * p
        return p

    kept = {g for g in {*counts[0], *counts[1]} if counts[0][g] + counts[1][g] >= min_count}
    ratio, otherwise = {}, {}
    for g in kept:
        h, likely = g[:-1], []
        for c in counts:
            total = sum(n for x, n in c.items() if x[:-1] == h)
            rest = 1 - sum(max(n - d, 0) for x, n in c.items() if x[:-1] == h and x in kept) / total if total else 1
            likely.append(((max(c[g] - d, 0) / total if total else 0) + rest * shared(g[1:]), rest))
        ratio[packed(g)] = math.log(likely[1][0] / likely[0][0])
        otherwise[packed(h)] = math.log(likely[1][1] / likely[0][1])
    return ratio, otherwise


def labelled_corpus(n=400, seed=11):
    rnd = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "éd", "nd", "ha"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    rude = ["zwurk", "glombo", "Snarf!"]
    texts, labels = [], {}
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 80))]
        labels[i] = int(rnd.random() < 0.3)
        if labels[i]:
            words[rnd.randrange(len(words))] = rnd.choice(rude)
            words[rnd.randrange(len(words))] = rnd.choice(rude)
        texts.append((i, " ".join(words)))
    return texts, labels


def test_model_against_dictionaries(spark):
    texts, labels = labelled_corpus(60)
    texts += [(1000, "never labelled words thandé"), (1001, None), (1002, "")]
    src = spark.createDataFrame([(i, True, t) for i, t in texts], "id bigint, teaches boolean, text string").repartition(3)
    ids = spark.sparkContext.broadcast((np.array(sorted(labels)), np.array([labels[i] for i in sorted(labels)])))
    counts = src.mapInArrow(toxicity._gathered(ids), "gram bigint, c0 bigint, c1 bigint").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    model = toxicity.fit_models(counts, min_count=3, max_grams=1 << 19)
    ratio, otherwise = plain_models(texts, labels, 3)
    assert model.gram.tolist() == sorted(ratio)
    assert np.allclose(model.ratio, [ratio[g] for g in sorted(ratio)])
    assert {c for c in model.context.tolist()} == {*otherwise}
    assert np.allclose(model.otherwise, [otherwise[c] for c in sorted(otherwise)])
    bytes_of = "zwurk THON thandé".encode()
    t = toxicity.Texts(np.frombuffer(bytes_of, np.uint8), np.array([0, len(bytes_of)]))
    got = dict(zip((tuple(x) for x in np.split(t.grams, t.begin[1:])), model.word_ratios(t), strict=True))
    for w in WORD.findall(bytes_of.lower()):
        grams = [packed(g) for g in plain_grams(w)]
        assert got[tuple(grams)] == pytest.approx(sum(ratio.get(g, otherwise.get(g >> 8, 0.0)) for g in grams))


def test_toxicity_held_out_and_odd_rows(spark):
    import zlib
    texts, labels = labelled_corpus()
    odd = [(5000, None), (5001, ""), (5002, " ;!"), (None, texts[0][1]), (None, None), texts[3], texts[3], (5003, "than zwurk " + "onand thre " * 30000)]
    docs = spark.createDataFrame(rows_of(texts + odd), DOCS).repartition(4)
    marks = [*labels.items(), (5, 1 - labels[5]), (7, None), (8, 9), (None, 1), (99999, 1)]
    out = toxicity.score(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int")).collect()
    assert len(out) == len(texts) + len(odd)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    good = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]
    assert sum(good) / len(good) > 0.95
    blank = {r.score for r in out if r.doc_id in (5000, 5001, 5002)}
    assert len(blank) == 1
    same = {r.score for r in out if r.doc_id == 3}
    assert len(same) == 1


def test_large_model_is_joined_and_whole(spark):
    texts, labels = labelled_corpus()
    texts += [(None, texts[0][1]), (5000, None), (5001, " ;!"), texts[3], texts[3]]
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(3)
    marks = spark.createDataFrame([*labels.items()], "doc_id bigint, toxic int")
    small, large = (sorted((r.doc_id or -1, *r[4:], r.score) for r in toxicity.score(docs, marks, max_grams=m).collect()) for m in (1 << 19, 20))
    assert len(large) == len(texts) and np.allclose(small, large, atol=1e-6)


def test_every_label_teaches(spark, monkeypatch):
    n, told, fit = 80_000, [], toxicity.fit_models
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("thon x"), F.col("id") % 500).alias("text")).repartition(8)
    marks = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 100 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "fit_models", lambda counts, *how: told.append(counts) or fit(counts, *how))
    toxicity.score(docs, marks)
    taught = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1 and pmod(xxhash64(text), 4) > 0")
    want = [taught.where(f"doc_id % 100 {sign} 0").count() for sign in ("<>", "=")]
    got = told[0].where(F.col("gram") == packed((toxicity.START, *b"t"))).first()
    assert want[0] > 37_600 and [got.c0, got.c1] == want


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame(rows_of([(1, "some words"), (2, None)]), DOCS)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    assert all(0 < r.score <= 0.5 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(empty(spark), one).collect() == []


# ---------------------------------------------------------------- repeated rows and shorter passages

def test_repeated_rows_count_their_lines_once(spark):
    from retrials.llm import quality_rules
    common = "a line that far too many texts of one host share between them"
    texts = [(i, f"{common}\n" + " ".join(chr(97 + i % 26) * (i // 26 + 1) + chr(97 + j) for j in range(20))) for i in range(30)]
    rows = texts + [texts[0]] * 4
    docs = spark.createDataFrame(rows_of(rows), DOCS).withColumn("source", F.lit("h")).repartition(3)
    out = quality_rules.quality_rules(docs).where("doc_id = 0").collect()
    assert len(out) == 5
    assert {(r.n_words, r.left_words, r.n_lines_removed, r.kept) for r in out} == {(33, 20, 1, True)}
    cleaned = quality_rules.clean_documents(docs, quality_rules.quality_rules(docs)).where("doc_id = 0").collect()
    assert [r.text for r in cleaned] == [texts[0][1].split("\n")[1]] * 5


@pytest.mark.parametrize("length,passages", [(60, 20), (30, 25)])
def test_shorter_passages_beside_the_longer(spark, length, passages):
    from test_llm import brute_bytes, corpus
    from test_llm import DOCS as WIDE
    from retrials.llm import suffix_array
    docs = spark.createDataFrame(corpus(), WIDE).repartition(3)
    out = suffix_array.remove_repeated_bytes(docs, length, passages=passages).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out)
    assert got == Counter(brute_bytes(corpus(), length))
    short = Counter((r.doc_id, r.left_text) for r in out)
    assert short == Counter((r[0], r[4].decode(errors="ignore")) for r in brute_bytes(corpus(), passages))


def test_ranks_encode_like_the_tokenizers_library(tokenizers):
    rnd = random.Random(1)
    texts = [t or "" for _, t in small(odd_texts())] + [c * 3000 for c in (" ", "a", "^", "\n", "1", "é", "ab ")]
    texts += ["".join(rnd.choice("ab's're  \n\t　\xa0é🙂12,.!-<|endoftext|>ÀñI\r٣") for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    assert tokenizers.ranks is not None
    assert tokenizers.encode(texts)[0] == [tokenizers.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
