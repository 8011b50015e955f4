"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrials.llm import chat_format, decontaminate, html_text, license_scan, mixing, near_duplicates, quality_rules, repeated_passages, rule_ensemble, suffix_array

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, words string, tkey string, id string"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return SPACES.findall(text or "")


def corpus(seed=5, n=70):
    rnd = random.Random(seed)
    vocab = ["ab", "cé", "de", "xyz", "the", "of", "lo", "ñu", "kk", "qr"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 90))) for _ in range(n)]
    passage = " ".join(rnd.choice(vocab) for _ in range(40))
    for i in range(0, n, 4):
        texts[i] = texts[i] + "\n" + passage + " " + texts[(i + 5) % n]
    for i in range(3, n, 9):
        cut = texts[i - 1].split()
        if len(cut) > 5:
            cut[rnd.randrange(len(cut))] = "changed"
        texts[i] = "  ".join(cut)
    texts[10], texts[11], texts[12], texts[13] = None, "", "   \t\n", "one"
    texts[14] = "again and " * 60
    texts[15] = texts[16] = texts[0]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, "k", "w", "t", "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (rows[1][0], texts[2], "en", "s1", 1, "k", "w", "t", "x"), (None, texts[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- 1

def repeat_words(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)})


def test_quality_base(spark, docs):
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in corpus():
        t, w = r[1] or "", words_of(r[1])
        lines = [x for x in t.split("\n") if words_of(x)]
        rep = repeat_words(w)
        want.append((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)))
    assert sorted_rows(got) == sorted(want, key=repr)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_common_lines_go_and_copies_stay(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits are all alike to the rule
    body = lambda i: " ".join(f"v{letters(i)}x{letters(j)}" for j in range(30))
    rows = [(i, f"{body(i)}\nAccept Cookies 12 now\n{body(i + 1000)}", "h") for i in range(20)]
    rows += [(100 + i, f"{body(5000)}\n{body(5001)}\n{body(5002)}", "h") for i in range(40)]  # copies of one article
    rows += [(200 + i, "\n".join([f"word{letters(i)} " * 3 + "tail " * 6, "accept cookies 99 NOW " * 1] + ["accept cookies 7 now"] * 20), "h") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = quality_rules.quality_rules(df, min_words=1)
    got = {r.doc_id: r for r in verdicts.collect()}
    assert all(got[i].kept and got[i].n_lines_removed == 1 for i in range(20))
    assert all(got[100 + i].kept and got[100 + i].n_lines_removed == 0 for i in range(40))
    assert not any(got[200 + i].kept for i in range(3))  # depleted
    kept = {r.doc_id: r.text for r in quality_rules.clean_documents(df, verdicts).collect()}
    assert kept[0] == f"{body(0)}\n{body(1000)}" and kept[100] == rows[20][1] and 200 not in kept


def test_shared_blocks_and_copied_pages_lose_their_common_lines(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    line = lambda name, i: f"{name}{letters(i)} and some more words"
    block = [line("shared", j) for j in range(10)]
    rows = [(i, "\n".join([*block, line("own", 2 * i), line("own", 2 * i + 1)]), "h") for i in range(40)]  # a block of ten lines, two of one's own
    rows += [(100 + i, "\n".join([*block[:8]] + [line("other", 20 * i + j) for j in range(20)]), "g") for i in range(11)]  # just over the limit
    rows += [(200 + i, "\n".join([*block[:8]] + [line("few", 20 * i + j) for j in range(20)]), "f") for i in range(10)]  # at the limit
    rows += [(300 + i, "\n".join(["the same footer here"] + [line("page", 9 * (i // 5) + j) for j in range(9)]), "e") for i in range(60)]  # 12 texts, 5 copies each
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_lines_removed, r.kept) for r in quality_rules.quality_rules(df).collect()}
    assert all(got[i] == (10, False) for i in range(40))  # depleted
    assert all(got[100 + i] == (8, True) for i in range(11))
    assert all(got[200 + i] == (0, True) for i in range(10))
    assert all(got[300 + i] == (1, True) for i in range(60))


# ---------------------------------------------------------------- 2

def test_repeated_passages(spark, docs):
    k, rows = 13, corpus()
    least = {}
    grams = []
    for r in rows:
        w, order = words_of(r[1]), r[0] if r[0] is not None else 1 << 62
        g = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
        grams.append((order, w, g))
        for x in g:
            least[x] = min(order, least.get(x, order))
    want = []
    for r, (order, w, g) in zip(rows, grams, strict=True):
        gone = {i + j for i, x in enumerate(g) if least[x] < order for j in range(k)}
        want.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = repeated_passages.remove_repeats(docs, k)
    assert sorted_rows(got) == sorted(want, key=repr)
    assert any(w[2] for w in want) and repeated_passages.remove_repeats(empty(spark)).count() == 0


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    words = np.zeros(1 << 4, np.uint64)
    for bit in np.concatenate([keys >> np.uint64(54), keys & np.uint64(1023)]):
        words[int(bit) >> 6] |= np.uint64(1) << (bit & np.uint64(63))
    assert repeated_passages.Filter(words, 10).may_hold(keys).all()


# ---------------------------------------------------------------- 3

PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies <b>now</b></div><article><h1>Head &amp; line</h1><p>First <i>para</i>graph.<p>Second&nbsp;one<br>more
<aside>Side</aside><form>Send <input></form><section id="comments"><p>Nice!</p></section></article><div class=ad>Buy</div><script>var a="<p>x</p>"</script><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line First paragraph. Second one more"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><!-- x -->") == ""
    long = "word " * 40
    plain = f"<ul><li><a href=a>Menu one</a><li><a href=b>Menu two</a></ul><p>{long}</p><p>short</p><p>{long}</p><hr><div class=menu>x</div><div><a href=q>Link</a></div>"
    assert html_text.main_text(plain) == f"{long.strip()} short {long.strip()}"
    assert html_text.main_text("<p>tiny") == "tiny"


def test_teaser_article_does_not_hide_the_main_text():
    long = "The main text stands outside of the article and goes on for long enough to surge. " * 2
    page = f"<body><nav><a href=x>Menu</a></nav><article><p>Teaser</p></article><nav>x</nav><div><p>{long}</p><p>short end</p></div><footer>f</footer><div><a href=y>{long}</a></div></body>"
    assert html_text.main_text(page) == f"Teaser {long.strip()} short end"


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted_rows(html_text.extract(df))
    assert got[0][2] == got[1][2] == "Head & line First paragraph. Second one more" and got[2] == (None, None, "", 0)
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4

def test_rule_ensemble(spark):
    good = [(i, " ".join(f"w{i * 7 + j}." for j in range(40)), 1) for i in range(60)]
    bad = [(100 + i, ("X$$ " * (20 + i)).strip(), 0) for i in range(60)]
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in good + bad] + [(None, None, "z"), (500, "", "z")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(9999, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rule_ensemble.score(df, labels, trees=4, penalty=0.01).collect()}
    assert len(got) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(i, q) for i, _, q in good + bad if got[i].held_out]
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.95
    import zlib
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in good + bad) and not got[None].held_out
    none = rule_ensemble.score(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert rule_ensemble.score(df.limit(0), labels).count() == 0
    with pytest.raises(ValueError, match="other than 0 and 1"):
        rule_ensemble.score(df, labels.union(spark.createDataFrame([(0, 2)], "doc_id long, quality int")))


def test_paths_of_a_tree():
    text = "root\n  If (feature 0 <= 2.5)\n   If (feature 1 <= 0.5)\n    Predict: 0.0\n   Else (feature 1 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 2.5)\n   Predict: 1.0\n"
    terms = [r.terms for r in rule_ensemble.paths(text, ("a", "b"))]
    assert terms == [(("a", True, 2.5),), (("a", True, 2.5), ("b", True, 0.5)), (("a", True, 2.5), ("b", False, 0.5)), (("a", False, 2.5),)]


# ---------------------------------------------------------------- 5

def test_license_scan(spark):
    texts = ["Released under the MIT License. Released under the MIT License!", "This work is licensed under the GNU General Public License, version 3.",
             "licensed under the gnu general public road", None, "", "CC BY-NC 4.0", "it is under the mit", "Apache License, Version 2.0 " * 3,
             "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated documentation files"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(0, texts[0], "b")], "doc_id long, text string, labels string")
    rows = license_scan.scan_licenses(df).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 10
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels) == (10, 2, 1, 6, "mit") and got[0].score == 1.0
    assert got[1].base_labels == "" and got[1].labels == "gpl-3" and 0.7 <= got[1].score <= 1
    assert got[2].labels == got[3].labels == got[4].labels == got[6].labels == "" and got[3].n_words == 0 and got[3].first_word is None
    assert got[5].base_labels == "cc-by-nc" and (got[7].n_base, got[7].last_word) == (3, 10) and got[8].labels == "mit"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def _noisy_notices(n):
    """Notices with words dropped, changed or put in, within filler that shares their common words."""
    import random
    rng = random.Random(5)
    filler = "the of and this software is license to under a any work version 2 public".split()
    texts = []
    for i in range(n):
        notice = rng.choice(license_scan.TEMPLATES)[1].split()
        words = [w if rng.random() > 0.12 * (i % 4) else rng.choice(filler) for w in notice if rng.random() > 0.05 * (i % 3)]
        texts.append(" ".join(rng.choices(filler, k=rng.randrange(60)) + words + rng.choices(filler, k=rng.randrange(60))))
    return texts


def test_license_places_lose_nothing_to_the_intersection():
    from collections import Counter
    texts = _noisy_notices(300)
    words = [license_scan.words_of(t) for t in texts]
    index = license_scan.Index(len(texts), Counter(w for ws in words for w in set(ws)))
    hits = 0
    for ws in words:
        starts, base, found, best = index.scan(ws)
        want, top = set(base), 1.0 if base else 0.0
        for t, (label, notice, must) in enumerate(index.templates):
            rare = {o for w in index.postings for u, o in index.postings[w] if u == t}
            for at in range(-len(notice) + 1, len(ws)):  # every place, no intersection first
                if not any(0 <= at + o < len(ws) and ws[at + o] == notice[o] for o in rare):
                    continue
                lo = max(0, at - index.slack)
                near = ws[lo: at + len(notice) + index.slack]
                share = index.shared(near, t, at - lo)
                if share >= index.coverage and all(index.holds(near, phrase) for phrase in must):
                    want.add(label)
                    top = max(top, share)
        assert (found, best) == (want, top)
        hits += bool(want)
    assert 100 < hits < 300
    assert all(need > 0 for need in index.needed)


def test_license_base_columns_match_sql(spark):
    import duckdb
    import pandas as pd
    phrases = [phrase for phrase, _ in license_scan.BASE]
    rows = [(i, t + (f" {phrases[i % 3].upper()}, {phrases[i % 2]}" if i % 5 else "")) for i, t in enumerate(_noisy_notices(120))] + [(900, None), (901, ""), (902, "CC-BY_NC é1 cc.by nc")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    listed = ", ".join(f"('{phrase}', '{label}')" for phrase, label in license_scan.BASE)
    want = con.execute(rf"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
        p as (select string_split(phrase, ' ') as phrase, label from (values {listed}) t(phrase, label)),
        h as (select doc_id, i, label from (select *, unnest(range(len(words))) as i from w), p where words[i + 1:i + len(phrase)] = phrase)
        select doc_id, len(any_value(words)), count(label), min(i), max(i), coalesce(string_agg(distinct label, ',' order by label), '') from w left join h using (doc_id) group by doc_id""").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_base for r in got) > 150


# ---------------------------------------------------------------- 6

def brute_groups(rows, k, percent):
    sets = []
    for r in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(r[1])]
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, k):
    got = near_duplicates.near_duplicates(docs, k=k).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted_rows(got) == sorted(brute_groups(corpus(), k, 80), key=repr)


def test_chain_of_near_copies(spark):
    """Each text is near the next only; the whole chain is one component."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(25):
        rows.append((1000 - i, " ".join(words)))
        words[(i * 4) % 100] = f"n{i}"
        words[(i * 4 + 1) % 100] = f"m{i}"
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.component_id for r in got} == {976} and sum(r.kept for r in got) == 1


def test_super_minhash_estimates():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 63, 900, dtype=np.uint64)
    a, b = np.sort(pool[:600]), np.sort(pool[300:])
    sig = near_duplicates.super_minhash(np.repeat([0, 1], 600), np.concatenate([a, b]), 2, 256)
    assert abs((sig[0] == sig[1]).mean() - 300 / 900) < 0.12
    again = near_duplicates.super_minhash(np.repeat([0, 1], 600), np.concatenate([a, b]), 2, 256, chunk=97)
    assert (sig == again).all()  # parts of a set combine


# ---------------------------------------------------------------- 7

def test_mix(spark, docs):
    rows = corpus()
    got = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((r[0], len(words_of(r[1]))) for r in rows), key=repr)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted_rows(mixing.mix(docs, buckets=3)) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(empty(spark)).count() == 0


# ---------------------------------------------------------------- 8

def test_chat(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "a<|end|>\n&lt;"), part("image", None, "i.png", 56, 57), part("text", "b")]), (1, 1, "assistant", [part("text", "[INST]&amp;")]),
            (1, 2, "user", [part("audio", None, "a.wav", s=2.5), part("document", None, "d.pdf", p=3), part("odd<|", None, "z")]), (1, 3, "assistant", [part("text", "x"), part("text", None)]),
            (None, None, None, None), (2, 0, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat_format.format_chat(df).withColumn("turns", chat_format.read_back(F.col("formatted")))
           .withColumn("learnt", chat_format.learnt_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = got[1]
    assert [(t.role, t.text) for t in one.turns][1] == ("assistant", "[INST]&amp;") and one.turns[0].text.startswith("a<|end|>\n&lt;")
    assert one.learnt == "[INST]&amp;x" and one.n_turns == 4
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, 1, "image", "i.png", 6), (2, 0, "audio", "a.wav", 63), (2, 1, "document", "d.pdf", 768), (2, 2, "odd<|", "z", 1)]
    assert one.n_expanded_tokens == 838 and "<|image:1|>" in one.formatted and one.formatted.count("<|end|>") == 4
    assert got[None].n_turns == 1 and got[2].learnt == ""
    assert chat_format.format_chat(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9

def test_decontaminate(spark, docs):
    rnd = random.Random(2)
    item = [f"q{rnd.randrange(10**6)}" for _ in range(30)]
    changed = list(item)
    for i in (4, 13, 22):
        changed[i] = "other"
    short = ["tiny", "quiz", "item"]
    extra = [(900, "x y z, " + ", ".join(item).upper() + " end"), (901, "a b " + " ".join(changed) + " c"), (902, " ".join(item[:8]) + " cut"), (903, "so Tiny quiz ITEM it is"), (904, " ".join(item[5:20]))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "")], "item_id long, text string")
    got = sorted_rows(decontaminate.find_overlaps(both, bench))
    assert got == [(900, 1, 3, 30, 30, 30), (901, 1, 7, 25, 23, 30), (903, 2, 1, 3, 3, 3), (904, 1, 0, 15, 15, 30)]
    assert sorted_rows(decontaminate.find_overlaps(both, bench, block_words=4)) == got  # block by block
    kept = decontaminate.drop_contaminated(both, bench)
    assert kept.columns == both.columns and {900, 901, 903, 904} & {r.doc_id for r in kept.collect()} == set() and kept.count() == both.count() - 4
    assert decontaminate.find_overlaps(empty(spark), bench).count() == 0 and decontaminate.find_overlaps(both, bench.limit(0)).count() == 0


def test_decontaminate_finds_all_over_the_limit():
    """Every item of 1 to 21 words with any words changed, as long as over 80 % are equal; none at or under that."""
    from itertools import combinations
    for n in range(1, 22):
        words = [f"w{i}" for i in range(n)]
        block = decontaminate.Block([(1, " ".join(words))])
        most = max(k for k in range(n) if n - k > 4 * k)
        texts = [" ".join(["a", *("other" if i in gone else w for i, w in enumerate(words)), "b"]) for gone in combinations(range(n), most)]
        if n <= 13:  # one more changed: under the limit
            texts += [" ".join("other" if i in gone else w for i, w in enumerate(words)) for gone in combinations(range(n), most + 1)]
        wanted = sum(1 for _ in combinations(range(n), most))
        data, at = decontaminate.byte_views(decontaminate.pa.array(texts, decontaminate.pa.string()))
        found = block.find(decontaminate.Words(data, at, lower=True, gaps=decontaminate.NOT_ALNUM))
        assert [r for r, *_ in found] == list(range(wanted)), n
        assert all(size >= min(13, n) and hit > 0.8 * size for _, _, _, size, hit in found)


def test_decontaminate_masks_cover_long_stretches():
    """Over all stretches of 13 to 77 words that no mask finds, the best has no more than 80 % equal words."""
    masks = [int(m, 2) for m in decontaminate.MASKS]
    span = max(map(len, decontaminate.MASKS))
    last = np.arange(1 << span)  # the last words: 1 for an equal one
    hit = np.any([(last & m) == m for m in masks], axis=0)
    half = 1 << (span - 1)
    best = np.full(half, -10**6)
    best[0] = 0
    for size in range(1, 78):
        score = np.where(hit, -10**6, best[last >> 1] + np.where(last & 1, 1, -4))
        best = np.maximum(score[:half], score[half:])
        assert size < 13 or best.max() <= 0, size


# ---------------------------------------------------------------- 10

def brute_bytes(rows, length):
    n = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        n.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length", [50, 101])
def test_suffix_array(spark, docs, length):
    got = [(*r[:4], bytes(r[4])) for r in suffix_array.remove_repeated_bytes(docs, length).collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(corpus(), length), key=repr)
    assert suffix_array.remove_repeated_bytes(empty(spark), length).count() == 0


def test_hot_anchors_are_salted(spark, docs, monkeypatch):
    """The same result when every repeated anchor is split, and when long texts come in pieces."""
    full = suffix_array.repeated_spans
    monkeypatch.setattr(suffix_array, "repeated_spans", lambda first, length: full(first, length, hot_rows=1))
    monkeypatch.setattr(suffix_array.pieces, "__defaults__", (200,))
    got = [(*r[:4], bytes(r[4])) for r in suffix_array.remove_repeated_bytes(docs, 50).collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(corpus(), 50), key=repr)


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 3, (400, 6)).astype(">u8")
    order = suffix_array.multikey_quicksort(tokens)
    assert [tuple(r) for r in tokens[order]] == sorted(tuple(r) for r in tokens)


# ---------------------------------------------------------------- the pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    rows = [r[:5] for r in corpus(seed=8)]
    rnd = random.Random(6)
    passage = " ".join(f"p{rnd.randrange(10**6)}" for _ in range(60))
    clean = [(300 + i, "\n".join(" ".join(f"c{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(3)), "en", f"s{i % 3}", 1) for i in range(12)]
    rows += clean + [(400 + i, f"{c[1]}\n{passage}", "en", "s9", 1) for i, c in enumerate([(0, " ".join(f"d{rnd.randrange(10**6)}" for _ in range(90))) for _ in range(4)])]
    near = clean[0][1].split()
    near[7] = "edited"
    rows.append((500, " ".join(near[:20]) + "\n" + " ".join(near[20:]), "en", "s1", 1))
    item = [f"b{rnd.randrange(10**6)}" for _ in range(25)]
    rows.append((501, " ".join(f"e{rnd.randrange(10**6)}" for _ in range(60)) + " " + " ".join(item), "en", "s1", 1))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert tuple(docs.columns) == cp.COLUMNS
    ids = [c[0] for c in clean]
    assert all(set(ids) <= set(seen[s]) for s in list(seen)[:4])
    assert 500 in seen["quality rules"] and 500 not in seen["near duplicates"]
    assert not any(passage in seen["repeated passages"][400 + i].text for i in range(4))
    assert 501 in seen["repeated passages"] and 501 not in seen["decontamination"]
    assert all(seen["repeated passages"][c[0]].text == c[1] for c in clean)
    assert len(seen["mixing"]) > 10


def test_queries_have_their_contract_columns():
    from retrials.llm import queries
    assert [n for n in queries.QUERIES if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
