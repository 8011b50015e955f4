import numpy as np
import pytest
from pyspark.sql import functions as F

from retrials.functions.lineage import materialize
from retrials.functions.ordered import mid_ranks, position, quantiles, with_previous
from retrials.operators import aggregates as A
from retrials.operators import contracts as C
from retrials.operators import discrimination as D
from retrials.operators import labels as L
from retrials.operators import models as K
from retrials.operators import paths as V
from retrials.operators import sampling as M
from retrials.operators import signals as S
from retrials.operators import text as Q
from retrials.operators import trees as R


def probes(spark, rows):
    return spark.createDataFrame([("r", "p", "m", a, s, n) for a, s, n in rows],
                                 "run_id string, problem_id string, model_key string, anchor long, successes long, continuations long")


def test_position_with_one_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 97).alias("v"), "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = {(r.k, r.id): r.position for r in position(df, ["k"], ["v", "id"]).collect()}
    hot = sorted((i % 97, i) for i in range(0, 5000, 3))
    assert len(got) == 5000
    assert all(got[("hot", i)] == n + 1 for n, (_, i) in enumerate(hot))


def test_quantiles_and_ranks_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=999), 2)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, v double")
    got = {r.g: (r.a, r.b) for r in quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5}).collect()}
    for g in (0, 1):
        assert np.allclose(got[g], np.quantile(x[g::2], [0.1, 0.5]))
    ranks = sorted((r.v, r.r) for r in mid_ranks(df.where("g = 0"), [], "v", "r").collect())
    xs = np.sort(x[0::2])
    assert all(abs(r - (np.searchsorted(xs, v) + np.searchsorted(xs, v, "right") + 1) / 2) < 1e-9 for v, r in ranks)


def test_chunked_lag_crosses_chunks(spark):
    df = spark.range(50).select(F.lit(1).alias("run_id"), F.col("id").alias("i"), (F.col("id") * 10).alias("v"))
    rows = {r.i: (r.p, r.n) for r in with_previous(df, ["run_id"], "i", {"p": ("v", 2), "n": ("v", -1)}, chunk=7).collect()}
    assert len(rows) == 50 and rows[7] == (50, 80) and rows[0] == (None, 10) and rows[49] == (470, None)


def test_stable_crossing_examples(spark):
    a = L.stable_crossing(probes(spark, [(64, 1, 4), (128, 3, 4), (256, 2, 4), (512, 4, 4), (1024, 3, 4)])).first()
    assert (a.interval_lower, a.interval_upper, a.stability_anchor) == (256, 512, 1024)
    b = L.stable_crossing(probes(spark, [(64, 0, 4), (128, 3, 4)])).first()
    assert not b.event_observed and b.censoring_time == 128 and b.interval_upper is None


@pytest.mark.parametrize("prefix,horizon,want", [(128, 128, 0), (128, 512, 1), (384, 256, None), (512, 128, None)])
def test_horizon_outcome(spark, prefix, horizon, want):
    lab = L.stable_crossing(probes(spark, [(64, 1, 4), (128, 3, 4), (256, 2, 4), (512, 4, 4), (1024, 3, 4)]))
    assert lab.select(L.horizon_outcome(F.lit(prefix), F.lit(horizon))).first()[0] == want


def test_signal_summary_and_theil_sen(spark):
    df = spark.range(2048).select(F.lit(1).alias("run_id"), F.lit(2048).alias("prefix_length"), (F.col("id") + 1).alias("rn"), F.col("id").cast("double").alias("v"))
    assert S.theil_sen(df, "v").first().robust_slope == 1.0
    r = S.scalar_summary(df.where("rn <= 100"), "v").first()
    assert r["mean"] == 49.5 and abs(r.slope - 1) < 1e-12 and r.max_rise == 1.0


def test_boxes_and_numbers(spark):
    assert Q.balanced_boxes(r"\boxed{a{b}c} x \boxed{\frac{1}{2}} y \boxed{open \fbox{in}") == ["a{b}c", r"\frac{1}{2}", "in"]
    df = spark.createDataFrame([("50\\%", "1/2"), ("1,250", "1250"), ("x", "1")], "a string, b string")
    got = [r[0] for r in df.select(Q.numbers_equal(Q.numeric_value(F.col("a")), Q.numeric_value(F.col("b")))).collect()]
    assert got == [True, True, None]


def test_segments_with_straddling_markers(spark):
    toks = ["<th", "ink>", "plan ", "</th", "ink>", "so ", "\\bo", "xed{4}", "."]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "run_id long, token_index long, token_text string")
    want = ["special", "special", "thinking", "special", "special", "solution", "final_answer", "final_answer", "final_answer"]
    for chunk in (3, 4096):
        got = [r.new_segment for r in Q.segment_tokens(df, chunk=chunk).orderBy("token_index").collect()]
        assert got == want


def test_overlap_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocab[:3 + i % 9], size=int(rng.integers(3, 14)))) for i in range(80)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:60])], "id long, text string")
    ref = spark.createDataFrame([(i, t) for i, t in enumerate(texts[60:])], "id long, text string")

    def sh(t):
        w = t.split()
        return {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    want = {}
    for i, t in enumerate(texts[:60]):
        best = max(((1.0 if t == u else len(sh(t) & sh(u)) / len(sh(t) | sh(u))), -j) for j, u in enumerate(texts[60:]))
        if best[0] >= 0.1:
            want[i] = (round(best[0], 9), -best[1])
    got = {r.id: (round(r.similarity, 9), r.match_id) for r in Q.overlap_audit(own, ref, 0.1).collect()}
    assert got == want


def test_auroc_matches_pairs_and_loo_is_zero(spark):
    rng = np.random.default_rng(5)
    rows = [(int(p), bool(rng.random() < 0.4), float(rng.integers(0, 6))) for p in range(12) for _ in range(8)]
    df = spark.createDataFrame(rows, "problem_id long, correct boolean, s double")
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(D.auroc(df, "s", "correct").first().auroc - want) < 1e-12
    per = D.within_problem(A.loo_pass_rate(df), "loo_rate", "correct")
    assert per.agg(F.max("auroc")).first()[0] == 0.0


def test_samples_are_nested_and_splits_disjoint(spark):
    p = spark.range(200).select(F.col("id").alias("problem_id"), (1 + F.col("id") % 5).alias("level"))
    small = {r.problem_id for r in M.balanced_sample(p, "x", 5, range(1, 6)).collect()}
    large = {r.problem_id for r in M.balanced_sample(p, "x", 9, range(1, 6)).collect()}
    assert len(small) == 25 and small < large
    split = M.split_by_problem(p, "s", strata=["level"])
    assert C.split_overlap(split).agg(F.sum("shared_problems")).first()[0] == 0
    assert split.groupBy("research_split").count().where("research_split = 'train'").first()["count"] == 120
    with pytest.raises(Exception, match="fewer problems"):
        M.balanced_sample(p, "x", 41, range(1, 6)).collect()


def test_contracts_fail_closed(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    with pytest.raises(Exception, match="duplicate key"):
        C.require_unique(df, ["a"]).collect()
    with pytest.raises(Exception, match="unknown finish_reason"):
        df.select(Q.terminal_outcomes(F.lit(True), F.lit("odd"))["needs_intervention"]).collect()


def test_instability_of_two_in_four(spark):
    df = spark.createDataFrame([(1, s, s < 3, 1, "c") for s in range(1, 5)], "problem_id long, seed long, correct boolean, level long, category string")
    assert abs(A.seed_instability(df, []).first().seed_instability - 1.0) < 1e-12


def test_bins_follow_the_edges_as_doubles(spark):
    from retrials.operators import discrimination as D
    got = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.3, 0.31, 0.6, 0.7, 0.70000001, 0.9, 1.0)], "p double").select(D.probability_bin(F.col("p"), 10).alias("b"))
    assert [r.b for r in got.collect()] == [0, 1, 2, 3, 5, 6, 7, 9, 9]


def test_manifest_keys_are_relative_paths(spark, tmp_path):
    import hashlib

    from retrials.sources.integrity import audit_files, file_manifest
    for folder, body in (("a", b"one"), ("b/c", b"three")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "same.txt").write_bytes(body)
    found = file_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("a/same.txt", 3, hashlib.sha256(b"one").hexdigest()), ("b/c/same.txt", 5, hashlib.sha256(b"three").hexdigest())]
    assert [r.status for r in audit_files(found, found).collect()] == ["ok", "ok"]


def test_large_files_are_digested_block_by_block(spark, tmp_path):
    import hashlib

    from retrials.sources.integrity import audit_files, file_manifest
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "deep" / "a b.bin").write_bytes(b"x" * 5000)
    with open(tmp_path / "deep" / "er" / "huge.bin", "wb") as f:  # over 2 GB, too long for one row
        f.seek((1 << 31) + 10)
        f.write(b"end")
    digest = hashlib.sha256()
    with open(tmp_path / "deep" / "er" / "huge.bin", "rb") as f:
        while part := f.read(1 << 22):
            digest.update(part)
    want = {"empty.bin": (0, hashlib.sha256(b"").hexdigest()), "deep/a b.bin": (5000, hashlib.sha256(b"x" * 5000).hexdigest()),
            "deep/er/huge.bin": ((1 << 31) + 13, digest.hexdigest())}
    assert {r.file: (r.size_bytes, r.sha256) for r in file_manifest(spark, str(tmp_path)).collect()} == want
    truncated = spark.createDataFrame([(k, 9 if k == "empty.bin" else n, d) for k, (n, d) in want.items()], "file string, size_bytes long, sha256 string")
    status = {r.file: r.status for r in audit_files(file_manifest(spark, str(tmp_path)), truncated).collect()}
    assert status == {"empty.bin": "size_mismatch", "deep/a b.bin": "ok", "deep/er/huge.bin": "ok"}
    streamed = file_manifest(spark, str(tmp_path / "deep"), "*.bin", whole=100).where("file = 'a b.bin'").first()
    assert (streamed.size_bytes, streamed.sha256) == want["deep/a b.bin"]


def _tar(path, members, mode="w"):
    import io
    import tarfile
    with tarfile.open(path, mode) as tar:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


def test_rollout_archives(spark, tmp_path):
    pytest.importorskip("yaml")
    from retrials.sources.archives import read_rollout_archives, write_rollout_archives
    block = b"gt_answer: B\nsamples:\n- |\n  first line\n  second: line\n- 'it''s B'\n"
    (tmp_path / "in" / "more").mkdir(parents=True)
    _tar(tmp_path / "in" / "one.tar", {"run/7.yaml": block, "run/logs/7.yaml": b"no: samples", "run/notes.txt": b"x", "8.yaml": b"{gt_answer: 3, samples: []}"})
    _tar(tmp_path / "in" / "more" / "two.tar.gz", {"9.yaml": '{"gt_answer": "é", "samples": ["ü", null]}'.encode(), f"{'d' * 150}/10.yaml": block}, "w:gz")
    rows = read_rollout_archives(spark, str(tmp_path / "in")).collect()
    assert sorted((r.problem, r.reference, r.sample, r.text) for r in rows if r.text is not None) == [
        ("10", "B", 0, "first line\nsecond: line\n"), ("10", "B", 1, "it's B"), ("7", "B", 0, "first line\nsecond: line\n"), ("7", "B", 1, "it's B"), ("9", "é", 0, "ü")]
    assert [(r.problem, r.sample) for r in rows if r.text is None] == [("9", 1)]

    odd = ["", None, "a: b\n- c", "\U0001F600 \u2028 \\ \"quoted\"", "x" * 100_000]
    docs = spark.createDataFrame([(i, odd[: i % 6], str(i)) for i in range(40)], "problem long, samples array<string>, gt_answer string").repartition(7)
    assert write_rollout_archives(docs, str(tmp_path / "out")) == 40
    back = {(r.problem, r.reference, r.sample): r.text for r in read_rollout_archives(spark, str(tmp_path / "out")).collect()}
    assert back == {(str(i), str(i), k): odd[k] for i in range(40) for k in range(min(i % 6, 5))}
    assert write_rollout_archives(docs.limit(0), str(tmp_path / "none")) == 0

    _tar(tmp_path / "bad.tar", {"1.yaml": b"gt_answer: 3"})
    with pytest.raises(Exception, match="1.yaml is no document"):
        read_rollout_archives(spark, str(tmp_path), "bad.tar").collect()


@pytest.mark.parametrize("grid", [None, (0.0, 0.05, 0.3, 0.31, 0.9)])
def test_penalty_from_differences_equals_every_row_on_every_penalty(spark, grid):
    from retrials.operators import policies as P
    rng = np.random.default_rng(3)
    costs = {"short": 1024.0, "medium": 4096.0, "long": 24576.0}
    # Exact ties on and beside grid points, equal probabilities, nulls and NaN among them.
    p = np.round(rng.random((400, 3)), 2)
    p[:60, 2] = np.minimum(1, p[:60, 1] + rng.integers(0, 80, 60) / 100 * (24576 - 4096) / 24576)
    p[60:80] = 0.5
    rows = [tuple(float(x) for x in r) + tuple(bool(b) for b in rng.random(3) < (0.3, 0.5, 0.7)) for r in p]
    rows += [(None, 0.5, 0.4, True, None, True), (0.2, None, 0.9, False, True, None), (0.1, 0.2, None, None, True, False), (float("nan"), 0.5, 0.9, True, True, True)]
    df = spark.createDataFrame(rows, "p_short double, p_medium double, p_long double, short_correct boolean, medium_correct boolean, long_correct boolean")
    lams = grid or P.PENALTIES
    acted = P.with_utilities(df.withColumn("lam", F.explode(F.array(*[F.lit(x) for x in lams]))), F.col("lam"), costs).collect()
    tables = []
    for lam in lams:
        got = [(r.selected_arm, r[f"{r.selected_arm}_correct"], r.long_correct) for r in acted if r.lam == lam]
        known = [y for _, y, _ in got if y is not None]
        longs = [y for _, _, y in got if y is not None]
        tables.append((sum(costs[a] for a, _, _ in got) / len(got), -sum(known) / len(known), lam, sum(longs) / len(longs), *[sum(a == b for b, _, _ in got) / len(got) for a in costs]))
    gaps = sorted(t[3] + t[1] + 1e-9 for t in tables)
    chosen = set()
    for gap in (gaps[0], gaps[len(gaps) // 2], gaps[-1]):
        want = min(t for t in tables if -t[1] >= t[3] - gap)
        r = P.select_penalty(df, costs, gap, lams).first()
        assert np.allclose((r.mean_token_cost, -r.accuracy, r.penalty, r.long_accuracy, r.route_rate_short, r.route_rate_medium, r.route_rate_long), want, atol=1e-12)
        chosen.add(r.penalty)
    assert len(chosen) > 1
    with pytest.raises(Exception, match="no feasible compute penalty"):
        P.select_penalty(df, costs, gaps[0] - 1e-6, lams).collect()


def test_feature_table_has_vector_geometry_and_terminal_flags(spark):
    rng = np.random.default_rng(8)
    tokens, states, vecs = [], [], {}
    for run, size in ((1, 20), (2, 9), (3, 12), (4, 6)):
        tokens += [(run, i, float(rng.normal()), "thinking" if i >= 2 else "solution") for i in range(size)]
        for i in range(0, size + 4, {1: 1, 2: 3, 3: 20, 4: 50}[run]):  # also off the window, one state, none on it
            vecs[run, i] = [0.0] * 3 if (run, i) == (1, 5) else [float(x) for x in rng.normal(size=3)]
            states.append((run, i, vecs[run, i]))
    states.append((3, 4, None))
    t = spark.createDataFrame(tokens, "run_id long, token_index long, s double, segment string")
    st = spark.createDataFrame(states, "run_id long, token_index long, vec array<double>").repartition(3)
    meta = spark.createDataFrame([(r, r, r % 2 == 0, "eos" if r < 3 else "max_new_tokens") for r in (1, 2, 3, 4)], "run_id long, problem_id long, correct boolean, finish_reason string")
    surface = spark.createDataFrame([(1, 5)], "problem_id long, characters long")
    got = S.feature_table(t, meta, surface, (4, 8), ["s"], states=st, finish="finish_reason").collect()
    assert sorted((r.run_id, r.prefix_length or 0) for r in got) == [(1, 0), (1, 4), (1, 8), (2, 0), (2, 4), (3, 0), (3, 4), (3, 8), (4, 0), (4, 4)]
    for r in got:
        size = {1: 20, 2: 9, 3: 12, 4: 6}[r.run_id]
        last = size if r.prefix_length is None else 2 + r.prefix_length
        x = np.array([v for (run, i), v in sorted(vecs.items()) if run == r.run_id and 2 <= i < last]).reshape(-1, 3)
        want = [None] * 5
        if len(x) >= 2:
            d = np.diff(x, axis=0)
            path = (np.linalg.norm(d, axis=1) / np.maximum(np.linalg.norm(x[:-1], axis=1), 1e-12)).sum()
            net = np.linalg.norm(x[-1] - x[0]) / max(np.linalg.norm(x[0]), 1e-12)
            cos = (d[:-1] * d[1:]).sum(axis=1) / np.maximum(np.linalg.norm(d[:-1], axis=1) * np.linalg.norm(d[1:], axis=1), 1e-12)
            angle = np.arccos(np.clip(cos, -1, 1))
            want = [net, path, net / path, *((angle.mean(), angle.var()) if len(angle) else (None, None))]
        have = [r[f"geometry_{c}"] for c in S.HIDDEN]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))) for a, b in zip(have, want, strict=True)), (r.run_id, r.prefix_length, have, want)
        forced, correct = r.run_id >= 3, r.run_id % 2 == 0
        assert (r.normal_completion, r.noncompletion, r.wrong_completion, r.needs_intervention) == (not forced, forced, not correct and not forced, not correct or forced)


def test_recalibration_falls_back_to_the_scores(spark):
    from retrials.operators import models as K
    one = spark.createDataFrame([(0.2, True), (0.7, True)], f"{K.P} double, y boolean")
    out = K.platt(one, one, "y").collect()
    assert [r.calibrated for r in out] == [0.2, 0.7]
    both = spark.createDataFrame([(0.2, False), (0.7, True), (float("nan"), True), (float("inf"), False)] * 5, f"{K.P} double, y boolean")
    out = K.platt(both, both, "y").collect()
    assert all(0 < r.calibrated < 1 for r in out) and sum(r.was_nan for r in out) == 5


def test_an_endpoint_without_power_is_not_fitted(spark):
    from retrials.operators import models as K
    rows = spark.createDataFrame([(f"r{i}", f"p{i}", "train", True, 1.0) for i in range(4)], "run_id string, problem_id string, research_split string, correct boolean, f double")
    got = K.confirmatory(rows, "correct", ["f"], ["f"], folds=2, draws=5).collect()
    assert len(got) == 1 and not got[0].powered and got[0].estimate is None and got[0].oof_auroc is None


def test_whole_run_summary_is_that_of_a_prefix_of_full_length(spark):
    rng = np.random.default_rng(5)
    rows = [(r, i + 1, n, float(v) if v > -1.5 else None) for r, n in (("a", 90), ("b", 7), ("c", 1)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "run_id string, rn long, n long, s double")
    whole = {r.run_id: r.asDict() for r in S.whole_run_summary(df, "s").collect()}
    prefixed = df.withColumn("prefix_length", F.col("n"))
    one = S.scalar_summary(prefixed, "s").join(S.theil_sen(prefixed, "s"), ["run_id", "prefix_length"], "left")
    for r in one.collect():
        for k, v in whole[r.run_id].items():
            assert (v is None and r[k] is None) or v == r[k] or abs(v - r[k]) < 1e-9, (r.run_id, k, v, r[k])
    assert len(whole) == one.count()


def test_model_queries_use_the_defaults():
    """The registered model queries cut neither draws, rounds, trees, components nor folds."""
    import ast
    from pathlib import Path

    from retrials.plans import q_models
    cut = {"draws", "rounds", "trees", "components", "folds"}
    listed = {"evaluate", "ablation_grid", "grid", "contrast_grid", "fit_predict", "probe_oof", "problem_oracle", "transfer", "confirmatory"}
    assert not hasattr(q_models, "DRAWS")
    for call in ast.walk(ast.parse(Path(q_models.__file__).read_text())):
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in listed:
            assert not cut & {k.arg for k in call.keywords}, ast.unparse(call)
            assert not any(k.arg is None for k in call.keywords), ast.unparse(call)
            assert not any(isinstance(a, ast.Constant) and isinstance(a.value, int) for a in call.args), ast.unparse(call)


def _plain_picks(n, draws, start="b:"):
    """Cluster picked by each slot of each draw, from the stated law."""
    import hashlib
    return [[int(hashlib.md5(f"{start}{d}:{i}".encode()).hexdigest()[:15], 16) % n + 1 for i in range(1, n + 1)] for d in range(draws)]


def _index_of(names):
    import hashlib
    order = sorted(names, key=lambda c: (int(hashlib.md5(f"c:{c}".encode()).hexdigest()[:15], 16), c))
    return {slot: c for slot, c in enumerate(order, 1)}


def test_bootstrap_against_explicit_picks(spark, monkeypatch):
    import random

    from retrials.operators import resampling as B
    monkeypatch.setattr(B, "CHUNK_PICKS", 70)
    monkeypatch.setattr(B, "CHUNK_SLOTS", 5)
    rnd, draws, names = random.Random(4), 23, [f"p{i}" for i in range(17)]
    rows = [(c, rnd.randint(0, 6) / 4, rnd.randint(0, 1)) for c in names for _ in range(rnd.randint(1, 9))] + [("p0", 0.5, 1)] * 60
    df = spark.createDataFrame(rows, "problem_id string, s double, y int").repartition(3)
    slots, picks = _index_of(names), _plain_picks(len(names), draws)
    weights = {c: [0] * draws for c in names}
    for d, chosen in enumerate(picks):
        for slot in chosen:
            weights[slots[slot]][d] += 1
    got = {r.problem_id: r.draws for r in B.weight_vectors(df, "problem_id", draws).collect()}
    assert {c: [got[c].count(d) for d in range(draws)] for c in got} == weights
    want = []
    for d in range(draws):
        pos = [(s, weights[c][d]) for c, s, y in rows if y]
        neg = [(s, weights[c][d]) for c, s, y in rows if not y]
        wins = sum(w * v * ((a > b) + 0.5 * (a == b)) for a, w in pos for b, v in neg)
        total = sum(w for _, w in pos) * sum(v for _, v in neg)
        want.append(wins / total if total else None)
    found = {r.draw: r.value for r in B.replicate_metric(df, "s", "y", "auroc", draws=draws).collect()}
    assert sorted(found) == list(range(draws))
    assert [found[d] for d in range(draws)] == pytest.approx(want)


def test_bootstrap_sums_by_group(spark):
    from retrials.operators import resampling as B
    rows = [(g, f"p{i}", float(i + k)) for k, g in enumerate(("u", "v")) for i in range(9 + k)]
    stats = spark.createDataFrame(rows, "g string, problem_id string, x double")
    got = {(r.g, r.draw): r.x for r in B.replicate_sums(stats, ["g"], "problem_id", ["x"], draws=11).collect()}
    for g in ("u", "v"):
        values = {c: x for h, c, x in rows if h == g}
        slots = _index_of(values)
        for d, chosen in enumerate(_plain_picks(len(values), 11, f"b:{g}:")):
            assert got[g, d] == pytest.approx(sum(values[slots[s]] for s in chosen))
    assert B.replicate_sums(stats.where("false"), ["g"], "problem_id", ["x"], draws=3).count() == 0


def test_bootstrap_over_several_blocks_without_broadcast(spark):
    from retrials.functions.digests import packed, pair_hashes, unpacked
    from retrials.operators import resampling as B
    for start in ("b:", "b:" + "é" * 40 + ":"):
        import hashlib
        want = [[int(hashlib.md5(f"{start}{d}:{i}".encode()).hexdigest()[:15], 16) for i in range(95, 102)] for d in range(8, 12)]
        assert pair_hashes(start, 8, 11, 95, 101).tolist() == want
    gaps = np.array([0, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1])
    assert unpacked(packed(gaps)).tolist() == gaps.tolist()
    n, draws = 20000, 2
    ids = spark.range(n).select(F.col("id").alias("problem_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    vectors = B.weight_vectors(ids, "problem_id", draws)
    assert "Broadcast" not in vectors._jdf.queryExecution().executedPlan().toString()
    slots, picks = _index_of(range(n)), _plain_picks(n, draws)
    want = np.zeros((n, draws), int)
    for d, chosen in enumerate(picks):
        np.add.at(want[:, d], [slots[s] for s in chosen], 1)
    got = {r.problem_id: r.draws for r in vectors.collect()}
    assert len(got) == n and all([got[i].count(d) for d in range(draws)] == want[i].tolist() for i in range(n))
    sums = {r.draw: r.x for r in B.replicate_sums(ids, [], "problem_id", ["x"], draws).collect()}
    assert [sums[d] for d in range(draws)] == pytest.approx([float((want[:, d] * (np.arange(n) % 7)).sum()) for d in range(draws)])
    hist = ids.select("problem_id", "x", (F.col("g") == 0).cast("long").alias("pos"), (F.col("g") != 0).cast("long").alias("neg"))
    value = {r.draw: r.value for r in B.replicate_auroc(hist, "x", draws=draws).collect()}
    for d in range(draws):
        pos, neg = (np.bincount(np.arange(n) % 7, weights=want[:, d] * keep, minlength=7) for keep in (np.arange(n) % 3 == 0, np.arange(n) % 3 != 0))
        assert value[d] == pytest.approx((pos * (np.cumsum(neg) - neg / 2)).sum() / pos.sum() / neg.sum())


def test_picks_take_about_two_bits(spark):
    from retrials.operators import resampling as B
    for counts in (np.array([0, 3, 0, 1, 1]), np.array([0] * 500 + [2] + [0] * 90 + [1]), np.array([900, 0, 7]), np.zeros(9, int)):
        assert B._as_cells(B._as_packed(counts.astype(np.uint32)), len(counts)).tolist() == counts.tolist()
    n, draws = 20000, 12
    indexed = B.index_clusters(spark.range(n).select(F.col("id").alias("problem_id")), [], "problem_id")
    size = B.pick_blocks(indexed, [], draws, "b").agg(F.sum(F.length("picks"))).first()[0]
    assert size < 0.3 * n * draws


def test_level_adjusted_ranks_tie_across_levels(spark):
    from retrials.operators import associations as S
    x = [b + v for b in (0.0, 1.0, 7.0) for v in (0.1, 0.2, 0.3)]
    y = [1.0, 3.0, 2.0, 6.0, 4.0, 5.0, 7.0, 9.0, 8.0]
    df = spark.createDataFrame([("m", i // 3, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g string, level int, x double, y double")
    got = S.level_adjusted_spearman(df, "x", "y", ["g"]).first()
    # within each level x is -0.1, 0, 0.1 and y a permutation of -1, 0, 1
    ax, ay = [-0.1, 0.0, 0.1] * 3, [-1.0, 1.0, 0.0, 1.0, -1.0, 0.0, -1.0, 1.0, 0.0]
    assert got.n == 9 and got.adjusted_rho == pytest.approx(np.corrcoef(ax, ay)[0, 1])


def plain_probe(x, y, fold, components, c=1.0):
    """Standardise, SVD and Newton steps for one problem, all rows at once."""
    out = np.full(len(y), np.nan)
    for k in np.unique(fold):
        tr, te = fold != k, fold == k
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z = (x - mu) / np.where(sd > 1e-9, sd, 1.0)
        _, _, vt = np.linalg.svd(z[tr], full_matrices=False)
        a = np.column_stack([np.ones(len(y)), z @ vt[: min(components, tr.sum() - 1)].T])
        n, t = tr.sum(), y[tr]
        w = np.where(t == 1, n / (2 * t.sum()), n / (2 * (n - t.sum())))
        ridge = np.eye(a.shape[1]) / c
        ridge[0, 0] = 0.0
        beta = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-a[tr] @ beta))
            beta -= np.linalg.solve((a[tr] * (w * p * (1 - p))[:, None]).T @ a[tr] + ridge, a[tr].T @ (w * (p - t)) + ridge @ beta)
        out[te] = 1 / (1 + np.exp(-a[te] @ beta))
    return out


def test_problem_scores_follow_one_rule_at_any_size(spark):
    from retrials.operators import models as K
    rng = np.random.default_rng(5)
    rows, ident = [], 0
    for problem, n in ((1, 40), (2, 600), (3, 12), (4, 30)):
        for i in range(n):
            x = rng.normal(size=6)
            x[5] = 2.0  # a constant element
            correct = bool(i % 2) if problem == 3 else bool(x[0] + x[1] * 0.5 + rng.normal() > 0) if problem != 4 else i < 3
            rows.append((problem, ident, [float(v) for v in x], correct, "x"))
            ident += 1
    df = spark.createDataFrame(rows, "problem_id long, vec_id long, vec array<double>, correct boolean, fold string")
    got = K.problem_scores(df.drop("fold"), components=4, folds=3).toPandas().sort_values("vec_id")
    assert set(got["problem_id"]) == {1, 2, 3}  # the fourth has too few of one class
    x = np.array([r[2] for r in rows])
    for problem, g in got.groupby("problem_id"):
        want = plain_probe(x[g["vec_id"]], g["y"].to_numpy(float), g["fold"].to_numpy(), 4)
        assert np.abs(want - g["p"]).max() < 1e-6, problem
    assert K.problem_scores(df.drop("fold").limit(0), components=4, folds=3).count() == 0


def _joins(df) -> list[str]:
    """The conditions of the joins in the optimised plan."""
    import re
    return re.findall(r"Join \w+, (.*)", df._jdf.queryExecution().optimizedPlan().toString())


def test_few_keys_do_not_gather_rows(spark):
    rows = spark.range(400).selectExpr("id AS problem_id", "id % 3 AS level", "id % 2 = 0 AS correct")
    split = M.split_by_problem(rows, "s", strata=["level"])
    halves = M.low_high_strata(rows.selectExpr("*", "problem_id % 7 AS s"), ["level"], "s", "problem_id")
    # rows meet the totals of their (key, bucket), never all rows of a key
    for df in (split, halves):
        assert _joins(df) and all("__bucket" in c for c in _joins(df))
    got = {(r["level"], r["research_split"]): r["n"] for r in split.groupBy("level", "research_split").agg(F.count("*").alias("n")).collect()}
    assert got[0, "train"] == 80 and got[1, "validation"] == 27 and sum(got.values()) == 400
    assert {(r["level"], r["uncertainty_stratum"]): r["count"] for r in halves.groupBy("level", "uncertainty_stratum").count().collect()}[1, "low"] == 66


def test_statistics_of_features_do_not_gather_rows(spark):
    from retrials.operators import models as K
    rows = spark.createDataFrame([(1.0, None, None), (2.0, 4.0, None), (None, 8.0, None), (6.0, float("nan"), None)], "a double, b double, c double")
    stats = K.numeric_statistics(rows, ["a", "b", "c"])
    assert all("__bucket" in c for c in _joins(stats))
    got = {r["feature"]: (r["median"], r["mean"], r["sd"]) for r in stats.collect()}
    assert got["a"] == pytest.approx((2.0, 2.75, np.std([1, 2, 2, 6])))
    assert got["b"] == pytest.approx((6.0, 6.0, np.std([6, 4, 8, 6]))) and got["c"] == (0.0, 0.0, 0.0)


def test_reports_are_written_before_they_are_joined(spark):
    from retrials.operators import models as K
    rows = spark.range(300).selectExpr("id % 40 AS problem_id", "(id * 37 % 101) / 101 AS s", "id % 3 = 0 AS correct")
    report = K.metric_report(rows, "s", "correct", draws=20)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "MapInArrow" not in plan
    row = report.first()
    y, p = np.arange(300) % 3 == 0, (np.arange(300) * 37 % 101) / 101
    pairs = np.subtract.outer(p[y], p[~y])
    assert row["auroc"] == pytest.approx(((pairs > 0) + (pairs == 0) / 2).mean()) and row["used_draws"] == 20
    assert row["brier"] == pytest.approx(((p - y) ** 2).mean()) and row["ci_low"] <= row["auroc"] <= row["ci_high"]


def test_overlap_pairs_only_what_can_match(spark, monkeypatch):
    short = [" ".join(f"w{i + j}" for j in range(12)) for i in range(0, 60, 3)]
    texts = [*short[:10], " ".join(f"w{j}" for j in range(400)), *(" ".join(f"x{i}y{j}" for j in range(12)) for i in range(40))]
    own = spark.createDataFrame([(i, t + " end") for i, t in enumerate(texts)], "id long, text string")
    ref = spark.createDataFrame([(i, t) for i, t in enumerate(short)], "id long, text string")
    written, plain = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df: written.append(plain(df)) or written[-1])
    got = sorted((r.id, r.reason, r.match_id) for r in Q.overlap_audit(own, ref, 0.8).collect())
    assert got == [(i, "near", i) for i in range(10)]
    # the long text is in no set to be paired, and no shingle of one side only is in a written table
    sets = [df for df in written if "rid" in df.columns]
    assert sets and all(df.agg(F.max("n")).first()[0] < 20 for df in sets)
    assert [df.count() for df in written if "f" in df.columns] == [35]


def test_rank_interval_makes_no_row_of_a_draw_and_a_cluster(spark, monkeypatch):
    from retrials.operators import resampling as B
    rows = spark.range(90).selectExpr("id AS problem_id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'one' END AS g", "CASE WHEN id % 3 = 2 THEN 1.5 WHEN id % 11 = 7 THEN double('NaN') ELSE id * 37 % 13 / 4.0D END AS x",
                                      "CASE WHEN id % 17 <> 5 THEN id * 7 % 5 END AS y").repartition(5)
    held = rows.where("y is not null").toPandas()
    midrank = lambda v: (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2
    for groups in ([], ["g"]):
        indexed = B.index_clusters(rows.where("y is not null").select(*groups, "problem_id", "x", "y"), groups, "problem_id")
        drawn = {r.problem_id: r.draws for r in B.draw_lists(indexed, indexed, groups, ["problem_id"], 30, "b").collect()}
        want = {}
        for g, part in (held.groupby("g") if groups else [((), held)]):
            values = []
            for d in range(30):
                take = np.repeat(part.index, [drawn[p].count(d) for p in part.problem_id])
                a, b = midrank(part.x[take].fillna(99).to_numpy()), midrank(part.y[take].to_numpy())
                values.append(np.corrcoef(a, b)[0, 1] if a.std() and b.std() else np.nan)
            good = [v for v in values if not np.isnan(v)]
            want[g] = (*(np.quantile(good, [0.025, 0.975]) if good else (None, None)), len(good), 30 - len(good))
        written, plain = [], B.materialize
        monkeypatch.setattr(B, "materialize", lambda df: written.append(plain(df)) or written[-1])
        got = {r.g if groups else (): r for r in B.spearman_interval(rows, "x", "y", "problem_id", 30, groups=groups).collect()}
        monkeypatch.undo()
        assert got.keys() == want.keys() and max(df.count() for df in written) < 300
        for g, (lo, hi, used, skipped) in want.items():
            assert (got[g].used_draws, got[g].skipped_draws) == (used, skipped)
            assert (got[g].ci_low, got[g].ci_high) == ((None, None) if lo is None else pytest.approx((lo, hi)))


def test_feature_table_joins_written_parts(spark):
    rows = spark.range(60).selectExpr("id % 3 AS run_id", "id div 3 AS token_index", "CAST(hash(id) % 97 AS double) AS s", "'thinking' AS segment")
    meta, surface = (spark.range(3).selectExpr("id AS run_id", "id AS problem_id"), spark.range(2).selectExpr("id AS problem_id", "id AS characters"))
    states = rows.selectExpr("run_id", "token_index", "array(s, s * s) AS vec")
    table = S.feature_table(rows, meta, surface, (4, 8), ["s"], ["s"], "s", states=states)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Aggregate", "Window", "Generate", "ArrowEval"))
    assert sorted((r.run_id, r.prefix_length or 0, r.geometry_turning_angle_mean is None, r.characters) for r in table.collect()) == [
        (i, p, False, i if i < 2 else None) for i in range(3) for p in (0, 4, 8)]


def test_prefix_geometry_reads_written_steps(spark):
    rows = spark.range(60).selectExpr("id % 3 AS run_id", "id div 3 AS token_index", "id AS s", "'thinking' AS segment")
    got = V.prefix_geometry(rows.selectExpr("run_id", "token_index", "array(s, s * s) AS vec"), S.analysis_window(rows), (4, 8))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "scalar-subquery" not in plan
    assert sorted((r.run_id, r.prefix_length or 0, r.states) for r in got.collect()) == [(i, p, p or 20) for i in range(3) for p in (0, 4, 8)]


def test_permutation_null_shuffles_rows_once(spark):
    from retrials.operators import resampling as B
    rows = spark.range(900).selectExpr("CASE WHEN id < 400 THEN 7 ELSE id % 23 END AS problem_id", "hash(id) AS run_id", "CASE WHEN id % 31 <> 0 THEN id * 13 % 17 END AS tokens",
                                       "CASE WHEN id % 29 <> 0 THEN id % 4 = 0 END AS correct")
    want = D.auroc(B.permuted_labels(rows, 3), "tokens", "permuted", ["permutation", "problem_id"]).where("auroc is not null")
    key = lambda df: sorted(tuple(r) for r in df.select("permutation", "problem_id", "auroc", "negatives").collect())
    whole = B.permuted_aurocs(rows, 3, "tokens")
    assert key(whole) == key(want) == key(B.permuted_aurocs(rows, 3, "tokens", most=100)) and len(key(want)) == 69
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_written_tables_are_merged_not_sent_through_the_driver(spark):
    rows = spark.range(400).select((F.col("id") % 4).alias("run_id"), F.floor(F.col("id") / 4).alias("token_index"), (F.col("id") % 13).cast("double").alias("s"),
                                   F.lit("thinking").alias("segment"), F.lit(100).alias("n_tokens"))
    states = rows.where("token_index % 3 = 0").select("run_id", "token_index", F.array(F.col("s"), F.lit(1.0)).alias("vec"))
    meta = rows.select("run_id", F.col("run_id").alias("problem_id"), (F.col("run_id") % 2 == 0).alias("correct")).distinct()
    surface = meta.select("problem_id", F.lit(3).alias("words"))
    scoped = materialize(S.analysis_window(rows))
    for df in (position(scoped, ["run_id"], ["token_index"]), quantiles(scoped, ["run_id"], "s", {"m": 0.5}), S.whole_run_summary(scoped, "s"),
               S.spectrum(scoped, "s"), S.feature_table(rows, meta, surface, (4, 8), ["s"], ["s"], "s", states=states)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def _tree_rows(spark):
    h = lambda k, n: F.abs(F.xxhash64(F.lit(k), "id")) % n
    rows = spark.range(3000).select(F.col("id").alias("run_id"), h(1, 9).cast("double").alias("a"), F.when(h(2, 7) > 0, h(3, 12) / 4).alias("b"), h(4, 25).alias("c"),
                                    h(5, 100).alias("noise"))
    return rows.withColumn("correct", F.col("noise") < 15 + 5 * F.col("a") + F.when(F.col("c") > 11, 20).otherwise(0)).drop("noise")


def test_trees_over_cells_are_those_over_rows(spark, monkeypatch):
    rows = materialize(_tree_rows(spark))
    train, test = rows.where("run_id % 3 > 0"), rows.where("run_id % 3 = 0")
    kinds = {"boosted": {"rounds": 8}, "forest": {"trees": 40}}
    cells = {r.run_id: r for r in K.tree_predictions(train, test, "correct", ["a", "b", "c"], kinds).collect()}
    monkeypatch.setattr(R, "CELLS", 100)
    plain = {r.run_id: r for r in K.tree_predictions(train, test, "correct", ["a", "b", "c"], kinds).collect()}
    assert len(cells) == len(plain) == 1000
    apart = [abs(cells[i].boosted - plain[i].boosted) for i in cells]
    assert max(apart) < 1e-6
    assert np.mean([abs(cells[i].forest - plain[i].forest) for i in cells]) < 0.05
    assert np.corrcoef([cells[i].forest for i in cells], [plain[i].forest for i in cells])[0, 1] > 0.9


def test_rounds_of_boosting_are_no_jobs(spark):
    rows = materialize(_tree_rows(spark))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    counted = []
    for rounds in (2, 12):
        start = jobs()
        assert K.fit_predict(rows, rows.limit(50), "correct", ["a", "c"], kind="boosted", rounds=rounds).count() == 50
        counted.append(jobs() - start)
    assert counted[0] == counted[1]


def test_cuts_of_a_feature_with_many_values(spark):
    rows = spark.range(6400).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(1.0).alias("z"))
    cuts = R.thresholds(rows, ["x", "y", "z"])
    assert cuts["x"] == [100.0 * k - 0.25 for k in range(1, 32)] and cuts["y"] == [0.5, 1.5] and cuts["z"] == []
    assert sorted(r["count"] for r in R.with_cell(rows.select("x"), {"x": cuts["x"]}).groupBy(R.CELL).count().collect()) == [200] * 32


def test_average_precision_makes_no_row_of_a_draw_and_a_score(spark, monkeypatch):
    import random

    from retrials.operators import resampling as B
    rnd, draws, names = random.Random(9), 40, [f"p{i}" for i in range(15)]
    rows = [(c, rnd.choice([0.1, 0.25, 0.5, 0.5, 0.75, 0.9, float("nan")]), int(rnd.random() < 0.3)) for c in names for _ in range(rnd.randint(1, 8))]
    df = materialize(spark.createDataFrame(rows, "problem_id string, s double, y int").repartition(3))
    slots, picks, want = _index_of(names), _plain_picks(len(names), draws), []
    for chosen in picks:
        seen = [(-s if s == s else 1.0, y) for slot in chosen for c, s, y in rows if c == slots[slot]]
        tops = {t: ([y for d, y in seen if d <= t], [y for d, y in seen if d == t]) for t in {d for d, _ in seen}}
        total = sum(y for _, y in seen)
        want.append(sum(sum(at) * sum(upto) / len(upto) for upto, at in tops.values()) / total if total else None)
    written, plain = [], B.materialize
    monkeypatch.setattr(B, "materialize", lambda df: (out := plain(df), written.append(out.count()))[0])
    found = {r.draw: r.value for r in B.replicate_metric(df, "s", "y", "average_precision", draws=draws).collect()}
    assert [found[d] for d in range(draws)] == pytest.approx(want)
    assert max(written) <= len(rows)


def test_metrics_of_the_same_rows_share_their_picks(spark, monkeypatch):
    from retrials.operators import resampling as B
    rows = spark.range(600).select(
        F.col("id").alias("run_id"), F.floor(F.col("id") / 4).alias("problem_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
        ((F.col("id") * 31) % 17 + F.col("id") % 7 > 11).alias("correct"))
    k = F.col("problem_id") % 5
    rows = materialize(rows.withColumn("research_split", F.when(k < 3, "train").when(k == 3, "validation").otherwise("test")))
    hashed, plain = [], B.pick_blocks
    monkeypatch.setattr(B, "pick_blocks", lambda *a: (hashed.append(1), plain(*a))[1])
    got = K.contrast_grid({("all",): rows}, ["scope"], "correct", {"one": ["a"], "two": ["a", "b"]}, "one", draws=20).collect()
    assert len(got) == 4 and len(hashed) == 1 and all(r.used_draws == 20 for r in got)
    table = {(r.feature_set, r.model): r for r in K.ablation_grid(rows, "correct", {"one": ["a"], "two": ["a", "b"]}, {"logistic": {}, "prior": {}}, draws=20).collect()}
    assert len(table) == 4 and len(hashed) == 2
    alone = K.evaluate(rows, "correct", ["a", "b"], draws=20).first()
    assert (alone.auroc, alone.ci_low, alone.ci_high) == pytest.approx([table["two", "logistic"][c] for c in ("auroc", "ci_low", "ci_high")])
    p = rows.select("problem_id", "correct", (F.col("a") / 7).alias("p"), (F.col("b") / 11).alias("q"))
    picked = B.shared_picks(p, ["correct", "p", "q"], draws=20)
    for m in K.CONTRASTED:
        sets = [{r.draw: r.value for r in B.replicate_metric(p, "p", "correct", m, draws=20, picked=x).collect()} for x in (None, picked)]
        assert sets[0] == pytest.approx(sets[1])
    assert B.shared_picks(p.withColumn("q", F.when(F.col("problem_id") > 3, F.col("q"))), ["correct", "q"], draws=20) is None


def test_hashes_look_up_the_lowest_digits(monkeypatch):
    import hashlib

    from retrials.functions import digests
    made, plain = [], np.arange
    monkeypatch.setattr(digests.np, "arange", lambda *a: (x := plain(*a), made.append(len(x)))[0])
    got = digests.pair_hashes("b:u:", 98, 101, 9990, 45003)
    assert sum(made) < 40_000
    for d in (98, 99, 100, 101):
        for i in (9990, 9999, 10000, 19999, 20000, 39999, 40000, 45003):
            assert got[d - 98, i - 9990] == int(hashlib.md5(f"b:u:{d}:{i}".encode()).hexdigest()[:15], 16)


def test_vectors_are_packed_many_at_a_time(monkeypatch):
    from retrials.operators import resampling as B
    counts = np.random.default_rng(3).poisson(1, (50, 37))
    counts[4], counts[7], counts[9, 2] = 0, 300, 6
    calls, plain = [], np.packbits
    monkeypatch.setattr(B.np, "packbits", lambda x: (calls.append(1), plain(x))[1])
    data = B._as_bytes(counts)
    assert len(calls) == 1 and data[4] == b"" and data[7][:1] == b"n" and B._as_bytes(counts[:0]) == []
    assert B._as_counts(data, 37).tolist() == counts.tolist() and B._as_counts([b""], 3).tolist() == [[0, 0, 0]]
