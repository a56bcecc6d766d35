"""Operators 1, 3, 4, 5, 7 and 9."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxsieve.llm import chat, mixing, ordinal, quality_rules, queries, simhash, voronoi
from fluxsieve.operators import components
from tests.oracle import compare, duck

from . import brute


def bag(rows):
    return sorted(rows, key=repr)


# ------------------------------------------------------------------ 1

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") \
        .select("*", F.lit(1).alias("cell"), F.lit(2).alias("v"), F.lit(3).alias("id"), F.lit(4).alias("score"))


def check_top_k(spark, rows, every, **how):
    want = brute.top_k([(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows], 5, every)
    got = {}
    for r in voronoi.top_k(vectors(spark, rows), F.col("vec_id") % every == 0, **how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_top_k(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(i % 7, 1) for _ in range(12)], 0) for i in range(700)]
    rows += [(1000 + i, [1.0] * 12, 0) for i in range(200)]                      # one very common vector
    rows += [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")] * 12, 0), (2003, [float("inf")] * 12, 0),
             (2004, [], 0), (2005, [1.0, -2.0], 0), (None, [1.0] * 12, 0)]
    rows += [rows[5], rows[5], rows[7]]                                          # repeated rows: a query's and another's
    check_top_k(spark, rows, 5)
    check_top_k(spark, rows, 5, pivots=3, groups=2, block=64)


def test_top_k_prunes(spark):
    """Far clusters are not sent to queries of another one, and results stay exact."""
    rnd = random.Random(2)
    spots = [[rnd.gauss(0, 100) for _ in range(8)] for _ in range(8)]
    rows = [(i, [x + rnd.gauss(0, 0.01) for x in spots[i % 8]], 0) for i in range(800)]
    check_top_k(spark, rows, 50)
    centre = voronoi._lift(np.array(spots), float((np.array(spots) ** 2).sum(axis=1).max()), False)
    needs, _, _ = voronoi._bounds(centre, {j: [0.0] * 6 for j in range(8)}, {0: (0.5, 3), 1: (0.5, 3)}, 5, 2)
    assert np.isinf(needs).sum() > 8


def test_top_k_repeated_query_id(spark):
    """A query's own rows, in one cell or several, are no neighbours: far cells stay needed."""
    rnd = random.Random(3)
    spots = [[rnd.gauss(0, 100) for _ in range(8)] for _ in range(8)]
    rows = [(i, [x + rnd.gauss(0, 0.01) for x in spots[1 + i % 7]], 0) for i in range(1, 400)]
    far = [3 * x for x in spots[0]]                                # the longest, hence at distance 0 of its own copies
    less = [far[0] - 1.0, *far[1:]]                                # a query asks with the least of its vectors
    check_top_k(spark, rows + [(0, far, 0)] * 7, 1000, pivots=500)
    check_top_k(spark, [(0, less, 0)] * 4 + rows + [(0, far, 0)] * 4 + [(1000, far, 0)], 1000, pivots=500)
    near = {0: [0.0] * 6, 1: [1.0] * 6}
    centre = np.array([[0.0, 0.0], [100.0, 0.0]])
    own, _, _ = voronoi._bounds(centre, near, {0: (0.5, 1)}, 5, 1, {0: [7] * 6, 1: list(range(6))})
    assert np.isfinite(own[0, 1])


def test_top_k_few_or_no_rows(spark):
    check_top_k(spark, [(0, [1.0, 2.0], 0), (50, [0.5, 0.5], 0), (7, [3.0, 1.0], 0)], 50)
    check_top_k(spark, [(3, [1.0], 0)], 50)
    assert voronoi.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


# ------------------------------------------------------------------ 3

def test_ordinal_gradient_and_order():
    rnd = np.random.default_rng(0)
    n, feats = 600, 40
    truth = rnd.normal(size=feats)
    rows, starts, z = [], [], []
    for _ in range(n):
        f = np.unique(rnd.integers(0, feats, 8)).astype(np.int32)
        starts.append(sum(map(len, rows)))
        rows.append(f)
        z.append(truth[f].sum())
    grade = np.digitize(np.array(z) + rnd.logistic(size=n) * 0.3, [-1.5, 1.5])
    m = ordinal.fit_arrays(np.concatenate(rows), np.array(starts), grade, 3, 8)
    assert (np.diff(m.thresholds) > 0).all()
    margin = np.array([m.weights[f].sum() for f in rows])
    assert np.corrcoef(m.expected(margin), z)[0, 1] > 0.85


def test_ordinal_held_out(spark):
    """Fit on half of the labelled documents, judge the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, sf, "documents"), queries.graded(queries.table(spark, sf, "labels"))
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    model = ordinal.fit(docs, fit, n_grades=3)
    rows = ordinal.score(docs, model, tail_grade=2).join(held, "doc_id").select("grade", "selected", "expected_grade").collect()
    good = [r.selected for r in rows if r.grade == 2]
    toxic = [r.selected for r in rows if r.grade == 0]
    low = [r.selected for r in rows if r.grade == 1]
    assert np.mean(good) > 0.97 and np.mean(toxic) < 0.3 and np.mean(low) < 0.15   # some 2,000 rated documents
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert mean == sorted(mean)


def test_ordinal_edges(odd, odd_list, none, spark):
    ratings = spark.createDataFrame([(r[0], i % 3) for i, r in enumerate(odd_list)] + [(1, None), (None, 2), (2, 9)], "doc_id long, grade int")
    model = ordinal.fit(odd, ratings, n_grades=3, fit_rows=50, bits=10)
    got = ordinal.score(odd, model, tail_grade=2, carry=["doc_id", "selected"] [:1]).collect()
    assert bag(r.doc_id for r in got) == bag(r[0] for r in odd_list)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    assert ordinal.score(none, model, tail_grade=2).count() == 0
    assert ordinal.fit(odd, ratings.limit(0), n_grades=3) is None
    assert all(r.selected and r.expected_grade is None for r in ordinal.score(odd, None, tail_grade=2).collect())


def test_ordinal_sample(frame, none, spark):
    """Ratings of other documents take no place in the sample; a repeated id is one document."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdef") + str(i % 3) for _ in range(12)), "en", "s") for i in range(60)]
    rate = lambda ids: spark.createDataFrame([(i, i % 3) for i in ids], "doc_id long, grade int")
    plain = ordinal.fit(frame(rows), rate(range(60)), n_grades=3, fit_rows=60, bits=10)
    crowded = ordinal.fit(frame(rows), rate(range(2000)), n_grades=3, fit_rows=60, bits=10)
    repeated = ordinal.fit(frame(rows + rows[:1] * 50), rate(range(60)), n_grades=3, fit_rows=60, bits=10)
    for other in (crowded, repeated):
        assert (plain.weights == other.weights).all() and (plain.thresholds == other.thresholds).all()
    with pytest.raises(ValueError):
        ordinal.fit(frame(rows), rate(range(100, 200)), n_grades=3, bits=10)
    assert ordinal.fit(none, rate(range(9)), n_grades=3) is None


def test_ordinal_against_the_plain_formula(odd, odd_list, spark):
    """Every document's expected grade and tail probability by the cumulative-link formula, word by word."""
    ratings = spark.createDataFrame([(r[0], i % 4) for i, r in enumerate(odd_list) if r[0] is not None], "doc_id long, grade int")
    model = ordinal.fit(odd, ratings, n_grades=4, bits=12)
    want = [brute.ordinal(r[1], model.weights, model.thresholds) for r in odd_list]
    assert len({round(e, 6) for e, _ in want}) > 50                   # the model tells documents apart
    for tail in (1, 3):
        got = ordinal.score(odd, model, tail_grade=tail, least_tail=0.4).collect()
        key = lambda i, e, p: (-1 if i is None else i, round(e, 7), round(p, 7))
        assert sorted(key(r.doc_id, r.expected_grade, r.tail_probability) for r in got) == \
            sorted(key(i[0], e, above[tail - 1]) for i, (e, above) in zip(odd_list, want))
        assert all(r.selected == (r.tail_probability >= 0.4) for r in got)


def test_ordinal_fit_is_the_least(frame, spark):
    """No small step from the fitted weights and thresholds lowers the plain penalised loss."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdef") + str(rnd.randint(0, 1 + i % 3)) for _ in range(8)), "en", "s") for i in range(90)]
    model = ordinal.fit(frame(rows), spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id long, grade int"), n_grades=3, bits=10)
    seen = Counter(f for _, t, *_ in rows for f in brute.ordinal_features(t, 10))
    free = sorted(f for f, n in seen.items() if n >= 10)
    assert not model.weights[[f for f, n in seen.items() if n < 10]].any()
    graded_texts = [(t, i % 3) for i, t, *_ in rows]
    loss = lambda w, th: brute.ordinal_loss(graded_texts, w, th, 3e-4)
    weights, best = model.weights.astype(float), loss(model.weights.astype(float), model.thresholds)
    for f in free[::3]:
        for step in (-0.05, 0.05):
            w = weights.copy()
            w[f] += step
            assert loss(w, model.thresholds) > best - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            th = model.thresholds.copy()
            th[k] += step
            assert loss(weights, th) > best - 1e-6


# ------------------------------------------------------------------ 4

def test_simhash(odd, odd_list, none):
    fps = [brute.simhash(r[1]) for r in odd_list]
    root = brute.groups(fps)
    least = {}
    for r, g in zip(odd_list, root):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    got = simhash.near_duplicates(odd, carry=["doc_id"]).collect()
    assert bag((r.doc_id, r.fingerprint, r.component_id) for r in got) == \
        bag((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(odd_list, fps, root))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert bag(r.doc_id for r in kept.collect()) == bag(least.get(g) for g in set(root))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rnd = random.Random(radius)
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("radius,bucket", [(1, 128), (2, 128), (2, 2), (3, 4)])
def test_links_connect_all_pairs(spark, radius, bucket):
    """Clouds of neighbours, with full buckets forced onto the exact way beyond the bucket limit."""
    rnd = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            fps.add(x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = dict(map(tuple, components.connected_components(simhash.links(df, radius, bucket)).collect()))
    want, mine = {}, {}
    for x, g in zip(fps, brute.groups(fps, radius)):
        want.setdefault(g, set()).add(x)
        s = simhash._signed(x)
        mine.setdefault(roots.get(s, s), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_components_long_chain(spark):
    edges = [(i, i + 1) for i in range(3000)] + [(10_000, 10_001), (10_002, 10_001), (5, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert len({got[i] for i in range(3001)}) == 1 and len({got[i] for i in (10_000, 10_001, 10_002)}) == 1
    assert len(set(got.values())) == 2
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 5, 7, 9

@pytest.mark.parametrize("name", ["op1_voronoi_top_k", "op2_lm_difference", "op5_adaptive_rules", "op7_curriculum_mix", "op8_substring_dedup", "op9_chat_format"])
def test_sql(spark, name):
    fn, sql = queries.QUERIES[name]
    ok, message = compare(fn(spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), sql)
    assert ok, message


def repeat_words(w, size=5):
    at = {}
    for i in range(len(w) - size + 1):
        at.setdefault(tuple(w[i:i + size]), []).append(i)
    return len({j for s in at.values() if len(s) > 1 for i in s for j in range(i, i + size)})


def test_rules(odd, odd_list, none):
    got = {}
    for r in quality_rules.judge(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in odd_list:
        w, t, r = [x.decode() for x in brute.words(text)], text or "", got[i][0]
        lines = [x for x in t.split("\n") if brute.words(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat_words(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 10 or 100 * want[4] > 20 * len(w))
        assert r.kept == (r.reason is None) and not (r.base_failed and r.kept)
    assert sum(map(len, got.values())) == len(odd_list)
    assert quality_rules.judge(none).count() == 0


def test_rules_follow_their_group(frame):
    """A ratio that is usual in one source is kept there and rejected in another."""
    rnd = random.Random(1)
    say = lambda mark: " ".join(f"w{rnd.randint(0, 500)}" + mark * (rnd.random() < 0.6) for _ in range(60))
    rows = [(i, say(""), "en", "plain") for i in range(300)] + [(1000 + i, say("&&"), "en", "code") for i in range(300)]
    rows += [(5000, say("&&"), "en", "plain"), (5001, say("&&"), "en", "small")]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame(rows)).collect()}
    assert not kept[5000] and all(kept[i] for i in range(300)) and sum(kept[1000 + i] for i in range(300)) > 290


@pytest.mark.parametrize("share, kind", [(0.1, 0), (0.3, 1), (0.4, 0), (0.4, 1)])
def test_rules_in_a_dirty_source(frame, share, kind):
    """Junk that passes the base rules is rejected though it is a large part of its source; clean documents stay."""
    rnd = random.Random(int(100 * share))
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    clean = lambda: " ".join(word() + "&" * (rnd.random() < 0.02) for _ in range(rnd.randint(30, 90)))
    kinds = [lambda: " ".join(word() + rnd.choice(["#$%", "<>|", "**"]) for _ in range(60)),         # full of symbols
             lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(40)) for _ in range(60))]   # endless words
    junk = {i: kinds[kind]() for i in range(int(600 * share))}
    rows = [(i, junk.get(i) or clean(), "en", "dirty") for i in range(600)] + [(1000 + i, clean(), "en", "clean") for i in range(600)]
    rows += [(2000 + i, "same five words again here " * 20, "en", "dirty") for i in range(600)]       # fail the base rules, move no fence
    got = {r.doc_id: r for r in quality_rules.judge(frame(rows)).collect()}
    assert all(got[i].base_failed for i in got if i >= 2000)
    assert not any(got[i].kept or got[i].base_failed for i in junk)
    lost = [i for i in got if i not in junk and i < 2000 and not got[i].kept]
    assert len(lost) <= 0.005 * 1200, [got[i] for i in lost]


def test_rules_without_a_sound_document(frame):
    """No document passes the base rules: no fences, every verdict is the base rule's."""
    assert [(r.kept, r.reason) for r in quality_rules.judge(frame([(1, "a b", "en", "s"), (2, None, None, None)])).collect()] \
        == [(False, "base")] * 2


def test_mix(odd, odd_list, none):
    plan = mixing.plan_mix(odd, carry=["doc_id", "size"]).collect()
    size = {}
    for i, t, _, s in odd_list:
        size[s] = size.get(s, 0) + len(brute.words(t))
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:                                                    # share what is left until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    assert len(plan) == len(odd_list)
    by_size = {size[s]: s for s in size}
    taken = {}
    for r in plan:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(target[s])
        assert r.copies <= 2 and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[s] = taken.get(s, 0) + r.copies * r.size
    longest = max(len(brute.words(r[1])) for r in odd_list)
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    rows = mixing.mix(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r.copies for r in plan)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_inverse_demand(spark):
    knots, schedules = (0.0, 0.25, 1.0), ((4.0, 1.0, 0.0), (1.0, 1.0, 1.0), (0.0, 2.0, 3.0))
    df = spark.range(0, 101).select((F.col("id") / 100.0).alias("y"))
    for k, values in enumerate(schedules):
        rows = df.select("y", mixing.inverse_demand(F.col("y"), F.lit(k), knots, schedules).alias("t")).collect()
        at = mixing.integrals(knots, values)
        for y, t in rows:
            i = 0 if t <= 0.25 else 1
            a, b, w = values[i], values[i + 1], knots[i + 1] - knots[i]
            u = t - knots[i]
            assert at[i] + a * u + (b - a) / w * u * u / 2 == pytest.approx(y * at[-1], abs=1e-9)


def test_mix_follows_schedule(spark, frame):
    """A falling schedule is read mostly early, a rising one late."""
    rows = [(i, "a b c d", "en", s) for i, s in enumerate(["s0", "s1", "s2"] * 600)]
    pos = {}
    for r in mixing.plan_mix(frame(rows), carry=["doc_id"], factor=1.0, repeats=1.0).collect():
        pos.setdefault(r.doc.doc_id % 3, []).extend(r.positions)
    assert np.mean(pos[0]) < 0.45 and abs(np.mean(pos[1]) - 0.5) < 0.01 and np.mean(pos[2]) > 0.55


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes </turn>\n<turn:user>no"), (1, 2, "user", "\\n \\\\ <\\turn:"), (1, 3, "assistant", "é🙂"),
         (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, None, "x"), (4, 0, "system", "s"), (4, 1, "user", ""), (4, 2, "assistant", ""),
         (None, None, "a>b:\\>", "t"), (None, 0, "user", "</turn></turn>\n"), (5, 0, "user", "u"), (5, 0, "user", "u"), (6, 1, "assistant", "z"), (6, 0, "user", "q")]


def test_chat(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("conv"), F.lit(2).alias("segments"))
    out = chat.format_conversations(df).select("conv_id", "valid", "first_bad_turn", "formatted", "segments",
                                               chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    rows = {r.conv_id: r for r in out.collect()}
    assert set(rows) == {r[0] for r in CHATS}
    for conv, got in rows.items():
        turns = sorted((r for r in CHATS if r[0] == conv), key=key)
        assert [(t.role, t.text) for t in got.turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert got.loss == "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert "".join(s.text for s in got.segments) == got.formatted
    assert {c: r.valid for c, r in rows.items()} == {1: True, 2: False, 3: False, 4: True, None: False, 5: False, 6: True}
    assert rows[2].first_bad_turn == 1 and rows[5].first_bad_turn == 2 and rows[3].first_bad_turn == 2 and rows[1].first_bad_turn is None
    assert chat.format_conversations(df.limit(0)).count() == 0
