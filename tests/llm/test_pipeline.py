"""The corpus pipeline stage by stage against brute force on sf0.001, and on edge cases."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from fluxsieve.llm.queries import graded, table, vocabulary

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs, out = table(spark, SF, "documents"), []
    out.append(docs)
    for k, (_, fn) in enumerate(P.STAGES):
        fn(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [len(P.STAGES), [n for n, _ in P.STAGES][1]] == [5, "simhash near-dedup"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    grade = {r.doc_id: r.grade for r in graded(table(spark, SF, "labels")).collect()}
    assert all(after[i] == before[i] for i in after)
    good = [i in after for i in grade if grade[i] == 2]
    bad = [i in after for i in grade if grade[i] != 2]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_near_duplicates(stages):
    before = list(rows(stages[1]).values())
    root = brute.groups([brute.simhash(r.text) for r in before])
    least = {}
    for r, g in zip(before, root):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(rows(stages[2])) == sorted(least.values())


def test_repeated_passages(stages):
    before = sorted(rows(stages[2]).values(), key=lambda r: r.doc_id)
    after = rows(stages[3])
    for r, (_, gone, _, kept) in zip(before, brute.byte_windows([r.text for r in before], 200)):
        if not gone:
            assert after[r.doc_id] == r
        elif kept.strip():
            text = after[r.doc_id].text
            assert len(kept) - 8 <= len(text.encode()) <= len(kept) and after[r.doc_id].n_chars == len(text)
        else:
            assert r.doc_id not in after


def test_mix_and_tokens(stages):
    from tokenizers import Tokenizer
    before, mixed = rows(stages[3]), stages[4].collect()
    times = {}
    for r in mixed:
        assert r == before[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    size = sum(len(brute.words(r.text)) for r in before.values())
    taken = sum(len(brute.words(r.text)) for r in mixed)
    assert abs(taken - 1.5 * size) < 0.1 * size
    whole = Tokenizer.from_file(vocabulary())
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in stages[5].collect())
    want = []
    for r in mixed:
        ids = whole.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes()))
    assert got == sorted(want)


def test_run_equals_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert key(P.run(spark, SF)) == key(stages[5])


def test_edges(spark, odd, none, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns pass all stages; so does no row."""
    for k, docs in enumerate((odd, none)):
        for n, (_, fn) in enumerate(P.STAGES):
            out = fn(spark, docs, SF)
            if n < 4:
                assert out.columns == odd.columns
            out.write.parquet(f"{tmp_path}/{k}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{n}")
        assert (docs.count() > 0) == (k == 0)


def test_shared_passage_goes_and_clean_text_stays(spark, frame):
    rnd = random.Random(3)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = say(60)
    rows_ = [(i, say(40) + "\n" + (passage if i < 5 else say(60)) + "\n" + say(40), "en", "s") for i in range(10)]
    got = {r.doc_id: r.text for r in P.repeated_passages(spark, frame(rows_), SF).collect()}
    assert all((passage not in got[i]) == (i < 5 or passage not in rows_[i][1]) for i in got)
    assert all(got[i] == rows_[i][1] for i in range(5, 10)) and all(passage[:300] not in got[i] for i in range(5))


def test_no_ratings_keeps_all(spark, odd, tmp_path):
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.quality(spark, odd, str(tmp_path)).count() == odd.count()
    assert odd.filter(F.col("text").isNull()).count() == 1
