"""The near-duplicate stage against brute force over all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphsift.llm import simhash
from glyphsift.sources import shared


def groups(texts: list[str], similarity: float = 0.8) -> list[int]:
    """The smallest index of each text's group, from all pairs."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common / max(1, len(sets[i]) + len(sets[j]) - common) >= similarity:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def edited(rng, ws: list[str], n: int) -> str:
    out = ws[:]
    for at in rng.sample(range(len(ws)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def kept(spark, texts: list[str]) -> list[int]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.distinct_documents(docs).collect())


@pytest.mark.parametrize("length", [12, 100, 400])
def test_chains(spark, length):
    """Texts about 0.8 from each other, so that many fail against the one that they meet first."""
    rng = random.Random(length)
    texts = ["", " \n", "one", "One ", "one two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        ws = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(6):
            texts.append(edited(rng, ws, rng.randint(0, max(1, round(length * 0.03)))))
            ws = texts[-1].split()
    rng.shuffle(texts)
    want = sorted(set(groups(texts)))
    assert len(want) < len(texts) and kept(spark, texts) == want


def test_long_texts_of_few_words(spark):
    """Scattered edits of long texts move the fingerprints of their distinct words far."""
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        ws = [f"w{rng.randrange(2000)}" for _ in range(10_000)]
        texts += [" ".join(ws), edited(rng, ws, 215)]
    want = sorted(set(groups(texts)))
    assert len(want) == 40 and kept(spark, texts) == want


def gathered(df) -> list[str]:
    """The plans whose rows the driver gathers for broadcasts, as Spark decides before anything has run."""
    found, rest = [], [df._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "BroadcastExchange":
            found.append(node.toString())
        rest += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_grid_rows_stay_out_of_the_driver(spark):
    fps = simhash.stored(spark.range(1000).select(F.xxhash64("id").alias("fp"), F.xxhash64("id").alias("pv")), "test-prints")
    assert gathered(simhash.links(fps)) == []


def test_bucket_rows_stay_out_of_the_driver(spark, monkeypatch):
    """Files of a few kilobytes may stand for any number of rows: columns of few values, and lists to be laid out."""
    plans, stored = {}, simhash.stored

    def noted(df, name):
        plans.setdefault(name, gathered(df))
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", noted)
    rng = random.Random(3)
    ws = [f"w{rng.randrange(5000)}" for _ in range(100)]
    kept(spark, [edited(rng, ws, 9) for _ in range(100)])
    assert {"shared-rows", "buckets", "stars", "met", "pairs"} <= plans.keys()
    assert not any("Generate" in p or "__set" in p for ps in plans.values() for p in ps)
    assert not any(plans[n] for n in ("shared-rows", "stars", "met", "pairs"))


def test_shuffles_go_before_the_next_step(spark, monkeypatch):
    """Whatever time the steps take: nothing is left to the release that comes every ten seconds."""
    monkeypatch.setattr(shared, "RELEASE_EVERY", 1e9)
    disk, stored = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), simhash.stored
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    made, left = {}, {}

    def noted(df, name):
        for step in ["shared-rows", "shingle-sets", "buckets", "stars", "met"]:
            if step in made and step not in left:
                end = time.monotonic() + 10  # the cleaner has a thread of its own
                while made[step] & files() and time.monotonic() < end:
                    time.sleep(0.1)
                left[step] = len(made[step] & files())
        before = files()
        out = stored(df, name)
        made.setdefault(name, files() - before)
        return out

    monkeypatch.setattr(simhash, "stored", noted)
    rng = random.Random(4)
    ws = [f"w{rng.randrange(5000)}" for _ in range(100)]
    kept(spark, [edited(rng, ws, 9) for _ in range(100)])
    assert made["shared-rows"] and made["shingle-sets"] and len(left) == 5 and not any(left.values())
