"""Each operator against brute force over awkward documents: null, empty, long and repeated texts, ties, odd columns."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphsift.llm import bpe, language_id, license_scan, mixing, order_minhash, quality, simhash, suffix_dedup, token_files, url_filter

#: The columns of documents, and some with the names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __d string, __t string, starts long, size string, fingerprint string, n_tokens int, `a.b` int"
NOT_WS = r"[^\x20\x09-\x0D]+"


def made() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, near = say(70), say(120)
    texts = [None, "", " \n\t", "x", "Ünï", "123 456", say(5), say(200), passage, say(30) + " " + passage + " " + say(9), passage + say(40), near, near.replace(" ", "  ", 3), near + " tail", say(40000), "ab" * 400, "word " * 300]
    texts += ["the MIT License and the Apache License. CC BY 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "gnu general public license mit license", "line one\nline one\nline two", "  <|endoftext|> it's I'LL ǅ á"]
    texts += [say(rng.randint(1, 60)) for _ in range(30)]
    rows = [(i, t, None if i % 7 == 0 else ("xx" if i % 2 else "yy"), None if i % 5 == 4 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, "no id " + passage, None, None, None))
    return [(*r, "d", "t", 1, "big", "f", 2, 3) for r in rows]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(r) -> str:
    return r[1] or ""


def key(r) -> str:
    return str(r[0])


def by_id(rows) -> dict:
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    assert len(rows) == len(ROWS)
    return out


def test_suffix_dedup(spark, docs, none):
    for hot in (4096, 1):  # the second sends every key through the split form
        got = by_id(suffix_dedup.remove_repeats(docs, 200, hot).collect())
        raw = [text_of(r).encode() for r in ROWS]
        seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
        for r, b in zip(ROWS, raw, strict=True):
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - 199):
                if seen[b[i : i + 200]] > 1:
                    gone[i : i + 200] = True
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = int((np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) == 1).sum())
            for g in got[r[0]]:
                assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(none).count() == 0
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)


def test_interval_expansion():
    rng = random.Random(1)
    for n in (3, 7):
        parts = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(8)]
        raw = np.frombuffer(("\0".join(parts) + "\0").encode(), np.uint8)
        sep = np.flatnonzero(raw == 0)
        text = np.where(raw == 0, 0, raw.astype(np.int64) - 96)
        seen = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        flags, at = suffix_dedup.repeated_starts(text, sep, n), 0
        for p in parts:
            want = [i + n <= len(p) and seen[p[i : i + n]] > 1 for i in range(len(p))]
            assert flags[at : at + len(p)].tolist() == want
            at += len(p) + 1


def test_order_minhash(spark, docs, none):
    got = by_id(order_minhash.fingerprints(docs).collect())
    order = sorted({(r[0] if r[0] is not None else -(2**63), text_of(r)) for r in ROWS}, key=lambda x: (-x[0], x[1]))
    after = {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    prints = {}
    for r in ROWS:
        t = text_of(r)
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[(r[0] if r[0] is not None else -(2**63), t)][:cut]
        for g in got[r[0]]:
            assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert prints.setdefault(t, g.fingerprint) == g.fingerprint
            assert 0 <= g.near_next <= 1 and 0 <= g.near_edited <= 1
            if edited == t:
                assert g.near_edited == 1
    long = got[7][0]
    assert long.near_edited > long.near_next
    assert order_minhash.fingerprints(none).count() == 0


def test_order_matters(spark):
    """The same words in another order are far by fingerprint, a small edit is near."""
    rng = random.Random(2)
    ws = [f"w{i}" for i in range(300)]
    shuffled = ws[:]
    rng.shuffle(shuffled)
    edited = ws[:]
    edited[100] = "new"
    df = spark.createDataFrame([(" ".join(ws), " ".join(shuffled), " ".join(edited))], "a string, b string, c string")
    for c in "abc":
        df = order_minhash.with_fingerprint(df, c, "f" + c)
    r = df.select(order_minhash.likeness("fa", "fb").alias("far"), order_minhash.likeness("fa", "fc").alias("near")).first()
    assert r.near > 0.9 and r.far < 0.2


def test_quality(spark, docs, none):
    got = by_id(quality.judge(docs).collect())
    for r in ROWS:
        t = text_of(r)
        w = re.findall(NOT_WS, t)
        lines = [x for x in t.split("\n") if re.search(NOT_WS, x)]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen, cover = Counter(wins), set()
        for i, x in enumerate(wins):
            if seen[x] > 1:
                cover.update(range(i, i + 8))
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        for g in got[r[0]]:
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed)
            assert not (g.kept and failed)
    assert quality.judge(none).count() == 0


def test_distrusted_host(spark):
    """A host of bad documents takes the doubtful ones along, not the clean ones."""
    clean = " ".join(f"word{i}" for i in range(60))
    doubtful = " ".join(f"word{i} |" for i in range(30))
    rows = [(i, clean if i % 2 else clean + str(i), "good") for i in range(200)] + [(1000 + i, "bad", "bad") for i in range(200)] + [(2000, clean, "bad"), (2001, doubtful, "bad"), (2002, doubtful, "good")]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert 2000 in kept and 2002 in kept and 2001 not in kept and 1000 not in kept


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    size, source = {}, {}
    for r in ROWS:
        size[r[0]] = len(re.findall(NOT_WS, text_of(r)))
        source[r[0]] = r[3]
    total = Counter()
    for r in ROWS:
        total[r[3]] += size[r[0]]
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        assert r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    # a few blocks: a block is at most 1/256 of a source, or a word
    assert len(rows) == len(ROWS) and all(abs(taken[s] - target[s]) <= 4 * (1 + total[s] // 256) for s in names)
    assert all((r.slot is None) == (r.taken == 0) for r in rows)
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter((r.doc_id, r.taken, r.slot) for r in rows) == Counter((r.doc_id, r.taken, r.slot) for r in again)
    # the points decide: another sequence gives another mix of the same shares
    other = mixing.mix(docs, points=mixing.van_der_corput).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) != Counter((r.doc_id, r.taken) for r in other)
    taken = Counter()
    for r in other:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 8 * (1 + total[s] // 256) for s in names)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_schedule(spark):
    """Each prefix of the mix has the shares, and the words are those of the blocks dealt."""
    sizes = [("a", 5000), ("b", 20000), (None, 900)]
    rows = [(i, " ".join(["w"] * 10), s) for i, s in enumerate(s for s, n in sizes for _ in range(n // 10))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = mixing.source_targets(df.select("source", F.lit(10).alias("size")).withColumnRenamed("source", "__source"))
    blocks = mixing.blocks_of(targets, 1024)
    want = {r["__pos"]: r["__slots"] for r in blocks.collect()}
    slots = sorted((r.slot, r["__pos"], r["__k"]) for r in mixing.schedule(blocks).collect())
    total, seen = sum(want.values()), Counter()
    assert [x[0] for x in slots] == list(range(round(total)))
    for i, (_, pos, k) in enumerate(slots, 1):
        assert k == seen[pos]
        seen[pos] += 1
        assert all(abs(seen[p] - i * w / total) < 4 for p, w in want.items())
    order = defaultdict(dict)
    for r in mixing.shuffled_blocks(blocks).collect():
        order[r["__pos"]][r["__k"]] = r["__b"]
    dealt = Counter((pos, order[pos][k]) for _, pos, k in slots if k in order[pos])
    size = {r["__pos"]: (r["__size"], r["source_size"]) for r in blocks.collect()}
    for pos, ks in order.items():
        n = -(-size[pos][1] // size[pos][0])
        assert all(sorted(ks[k] for k in range(p * n, p * n + n)) == list(range(n)) for p in range(3)) and [ks[k] for k in range(n)] != list(range(n))
    words = Counter()
    for (pos, b), times in dealt.items():
        words[pos] += times * (min((b + 1) * size[pos][0], size[pos][1]) - b * size[pos][0])
    got = mixing.mix(df).groupBy("source_size").agg(F.sum("taken").alias("n")).collect()
    assert {r.source_size: r.n for r in got} == {size[p][1]: n for p, n in words.items()}


def test_golden_points(spark):
    pts = sorted(r[0] for r in spark.range(1, 1001).select(mixing.golden(mixing.F.col("id"))).collect())
    assert max(abs(p - (i + 0.5) / 1000) for i, p in enumerate(pts)) < 0.003


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/a", "https://example.com/fr/a", "http://a.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://net/frx", "http://x.net?q=/es/", "http://xcom/", "http://com-x/", "http://a..com/", "ftp://É.net/es/"]
    rows = [(i if i else None, u, "r", 1, "k") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, __key int, host string")
    rules = [(v, h, p) for v, h, p in url_filter.RULES]
    want = []
    for i, u, *_ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, None, "allow")
        want.append((i, host, path, best[1], best[2]))
    got = [tuple(r) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, []), "block").collect()} == {"block"}


def test_many_rules_of_one_host(spark):
    """Nested paths, hosts around hosts, rules that fit nothing, and 100,000 rules on one host."""
    rng = random.Random(3)
    hosts, parts = ["a.com", "com", "b.a.com", "x.b.a.com", "org", "a..com"], ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/b/", "a/", "/é/"]
    rules = list({(h, q): (rng.choice(["allow", "block"]), h, q) for h in hosts for q in rng.sample(parts, 6)}.values())
    urls = [f"http://{h}{q}" for h in [*hosts, "y.x.b.a.com", "xcom", "net", ""] for q in ["", "/", "/a", "/a/b/c/d", "/abc", "/b", "/é/x", "?a/", "/a/b#c"]]

    def want(u):
        rest = u.split("://", 1)[1]
        host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + q), len(h), h + q, v) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        return max(fit)[2:] if fit else (None, "allow")

    many = [("block", "big.com", f"/{i}/") for i in range(100_000)]
    urls += [f"http://www.big.com/{i}/x" for i in (0, 7, 99_999, 100_000)]
    expected = {u: want(u) for u in urls} | {f"http://www.big.com/{i}/x": (f"big.com/{i}/", "block") for i in (0, 7, 99_999)}
    # 'com' may have rules of its own
    expected = {u: v if "big.com" not in u or "big.com" in str(v[0]) else want(u) for u, v in expected.items()}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = url_filter.rules_frame(spark, rules).unionByName(spark.createDataFrame(many, "verdict string, host string, path string"))
    got = {urls[r.page_id]: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, frame).collect()}
    assert got == expected


def test_simhash(spark, docs, none):
    got = by_id(simhash.near_duplicates(docs).collect())
    fp = {}
    for r in ROWS:
        w = re.findall(NOT_WS, "".join(c.lower() if c.isascii() else c for c in text_of(r)))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], ">u8")
        fp[r[0]] = sum(1 << (63 - b) for b, n in enumerate(np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0)) if 2 * n > len(h)) if len(h) else 0
    root = {d: d for d in fp}
    ids = sorted((d for d in fp if d is not None)) + [None]
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] != root[b]:
                    low = min((x for x in (root[a], root[b]) if x is not None), default=None)
                    root[a] = root[b] = low
                    changed = True
    for d in ids:
        for g in got[d]:
            assert (g.fingerprint, g.component_id) == (f"{fp[d]:016x}", root[d])
    assert simhash.near_duplicates(none).count() == 0


def test_distinct_documents(spark, docs, none):
    kept = simhash.distinct_documents(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 11 in ids and 12 not in ids and 13 not in ids  # a text, a copy but for spaces, one with a word more
    assert {7, 9, 10} <= set(ids)
    assert simhash.distinct_documents(none).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    path = str(tmp_path / "shards")
    token_files.write_token_files(docs, path, shard_tokens=500)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    tok = bpe.WordIds.of(bpe.tokenizer_path()).tok
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, text_of(r)))
    for g, r in zip(got, order, strict=True):
        ids = np.array([*tok.encode(text_of(r), add_special_tokens=False).ids, 1], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_token_files(none, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (1, 2**40), (5, 3), (1000, 10**6), (3000, 3000)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        e = token_files.EliasFano.encode(v)
        assert (e.all() == v).all() and [e.select(i) for i in range(n)] == v.tolist()
        assert len(e.low) + len(e.high) <= n * (2 + max(0, np.log2((top + 1) / n))) / 8 + 24
    with pytest.raises(IndexError):
        e.select(n)
    assert len(token_files.EliasFano.encode(np.zeros(0)).all()) == 0


def test_language_id(spark, none):
    rng = random.Random(3)
    words = {"aa": ["abra", "cada", "bala"], "bb": ["ixo", "myx", "onyx"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 40))), lang) for i in range(300) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !?", "bb"), (1003, "éé", None), (1004, "abra " * 50000, None), (None, "onyx myx", None)]
    rows.append(rows[5])  # a repeated row
    own = [(*r, "d", "p", "s", 1) for r in rows]
    df = spark.createDataFrame(own, "doc_id long, text string, lang string, __d string, lang_pred string, score string, held_out int")
    found = language_id.identify(df).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    for d, t, lang in rows:
        r = got[d]
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
        if d is not None and d < 300:
            assert r.lang_pred == lang
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred != "und" and got[1004].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", language_id.F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.doc_id for r in language_id.accepted(df).collect()} == {d for d, *_ in rows} - {1000, 1001, 1002} and language_id.accepted(df).columns == df.columns


def test_code_lengths():
    """The tables against the definition, byte by byte."""
    texts = {"a": b"abracadabra abra", "b": b"banana bandana"}
    counts = {}
    for lang, t in texts.items():
        p = b"   " + t
        counts[lang] = Counter(int.from_bytes(p[i : i + 4], "big") for i in range(len(t)))
    model = language_id.Ppm({k: (list(c), list(c.values())) for k, c in counts.items()})
    sample = b"abana xbra"
    got = model.code_lengths(np.frombuffer(sample, np.uint8), np.array([0]))

    def bits(lang, ctx, s):
        after = Counter()
        for g, n in counts[lang].items():
            b = g.to_bytes(4, "big")
            if b[3 - len(ctx) : 3] == ctx:
                after[b[3]] += n
        n, d = sum(after.values()), len(after)
        shorter = (lambda: bits(lang, ctx[1:], s)) if ctx else (lambda: 8.0)
        if not n:
            return shorter()
        return -np.log2(after[s] / (n + d)) if after[s] else -np.log2(d / (n + d)) + shorter()

    padded = b"   " + sample
    for i, s in enumerate(sample):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == pytest.approx(bits(lang, padded[i : i + 3], s), abs=1e-4)
    again = pickle.loads(pickle.dumps(model))
    assert np.array_equal(again.code_lengths(np.frombuffer(sample, np.uint8), np.array([0])), got)
    rng = np.random.default_rng(0)  # more windows than the worker's table has slots
    noise = rng.integers(0, 256, 600_000).astype(np.uint8)
    want = model.lengths(model.windows(noise, np.array([0])))
    assert np.array_equal(model.code_lengths(noise, np.array([0])), want)
    assert np.allclose(model.totals(noise, np.array([0, len(noise)])), want.sum(0, dtype=np.float64))  # in slices
    both = np.frombuffer(sample + b"a" + sample, np.uint8)
    one = model.totals(np.frombuffer(sample, np.uint8), np.array([0, len(sample)]))
    assert np.allclose(model.totals(both, np.array([0, 10, 11, 11, 21]))[[0, 3]], one)


def test_model_of_many_languages():
    """Twenty languages with many bytes in use stay sparse."""
    rng = np.random.default_rng(1)
    counts = {}
    for k in range(20):
        gram = np.unique(rng.integers(0, 190, (100_000, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]))
        counts[f"l{k}"] = gram, np.ones(len(gram))
    assert language_id.Ppm(counts).size() < 200e6


def test_held_out_accuracy(spark):
    """Rows that were not learned from, of a table with labels."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert len({round(r.score, 3) for r in rows}) > 10


def license_spec(text: str, phrases, notices) -> tuple:
    """The operator's definition, word by word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    at, scores = [], {}
    for label, p in phrases:
        at += [(i, label) for i in range(len(w) - len(p.split()) + 1) if w[i : i + len(p.split())] == p.split()]
    for label, p in notices:
        q = p.split()
        best = 0.0
        for d in range(1 - len(q), len(w)):
            if any(0 <= d + i and w[d + i : d + i + 2] == q[i : i + 2] for i in range(len(q) - 1)):
                if len(q) < license_scan.WHOLE:
                    best = max(best, float(d >= 0 and w[d : d + len(q)] == q))
                else:
                    best = max(best, common(w[max(0, d - license_scan.PAD) : d + len(q) + license_scan.PAD], q) / len(q))
        if best >= 0.6:
            scores[label] = max(best, scores.get(label, 0))
    base = {x for _, x in at}
    return (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | set(scores))), max([1.0] * bool(at) + [*scores.values(), 0.0]))


def test_license_scan(spark, docs, none):
    got = by_id(license_scan.scan(docs).collect())
    for r in ROWS:
        want = license_spec(text_of(r), license_scan.PHRASES, license_scan.NOTICES)
        for g in got[r[0]]:
            assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels, pytest.approx(g.score)) == want
    assert got[18][0].labels == "mit" and got[18][0].n_base == 0 and got[18][0].score == 1
    assert license_scan.scan(none).count() == 0


def test_license_spans(spark):
    """Labels and scores against the definition: edited notices, words out of order, parts that come twice, common words."""
    rng = random.Random(11)
    texts = ["licensed under a licensed under a", "they want all rights for people", "human rights reserved seats", "ALL rights, reserved.", "this software " * 30, "licensed under a creative commons attribution 4 0", "under the terms of the " * 8]
    for label, p in license_scan.NOTICES:
        ws = p.split()
        texts += [" ".join(reversed(ws)), " ".join(ws[: len(ws) // 2]), " ".join(ws[len(ws) // 2 :] + ws[: len(ws) // 2])]
        for _ in range(12):
            out = [x for x in ws if rng.random() > 0.2 or label == "x"]
            for _ in range(rng.randint(0, 4)):
                out.insert(rng.randint(0, len(out)), rng.choice(["um", "the", "of", "software"]))
            texts.append(" ".join([*["the", "x"] * rng.randint(0, 20), *out, *["of", "the"] * rng.randint(0, 9)]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in license_scan.scan(df).collect():
        want = license_spec(texts[g.doc_id], license_scan.PHRASES, license_scan.NOTICES)
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels, pytest.approx(g.score)) == want, texts[g.doc_id]
    with pytest.raises(ValueError):
        license_scan.scan(df, notices=[("long", "w " * 63)])


def test_bpe(spark, docs, none):
    got = by_id(bpe.encode_documents(docs).collect())
    tok = bpe.WordIds.of(bpe.tokenizer_path()).tok
    for r in ROWS:
        ids = tok.encode(text_of(r), add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert all((g.n_tokens, g.ids_sha256, g.decoded_sha256) == want for g in got[r[0]])
    assert bpe.encode_documents(none).count() == 0


def test_chunk_reuse():
    rng = random.Random(4)
    shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    texts = [shared, "x " + shared, shared[:9000] + "yz" + shared[9000:]]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    e = bpe.Encoder(bpe.tokenizer_path())
    got = e.encode(raw, np.cumsum([0, *map(len, texts)]))
    assert [g.tolist() for g in got] == [e.words.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.reused > e.chunks / 2 and e.repaired


def test_texts_over_a_megabyte(spark):
    """Texts longer than any piece, slice or group that the operators work on at a time."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(80)
    long = say(300_000) + " " + passage + " " + say(1000) + passage + "ab " * 200_000
    texts = [long, "x " + passage, "é" * 1_500_000, "", say(50)]
    df = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    raw = [t.encode() for t in texts]
    assert len(raw[0]) > 2 << 20 < len(raw[2])
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    for d, b in enumerate(raw):
        turn = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                turn[i] += 1
                turn[i + 200] -= 1
        gone = np.cumsum(turn[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[d].n_removed, got[d].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())
    tok = bpe.WordIds.of(bpe.tokenizer_path()).tok
    for r in bpe.encode_documents(df.where("doc_id <> 2")).collect():
        ids = np.array(tok.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    w = {r.doc_id: r.n_words for r in quality.judge(df).select("doc_id", "n_words").collect()}
    assert w == {i: len(t.split()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}[3] == "und"


def test_chunks_are_kept_between_tasks():
    """A worker's next task finds what an earlier one has encoded."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(5000))])], ["doc_id", "text"])
    run = bpe._encode(bpe.tokenizer_path())
    first = [b.to_pylist() for b in run([batch])]
    own = bpe.worker_store("bpe")["encoder", bpe.tokenizer_path()]
    before = own.reused, own.chunks
    assert [b.to_pylist() for b in run([batch])] == first
    assert own.reused - before[0] == own.chunks - before[1] > 0


def test_bpe_memory_is_bounded(monkeypatch):
    """Neither a large batch nor a long text takes a worker's memory by its own size; borders don't depend on the slices."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    texts = [" ".join(rng.choice(vocab) for _ in range(350)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], ["doc_id", "text"])
    raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
    assert len(raw) > 7 << 20
    run = bpe._encode(bpe.tokenizer_path())
    list(run([batch.slice(0, 10)]))
    tracemalloc.start()
    try:
        rows = [r for b in run([batch]) for r in b.to_pylist()]
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.reset_peak()
        border = bpe.cuts(raw, np.array([0, len(raw)]))
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(bpe, "SLICE", len(raw))
    assert np.array_equal(border, bpe.cuts(raw, np.array([0, len(raw)]))) and len(border) > 1000
    tok = bpe.WordIds.of(bpe.tokenizer_path()).tok
    assert [r["doc_id"] for r in rows] == list(range(4000))
    for r in rows[::100]:
        ids = np.array(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
