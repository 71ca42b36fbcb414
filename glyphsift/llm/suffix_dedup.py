"""Exact removal of repeated passages (operator 1).

Method: threshold-bounded interval expansion.  A breadth-first backward
extension over a Burrows-Wheeler transform finds the common-prefix values of
neighbouring suffixes in increasing order (0, 1, 2, ...) and stops at the
minimum length; entries that are still unset then are repeats.

A transform over a whole corpus does not fit one machine, so the corpus is cut
into independent transforms first.  Every ``min_len``-byte string is keyed by
the smallest of its 32-byte gram hashes (leftmost on ties), which depends on
nothing outside the string: equal strings meet under one key.  Neighbouring
starts with one key form a *run*; a run's bytes hold exactly its own strings.

1. ``runs``: one row per run with its key and the hash of its bytes.
2. Keys that occur once can hold no repeat and go.
3. Equal runs collapse to one with a count.  Their bytes are fetched, gathered
   by key, and blocks of whole keys of bounded size go through the transform.
   A key with one distinct run needs no transform: its count decides.
4. A key with more than ``hot_runs`` distinct runs (a passage inside very many
   documents) is split further: its strings are counted one by one under
   their own 128-bit hashes, so no task sees more than bounded memory.
5. Repeated starts go back to their documents and are merged to byte spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.sources.tables import table

from .common import bounded_batches, byte_column, drop_stored, identified, parallelism, pieces, rows_with_identity, stored, worker_store

GRAM = 32
#: Bytes that are hashed at a time, of one transform (a single key may have more: ``hot_runs`` runs at most), and of runs or texts handed on at once.
PIECE, BLOCK, HANDED = 1 << 20, 1 << 18, 1 << 21
POS_BITS = 21
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes that start at each place."""
    n = len(raw) - GRAM + 1
    word = np.empty(len(raw) - 7, np.uint64)
    for o in range(8):
        part = raw[o : o + (len(raw) - o) // 8 * 8]
        word[o::8] = part.view("<u8") if part.flags.aligned else np.frombuffer(part.tobytes(), "<u8")
    h = word[:n] * _C[0]
    for j in range(1, 4):
        h ^= h >> np.uint64(29)
        h += word[8 * j : 8 * j + n]
        h *= _C[j]
    h ^= h >> np.uint64(32)
    h *= _C[0]
    return h


def window_keys(raw: np.ndarray, min_len: int) -> np.ndarray:
    """For each start of a ``min_len``-byte string: the place of its smallest gram hash, leftmost on ties, below the hash's upper bits."""
    h = gram_hashes(raw)
    h >>= np.uint64(POS_BITS)
    h <<= np.uint64(POS_BITS)
    h |= np.arange(len(h), dtype=np.uint64)
    width, have = min_len - GRAM + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return h


def find_runs(raw: np.ndarray, offs: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(document, start in ``raw``, number of starts, key) of each run."""
    if len(raw) < min_len:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    keys = window_keys(raw, min_len)
    cut = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=cut[1:-1])
    cut[offs[offs < len(keys)]] = True
    ends = offs[1:] - min_len + 1
    cut[ends[(ends >= 0) & (ends < len(keys))]] = True
    at = np.flatnonzero(cut)
    start, count = at[:-1], np.diff(at)
    doc = np.searchsorted(offs, start, "right") - 1
    fits = start + min_len <= offs[doc + 1]
    start, count, doc = start[fits], count[fits], doc[fits]
    return doc, start, count, keys[start] >> np.uint64(POS_BITS)


def _pieces(raw: np.ndarray, offs: np.ndarray, min_len: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place in the row, number of starts, key, bytes' start in raw): documents in bounded pieces, whose ends overlap."""
    i = 0
    while i < len(offs) - 1:
        if offs[i + 1] - offs[i] > PIECE:
            for a in range(offs[i], offs[i + 1], PIECE):
                b = min(a + PIECE + min_len - 1, offs[i + 1])
                _, start, count, key = find_runs(raw[a:b], np.array([0, b - a]), min_len)
                yield np.full(len(start), i), start + (a - offs[i]), count, key, start + a
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1)
        doc, start, count, key = find_runs(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], min_len)
        yield doc + i, start + offs[i] - offs[doc + i], count, key, start + offs[i]
        i = j


def _runs(min_len: int):
    def f(batches):
        import pyarrow as pa
        import xxhash

        worker_store("suffix")
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            raw, offs = byte_column(batch.column(2))
            view = memoryview(raw)
            d, t = (batch.column(k).to_numpy() for k in (0, 1))
            for row, place, count, key, at in _pieces(raw, offs, min_len):
                stop = at + count + (min_len - 1)
                sh = np.array([digest(view[a:b]) for a, b in zip(at.tolist(), stop.tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), sh.view(np.int64), d[row], t[row], place, count.astype(np.int32))], ["mh", "sh", "__d", "__t", "off", "n"])

    return f


def suffix_order(text: np.ndarray, sep: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` by their suffixes' first ``depth`` symbols or more; separators (0) all differ, and order by place."""
    n = len(text)
    at = np.arange(n, dtype=np.int32)
    to_sep = np.append(sep, n).astype(np.int32)[np.searchsorted(sep, at)] - at
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 8
        seen = to_sep[: n - j] >= j
        key[: n - j][seen] |= text[j:][seen]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    head = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=head[1:])
    del key
    lone = (to_sep < 7)[order]
    head |= lone
    # after a suffix that is unique, the next one starts a group of its own as well
    head[1:] |= lone[:-1]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, at, np.int32(0)))
    have = 7
    while have < depth:
        alone = head & np.append(head[1:], True)
        todo = np.flatnonzero(~alone).astype(np.int32)
        if not len(todo):
            break
        places = order[todo]
        key = rank[places].astype(np.int64) << 32 | (rank[np.minimum(places + have, n)] + 1)
        by = np.argsort(key)
        order[todo] = places[by]
        key = key[by]
        new = np.ones(len(todo), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        head[todo] = new
        rank[order[todo]] = np.maximum.accumulate(np.where(new, todo, np.int32(0)))
        have *= 2
    return order


def repeated_starts(text: np.ndarray, sep: np.ndarray, min_len: int) -> np.ndarray:
    """Whether the ``min_len`` symbols at each place also start elsewhere in ``text`` (separators match nothing).

    Breadth-first: level v holds the intervals of strings of length v; each is
    extended to the left by every symbol that precedes it; where the new
    interval's right border has no value yet, its value is v and the interval
    goes on to the next level.
    """
    n = len(text)
    sa = suffix_order(text, sep, min_len)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    before = sa - np.int32(1)
    before[before < 0] = n - 1
    lf, bwt = isa[before], text[before]
    del isa, before
    unset = np.ones(n + 1, bool)
    # level 0: every symbol's interval; separators are one-place intervals
    first = text[sa]
    edge = np.flatnonzero(np.append(first[1:] != first[:-1], True) | (first == 0)).astype(np.int32)
    lo, hi = np.append(np.zeros(1, np.int32), edge[:-1] + np.int32(1)), edge
    unset[0] = False
    unset[hi + 1] = False
    for _ in range(1, min_len):
        if not len(lo):
            break
        one = lo == hi
        to = lf[lo[one]]
        single = to[unset[to + 1]]
        wide_lo, wide_n = lo[~one], (hi - lo + 1)[~one]
        if len(wide_lo):
            owner = np.repeat(np.arange(len(wide_lo), dtype=np.int64), wide_n)
            place = np.arange(len(owner)) + np.repeat(wide_lo - (np.cumsum(wide_n) - wide_n), wide_n)
            symbol, to = bwt[place], lf[place]
            ok = symbol > 0
            kind, to = owner[ok] << 8 | symbol[ok], to[ok]
            del owner, place, symbol
            by = np.argsort(kind, kind="stable")
            kind, to = kind[by], to[by]
            starts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
            a = np.minimum.reduceat(to, starts) if len(starts) else starts
            b = np.maximum.reduceat(to, starts) if len(starts) else starts
            new = unset[b + 1]
            a, b = a[new], b[new]
        else:
            a = b = wide_lo
        lo, hi = np.append(single, a), np.append(single, b)
        unset[hi + 1] = False
    out = np.zeros(n, bool)
    pair = np.flatnonzero(unset[:n])
    out[sa[pair]] = True
    out[sa[pair - 1]] = True
    return out


def _block(rows: list[tuple], min_len: int) -> list[tuple]:
    """rows: (key, run hash, count, starts, bytes). Ranges of repeated starts of each run that has any."""
    lengths = np.array([len(r[4]) for r in rows])
    raw = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", np.uint8)
    sep = np.cumsum(lengths + 1) - 1
    is_sep = np.zeros(len(raw), bool)
    is_sep[sep] = True
    used = np.bincount(raw[~is_sep], minlength=256) > 0
    code = np.zeros(256, np.uint16)
    code[used] = 1 + np.arange(used.sum())
    text = code[raw]
    text[is_sep] = 0
    flags = repeated_starts(text, sep, min_len)
    out = []
    for row, end, length in zip(rows, sep.tolist(), lengths.tolist(), strict=True):
        mask = np.ones(row[3], bool) if row[2] > 1 else flags[end - length : end - length + row[3]]
        if mask.any():
            turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
            out.append((row[0], row[1], turn.tolist()))
    return out


def _transform(min_len: int):
    """Blocks of whole keys: one is closed before a key that would not fit any more."""

    def f(batches):
        import pyarrow as pa

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int32()))], ["mh", "sh", "turns"])

        def keys():
            group: list[tuple] = []
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                        if group and group[-1][0] != row[0]:
                            yield group
                            group = []
                        group.append(row)
            if group:
                yield group

        worker_store("suffix")
        rows, size = [], 0
        for group in keys():
            more = sum(len(r[4]) for r in group)
            if rows and size + more > BLOCK:
                yield emit(_block(rows, min_len))
                rows, size = [], 0
            rows += group
            size += more
        if rows:
            yield emit(_block(rows, min_len))

    return f


def _gathered(raw: np.ndarray, a: np.ndarray, size: np.ndarray):
    """An Arrow binary array of the byte ranges of ``raw`` that begin at ``a``."""
    import pyarrow as pa

    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    view = memoryview(raw)
    data = b"".join([view[x:y] for x, y in zip(a.tolist(), (a + size).tolist(), strict=True)])
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _fetch(min_len: int):
    """``mh, sh, c, n, hot, bytes`` of the runs wanted (a list for each text), at most about ``HANDED`` bytes at a time."""

    def f(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offs = byte_column(batch.column(0))
            lists = batch.column(1)
            runs = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            a = offs[row] + runs.field("off").to_numpy()
            size = runs.field("n").to_numpy().astype(np.int64) + (min_len - 1)
            part = np.cumsum(size) // HANDED
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for x, y in zip(cut, [*cut[1:], len(size)], strict=True):
                own = runs.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*(own.field(c) for c in ("mh", "sh", "c", "n", "hot")), _gathered(raw, a[x:y], size[x:y])], ["mh", "sh", "c", "n", "hot", "bytes"])

    return f


def _strings(min_len: int):
    """Each string of a hot key's runs under its own 128-bit hash."""

    def f(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            mh, sh, c, n, data = (batch.column(k).to_pylist() for k in range(5))
            for i in range(len(mh)):
                digest = [xxhash.xxh3_128_digest(data[i][j : j + min_len]) for j in range(n[i])]
                both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (both[:, 0].copy(), both[:, 1].copy(), np.full(n[i], mh[i]), np.full(n[i], sh[i]), np.arange(n[i], dtype=np.int32), np.full(n[i], c[i]))], ["w1", "w2", "mh", "sh", "i", "c"])

    return f


def _kept(batch, text_at: int, starts_at: int, min_len: int):
    """(first row, rows, kept bytes' mask, offsets, bytes, spans of each row) of slices of a batch that have about ``HANDED`` bytes."""
    raw, offs = byte_column(batch.column(text_at))
    lists = batch.column(starts_at)
    at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    runs = lists.flatten()
    a = runs.field("a").to_numpy().astype(np.int64)
    b = runs.field("b").to_numpy().astype(np.int64) + (min_len - 1)
    for i, j in pieces(offs, HANDED):
        own, base = raw[offs[i] : offs[j]], offs[i]
        change = np.zeros(len(own) + 1, np.int32)
        x, y = np.searchsorted(at, [i, j])
        np.add.at(change, offs[at[x:y]] - base + a[x:y], 1)
        np.add.at(change, offs[at[x:y]] - base + b[x:y], -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        local = offs[i : j + 1] - base
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        first = local[:-1][np.diff(local) > 0]
        begin[first] = gone[first]
        spans = np.append(0, np.cumsum(begin, dtype=np.int32)).astype(np.int64)
        yield i, j - i, ~gone, local, own, spans[local[1:]] - spans[local[:-1]]


def _cut(min_len: int):
    """Merge a document's repeated starts to byte spans and cut them out."""

    def f(batches):
        import pyarrow as pa

        for batch in batches:
            for i, n, kept, offs, raw, spans in _kept(batch, 1, 2, min_len):
                size = np.diff(np.append(0, np.cumsum(kept, dtype=np.int32))[offs]).astype(np.int64)
                left = raw[kept]
                ends = np.append(0, np.cumsum(size))
                digest = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                whole = np.diff(offs)
                cols = [pa.array(whole), pa.array(whole - size), pa.array(spans), pa.array(digest, pa.string()), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(left)])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return f


def repeated_spans(docs: DataFrame, min_len: int = 200, hot_runs: int = 4096) -> DataFrame:
    """``__d, __t, starts array<struct<a, b>>``: starts a <= s < b of strings that occur more than once."""
    bounded_batches(docs.sparkSession)
    base = identified(docs).select("__d", "__t", "text")
    runs = stored(base.mapInArrow(_runs(min_len), "mh long, sh long, __d long, __t long, off long, n int"), "runs")
    often = runs.groupBy("mh").agg(F.count("*").alias("__k")).where("__k > 1").select("mh")
    some = stored(runs.join(stored(often, "shared-keys"), "mh"), "shared-runs")
    drop_stored(runs)

    distinct = some.groupBy("mh", "sh").agg(F.count("*").alias("c"), F.min(F.struct("__d", "__t", "off", "n")).alias("__r"))
    distinct = stored(distinct, "run-counts")
    of_key = stored(distinct.groupBy("mh").agg(F.count("*").alias("__nd")), "key-counts")
    distinct = distinct.join(of_key, "mh").select("mh", "sh", "c", "__r.*", "__nd", (F.col("__nd") > hot_runs).alias("hot"))
    distinct = stored(distinct, "distinct-runs")
    sure = distinct.where("__nd = 1").select("mh", "sh", F.array(F.lit(0), F.col("n")).alias("turns"))
    wanted = distinct.where("__nd > 1").groupBy("__d", "__t").agg(F.collect_list(F.struct("mh", "sh", "c", "off", "n", "hot")).alias("__w"))
    bodies = stored(base.dropDuplicates(["__d", "__t"]).join(wanted, ["__d", "__t"]).select("text", "__w").mapInArrow(_fetch(min_len), "mh long, sh long, c long, n int, hot boolean, bytes binary"), "run-bytes")

    spark = docs.sparkSession
    cold = bodies.where("not hot").select("mh", "sh", "c", "n", "bytes").repartition(parallelism(spark), "mh").sortWithinPartitions("mh")
    turns = cold.mapInArrow(_transform(min_len), "mh long, sh long, turns array<int>")
    strings = bodies.where("hot").select("mh", "sh", "c", "n", "bytes").mapInArrow(_strings(min_len), "w1 long, w2 long, mh long, sh long, i int, c long")
    twice = stored(strings.groupBy("w1", "w2").agg(F.sum("c").alias("__k")).where("__k > 1").select("w1", "w2"), "hot-strings")
    hot = strings.join(twice, ["w1", "w2"]).select("mh", "sh", F.array(F.col("i"), F.col("i") + 1).alias("turns"))
    found = stored(turns.unionByName(hot).unionByName(sure), "repeated-runs")
    drop_stored(bodies, distinct)

    pairs = F.transform(F.expr("sequence(0, size(turns) - 1, 2)"), lambda j: F.struct((F.col("off") + F.get("turns", j)).alias("a"), (F.col("off") + F.get("turns", j + 1)).alias("b")))
    spans = some.join(found, ["mh", "sh"]).select("__d", "__t", F.explode(pairs).alias("__p")).select("__d", "__t", "__p.*")
    # ranges that follow one another are one before a document's ranges are gathered: a periodic text has a run for each period
    by = Window.partitionBy("__d", "__t").orderBy("a", "b")
    spans = spans.withColumn("__new", F.coalesce(F.col("a") > F.lag("b").over(by), F.lit(True)).cast("int")).withColumn("__at", F.sum("__new").over(by))
    spans = spans.groupBy("__d", "__t", "__at").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy("__d", "__t").agg(F.collect_list(F.struct("a", "b")).alias("starts"))


def remove_repeats(docs: DataFrame, min_len: int = 200, hot_runs: int = 4096) -> DataFrame:
    """Remove every byte that a string of ``min_len`` bytes covers which also starts anywhere else.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the
    remaining bytes), one row per input row.  Null text counts as empty; a
    text shorter than ``min_len`` is kept whole; repeated rows are documents of
    their own, so all of a repeated long text goes; an empty table gives no
    rows; a null ``doc_id`` is an id like any other.
    """
    starts = repeated_spans(docs, min_len, hot_runs)
    joined = identified(docs).join(starts, ["__d", "__t"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut(min_len), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _left(min_len: int, text_at: int, chars_at: int | None):
    """The rows (a struct) with what is left of their texts; the second column has the repeated starts."""

    def f(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            rows, names = batch.column(0), [f.name for f in batch.schema.field(0).type]
            columns = rows.flatten()
            own = pa.RecordBatch.from_arrays([columns[text_at].fill_null(""), batch.column(1)], ["text", "starts"])
            for i, n, kept, offs, raw, _ in _kept(own, 0, 1, min_len):
                # a span may begin or end within a character: what is left of it goes too
                lead = np.flatnonzero(raw & 0xC0 != 0x80)
                part = ~np.logical_and.reduceat(kept, lead) if len(lead) else np.zeros(0, bool)
                kept &= ~np.repeat(part, np.diff(np.append(lead, len(raw)))) if len(lead) else kept
                ends = np.append(0, np.cumsum(kept, dtype=np.int32))[offs].astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[kept])])
                out = [c.slice(i, n) for c in columns]
                out[text_at] = text.cast(out[text_at].type)
                if chars_at is not None:
                    out[chars_at] = pc.utf8_length(text).cast(out[chars_at].type)
                yield pa.RecordBatch.from_arrays(out, names)

    return f


def deduplicated(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (``n_chars`` follows, where there is one); no row goes."""
    starts = repeated_spans(docs, min_len)
    joined = rows_with_identity(docs).join(starts, ["__d", "__t"], "left").select("__row", "starts")
    at = docs.columns.index("text")
    return joined.mapInArrow(_left(min_len, at, docs.columns.index("n_chars") if "n_chars" in docs.columns else None), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
