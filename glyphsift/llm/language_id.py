"""Language identification by prediction by partial matching (operator 8).

Method: for each language a tree of byte contexts of 0 to 3 bytes is counted
over a bounded sample of labelled rows and then frozen.  A byte's code length
comes from the longest context that was seen: a byte seen n_s times in a
context seen n times with d different bytes after it has probability
n_s / (n + d); otherwise the escape, d / (n + d), is paid and the next shorter
context is asked; below the empty context all 256 bytes are alike.  A text gets
the language that gives it the shortest code.

With frozen counts each window of 4 bytes (context and byte) has one exact code
length for each language.  The trees are kept sparse, as sorted arrays of the
contexts and bytes that were seen; a worker asks them once for each window that
it meets and keeps the answers in a table of fixed size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.sources.tables import table

from .common import NO_ID, bounded_batches, byte_column, pieces, rows_with_identity, stored, worker_store

ORDER = 3
#: The sample: at most so many labelled rows of each language, those whose ids hash lowest.
ROWS_PER_LANGUAGE = 400
#: The languages with the most rows in the sample are learned, at most so many; the trees, which are broadcast, have at most so many bytes.
LANGUAGES, MODEL_BYTES = 200, 1 << 29
PAD = 0x20
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _grams(batches):
    """Counts of 4-byte windows, each text preceded by spaces."""
    import pyarrow as pa

    worker_store("language")
    pad = np.full(ORDER, PAD, np.uint8)
    for batch in batches:
        raw, offs = byte_column(batch.column(1))
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            parts = []
            for i in (i for i, x in enumerate(langs) if x == lang):
                b = _FOLD[np.concatenate((pad, raw[offs[i] : offs[i + 1]]))].astype(np.int64)
                parts.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


#: Windows whose code lengths a worker keeps.
SLOTS = 1 << 18


class Ppm:
    """Frozen context trees of some languages.

    ``trees``: for each language and order the seen (context, byte) pairs, packed
    and sorted, with their code lengths in bits, and the contexts with the bits
    of their escape.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: language -> 4-byte windows (packed, big endian) and how often they were seen."""
        self.langs = sorted(counts)
        self.trees = []
        for lang in self.langs:
            gram, n = (np.asarray(x, np.int64) for x in counts[lang])
            orders = []
            for order in range(ORDER + 1):
                key, at = np.unique(gram & (1 << 8 * (order + 1)) - 1, return_inverse=True)
                times = np.bincount(at, weights=n, minlength=len(key))
                ctx, first, kinds = np.unique(key >> 8, return_index=True, return_counts=True)
                all_ = np.add.reduceat(times, first) if len(first) else times
                orders.append((key.astype(np.uint32), -np.log2(times / np.repeat(all_ + kinds, kinds)), ctx.astype(np.uint32), -np.log2(kinds / (all_ + kinds))))
            self.trees.append(orders)
        self._fresh()

    def _fresh(self) -> None:
        self.owner = np.zeros(SLOTS, np.uint32)
        self.known = np.zeros(SLOTS, bool)
        self.bits = np.zeros((SLOTS, len(self.langs)), np.float32)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "trees": self.trees}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def size(self) -> int:
        """Bytes of the trees."""
        return sum(x.nbytes for orders in self.trees for arrays in orders for x in arrays)

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window (rows, uint32) under each language."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        for k, orders in enumerate(self.trees):
            left = np.arange(len(gram))
            for order in range(ORDER, -1, -1):
                key, bits, ctx, escape = orders[order]
                own = gram[left] & np.uint32((1 << 8 * (order + 1)) - 1)
                at = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
                hit = key[at] == own if len(key) else np.zeros(len(own), bool)
                out[left[hit], k] += bits[at[hit]]
                left, own = left[~hit], own[~hit] >> np.uint32(8)
                at = np.minimum(np.searchsorted(ctx, own), max(0, len(ctx) - 1))
                hit = ctx[at] == own if len(ctx) else np.zeros(len(own), bool)
                out[left[hit], k] += escape[at[hit]]
            out[left, k] += 8
        return out

    def windows(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The packed window that ends at each byte; texts begin at ``starts``, after spaces."""
        r = _FOLD[raw].astype(np.uint32)
        out = r.copy()
        for back in range(1, ORDER + 1):
            p = np.full(len(r), PAD, np.uint32)
            p[back:] = r[:-back]
            for j in range(back):
                here = starts + j
                p[here[here < len(p)]] = PAD
            out |= p << np.uint32(8 * back)
        # a text shorter than the context leaves pads beyond its end: the next text's own pads overlap them
        return out

    def code_lengths(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each byte (rows) under each language; texts begin at ``starts``."""
        gram = self.windows(raw, starts)
        slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)
        miss = ~(self.known[slot] & (self.owner[slot] == gram))
        if miss.any():
            self.owner[slot[miss]] = gram[miss]  # of several for one slot the last stays
            self.known[slot[miss]] = True
            new = np.unique(slot[miss])
            self.bits[new] = self.lengths(self.owner[new])
        out = self.bits[slot]
        odd = np.flatnonzero(self.owner[slot] != gram)
        if len(odd):
            which, at = np.unique(gram[odd], return_inverse=True)
            out[odd] = self.lengths(which)[at]
        return out

    def totals(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        step = 1 << 18
        for i, j in pieces(offs, step):
            if j == i + 1:  # perhaps a very long text: in slices that see the bytes before them
                for a in range(int(offs[i]), int(offs[j]), step):
                    first = max(int(offs[i]), a - ORDER)
                    out[i] += self.code_lengths(raw[first : min(a + step, offs[j])], np.array([0]))[a - first :].sum(0, dtype=np.float64)
                continue
            some = np.flatnonzero(np.diff(offs[i : j + 1])) + i
            if len(some):
                begin = offs[some] - offs[i]
                out[some] = np.add.reduceat(self.code_lengths(raw[offs[i] : offs[j]], begin), begin, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> Ppm:
    """Count the trees over the sample; only ``text`` and ``lang`` are learned from."""
    bounded_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    lowest = Window.orderBy(F.xxhash64("__d"), "__d")
    # first within parts of a language, then among those: no task sees all of a language's rows
    parts = labelled.select("lang", key.alias("__d")).withColumn("__p", F.pmod(F.xxhash64("__d"), F.lit(64)))
    some = parts.withColumn("__r", F.row_number().over(lowest.partitionBy("lang", "__p"))).where(F.col("__r") <= rows_per_language)
    chosen = some.withColumn("__r", F.row_number().over(lowest.partitionBy("lang"))).where(F.col("__r") <= rows_per_language).select("lang", "__d").distinct()
    chosen = stored(chosen, "language-sample")
    most = chosen.groupBy("lang").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "lang").limit(languages).select("lang")
    # at most rows_per_language ids for each of at most LANGUAGES languages
    chosen = chosen.join(F.broadcast(most), "lang", "left_semi").select(F.col("lang").alias("__l"), F.col("__d").alias("__id"))
    sample = labelled.select(key.alias("__d"), F.col("lang").alias("lang"), "text").join(F.broadcast(chosen), (F.col("__d") == F.col("__id")) & (F.col("lang") == F.col("__l")), "left_semi").select("lang", "text")
    rows = sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = np.array(rows["lang"].to_pylist(), object), rows["gram"].to_numpy(), rows["n"].to_numpy()
    model = Ppm({x: (gram[lang == x], n[lang == x]) for x in sorted(set(lang))})
    if model.size() > MODEL_BYTES:
        raise ValueError(f"trees of {model.size()} bytes: take fewer rows of each language")
    return model


def predict(model: Ppm, texts) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of an Arrow string array without nulls."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    raw, offs = byte_column(texts)
    total = model.totals(raw, offs)
    count = np.append(0, np.cumsum(letter[raw]))
    has = count[offs[1:]] > count[offs[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in raw[offs[i] : offs[i + 1]].tobytes().decode(errors="replace"))
    if not model.langs or not len(has):
        return [UNKNOWN] * len(has), np.zeros(len(has))
    best = total.argmin(1)
    each = total / np.maximum(np.diff(offs), 1)[:, None]
    score = 1 / np.exp2(np.maximum(-1000, each.min(1, keepdims=True) - each)).sum(1)
    return [model.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def _predict(shared):
    def f(batches):
        import pyarrow as pa

        worker_store("language")
        for batch in batches:
            lang, score = predict(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return f


def _accept(shared, text_at: int):
    def f(batches):
        import pyarrow as pa

        worker_store("language")
        for batch in batches:
            columns = batch.column(0).flatten()
            lang, _ = predict(shared.value, columns[text_at].fill_null(""))
            rows = pa.RecordBatch.from_arrays(columns, [f.name for f in batch.schema.field(0).type])
            yield rows.filter(pa.array([x != UNKNOWN for x in lang]))

    return f


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per input row.

    ``lang_pred`` is ``und`` (score 0) where the text is null or has no letter,
    and everywhere if there is no labelled row to learn from.  ``score`` is the
    best language's share of the probability that all learned languages give
    a byte of the text on average; ties go to the first language by name.  Texts of any length are
    scored whole; repeated rows give repeated rows, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows_per_language))
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose text has a language; those that get ``und`` go."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows_per_language))
    # as one struct, so that columns of any name pass through
    return rows_with_identity(docs).select("__row").mapInArrow(_accept(shared, docs.columns.index("text")), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
