"""BPE encoding and decoding with a given tokenizer file (operator 10).

Method: content-defined chunk reuse.  A rolling hash of 32 bytes cuts each text
where its low bits are zero, so passages that documents share give the same
chunks wherever they stand.  A chunk is encoded once for each Python worker
that meets it: a store of bounded size keeps the results from task to task.
(Sharing them between workers needs the texts joined with the ids of their
chunks, a shuffle of all texts there and of the ids back.)  A chunk's inner words are
whole; the half words at a cut are repaired: they are joined, encoded anew with
whole words from both sides as witnesses, and the new ids have to start and end
with the witnesses' own ids.  If they don't, more witnesses are taken, until
both sides agree or the whole neighbouring chunks are encoded as one.

White space (space, \\t, \\n, \\v, \\f, \\r) separates words; :class:`WordIds`
encodes distinct words once as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame

from glyphsift.sources.tables import table

from .common import bounded_batches, byte_column, give_back, pieces, worker_store
from .suffix_dedup import GRAM, gram_hashes

#: One place in CUT is a cut; entries kept for each worker; words around a join at most; words in a call.
CUT, KEPT_CHUNKS, KEPT_WORDS, PIECE, GROUP = 1 << 10, 20_000, 500_000, 1 << 21, 64
#: Bytes handled at a time; hashes alone take some 24 times as much in the worker.
SLICE = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of words by a tokenizer whose tokens never cross white space."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.kept = kept
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.strings = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        special = [(i, x) for i, x in self.tok.get_added_tokens_decoder().items() if x.special and "<" in x.content and not x.normalized]
        self.mark_id, self.mark = (special[0][0], special[0][1].content) if special else (None, None)
        self.folds = self.direct(["QuiZ,. Ab"]) == self.direct(["quiz ,. ab"])
        self._reset()

    @classmethod
    def of(cls, path: str, words: int = KEPT_WORDS) -> "WordIds":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = worker_store("bpe")
        if (path, words) not in kept:
            kept[path, words] = cls(path, words)
        return kept[path, words]

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.used = np.zeros(1 << 12, np.int32)
        self.filled = 0
        self._add([b""], [b""])

    def _shrink(self) -> None:
        """Keep the words that came up again; those that were met once, most of them, go."""
        words = list(self.index)
        used = self.used[: len(words)]
        used[0] = 1 << 20
        least = 2
        while (used >= least).sum() > self.kept // 2:
            least *= 2
        keep = np.flatnonzero(used >= least)
        size = self.length[keep]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.begin[keep] - (ends - size), size) + np.arange(int(ends[-1]))]
        got, at = flat.tobytes(), (4 * ends).tolist()
        self._reset_to([words[i] for i in keep.tolist()], [got[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)], used[keep] // 2)

    def _reset_to(self, words: list[bytes], ids: list[bytes], used: np.ndarray) -> None:
        self._reset()
        self._add(words[1:], ids[1:])
        self.used[1 : len(words)] = used[1:]

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, new: list[bytes]) -> list[bytes]:
        """Ids (uint32) of words, many to a call: a special token's string between them keeps them apart."""
        if self.mark is None:
            return [np.array(x, np.uint32).tobytes() for x in self.direct([w.decode() for w in new])]
        odd = [w for w in new if b"<" in w]
        plain = [w for w in new if b"<" not in w] if odd else new
        got: dict[bytes, bytes] = {}
        mark = self.mark.encode()
        for a in range(0, len(plain), GROUP * 256):
            part = plain[a : a + GROUP * 256]
            lists = self.direct([mark.join(part[b : b + GROUP]).decode() for b in range(0, len(part), GROUP)])
            flat = np.fromiter(chain.from_iterable(x + [self.mark_id] for x in lists), np.uint32)
            cut = (4 * np.flatnonzero(flat == self.mark_id)).tolist()
            data = flat.tobytes()
            got.update(zip(part, (data[x:y] for x, y in zip([0, *(c + 4 for c in cut[:-1])], cut, strict=True)), strict=True))
        got.update(zip(odd, (np.array(x, np.uint32).tobytes() for x in self.direct([w.decode() for w in odd])), strict=True))
        return [got[w] for w in new]

    def _add(self, new: list[bytes], got: list[bytes]) -> None:
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        n, k = len(self.index), len(new)
        while n + k > len(self.begin):
            self.begin, self.length, self.used = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.length, self.used))
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.length[n : n + k] = size
        self.begin[n : n + k] = self.filled + np.cumsum(size) - size
        self.filled += len(flat)
        self.index.update(zip(new, range(n, n + k), strict=True))

    def _of(self, word: bytes) -> bytes:
        i = self.index[word]
        return self.ids[self.begin[i] : self.begin[i] + self.length[i]].tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Words that differ in ASCII case or in full stops and commas at the end share a stem.

        The tokenizer has to fold case and to break between a letter and
        punctuation; ``folds`` says whether it was found to.
        """
        made: list[tuple[bytes, bytes, bytes]] = []
        stems: dict[bytes, None] = {}
        for w in new:
            if self.folds and w.isascii() and b"<" not in w:
                low = w.lower()
                stem = low.rstrip(b".,")
                if stem == low or not stem[-1:].isalpha():
                    stem, end = low, b""
                else:
                    end = low[len(stem) :]
                    stems[end] = None
                if w != stem:
                    made.append((w, stem, end))
                stems[stem] = None
            else:
                stems[w] = None
        fresh = [x for x in stems if x not in self.index]
        ids = dict(zip(fresh, self._stems(fresh), strict=True))
        self._add(fresh, list(ids.values()))
        made = [x for x in made if x[0] not in ids]
        self._add([x[0] for x in made], [(ids.get(a) or self._of(a)) + ((ids.get(b) or self._of(b)) if b else b"") for _, a, b in made])

    def encode(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        import pyarrow as pa

        flat, ends = self.encode_column(pa.array(list(texts), pa.string()))
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode_column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string array's texts, and the n + 1 offsets of the texts in them."""
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ws = coded.dictionary.cast("binary").to_pylist()
        at = np.fromiter(map(self.index.get, ws, repeat(-1)), np.int64, len(ws))
        missed = np.flatnonzero(at < 0).tolist()
        if missed and len(self.index) + 2 * len(missed) > self.kept and len(self.index) > self.kept // 2:
            self._shrink()
            at = np.fromiter(map(self.index.get, ws, repeat(-1)), np.int64, len(ws))
            missed = np.flatnonzero(at < 0).tolist()
        if missed:
            self._learn([ws[i] for i in missed])
            at[missed] = np.fromiter(map(self.index.__getitem__, (ws[i] for i in missed)), np.int64, len(missed))
        self.used[at] += 1
        at = at[coded.indices.to_numpy()]
        size = self.length[at]
        ends = np.append(0, np.cumsum(size))
        flat = self.ids[np.repeat(self.begin[at] - ends[:-1], size) + np.arange(int(ends[-1]))]
        return flat, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a file without a decoder."""
        if self.tok.decoder is not None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def cuts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chunk borders within texts that stand one after another; texts' ends are borders too."""
    found = [offs]
    for a in range(0, len(raw) - GRAM + 1, SLICE):
        at = np.flatnonzero(gram_hashes(raw[a : a + SLICE + GRAM - 1]) >> np.uint64(20) & np.uint64(CUT - 1) == 0) + a + GRAM
        at = at[at < len(raw)]
        at = at[raw[at] & 0xC0 != 0x80]  # not within a character
        doc = np.searchsorted(offs, at, "right") - 1
        found.append(at[at - offs[doc] >= GRAM])  # the hashed bytes belong to one text
    return np.unique(np.concatenate(found))


class Chunk:
    """A chunk: the half words at its ends, its inner bytes and their ids. ``whole``: it has no white space."""

    __slots__ = ("head", "tail", "inner", "ids", "whole")

    def __init__(self, data: bytes):
        first = next((i for i, c in enumerate(data) if c in b" \t\n\x0b\x0c\r"), -1)
        self.whole = first < 0
        if self.whole:
            self.head, self.tail, self.inner = data, b"", b""
        else:
            last = max(data.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            self.head, self.tail, self.inner = data[:first], data[last + 1 :], data[first : last + 1]
        self.ids = None


class Encoder:
    """Encodes texts by chunks that it keeps."""

    def __init__(self, path: str):
        self.words = WordIds.of(path)
        self.kept: dict[bytes, Chunk] = {}
        self.chunks = self.reused = self.repaired = self.widened = 0

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        border = cuts(raw, offs)
        data = raw.tobytes()
        chunks: list[Chunk] = []
        new: list[Chunk] = []
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            part = data[a:b]
            key = hashlib.blake2b(part, digest_size=16).digest()
            c = self.kept.get(key)
            if c is None:
                c = Chunk(part)
                if len(self.kept) >= KEPT_CHUNKS:
                    del self.kept[next(iter(self.kept))]
                self.kept[key] = c
                new.append(c)
            else:
                self.reused += 1
            chunks.append(c)
        self.chunks += len(chunks)
        for a, b in pieces(np.cumsum([0, *(len(c.inner) for c in new)]), SLICE):
            for c, ids in zip(new[a:b], self.words.encode([c.inner for c in new[a:b]]), strict=True):
                c.ids = ids
        of = np.searchsorted(border, offs)
        plan: list[list] = []  # for each text: ids, or (left chunk, bytes, right chunk) to repair
        for i in range(len(offs) - 1):
            parts: list = []
            left, half = None, b""
            for c in chunks[of[i] : of[i + 1]]:
                half += c.head
                if not c.whole:
                    if half:
                        parts.append((left, half, c))
                    if len(c.ids):
                        parts.append(c.ids)
                    left, half = c, c.tail
            if half:
                parts.append((left, half, None))
            plan.append(parts)
        joins = [x for p in plan for x in p if isinstance(x, tuple)]
        fixed = iter(self._repair(joins))
        none = np.zeros(0, np.uint32)
        return [np.concatenate([next(fixed) if isinstance(x, tuple) else x for x in p] or [none]) for p in plan]

    def _repair(self, joins: list[tuple]) -> list[np.ndarray]:
        """Ids of the joined half words, agreed on with the words around them."""
        out: list = [None] * len(joins)
        todo, n = list(range(len(joins))), 1
        self.repaired += len(joins)
        while todo:
            sides = []
            for k in todo:
                left, half, right = joins[k]
                before = left.inner.split()[-n:] if left and n > 1 else left.inner.rsplit(None, 1)[-1:] if left else []
                after = right.inner.split(None, n)[:n] if right else []
                sides.append((b" ".join(before), half, b" ".join(after)))
            around = self.words.encode([x for a, _, b in sides for x in (a, b)])
            whole = self.words.direct([b" ".join(x for x in s if x).decode() for s in sides])
            again = []
            for k, j in enumerate(todo):
                a, b, ids = around[2 * k], around[2 * k + 1], np.array(whole[k], np.uint32)
                if len(ids) >= len(a) + len(b) and np.array_equal(ids[: len(a)], a) and np.array_equal(ids[len(ids) - len(b) :], b):
                    out[j] = ids[len(a) : len(ids) - len(b)]
                elif n > PIECE:
                    raise ValueError("this tokenizer's tokens cross white space")
                else:
                    again.append(j)
            self.widened += len(again)
            todo, n = again, 2 * n
        return out


def _encode(path: str):
    def f(batches):
        import pyarrow as pa

        kept = worker_store("bpe")
        if ("encoder", path) not in kept:
            kept["encoder", path] = Encoder(path)
        own = kept["encoder", path]
        for batch in batches:
            raw, offs = byte_column(batch.column(1))
            for i, j in pieces(offs, SLICE):
                got = own.encode(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.words.decode(x).encode()).hexdigest()) for x in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                del got, rows
                give_back()

    return f


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row.

    Null and empty text have no tokens; the SHA-256 are those of no bytes then.
    Repeated rows give repeated rows, an empty table an empty one; texts of any
    length are encoded whole.  The tokenizer's truncation and padding are off.
    """
    from pyspark.sql import functions as F

    bounded_batches(docs.sparkSession)
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_encode(path or tokenizer_path()), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
