"""The pipeline's stages keep their columns and act on what the one before kept."""

import hashlib
from collections import Counter

import numpy as np

import __spark_entry__
import corpus_pipeline
from glyphsift.llm import bpe, mixing, suffix_dedup
from glyphsift.llm.common import stored
from tests.llm.test_operators import ROWS, SCHEMA
from tests.llm.test_similar_links import groups


def test_stages(spark):
    """Each stage against what its operator says of that stage's own input."""
    docs = stored(spark.createDataFrame(ROWS, SCHEMA), "test-rows")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, "/nowhere"), "test-stage")
        old, new = before.collect(), docs.collect()
        if i < 4:
            assert docs.columns == before.columns
        if i == 0:  # rows whose text has no letter or is null go, all others stay as they are
            assert Counter(new) == Counter(r for r in old if any(c.isalpha() for c in r.text or ""))
        if i == 1:  # the smallest id of each group of copies and near copies, as it is
            texts = sorted({r.text for r in old})
            root = dict(zip(texts, groups(texts), strict=True))
            best = {}
            for r in old:
                key = (r.doc_id is not None, r.doc_id or 0)
                best[root[r.text]] = min(best.get(root[r.text], key), key)
            assert len(new) == len(best) and sorted((r.doc_id is not None, r.doc_id or 0) for r in new) == sorted(best.values())
            assert set(new) <= set(old)
        if i == 2:  # the bytes that the operator keeps, less parts of characters; nothing else changes
            want = {(r.doc_id, r.n_bytes): bytes(r.kept).decode(errors="ignore") for r in suffix_dedup.remove_repeats(before).collect()}
            text = {r.doc_id: r.text for r in old}
            assert len(new) == len(old) and any(r.text != text[r.doc_id] for r in new)
            for r in new:
                assert r.text == want[r.doc_id, len(text[r.doc_id].encode())] and r.n_chars == len(r.text)
            rest = [c for c in range(len(before.columns)) if before.columns[c] not in ("text", "n_chars")]
            assert Counter(tuple(r[c] for c in rest) for r in new) == Counter(tuple(r[c] for c in rest) for r in old)
        if i == 3:  # each document as often as the mix takes its words, to the nearest
            taken = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix(before).collect() if r["size"]}
            assert Counter(r.doc_id for r in new) == Counter({d: n for d, n in taken.items() if n})
            assert set(new) <= set(old) and max(taken.values()) <= 3
        if i == 4:
            tok = bpe.WordIds.of(bpe.tokenizer_path()).tok
            want = sorted(hashlib.sha256(np.array(tok.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in old)
            assert sorted(r.ids_sha256 for r in new) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 11))
