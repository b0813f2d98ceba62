import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import edge
from tablegauge.llm import tokenfiles
from tablegauge.llm.queries import word_tokenizer
from tablegauge.llm.shared import new_folder


def brute(rows, end=2):
    """Ids in ascending id order (null ids last, repeated ids by text), counted and checksummed directly."""
    t = Tokenizer.from_file(word_tokenizer())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for doc_id, text in order:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def written(spark, df, options=tokenfiles.Framing()):
    path = new_folder(spark, "tokens-test")
    tokenfiles.write_token_files(df, path, word_tokenizer(), options)
    return path


def test_round_trip_against_direct_encoding(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = written(spark, edge.with_clashing(docs), tokenfiles.Framing(block_bytes=3000))
    got = tokenfiles.read_token_files(spark, path)
    assert got.filter("broken").count() == 0
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str) == brute(rows)
    # Several blocks per range, and the index places every record.
    assert spark.read.parquet(f"{path}/blocks").count() > 3
    assert spark.read.parquet(f"{path}/index").count() == len(rows)


def test_index_gives_random_access(spark, docs):
    path = written(spark, docs)
    index = {(r.range, r.block, r.offset): r for r in spark.read.parquet(f"{path}/index").collect()}
    for b in spark.read.parquet(f"{path}/blocks").collect():
        for offset, payload, _ in tokenfiles.records(b.data):
            assert index[(b.range, b.block, offset)].n_tokens == len(payload) // 4


def test_damage_is_found():
    data = tokenfiles.frame(np.arange(5, dtype="<u4").tobytes()) + tokenfiles.frame(b"")
    assert [len(p) for _, p, _ in tokenfiles.records(data)] == [20, 0]
    for bad in (data[:-1], data[:3] + b"x" + data[4:], data[:14] + b"\xff" + data[15:]):
        with pytest.raises(ValueError):
            list(tokenfiles.records(bad))


def test_empty_table(spark, no_docs):
    path = written(spark, no_docs)
    assert tokenfiles.read_token_files(spark, path).count() == 0
