import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import edge
from tablegauge.llm import packing
from tablegauge.llm.packing import Packing, best_fit, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity):
    encoder = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = np.array(encoder.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want.append((i is None, i or 0, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    got = [(r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(x[4] for x in want) // capacity)


STRANGE = ["DON'T stop; it's 'RE' we'll", "a<|endoftext|>b <|STARTOFTEXT|> c<|startoftext|>", "é É,  x　y.,!?;:", "1,000.5 a1b2! #?!",
           "...?!", "😀😀, ok.", "İstanbul ſ K Σας.", "\x00\x01 x", "don't. can't, ’s 's"]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_sequences(spark, docs, capacity):
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(STRANGE)], edge.DOCS)
    both = edge.with_clashing(docs.unionAll(more))
    rows = pack_documents(both, PATH, options=Packing(capacity=capacity, batch=40)).collect()
    n, least = check(rows, [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()], capacity)
    assert n <= 1.03 * least + 1


def test_the_word_table_may_be_small(docs, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    from tablegauge.llm.textarrays import Texts, text_column
    import pyarrow as pa

    encoder, tokenizer = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    for row in docs.collect():
        ids, n = tokenizer.encode(Texts(*text_column(pa.array([row.text or ""]))))
        assert ids.tolist() == encoder.encode(row.text or "", add_special_tokens=False).ids and n.tolist() == [len(ids)]


def test_best_fit():
    assert sorted(map(sorted, best_fit([6, 5, 4, 3, 2], 10))) == [[0, 2], [1, 3, 4]]


def test_items_that_never_fit_together_end_early(spark):
    rng = random.Random(1)
    pieces = spark.createDataFrame([(i, rng.randrange(60, 100)) for i in range(400)], "n long, length long").repartition(6)
    rows = pack(pieces, Packing(capacity=100, batch=50)).collect()
    assert sorted(r.n for r in rows) == list(range(400)) and len({r.sequence_id for r in rows}) == 400


def test_empty(no_docs):
    assert pack_documents(no_docs, PATH).collect() == []
