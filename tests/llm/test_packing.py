import struct
import zlib

import numpy as np
from tokenizers import Tokenizer

from quillon.llm.common import tokenizer_path
from quillon.llm.packing import pack_documents, sum_of_squares
from quillon.llm.tokens import ByteIds

TEXTS = [None, "", " ", "Hello  world\n\tx", "don't <|endoftext|> stop", "日本語 テキスト", "a" * 5000, "word " * 3000, "é ü x  ", "x\x1cy \x85z", "İstanbul ½ ²"]


def test_ids_are_those_of_the_library():
    ids, want = ByteIds("byte_bpe_50k.json"), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for text in TEXTS[1:]:
        got = want.encode(text, add_special_tokens=False).ids
        assert ids(text) == struct.pack(f"<{len(got)}I", *got), text
    ids.unproved = 0
    assert ids.exact is not None


def test_packing(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 2), (None, "no id", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, sequence_id int")
    got = pack_documents(docs, keep_ids=True).toPandas()
    want = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc = {}
    for r in got.itertuples():
        by_doc.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append(r)
    for doc, text, _, copies in [(*r[:2], r[2], 2 if r[0] == 3 else 1) for r in rows]:
        ids = [*want.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert list(r.ids) == part and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
            assert r.length <= 2048 and (r.length == 2048 or r.piece == 0)
    for _, seq in got.groupby("sequence_id"):
        at = 0
        for r in seq.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert pack_documents(docs.where("false")).count() == 0


def test_sum_of_squares_wastes_little():
    lengths = np.random.default_rng(0).lognormal(6, 1, 3000).astype(int).clip(1, 2047)
    bins, offsets = sum_of_squares(lengths, 2048)
    used = np.bincount(bins, lengths)
    assert used.max() <= 2048 and len(used) <= lengths.sum() / 2048 + 3
    for b in range(len(used)):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert (offsets[mine] == np.concatenate([[0], np.cumsum(lengths[mine])[:-1]])).all()
