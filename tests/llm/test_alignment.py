import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import alignment
from quillon.llm.alignment import align_tokens, byte_alphabet
from quillon.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def brute(rows):
    """All columns, by the libraries' tokens and a walk over their bytes."""
    a, b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letter = byte_alphabet()
    of_a = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made, pairs = [], Counter()
    for doc, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xa, xb = [of_a(i) for i in ia], [of_b(i) for i in ib]
        if text and not b"".join(xa) == b"".join(xb) == b" " + text.encode():
            ia, ib, xa, xb = [], [], [], []
        groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        while i < len(ia) or j < len(ib):
            if not groups or at_a == at_b:
                groups.append(([], []))
            if at_a <= at_b:
                groups[-1][0].append(ia[i])
                at_a += len(xa[i])
                i += 1
            else:
                groups[-1][1].append(ib[j])
                at_b += len(xb[j])
                j += 1
        spans = []
        for ids, words in ((ia, xa), (ib, xb)):
            at, own = 0, []
            for t, w in zip(ids, words, strict=True):
                own.append((t, at, at + len(w)))
                at += len(w)
            spans.append(own)
        k = 0
        for t, s, e in spans[0]:
            while k and spans[1][k][1] > s:
                k -= 1
            while spans[1][k][2] <= s:
                k += 1
            links += [(t, u) for u, s2, e2 in spans[1][k : k + e - s + 1] if s2 < e and s < e2]
        pairs.update(set(links))
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        made.append((doc, len(ia), len(ib), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if ia else ""))
    best = {}
    for (t, _), n in pairs.items():
        best[t] = max(best.get(t, 0), n)
    return [(d, na, nb, g, len(x), sum(pairs[p] == best[p[0]] for p in x), sum(pairs[p] for p in x), h) for d, na, nb, g, x, h in made]


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(align_tokens(docs).collect(), brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_odd_texts(spark, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "CHUNK", 4 * part)
    texts = [None, "", " ", "Hello  world\n\tx", "a<|endoftext|> b", "<s> </s><unk> <0x41>", "日本語 テキスト 😀", "é ﬁ ½ ́", "▁x", "﻿bom", "x\x00y", "a" * 3000, "word " * 400, "  two", "\r\n\x0b", "İstanbul"]
    rows = [((1 << 60) + i, t) for i, t in enumerate(texts)] + [(5, texts[3]), (5, texts[3]), (None, texts[6]), (None, None)]
    docs = spark.createDataFrame([(t, "c", d, 1) for d, t in rows], "text string, chunk string, doc_id long, pair int").repartition(3)
    same(align_tokens(docs).collect(), brute(rows))
    assert align_tokens(docs.where("false")).count() == 0
    named = spark.createDataFrame([("k", "one text")], "doc_id string, text string")
    assert align_tokens(named).collect()[0][:5] == ("k", *brute([("k", "one text")])[0][1:5])
