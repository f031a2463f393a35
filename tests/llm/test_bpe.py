import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from joinwright.llm.bpe import Codec, decode_documents, encode_documents
from joinwright.llm.queries import VOCABULARY

ODD = [None, "", "  ", "<|endoftext|> Hello<|startoftext|>x", "ΣΑΣ Σ", "İstanbul ß ẞ", "a" * 30_000, "don't you'LL we've 'ſ", "日本語 한글 ￼😀👍🏽 é xᴬ½²Ⅷ", "\x1c\x1d \x85\xa0 a\u200bb", "ab" * 300 + "!" * 200, "Décor naïve ÉÈ\nnew\r\nlines", "1234567 3.14"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(VOCABULARY, "rb") as f:
        return Codec(f.read())


def test_same_ids_as_the_library(own, library):
    draw = random.Random(5)
    syllables = ["tion", "er", "ing", "th", "é", "ü", "ó", "Q", "zz", "an", "qu", "x", "7", "-", "'s", " ", " ", " ", "\n", "."]
    texts = [t or "" for t in ODD] + ["".join(draw.choices(syllables, k=draw.randint(1, 400))) for _ in range(300)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(160, 0x250), draw.randrange(0x250, 0xD7FF), draw.randrange(0x1F300, 0x1F9FF)])) for _ in range(60)) for _ in range(100)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [own.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert 0 < own.failed < own.speculated


def test_each_plain_character_inside_a_word(own, library):
    texts = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("ab", "cd"), ("", "kra"), ("'", " 7"))] + ["Əliyev Baku", "Ɔkra", "WȺSANEC"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, own.encode(texts), want) if g.tolist() != w] == []


def test_speculation_and_exact_merging_agree(own):
    for word in (b"reconsiderations", b"thonnttiontion", b"aaaaaaaaab", b"x", "é".encode()):
        exact = own.merge(own.symbols_of(word))
        assert own._merge_long(own.symbols_of(word)) == exact


def test_query(spark, library):
    docs = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(ODD)] + [(0, "twice", "", []), (None, "x", "", [])], "doc_id long, text string, n_tokens string, token_ids array<int>")
    found = encode_documents(docs, VOCABULARY)
    rows = found.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.id is not None and r.id > 0:
            ids = library.encode(ODD[r.id] or "", add_special_tokens=False).ids
            assert r.token_ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    texts = {r.id: r.text for r in decode_documents(found.where("id > 0"), VOCABULARY).collect()}
    assert all(hashlib.sha256(texts[r.id].encode()).hexdigest() == r.decoded_sha256 for r in rows if r.id)
    assert encode_documents(docs.limit(0), VOCABULARY).count() == 0
