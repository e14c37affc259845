import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import word_bpe as bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(16)
    made = [None, "", " \n", "It's WE'LL ok 'S'T'd '", "a b\x85c\x1cd\x1d\x00\x7f", "naïve ÀÉ ﬁ 你好 😀 क्षि é İSTANBUL ΣΑΣ ΑΣ", "<|endoftext|> x", "a <|endoftext|> x", "a<|startoftext|>B,<|endoftext|><|endoftext|>.", "<|ENDOFTEXT|>"]
    made += ["1234 5,6 a1b2", "ŉ ß ªº µ ǅ", "<|endoftext", "<<|endoftext|>é<|startoftext|>", "á<|endoftext|>́b", "x</w> </w>", "a b c　d", "the " * 9000, "x" * 3000, "ab" * 700 + "!" * 900]
    made += ["".join(rng.choice(["a", "The", "ing", " ", "\n", "\t ", "é", "1", "'s", "!", "||", "́", "‍", "Ω", "<|endoftext|>"]) for _ in range(rng.randrange(70))) for _ in range(300)]
    made += ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(0xA0, 0x2100), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(90)) for _ in range(60)]
    return [*made, "".join(map(chr, range(1, 0xD800)))]


def expected(plain, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    return ids, plain.decode(ids, skip_special_tokens=False)


def test_ids_and_texts_against_the_library(spark, docs, plain):
    rows = list(enumerate(texts())) + [(7, "a"), (7, "a"), (None, "null id")]
    got = bpe.encode(docs(rows), PATH).collect()
    want = [(i, *expected(plain, t)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_digests(spark, docs, plain):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in bpe.digests(docs(rows), PATH).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids, text = expected(plain, t)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("widths", [(), (1,), (2, 5), (3, 9000)])
def test_scanned_and_queued_words_are_alike(monkeypatch, plain, widths):
    monkeypatch.setattr(bpe, "WIDTHS", widths)
    monkeypatch.setattr(bpe, "PARTS", 20_000)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 50)
    own = bpe.Coder(PATH)
    for t in texts()[1:150]:
        ids, counts = own.encode(pa.array([t, t]))
        assert ids.tolist() == 2 * expected(plain, t)[0] and counts[0] == counts[1]


@pytest.mark.parametrize("word", ["-" * 2_000_000, "ab" * 1_000_000, "abcdefg" * 150_000 + "x", "é" * 300_000, "你好世界" * 100_000], ids=lambda w: w[:4])
def test_very_long_words(plain, word):
    own = bpe.Coder(PATH)
    began = time.perf_counter()
    ids, counts = own.encode(pa.array([word]))
    assert time.perf_counter() - began < 60
    assert ids.tolist() == expected(plain, word)[0]


def test_random_letters(plain):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500_000))
    assert bpe.Coder(PATH).encode(pa.array([word]))[0].tolist() == expected(plain, word)[0]


def test_empty_table(spark, docs):
    assert bpe.encode(docs([]), PATH).count() == 0
    assert bpe.digests(docs([]), PATH).count() == 0
