import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from quire.llm import byte_bpe as bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(8)
    made = [None, "", " ", "  a", "a  ", "x\n  y", "\n\n\n", "it's we'll 'S", "\x1c\x1d!\x1c!", "a\x85b\xa0c  d", "naïve 你好 😀😀 क्षि é", "a" * 5000, "ab" * 3000, "=" * 999]
    made += ["<|endoftext|>", "　　x \t y", "".join(map(chr, range(1, 0xD800))), "the the the " * 4000, "0123456789" * 2000]
    made += ["".join(rng.choice(["a", "b", "th", "e", " ", "\n", "é", "1", "'s", "!", "ing", "😀"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    made += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2100)])) for _ in range(90)) for _ in range(60)]
    return made


def test_ids_and_bytes_against_tiktoken(spark, docs, plain):
    rows = list(enumerate(texts())) + [(7, "a"), (7, "a"), (None, "null id")]
    got = bpe.encode(docs(rows), RANKS, public_tokenizers.PATTERN).collect()
    want = [(i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted([(r.doc_id, r.ids, bytes(r.decoded)) for r in got], key=str) == sorted(want, key=str)


def test_digests(spark, docs, plain):
    rows = list(enumerate(texts()[:40]))
    for r in bpe.digests(docs(rows), RANKS, public_tokenizers.PATTERN).collect():
        ids = plain.encode_ordinary(rows[r.doc_id][1] or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()


def test_forgetting_and_small_rounds(monkeypatch, plain):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 30)
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    for t in texts()[1:60]:
        assert [x.tolist() for x in coder.encode([t, t])] == [plain.encode_ordinary(t)] * 2


def test_merges_that_a_lower_rank_can_cut_short():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"cab": 4, b"ab": 5, b"dc": 6}
    coder = bpe.Coder.__new__(bpe.Coder)
    assert {(r["l"], r["r"]): r["alone"] for r in bpe.merge_table(ranks).to_pylist()} == {(0, 1): True, (2, 5): False, (3, 2): False}
    del coder


def long_words():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["".join(rng.choice(letters[: rng.randrange(1, 27)]) for _ in range(rng.randrange(100, 700))) for _ in range(60)]
    made += ["x" * 120, "x" * 121, "xy" * 90 + "z", "-" * 777 + "_" * 333, "abcdefg" * 3000, "the" * 5000, "ab" * 60_000]
    return [*made, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)), "".join(rng.choice(letters) for _ in range(200_000))]


def test_long_words(plain):
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    for word in long_words():
        began = time.perf_counter()
        assert coder.encode([word])[0].tolist() == plain.encode_ordinary(word)
        assert time.perf_counter() - began < 60


@pytest.mark.parametrize("word", ["-" * 5_000_000, "=-" * 1_000_000, "abcdefg" * 300_000, "ab-" * 700_000 + "q"], ids=lambda w: w[:4])
def test_millions_of_bytes_without_white_space(plain, word):
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    ids = coder.encode([word])[0]
    assert coder.decode([ids]) == [word.encode()]
    # The library's own time grows with the square of a word: its ids are known of a word that repeats by a shorter one.
    short = word[:7560] + ("q" if word[-1] == "q" else "")
    assert coder.encode([short])[0].tolist() == plain.encode_ordinary(short)


def test_a_worker_goes_on_after_an_error(spark, docs, monkeypatch, plain):
    coder = bpe.coder(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe.Coder, "words", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError), bpe.using(RANKS, public_tokenizers.PATTERN) as own:
        own.encode(["never seen before"])
    monkeypatch.undo()
    with bpe.using(RANKS, public_tokenizers.PATTERN) as own:
        assert own is not coder and own.encode(["never seen before, again"])[0].tolist() == plain.encode_ordinary("never seen before, again")


def test_windows_without_a_common_token(monkeypatch, plain):
    monkeypatch.setattr(bpe, "WINDOW", 4)
    monkeypatch.setattr(bpe, "STEP", 3)
    monkeypatch.setattr(bpe, "LARGER", ((9, 5), (30, 17)))
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    for word in long_words()[:5]:
        assert coder.encode([word])[0].tolist() == plain.encode_ordinary(word)


def test_empty_table(spark, docs):
    assert bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
