import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

from data import SCHEMA, awkward_rows, frame
from skein.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
EXACT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
MORE = ["a" * 500, "=" * 333 + " x", "日本語の文章は空白を使わない" * 20, "<|endoftext|> don't we'll\r\n\t  x  ", "🙂é́" * 9, "\x00\x01 ", "thethethe" * 60]


def brute(text):
    ids = EXACT.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_match_tiktoken(spark):
    rows = awkward_rows() + [(500 + i, t, "en", "s", 1) for i, t in enumerate(MORE)]
    got = bpe.token_digests(frame(spark, rows).selectExpr("*", "1 as ids"), PATH).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *brute(r[1])) for r in rows)
    assert bpe.token_digests(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_ids_round_trip(spark):
    got = bpe.encode(frame(spark), PATH).collect()
    texts = Counter((r[0], r[1] or "") for r in awkward_rows())
    assert Counter((r.doc_id, EXACT.decode(r.ids)) for r in got) == texts


def test_the_vocabulary_lets_a_round_join_every_separate_pair():
    assert bpe.rounds_may_join(bpe.ranks(PATH))
    letters = {bytes([i]): i for i in range(256)}
    assert bpe.rounds_may_join(letters | {b"ab": 300, b"abc": 301})
    # "xab": a pair of a lower rank than that of the pair that makes it.
    assert not bpe.rounds_may_join(letters | {b"xab": 299, b"ab": 300})


def test_both_kinds_of_round_agree_with_tiktoken(monkeypatch):
    rnd = random.Random(5)
    pieces = {"".join(rnd.choice("abethinoré=.- ") for _ in range(rnd.randint(1, 60))) for _ in range(1500)}
    pieces |= {"".join(rnd.choice("abethinor") for _ in range(n)) for n in (65, 300, 2000)} | {"=" * 5000, "ab" * 3000}
    pieces = sorted(pieces)
    for long_piece, slice_rows in ((64, bpe.SLICE_ROWS), (0, bpe.SLICE_ROWS), (64, 40_000), (1 << 30, bpe.SLICE_ROWS)):
        monkeypatch.setattr(bpe, "SLICE_ROWS", slice_rows)
        if long_piece > 64:  # one pair a round also for long pieces
            pieces = [p for p in pieces if len(p) < 1000]
        codec = bpe.Codec(PATH, public_tokenizers.PATTERN, long_piece)
        codec.learn(pieces)
        for p in pieces:
            ids, decoded = codec.young[p]
            assert decoded == p.encode()
            assert [int(i) for i in ids.split(",")] == EXACT._core_bpe.encode_single_piece(p.encode())


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for text in ("one two three four five", "six one seven", "two eight nine ten", "one six ten"):
        ids = [int(i) for p in codec.encode([text])[0][0] for i in p.split(",")]
        assert ids == EXACT.encode_ordinary(text)


def test_the_older_half_of_the_cache_is_packed(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 2)
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    text = "a | b||c | \x00 unhyphenated"
    first = codec.encode([text])
    assert codec.old and not codec.young and all(isinstance(x, bytes) for x in codec.old.values())
    assert codec.encode([text]) == first
    assert b"".join(first[0][1]).decode() == text


def test_a_share_makes_cache_batches_and_slices_smaller(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 8)
    monkeypatch.setattr(bpe, "SLICE_ROWS", 4000)
    monkeypatch.setattr(bpe, "NEW_PIECES", 8)
    whole, part = (bpe.Codec(PATH, public_tokenizers.PATTERN, share=s) for s in (1, 4))
    steps: list[int] = []
    contract = part._contract
    part._contract = lambda pieces, long: steps.append(len(pieces)) or contract(pieces, long)
    texts = ["one two three four", "=" * 500 + " x"]
    for text in texts:
        assert part.encode([text]) == whole.encode([text])
    assert max(steps) == 2 and not whole.old and len(part.old) > 2
    got = bpe.token_digests(frame(spark), PATH, share=1000).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *brute(r[1])) for r in awkward_rows())
