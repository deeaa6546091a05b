import base64
import random

import public_tokenizers
import pytest
import tiktoken

from eventloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "Hello, world! It's 2024; don't  stop.\n\n\tTabs", "été Straße ñandú 日本語 العربية 🙂🙂 a\u0301", "a" * 1000, "ab" * 777, " " * 50, "\x00\x1c\x1d\x85\xa0\u2028x",
    "<|endoftext|>", "aaaa aaa aa a", "the" * 300, "0" * 37 + "١٢٣", "\r\n\r\n", "x" * 20_000 + "y",
]


def test_ids_and_round_trip_equal_the_library(frame, library):
    rng = random.Random(8)
    alphabet = "abcdeé ß'\n\t.,!?019ÅÄ日🙂\x1c\xa0"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (500, None), (7, texts[7])]
    encoded = bpe.encode(frame(docs, "doc_id BIGINT, text STRING"), RANKS, public_tokenizers.PATTERN)
    out = bpe.decode(encoded, RANKS).collect()
    want = sorted((str(i), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in docs)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in out) == want


def test_replay_equals_single_word_merging():
    with open(RANKS, "rb") as f:
        ranks = bpe.tables(f.read())
    rng = random.Random(1)
    words = [bytes(rng.choice(b"aabetnos \xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(2000)] + [b"a" * n for n in range(1, 60)]
    ids, firsts = bpe.replay(words, ranks)
    for w, word in enumerate(words):
        assert ids[firsts[w]:firsts[w + 1]].tolist() == ranks.merge_one(word)


def test_a_merge_that_makes_an_earlier_pair():
    """Ranks in which merging one pair makes a pair of lower rank: words are merged again in their own order."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab c", b"cabc"]
    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    ranks = bpe.Ranks(raw)
    words = [b"abc", b"bcabc", b"abcabcbc", b"cabcabc"]
    ids, firsts = bpe.replay(words, ranks)
    assert [ids[a:b].tolist() for a, b in zip(firsts, firsts[1:])] == [ranks.merge_one(w) for w in words]


def test_other_columns_empty_table_and_null_ids(frame, spark):
    docs = frame([(1, "a b", "x", 2.5)], "doc_id INT, text STRING, _text STRING, ids DOUBLE")
    out = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "_text", "ids"] and out.first()["_text"] == "x"
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k INT, ids ARRAY<INT>")
    assert [bytes(r.decoded) for r in bpe.decode(nulls, RANKS).collect()] == [b"", b""]


def test_decoding_in_the_same_pass(frame):
    docs = frame([(i, t, b"x") for i, t in enumerate([*TEXTS, None])], "doc_id BIGINT, text STRING, decoded BINARY")
    once = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    twice = bpe.decode(bpe.encode(docs.drop("decoded"), RANKS, public_tokenizers.PATTERN), RANKS)
    key = lambda r: r.doc_id
    assert sorted(once.collect(), key=key) == sorted(twice.collect(), key=key)
    assert all(bytes(r.decoded) == ([*TEXTS, None][r.doc_id] or "").encode() for r in once.collect())
