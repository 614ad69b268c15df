import base64
import hashlib
import random
import time

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from echosieve.llm.bpe import Coder, encode_decode  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "\n\n  \t x", "it's we'll I'd", "a" * 5000, "ab" * 3000, "é日本 123456 !!!???", "<|endoftext|>", "x\x1cy\x85z w", "Straße\r\n ", "😀😀 ok"]
    out += ["".join(chr(rng.choice([*range(256)] * 3 + [0x152, 0x2014, 0x2019])) for _ in range(300)) for _ in range(30)]
    out += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    out += ["".join(rng.choice("aab") for _ in range(rng.randrange(60, 900))) for _ in range(20)]  # long words with runs
    out += ["".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "".join(rng.choice("ethe ") for _ in range(300_000))]
    out += ["".join(chr(rng.randrange(32, 0x2FF)) for _ in range(200)) for _ in range(20)]
    return out


def test_equals_tiktoken_and_round_trips(spark, reference):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, ids int, word string")
    got = {r["doc_id"]: r for r in encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i]["ids"] == " ".join(map(str, ids)), (i, t)
        assert got[i]["n_tokens"] == len(ids)
        assert bytes(got[i]["decoded"]).decode() == (t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(got[i]["ids"].encode()).hexdigest()


def test_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=False).collect()}
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert encode_decode(docs.where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_forgotten_words_come_back():
    c = Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, generation=3)
    for words in (["hello", " world", "hello"], ["abc", " def", " xyz", "hello"], ["hello", "q"], [" world"]):
        ids, decoded = c.encode(pa.array(words))
        assert ids.to_pylist() == [c.known[w] for w in words] and decoded.to_pylist() == [w.encode() for w in words]


@pytest.mark.parametrize("block, stride, wide", [(128, 64, 1024), (12, 6, 24), (8, 4, 8)])
def test_long_words_join_from_blocks(reference, monkeypatch, block, stride, wide):
    """Small blocks often share no token, so that they grow and go alone in several queries."""
    from echosieve.llm import bpe

    for name, value in (("BLOCK", block), ("STRIDE", stride), ("WIDE", wide), ("STEPS", 2000)):
        monkeypatch.setattr(bpe, name, value)
    c, rng = Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(3)
    words = ["".join(rng.choice(x) for _ in range(rng.randrange(65, 700))) for x in ("abcdefghtheing", "aab", "a", "-=", "é日ab") for _ in range(4)]
    words += ["x" * 65, "y" * 64, "-" * 300, "the" * 90, "=" * 129 + "-" * 192]
    words += ["internationalization" * 9, "a" * 127 + "b" * 130]
    c._learn(words)
    assert not c.odd
    for w in words:
        assert c.known[w] == " ".join(map(str, reference._core_bpe.encode_single_piece(w.encode()))), w


def test_a_word_of_a_million_letters(reference):
    """Ends within a minute (a few seconds here); contracted as a whole it took hours."""
    rng, start = random.Random(8), time.monotonic()
    word = "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(1_000_000))
    c = Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    c._learn([word])
    spent = time.monotonic() - start
    assert c.known[word] == " ".join(map(str, reference.encode_ordinary(word))) and spent < 60


def test_repeated_rows_and_other_columns(spark):
    """Repeated rows give repeated rows; columns named like the operator's own don't disturb it."""
    df = spark.createDataFrame([(1, "a b", "q", 5), (1, "a b", "q", 5), (None, "a b", None, 6)], "doc_id long, text string, ids string, n_tokens int")
    rows = encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [r["n_tokens"] for r in rows] == [2, 2, 2] and sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert len({r["ids"] for r in rows}) == 1 and "q" not in rows[0]["ids"]


def test_latin_split_equals_the_pattern():
    import regex

    from echosieve.llm.bpe import splitter

    every, rng = regex.compile(P.PATTERN).findall, random.Random(9)
    split = splitter(P.PATTERN)
    for n in range(3000):
        text = "".join(chr(rng.randrange(256)) if rng.random() < 0.5 else rng.choice(" '\tsdlva1\n") for _ in range(rng.randrange(30)))
        assert split(text) == every(text)
    for pattern in (r"\d+|\D", r"(?i:a)|[^a]", r"[\S]"):
        assert splitter(pattern)("aA 1") == regex.compile(pattern).findall("aA 1")
