import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mercata.llm.bpe import encode_and_decode, load_vocabulary, PrefixEncoder

from .conftest import EDGE_TEXTS, SF, file_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "Hello   world\n\n\tfoo", "<|endoftext|> a<|startoftext|>b", "a<|endoftext|><|endoftext|> b", "a\x1cb \x85 x\xa0y z \x1c q", "don't I'LL x's 12a3 ²³ ½ ªº",
    "ab" * 3000, "𝒳 😀👍🏽 ﬁ İ ı", "foo bar　baz", "  lead", "trail  ", "\n a \n b", "a​b ​ c", "\x00\x01\x7f", " " * 300, "=====  ----- ***",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def check(df, rows, library):
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) for r in encode_and_decode(df, PATH).collect())
    expect = []
    for i, text in rows:
        n, ids, back = want(library, text)
        expect.append((i or -1, n, ids, back, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(expect)


def test_table_equals_library(spark, library):
    check(spark.read.parquet(f"{SF}/documents.parquet"), file_rows("documents", ("doc_id", "text")), library)


def test_edges(edge_docs, library):
    check(edge_docs, EDGE_TEXTS, library)


def test_odd_and_random_texts(make_docs, library):
    rng = random.Random(5)
    parts = [" ", " ", "\n", "a", "th", "ing", "'s", "19", "é", ".", "\xa0", "　", "\x1c", "日", "😀", "<|endoftext|>", "|", "\t", "the ", "_"]
    rows = list(enumerate(ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)], 1))
    check(make_docs(rows), rows, library)


def test_empty_table(no_docs):
    assert encode_and_decode(no_docs, PATH).collect() == []


def merge_by_rank(piece, vocabulary):
    """Plain BPE: the first pair of the lowest rank, again and again."""
    ids = {t: i for i, t in enumerate(vocabulary["tokens"])}
    ranks = dict(zip(vocabulary["pairs"].tolist(), vocabulary["pair_rank"].tolist()))
    parts = [ids[bytes([b])] for b in piece]
    while True:
        found = [(ranks[a << 32 | b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a << 32 | b in ranks]
        if not found:
            return parts
        _, k = min(found)
        parts[k : k + 2] = [ids[vocabulary["tokens"][parts[k]] + vocabulary["tokens"][parts[k + 1]]]]


def test_prefix_encoder_equals_merging_by_rank():
    vocabulary = load_vocabulary(PATH)
    encoder = PrefixEncoder(vocabulary)
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"aeinrst hou") for _ in range(rng.randint(1, 25))) for _ in range(300)]
    pieces += [bytes(rng.randrange(256) for _ in range(12)) for _ in range(100)] + [b"aaaaaaaaaaaaaaaaaaaaa", b"x", b"abab" * 120, b""]
    ids, counts = encoder.encode(pieces)
    at = 0
    for piece, n in zip(pieces, counts.tolist()):
        assert ids[at : at + n].tolist() == merge_by_rank(piece, vocabulary)
        at += n
