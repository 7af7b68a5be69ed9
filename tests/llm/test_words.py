import hashlib

import numpy as np
import pytest

from mercata.llm.bpe import encode_and_decode
from mercata.llm.near_dedup import near_dedup
from mercata.llm.token_files import read_token_files, scratch_dir, write_token_files
from mercata.llm.words import SpanHasher


def thue_morse(n: int, zero: str, one: str) -> str:
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


PAIRS = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (16, 64, 256, 2048) for a, b in ("ab", "xy", "k7")]


def hashes(words, **kw):
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return SpanHasher(**kw)(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def test_words_that_cancel_differ():
    words = [w for pair in PAIRS for w in pair]
    assert len(set(hashes(words).tolist())) == len(set(words))


def test_hash_depends_on_the_span_alone():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcXYZ019é"), n)) for n in (*range(1, 90), 500) for _ in range(3)]
    got = hashes(words)
    assert [hashes([w])[0] for w in words] == got.tolist()
    assert hashes([*words[::-1]]).tolist() == got[::-1].tolist()
    assert len(set(got.tolist())) == len(set(words))
    assert hashes(["Word\x01"]) != hashes(["word\x01"]) and hashes(["Word\x01"], lower=True) == hashes(["word\x01"], lower=True)
    assert hashes(["a" * 100], key=1) != hashes(["a" * 100], key=2) and hashes(["a"], key=1) != hashes(["a"], key=2)
    assert hashes(["a"]) != hashes(["a\0"])  # the length counts, not only the filled block


def test_empty_spans():
    none = np.zeros(0, np.int64)
    assert len(SpanHasher()(np.zeros(0, np.uint8), none, none)) == 0


@pytest.fixture(scope="module")
def twins(spark):
    return spark.createDataFrame([(2 * i + k, pair[k]) for i, pair in enumerate(PAIRS) for k in (0, 1)], "doc_id long, text string").coalesce(1)


def test_near_dedup_links_no_twins(twins):
    assert all(r.component_id == r.doc_id and r.kept for r in near_dedup(twins).collect())


def test_bpe_gives_every_twin_back(twins):
    import public_tokenizers

    got = {r.doc_id: r.decoded_sha256 for r in encode_and_decode(twins, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in twins.collect()}


def test_token_files_hold_every_twin(spark, twins):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids_crc32 for r in read_token_files(write_token_files(twins, path, scratch_dir(spark))).collect()}
    assert got == {r.doc_id: zlib.crc32(np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in twins.collect()}
