"""The prefix coder against the tokenizers library, id for id."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from headwater.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def same(library, text):
    theirs = library.encode(text, add_special_tokens=False).ids
    ours = bpe.coder(PATH).encode(text)
    assert ours == theirs and bpe.coder(PATH).decode(ours) == library.decode(theirs, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    same(LIBRARY, text)


def test_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own = bpe.coder(PATH)
    for s in range(0, len(points), 50_000):
        texts = [f"a{c}b" for c in points[s : s + 50_000]]
        assert [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != e.ids] == []


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 200_000, "é" * 50_000, "word " * 50_000])
def test_long_runs(library, text):
    same(library, text)


def test_made_texts(library):
    rng = random.Random(3)
    pool = "abcdeiou tnrs  '\"0123-.,!?éüßΣσςİıſK中文한😀👍́‍ \x00\x1c\x85\t\n<|>_"
    for _ in range(3000):
        same(library, "".join(rng.choice(pool) for _ in range(rng.randint(0, 50))))
    for k in range(1, 60):
        same(library, "a" * k + " " + "ab" * k + " " + "!" * k)
    same(library, "x<|endoftext|>y <|startoftext|>Z <|ENDOFTEXT|> it's WE'LL")


def test_compatibility_is_what_merging_says():
    own, rng = bpe.coder(PATH), random.Random(1)
    ids = [i for i in own.token_of if i < 49406 and not own.token_of[i].endswith("</w>")]
    for _ in range(400):
        a, b = rng.choice(ids), rng.choice(ids)
        word = own.token_of[a] + own.token_of[b] + "q"
        inner = own.encode_word(word)
        if inner[:2] == [a, b]:
            assert own.apart(a, b)


def test_query_equals_the_library(spark, sf_dir, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op4_prefix_bpe(spark, sf_dir).collect():
        ids = library.encode(rows[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(awkward, nothing, library):
    for r in bpe.encode_texts(awkward).collect():
        assert isinstance(r["ids"], list)
    found = {(r["doc_id"], r["n_tokens"]) for r in bpe.encoding_digests(awkward).collect()}
    assert (1, 0) in found and (2, 0) in found and (3, 0) in found
    assert bpe.encoding_digests(nothing).isEmpty()
    assert bpe.encoding_digests(awkward).count() == 11
    clash = awkward.selectExpr("*", "lang AS ids", "n_chars AS id", "source AS decoded")
    assert bpe.encode_texts(clash).columns == ["doc_id", "ids", "decoded"] and bpe.encode_texts(clash).count() == 11


def test_full_word_table_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    own = bpe.PrefixCoder(PATH)
    assert own.encode("one two three four five six one") == bpe.coder(PATH).encode("one two three four five six one") and len(own.words) <= 3 and len(own.fits) <= 5
    assert not any(len(w) > bpe.CACHE_WORD for w in own.words) and own.encode("x" * 90) == bpe.coder(PATH).encode("x" * 90)
