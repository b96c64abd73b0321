import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path(bpe.VOCABULARY)
    return bpe.WordTokenizer(path), Tokenizer.from_file(path)


def check(both, text):
    own, public = both
    want = public.encode(text, add_special_tokens=False).ids
    raw, decoded = own.encode_bytes(text)
    assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == want
    assert decoded.decode() == public.decode(want, skip_special_tokens=False) == own.decode(want)


@pytest.mark.parametrize("text", ["", "Hello, World's 123!", "<|endoftext|> x <|startoftext|>y", "ha<|endoftext|>ha", "<|ENDOFTEXT|>", "a" * 3000, "ΣΑΣ İ ǅ ﬁ é 가", "a\x1cb\x85c d　e​f", "\U0001f44d\U0001f3fd 漢字 ½²①"])
def test_known_texts(both, text):
    check(both, text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(both, text):
    check(both, text)


@given(st.text(alphabet="abehinost' ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_wordlike_text(both, text):
    check(both, text)


def test_token_mixtures(both):
    rng = random.Random(3)
    names = [n.replace("</w>", "") for n in json.load(open(public_tokenizers.path(bpe.VOCABULARY)))["model"]["vocab"]]
    for _ in range(400):
        check(both, "".join(rng.choice(names) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 10))))


def test_query_on_documents(spark, sf_dir, both):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    public = both[1]
    for row in bpe.op9_bpe(spark, sf_dir).collect():
        ids = public.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest()
