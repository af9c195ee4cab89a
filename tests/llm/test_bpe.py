import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm.bpe import TreeEncoder, decode_frame, encode_frame, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = TreeEncoder(PATH, P.PATTERN, leaf=5, window=2)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab '\n\t  .,123é漢🙂\xa0　\x1c\x85"), st.characters(codec="utf-8")), max_size=80))
def test_tree_equals_the_library(text):
    ids = SMALL.encode(text)
    assert ids == OWN.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000 + "x", "\n" * 999, "don't " * 500, "x" + " " * 500])
def test_runs_longer_than_a_piece(text):
    assert SMALL.encode(text) == OWN.encode_ordinary(text)


def test_round_trip_of_odd_rows(spark, docs, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(docs, PATH, P.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, t or "", OWN.encode_ordinary(t or "")) for i, t, _ in rows]
    assert got == sorted((i is None, i or 0, len(x), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, t, x in ids)


def test_frames_encode_and_decode(spark, docs, rows, empty):
    decoded = decode_frame(encode_frame(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in decoded) == sorted((t or "").encode() for _, t, _ in rows)
    assert encode_frame(empty, PATH, P.PATTERN).count() == round_trip(empty, PATH, P.PATTERN).count() == 0


def test_long_random_text():
    r = random.Random(0)
    text = "".join(r.choice(["word", "é", " ", "  ", "\n", "12", "'s", "!"]) for _ in range(20000))
    assert TreeEncoder(PATH, P.PATTERN, leaf=100).encode(text) == OWN.encode_ordinary(text)
