import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemora.llm.token_files import TokenFiles, WordTokenizer, read_token_files, word_tokenizer, write_token_files

PATH = P.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WORDS = WordTokenizer(PATH, most=50, most_plain=20, longest=12)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abAB '\n\t  .,123éÉçΣς漢🙂\xa0́<|>"), st.characters(codec="utf-8")), max_size=60))
def test_words_equal_the_library(text):
    texts = [text, f"{text} <|endoftext|> Don't,stop. ÉÉ, {text}"]
    assert [x.tolist() for x in WORDS(texts)] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def test_files_hold_every_document_in_order(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}/set"
    write_token_files(docs, word_tokenizer(PATH), 1, 49408, folder, parts=3)
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [r[0] for r in sorted(rows, key=key)]
    want = {}
    for i, t, _ in rows:
        ids = np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for i, start, n, crc in got:
        assert start == at
        want[i].remove((n, crc))
        at += n
    files = TokenFiles(folder)
    assert files.dtype == np.uint16
    ids = [np.asarray(x) for p in files.parts for _, _, x in files.documents(p["part"])]
    assert sum(map(len, ids)) == at and all(x[-1] == 1 for x in ids)


def test_empty_table_and_wide_ids(spark, empty, docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert write_token_files(empty, word_tokenizer(PATH), 1, 49408, folder) == []
    assert read_token_files(spark, folder).count() == 0
    write_token_files(docs.limit(5), lambda: lambda texts: [np.array([70000 + len(t)]) for t in texts], 2, 80000, f"file://{tmp_path}/wide", parts=1)
    assert TokenFiles(f"file://{tmp_path}/wide").dtype == np.uint32
