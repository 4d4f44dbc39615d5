import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quernstone.llm import byte_bpe as B


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(B.RANK_FILE), special_tokens={})


def expected(enc, text):
    raw = np.array(enc.encode_ordinary(text or ""), "<u4").tobytes()
    return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def samples():
    rng = random.Random(2)
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "it's don't WE'LL 's", "x" * 700, "ab" * 400 + " é" * 90, "日本語のテキスト 123 ٣٤", "a  b\n\n c \t d", "e\x85f\xa0g h\x1ci", "<|endoftext|> \U0001f600\U0001f468‍\U0001f469", "́combining", "…", "a\r\nb", "1234567890" * 30]
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "é", "ß", "7", "42", "!", "--", "\t", "語", "\U0001f600", " "]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return texts


def test_against_the_library(spark, folder, reference, monkeypatch):
    monkeypatch.setattr(B, "GROUP", 1500)  # several groups and buckets
    monkeypatch.setattr(B, "BUCKET", 900)
    monkeypatch.setattr(B, "BLOCK", 400)
    texts = samples()
    texts += texts[-2:]
    path = folder(list(enumerate(texts)) + [(5, texts[5]), (5, texts[5]), (None, "no key"), (None, None)])
    got = B.op7_byte_bpe(spark, path).collect()
    assert len(got) == len(texts) + 4
    for r in got:
        text = "no key" if r.doc_id is None and r.n_tokens else None if r.doc_id is None else texts[r.doc_id]
        assert tuple(r)[1:] == expected(reference, text), repr(text)


def test_long_merges_agree_with_the_library(reference):
    ranks = B.read_ranks(B.RANK_FILE)
    rng = random.Random(4)
    for n in (1, 2, 201, 999):
        word = "".join(rng.choice("abcdeiounst") for _ in range(n))
        assert B.merge_long(word.encode(), ranks) == reference.encode_ordinary(word)


def test_pieces_as_the_pattern_gives_them():
    import regex

    for t in samples():
        assert B.pieces((t or "").encode()) == [p.encode() for p in regex.findall(public_tokenizers.PATTERN, t or "")]
    for c in range(128):
        t = f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1 'll{chr(c)}"
        assert B.pieces(t.encode()) == [p.encode() for p in regex.findall(public_tokenizers.PATTERN, t)]


def test_segments_cut_between_pieces_only():
    import regex

    texts = [t or "" for t in samples()] + [f"a{c} b {c}c{c}{c} " for c in "\x1c\x85\xa0\u1680\u2003\u200a\u2028\u202f\u205f\u3000\u200b\ufeff"]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    cut = [*B.segments(data, offs).tolist(), len(data)]
    got = [w for a, b in zip(cut[:-1], cut[1:], strict=True) for w in B.pieces(data[a:b].tobytes())]
    assert got == [p.encode() for t in texts for p in regex.findall(public_tokenizers.PATTERN, t)]


def test_empty_table_and_stage(spark, folder, reference):
    assert B.op7_byte_bpe(spark, folder()).count() == 0


def test_stage_round_trip(spark, folder, reference):
    path = folder([(1, "some text"), (2, None)])
    got = {r.doc_id: r for r in B.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    assert np.frombuffer(got[1].ids, np.uint32).tolist() == reference.encode_ordinary("some text")
    assert got[2].n_tokens == 0 and got[1].lang == "en"
