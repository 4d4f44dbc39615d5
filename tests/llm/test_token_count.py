"""Counts by pieces against the libraries on whole texts."""

import random

import public_tokenizers
import pytest
from quernstone.llm import token_count
from quernstone.llm.token_count import DROPPED, LEADS, PREFIXED

ODD = [None, "", " ", "\n\n", "a", "it's  they'll<|endoftext|>don't <|startoftext|> x", "x\x1cy \x85z w v", "é ́e  é", "İSTANBUL ΣΑΣ ΣΑΣ", "１２３ 12345 ½", "한국어 텍스트", "🙂🙂 👩‍👩‍👧", "�\u0000x"]


def sample():
    rng = random.Random(4)
    letters = ["a", "B", "é", "é", "ñ", "中", "文", "9", " ", " ", "  ", "\n", "\t", ".", "'s", "-", "🙂", " ", "<|endoftext|>", "the ", "word"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.choice([3, 30, 300]))) for _ in range(150)]
    return texts + ["long words and 42 numbers " * 9000, "unbroken" * 20000, "中文" * 9000 + " end of it"]


def whole(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts], num_threads=1)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "boundary"), [("word_bpe_49k.json", DROPPED), ("word_bpe_49k.json", LEADS), ("byte_bpe_50k.json", LEADS), ("piece_bpe_32k.model", PREFIXED)])
@pytest.mark.parametrize("most", [1, 40, token_count.PIECE])
def test_pieces_sum_to_the_whole(name, boundary, most, monkeypatch):
    monkeypatch.setattr(token_count, "BATCH", 4000)
    texts = sample()
    with open(public_tokenizers.path(name), "rb") as f:
        counter = token_count.Counter(f.read(), name.endswith(".model"), boundary)
    counter_cut = token_count.cut
    monkeypatch.setattr(token_count, "cut", lambda t, b: counter_cut(t, b, most))
    assert counter.count([(t or "").encode() for t in texts]) == whole(name, texts)


def test_query_on_edge_rows(spark, folder, rows):
    texts = sample() + ["word " * 2048, "word " * 2049]
    docs = [*enumerate(texts), (5, "repeated row"), (5, "repeated row"), (None, "no key")]
    path = folder(docs)
    counts = whole("word_bpe_49k.json", [t for _, t in docs])
    want = [{"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 2048} for (i, t), n in zip(docs, counts, strict=True)]
    assert rows(token_count.op12_token_count(spark, path)) == sorted(want, key=repr)
    assert [r["over_limit"] for r in sorted(want, key=lambda r: (r["doc_id"] is None, r["doc_id"])) if r["doc_id"] in (len(texts) - 2, len(texts) - 1)] == [False, True]


def test_kept_columns_may_clash_and_tables_may_be_empty(spark, folder):
    docs = spark.read.parquet(folder([(1, "a b c")]) + "/documents.parquet")
    got = token_count.token_counts(docs, keep=("out", "keep", "text"), flat=False).collect()
    assert [(r.keep.c0, r.keep.c1, r.keep.c2, r.out.n_bytes, r.out.n_tokens) for r in got] == [("x", 1, "a b c", 5, 3)]
    assert token_count.token_counts(docs.limit(0)).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_count, "KNOWN", 3)
    with open(token_count.WORD_FILE, "rb") as f:
        counter = token_count.Counter(f.read(), False, DROPPED)
    texts = ["one two three four", "two five", "x" * 100 + " two", "six seven two"]
    assert [counter.count([t.encode()])[0] for t in texts] == whole("word_bpe_49k.json", texts)
    assert not any(len(w) > token_count.SHORT for w in counter.known)
