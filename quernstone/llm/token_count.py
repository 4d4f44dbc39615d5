"""Token counts of whole texts: batches go through a tokenizer library in Arrow functions that return lengths only.

Nothing is shuffled: a task reads its share of the files, which Spark deals by bytes. Within a task texts are cut into pieces at
safe boundaries, where the count of a whole is the sum of its pieces' counts, and pieces go to the library in batches of BATCH
bytes, so neither a long text nor many short ones make a large call. What a boundary is depends on what the tokenizer does
with white space:

- DROPPED (word vocabularies whose splitter removes white space): every run of ASCII white space. Pieces are words, and a task
  remembers the lengths of the short ones it has seen, KNOWN of them at most, so a frequent word is encoded once.
- LEADS (byte-level vocabularies whose words carry the space before them): before a space between two ASCII letters or digits.
- PREFIXED (SentencePiece models that put a space before every text): at such a space, which is left out, as the model puts it back.

LEADS and PREFIXED cut texts of more than PIECE bytes only. A stretch without a boundary stays whole, however long.

The vocabulary file is read on the driver and broadcast; LARGEST bytes are its bound. No begin, end or added special tokens, no
truncation or padding; special strings inside texts are what the library makes of them by default (boundaries never lie within one,
as they hold no white space).

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and null keys are counted each by itself; an empty table
gives no rows; columns of any name can be kept.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import map_text, table

DROPPED, LEADS, PREFIXED = "dropped", "leads", "prefixed"
#: Bytes of a piece that is cut further, of a call of the library, of a word that is remembered; words remembered; bytes of a vocabulary file.
PIECE, BATCH, SHORT, KNOWN, LARGEST = 64 << 10, 256 << 10, 48, 1 << 19, 256 << 20
#: Tokens beyond which a text is over the limit of a training window.
LIMIT = 2048
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")

_BETWEEN = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def cut(text: bytes, boundary: str, most: int = PIECE) -> list[bytes]:
    """Pieces of a text whose counts sum to its own."""
    if boundary == DROPPED:
        return text.split()
    out, begin = [], 0
    while len(text) - begin > most:
        place = _BETWEEN.search(text, begin + most)
        if not place:
            break
        out.append(text[begin : place.start()])
        begin = place.end() if boundary == PREFIXED else place.start()
    return [*out, text[begin:]]


def batches_of(pieces: list[bytes], most: int = BATCH):
    """Runs of pieces of about most bytes each; a longer piece stands alone."""
    ends = np.cumsum([len(p) + 1 for p in pieces])
    i = 0
    while i < len(pieces):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield pieces[i:j]
        i = j


@lru_cache(2)
def _lengths(content: bytes, sentencepiece: bool):
    """Token counts of a batch of texts by the library that reads the vocabulary."""
    if sentencepiece:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(content)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


class Counter:
    """Counts tokens of texts with one vocabulary; remembers short words where white space is dropped."""

    def __init__(self, content: bytes, sentencepiece: bool, boundary: str):
        self.lengths, self.boundary, self.known = _lengths(content, sentencepiece), boundary, {}

    def encode(self, pieces: list[bytes]) -> list[int]:
        return [n for part in batches_of(pieces) for n in self.lengths([p.decode("utf-8", "replace") for p in part])]

    def count(self, texts: list[bytes]) -> list[int]:
        parts = [cut(t, self.boundary) for t in texts]
        if self.boundary != DROPPED:
            found = iter(self.encode([p for ps in parts for p in ps]))
            return [sum(next(found) for _ in ps) for ps in parts]
        known = self.known if len(self.known) < KNOWN else {}
        new = list({p for ps in parts for p in ps if p not in known})
        known.update(zip(new, self.encode(new), strict=True))
        out = [sum(map(known.__getitem__, ps)) for ps in parts]
        for p in new:
            if len(p) > SHORT:
                del known[p]
        self.known = known
        return out


def token_counts(docs: DataFrame, path: str = WORD_FILE, boundary: str = DROPPED, text: str = "text", keep=("doc_id",), flat: bool = True) -> DataFrame:
    """The columns of keep, and out: struct of n_bytes (UTF-8) and n_tokens by the vocabulary file (.json or .model) at path on the driver."""
    with open(path, "rb") as f:
        content = f.read(LARGEST + 1)
    if len(content) > LARGEST:
        raise ValueError(f"{path} is larger than {LARGEST} bytes")
    shared, sentencepiece = docs.sparkSession.sparkContext.broadcast(content), path.endswith(".model")
    counters: list[Counter] = []  # one for each task, which unpickles its own list

    def lengths(data, offs):
        if not counters:
            counters.append(Counter(shared.value, sentencepiece, boundary))
        whole, n = data.tobytes(), np.diff(offs)
        counts: list[int] = []
        # texts of about 1 MB at a time, so that their words are not all in memory
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), side="right")) - 1)
            counts += counters[0].count([whole[a:b] for a, b in zip(offs[at:to].tolist(), offs[at + 1 : to + 1].tolist(), strict=True)])
            at = to
        return [n, np.array(counts, np.int64)]

    return map_text(docs, lengths, "n_bytes long, n_tokens long", text, keep, flat)


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "out.n_bytes", "out.n_tokens", (F.col("out.n_tokens") > LIMIT).alias("over_limit"))
