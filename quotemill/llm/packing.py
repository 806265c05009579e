"""Packing by power-of-two decomposition.

A document of n tokens becomes n // 4096 pieces of 4096 tokens and one piece for each binary digit of the rest, longest
first. Pieces of one length make one bucket. Every piece is a sequence of its own: all lengths are powers of two, so
nothing is padded and no sequence crosses documents. The work is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import columns, lists, per_batch, tune

LONGEST = 4096
END_ID = 2
#: Chunks of text whose ids a worker keeps (about 200 bytes each); when full it starts anew.
REMEMBERED = 500_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Chunks(dict):
    """Little-endian ids of chunks of text without white space; a chunk is encoded when it is first met.

    The tokenizer drops white space before it cuts words, so a text's ids are its chunks' ids in a row. Plain Latin words
    go to the BPE model at once; every other chunk takes the tokenizer's whole way.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}  # a character for each byte

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join(map(self.shown.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(word)]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if plain := _PLAIN.fullmatch(chunk):
            ids = self._word(plain[1].lower())
            if plain[2]:
                ids = ids + self._word(plain[2])
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        self[chunk] = found = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # str.split() takes these for white space, the tokenizer doesn't
        return b"".join(map(self.__getitem__, _SPACE.split(text.strip(" \t\n\r\x0b\x0c")) if odd else text.split()))


@functools.cache
def _chunks(file: str | None) -> _Chunks:
    return _Chunks(file or tokenizer_file())


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n, none over `longest` (itself a power of two), longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (its length) and,
    unless with_ids is False, ids.

    `tokenizer` is a tokenizers file that every worker can read (by default that of the installed public tokenizers).
    Null and empty texts are one piece that holds the end id. Null ids stay null, repeated rows are packed each by
    themselves; an empty table gives an empty one and other columns play no part. sequence_id is unique, not dense.
    """
    tune(docs.sparkSession)

    def work(batches):
        encode = _chunks(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    piece = ids[4 * at : 4 * (at + length)]
                    for c, x in zip(out, (doc_id, at, length, zlib.crc32(piece), n, piece)):
                        out[c].append(x)
                    at += length
            pieces = out.pop("ids")
            yield out | ({"ids": lists([np.frombuffer(p, "<u4").astype(np.int32) for p in pieces], np.int32)} if with_ids else {})

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    found = per_batch(columns(docs, doc_id="long", text="string"), work, kind)
    found = found.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.col("length"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * with_ids)
