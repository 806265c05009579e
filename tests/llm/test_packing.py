import random
import zlib

import numpy as np

from quotemill.llm.packing import _Chunks, binary_lengths, pack, tokenizer_file


def test_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t, chunks, rnd = Tokenizer.from_file(tokenizer_file()), _Chunks(tokenizer_file()), random.Random(5)
    pieces = ["don't", "We'll", "ÀÉß", "é", "é", " ", "\x1c", "\x85", " ", "\n\n", "\t", "12", "a1b", "...", ",", "!?", "<|endoftext|>", "ﷺ", "你好", "Hello", "WORLD's", "İ", "ΟΔΟΣ", "µ", "ª", " ", "🙂", "x-y", "́", "“q”"]
    for _ in range(1500):
        text = "".join(rnd.choice(pieces) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(9)))
        assert np.frombuffer(chunks.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_rebuild_every_document(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "no id"), (5, "long word " * 5000), (1, "one two three")]
    df = spark.createDataFrame([(i, x, "e") for i, x in rows], "doc_id long, text string, length string")
    got = pack(df).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length == len(r.ids) <= 4096 and r.length & (r.length - 1) == 0 for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        times = rows.count((doc_id, text))
        assert sum(r.length for r in mine) == times * len(ids) and {r.doc_tokens for r in mine} == {len(ids)}
        for r in mine:
            assert list(r.ids) == ids[r.start : r.start + r.length]
    assert pack(df.limit(0)).count() == 0


def test_binary_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 8191, 10000):
        found = binary_lengths(n)
        assert sum(found) == n and all(x & (x - 1) == 0 for x in found) and len(found) <= n // 4096 + 12
