import os
import random

import pytest

from ledgerloom.llm import tokens as tk

PATH = tk.DEFAULT_VOCABULARY
needs_files = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
TEXTS = [
    "", None, " ", "\n\n  \t", "Hello, world's end!", "<|endoftext|> as text", "中文 和 English 混排", "é" * 300 + "👩‍👩‍👧", "a" * 50000, "ab" * 3000, "0123 4567 x²½", "don't WE'LL I'm", " 　​", "tab\tnew\r\nline   end ",
]


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@needs_files
def test_merge_against_naive():
    bpe, rng = tk.ByteBPE(PATH), random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcethin 0\xc3\xa9\xe4") for _ in range(rng.randrange(1, 40)))
        assert tk.merge(piece, bpe.ranks) == naive(piece, bpe.ranks)


@needs_files
def test_same_as_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(PATH), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    bpe = tk.ByteBPE(PATH)
    for text in TEXTS:
        assert bpe.encode(text) == t.encode(text or "", add_special_tokens=False).ids


@needs_files
def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id int, text string, n_tokens string")
    ids = tk.encode(df, "text")
    back = {r.doc_id: (r.ids, r.again) for r in tk.decode(ids, "ids", name="again").collect()}
    assert {k: v[1] for k, v in back.items()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert back[0][0] == [] and back[1][0] == []
    counts = {r.doc_id: r.n_tokens for r in tk.count(df.drop("n_tokens"), "text").collect()}
    assert counts == {k: len(v[0]) for k, v in back.items()}
    assert tk.encode(df.limit(0), "text").count() == 0
