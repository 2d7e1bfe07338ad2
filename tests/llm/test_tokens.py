import random

import pytest
from made_texts import prose
from loomwork.llm import tokens

public = pytest.importorskip("public_tokenizers")
PARTS = ["a", "b", " ", "  ", "\n", "'", "ll", "re", "é", "漢", "<|endoftext|>", "<|endo", "9", "...", "😀", "'l", " " * 30, "x" * 50, "\t", "́", " "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(tokens.TOKENIZER))


def texts(n=800):
    draw = random.Random(1)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 256), (64, 8), (40, 4), (200, 16)])
def test_counts_equal_the_library(library, chunk, overlap):
    counter = tokens.PieceCounter(public.path(tokens.TOKENIZER), public.PATTERN, chunk, overlap)
    some = texts()
    assert [counter(t) for t in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_huge_texts(library):
    counter = tokens.PieceCounter(public.path(tokens.TOKENIZER), public.PATTERN, 1000, 16)
    for text in (prose(1, 50_000), " " * 30_000, "x" * 30_000, "1" * 9000 + "\n" * 9000):
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rows(spark, docs_of, library):
    rows = [(1, "Hello <|endoftext|> world", "en", "s", "c"), (None, None, None, None, "c"), (2, "", "en", "s", "c"), (2, "", "en", "s", "c"), (3, "word " * 600, "en", "s", "c")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs_of(rows, ", n_tokens string")).collect())
    n = len(library.encode(rows[0][1], add_special_tokens=False).ids)
    assert got == [(0, 0, 0, False), (1, 25, n, False), (2, 0, 0, False), (2, 0, 0, False), (3, 3000, len(library.encode(rows[4][1]).ids), True)]
    assert tokens.count_tokens(docs_of([])).count() == 0
