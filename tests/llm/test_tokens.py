import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from helixframe.llm.packing import TOKENIZER, _encoder, cut_documents

TEXTS = [
    "", "a", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "no end <|endoftext| > here", "<|ENDOFTEXT|>", "two  spaces <|endoftext|>\n\nline",
    "Plain text, it's 12345 words;\n\tnew\r\nline  and   more ", " lead", "ßé 漢字 🙂 x", "<|endoftext|>" * 3000,
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(str(public.path(f"{TOKENIZER}.json")))


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_the_tokenizer_file(whole, text):
    assert np.frombuffer(_encoder(TOKENIZER)(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces(spark, whole):
    out = cut_documents(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    for i, text in enumerate(TEXTS):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert sum(p[1] for p in pieces) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)
