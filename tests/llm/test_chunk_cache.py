"""The cache of chunk ids gives the library's ids when it is full too, and keeps what it met last."""

import public_tokenizers
from tokenizers import Tokenizer

from corpusmill.llm.pretokens import ChunkIds
from corpusmill.llm.queries import BYTE_BPE


def test_a_full_cache(monkeypatch):
    path = public_tokenizers.path(BYTE_BPE)
    whole, small = Tokenizer.from_file(path), ChunkIds(path, 12)
    texts = ["often word, señor.\nNext often", "often Größe zwei$$$ end.\nZwei, often 中文 often", "a  b\n\nc often's x1 often <s> often", *(f"often new{c}, new{c} often" for c in "abcdefghij")]
    for text in texts * 2:
        ids = memoryview(small.ids(text)).cast("I").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids
    small.ids("often " * 2 + " ".join(f"word{c}" for c in "klmnop"))
    # a full cache is not forgotten at once: what it met last is not encoded anew
    assert len(small) <= 6 and len(small.before) == 6
    known = next(c for c in small.before if c not in small)
    monkeypatch.setattr(small, "word", None)
    monkeypatch.setattr(small, "encoded", None)
    assert small[known] == small.before.get(known, small[known])
