"""What packing leaves with a worker."""

import public_tokenizers

from seamline.llm import packing


def test_a_task_leaves_few_pieces(monkeypatch):
    monkeypatch.setattr(packing, "LEFT", 3)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    import pyarrow as pa

    texts = pa.array(["one two three four five", "six two one"])
    before = [a.tolist() for a in words.encode(texts)]
    held = len(words.pieces)
    words.forget()
    assert held > 3 == len(words.pieces)
    assert [a.tolist() for a in words.encode(texts)] == before
