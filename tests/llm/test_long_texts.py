import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from plyframe.llm import chunks, packing, repeats, simhash


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(n))


def test_contexts_in_parts_hold_every_window_once():
    rng = random.Random(1)
    text = prose(rng, 3000) + " ab" * 500
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([0]), pa.array([text])], ["doc_id", "mark", "mark2", "text"])
    body = text.encode()
    for part in (1 << 22, 777):
        found = sorted((at, r["n"], r["name"], r["place"]) for b in repeats._contexts([batch], 200, part) for r in b.to_pylist() for at in r["at"])
        names, at = {}, 0
        for start, n, name, place in found:
            assert start == at
            for i in range(n):
                window = body[start + i : start + i + 200]
                assert names.setdefault(window, (name, place - i)) == (name, place - i)
            at += n
        assert at == len(body) - 199


def test_boundaries_in_parts_are_the_same():
    data = np.frombuffer(bytes(64) + prose(random.Random(2), 5000).encode() + bytes(64), np.uint8)
    assert chunks.boundaries(data).tolist() == chunks.boundaries(data, 501).tolist()


def test_fingerprints_in_parts_are_the_same():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 5, 50, 700):
        text = prose(rng, n) + rng.choice(["", " ", "\n\n"])
        assert {simhash.fingerprint(text, span=s) for s in (1, 7, 64, 1 << 20)} == {simhash.fingerprint(text)}
    assert simhash.fingerprint(" \n ") == simhash.fingerprint(None) == 0


def test_ids_in_parts_are_the_same(monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for text in (prose(random.Random(4), 400), " starts and ends with a space ", " ", "", "a" * 200 + " b"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
