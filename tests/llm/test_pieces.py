"""Parity is decided on whole texts: a wrong normaliser or a wrong piece falls back to the original library."""

from __future__ import annotations

import os

import pytest

from tidemark.llm import pieces, queries

TEXTS = ["two  blanks here", "", None, " lead", "plain", "é 日本 😀", "a\u0000b", "plain"]


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(queries.PIECE_MODEL):
        pytest.skip("the model is not here")
    with open(queries.PIECE_MODEL, "rb") as f:
        return f.read()


def test_ids_are_the_rebuilt_models(model, monkeypatch):
    encoder = pieces.Encoder(model, 2)
    want = [encoder.original.encode(t or "") for t in TEXTS]

    def refused(*_, **__):
        raise AssertionError("a text at parity is not encoded by the original library")

    monkeypatch.setattr(encoder, "original", type("Only", (), {
        "normalize": encoder.original.normalize, "encode": staticmethod(refused)})())
    ids, parity = encoder.encode(TEXTS)
    assert [i.tolist() for i in ids] == want and all(parity)


def test_a_wrong_normaliser_is_seen(model, monkeypatch):
    encoder = pieces.Encoder(model, 2)
    right = encoder.normalised
    monkeypatch.setattr(encoder, "normalised", lambda t: right(t.replace("  ", " ")))
    ids, parity = encoder.encode(TEXTS)
    assert parity == [False] + [True] * 7
    assert [i.tolist() for i in ids] == [encoder.original.encode(t or "") for t in TEXTS]


def test_a_wrong_piece_is_seen(model, monkeypatch):
    encoder = pieces.Encoder(model, 2)
    swapped = pieces.PieceModel.parse(model)
    swapped.scores = list(reversed(swapped.scores))
    monkeypatch.setattr(encoder, "backend", swapped.backend())
    ids, parity = encoder.encode(["a plain sentence with several words", ""])
    assert parity == [False, True]
    assert ids[0].tolist() == encoder.original.encode("a plain sentence with several words")
