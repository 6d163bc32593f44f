"""Vocabulary files of public tokenizers, read on the driver only (a few MB) and sent to the tasks as a broadcast variable."""

from __future__ import annotations

import base64

#: Folder of the vocabulary files; every reader takes another one as a parameter.
TOKENIZERS = "/opt/tokenizers"


def ranked_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file (base64 piece and rank on each line), in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(p) for p, _ in sorted(pairs, key=lambda x: int(x[1]))]


def word_pieces(pieces: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """(first, inner) pieces: those written with a leading blank begin a word, the others continue one.

    Single bytes are in both, so that every word has pieces.
    """
    single = [p for p in pieces if len(p) == 1]
    return [*single, *(p[1:] for p in pieces if p[:1] == b" " and len(p) > 1)], [p for p in pieces if p[:1] != b" " or len(p) == 1]


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(raw: bytes):
    """(field number, value) of a protocol buffer message: integers, or bytes for lengths and fixed numbers."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        elif key & 7 == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


def model_pieces(path: str) -> list[tuple[str, int]]:
    """(piece, type) by id of a SentencePiece model file; types: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece.get(1, b"").decode(), piece.get(3, 1)))
    return out
