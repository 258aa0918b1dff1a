"""Reading SentencePiece model files without their library: pieces, scores and the few settings used."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

SPACE = "▁"
# Fixed values of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _messages(raw: bytes):
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    texts: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    unk_id: int = 0

    @property
    def byte_ids(self) -> list[int]:
        ids = [0] * 256
        for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)):
            if k == BYTE:
                ids[int(t[3:5], 16)] = i
        return ids


def parse(raw: bytes) -> PieceModel:
    model = PieceModel()
    plain = True
    for number, value in _messages(raw):
        if number == 1:
            piece = dict(_messages(value))
            model.texts.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            settings = dict(_messages(value))
            model.model_type = settings.get(3, UNIGRAM)
            model.byte_fallback = bool(settings.get(35, 0))
            model.unk_id = settings.get(40, 0)
        elif number == 3:
            settings = dict(_messages(value))
            model.dummy_prefix = bool(settings.get(3, 1))
            plain = not settings.get(2) and not settings.get(4, 1)
    if not plain or {USER_DEFINED, UNUSED} & set(model.kinds) or not model.byte_fallback:
        raise ValueError("only identity-normalised models with byte fallback and no user symbols are supported")
    if any(SPACE in t.lstrip(SPACE) for t, k in zip(model.texts, model.kinds, strict=True) if k == NORMAL):
        raise ValueError("a piece crosses a word boundary")
    return model


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """Tokenizer files are installed with the library on every machine; the path is a parameter."""
    with open(path, "rb") as f:
        return parse(f.read())
