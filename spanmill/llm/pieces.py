"""A SentencePiece vocabulary cut into chunks that no piece crosses.

Text is the model's own view: a dummy ``▁`` in front, spaces as ``▁``. No piece of such a vocabulary may contain a
letter next to a non-letter, or a ``▁`` after another character; ``Vocabulary`` proves that over all pieces before it
cuts there, so segmentations of chunks are independent of each other, and falls back to larger chunks otherwise.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

SPACE = "▁"
_COARSE = re.compile(r"▁*[^▁]+|▁+")
_NORMAL, _BYTE, _USER = 1, 6, 4


class Vocabulary:
    """Pieces with ids and scores, byte fallback, and the chunk pattern proven for them."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or any(p.type == _USER for p in proto.pieces):
            raise ValueError("only models with the identity normaliser, a dummy prefix and no user symbols are supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - 10.0
        self.raw = [b""] * len(proto.pieces)
        for piece, i in self.ids.items():
            self.raw[i] = piece.encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = "".join(sorted({c for p in self.ids for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        fine = re.compile(rf"▁*[^\W\d_{odd}]+|▁*(?:[^\w▁]|[\d_{odd}])+|▁+")
        self.pattern = next((cut for cut in (fine, _COARSE) if all(cut.fullmatch(p) for p in self.ids)), re.compile(r"(?s).+"))
        self.words_cut = self.pattern.pattern != "(?s).+"  # a space ends every chunk
        self.newline_cuts = not any("\n" in p for p in self.ids)

    def chunks(self, text: str) -> list[str]:
        """Chunks of the text in order; together they are the model's view of it."""
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace").replace(SPACE, " ")
        return text.removeprefix(" ")

    def encode_chunk(self, chunk: str) -> list[int]:
        """The library's tokens of one chunk: a newline in front keeps the dummy prefix away from it."""
        assert self.newline_cuts
        return self.processor.encode("\n" + chunk.replace(SPACE, " "))[2:]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
