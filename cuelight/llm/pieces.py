"""SentencePiece encoding with source spans, and decoding.

The text is normalised by longest-prefix match through the model's compiled character map; the normaliser records where every byte of
the normalised text came from. The pieces cover the normalised text without gaps, so their lengths project each piece to a span of
bytes of the original text. The merges themselves are those of the sentencepiece library.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cuelight.llm.tables import registered, table
from cuelight.llm.words import slices

SPACE = "▁".encode()


class CharMap:
    """The compiled character map: a double-array trie from byte strings to offsets of their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]
        self.starts = frozenset(c for c in range(256) if self.units and self._step(self._offset(self.units[0]), c) is not None)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        at = node ^ byte
        if at >= len(self.units) or (self.units[at] & 0x800000FF) != byte:
            return None
        return at ^ self._offset(self.units[at]), self.units[at] >> 8 & 1

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that the data has at the position."""
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            step = self._step(node, data[i])
            if step is None:
                break
            node, leaf = step
            if leaf:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, value
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


class Normaliser:
    """Normalised bytes and, for each of them and the end, the offset in the original bytes."""

    def __init__(self, spec, kept: list[bytes]):
        self.map = CharMap(spec.precompiled_charsmap)
        self.squeeze, self.prefix, self.escape = spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces
        self.kept = sorted(kept, key=len, reverse=True)
        self.plain = not self.map.units and not kept and not self.squeeze

    def _chunks(self, data: bytes):
        """(source offset, source length, replacement): the next kept symbol, map key or character."""
        at = 0
        while at < len(data):
            held = next((k for k in self.kept if data.startswith(k, at)), None)
            if held:
                size, out = len(held), held
            elif data[at] in self.map.starts and (hit := self.map.longest(data, at)):
                size, out = hit
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at : at + size]
            yield at, size, out
            at += size

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        mark = SPACE if self.escape else b" "
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(mark), 1))
            head = mark if self.prefix else b""
            return head + data.replace(b" ", mark), np.concatenate([np.zeros(len(head), np.int64), source, [len(raw)]])
        out, source, chunks = bytearray(), [], list(self._chunks(data))
        if self.squeeze:
            while chunks and chunks[0][2] in (b" ", b""):
                chunks.pop(0)
            if not chunks:
                return b"", np.zeros(1, np.int64)
        if self.prefix:
            out += mark
            source += [chunks[0][0]] * len(mark)
        space = self.squeeze
        for at, _, piece in chunks:
            if space:
                piece = piece.lstrip(b" ")
            if piece:
                escaped = piece.replace(b" ", mark)
                out += escaped
                source += [at] * len(escaped)
                space = piece.endswith(b" ")
            if not self.squeeze:
                space = False
        end = chunks[-1][0] + chunks[-1][1]
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = source[-len(mark)]
                del source[-len(mark) :]
        return bytes(out), np.array([*source, end], np.int64)


class Pieces:
    """A model's encoder and decoder."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.normalise = Normaliser(proto.normalizer_spec, [p.piece.encode() for p in proto.pieces if p.type == 4])
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = proto.trainer_spec.unk_id

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and last offset of each piece in the text's UTF-8 bytes. Every byte of the normalised text belongs to
        one piece; a dummy prefix has an empty span."""
        normal, source = self.normalise(text.encode())
        ids = np.asarray(self.model.encode(text), np.int64)
        sizes = self.sizes[ids] if len(ids) else np.zeros(0, np.int64)
        if (ids == self.unknown).any():  # an unknown piece takes what the known ones around it leave
            sizes = np.array([len(p.encode()) for p in self.model.encode(text, out_type=str)], np.int64)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        return ids, source[ends - sizes], source[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


@lru_cache(maxsize=4)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: str, spans: bool = True) -> DataFrame:
    """``docs`` as ``_doc`` with ``_pieces``: ids, starts, ends (bytes of the text), decoded text.

    ``model`` is a path that every worker can read. A null text counts as empty; an empty text has no pieces and decodes to "".
    Repeated rows are encoded alike.
    """
    kind = "ids array<int>, starts array<int>, ends array<int>, decoded string"

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        coder = pieces(model)
        parts = []
        for batch in slices([pa.RecordBatch.from_arrays([text], ["text"])]):
            found = [coder.encode(t) for t in batch.column(0).to_pylist()]
            parts.append(pa.StructArray.from_arrays(
                [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in range(3)]
                + [pa.array([coder.decode(f[0]) for f in found], pa.string())], ["ids", "starts", "ends", "decoded"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())]))

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), run.asNondeterministic()(F.col("text")).alias("_pieces"))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """``_doc`` with ``_digest``: n_tokens, ids_sha256, decoded_sha256, and span_bytes, the bytes of the text under its pieces."""
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        coder = pieces(model)
        rows = []
        for batch in slices([pa.RecordBatch.from_arrays([text], ["text"])]):
            for t in batch.column(0).to_pylist():
                ids, starts, ends = coder.encode(t)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(),
                             hashlib.sha256(coder.decode(ids).encode()).hexdigest(), int((ends - starts).sum())))
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int64()])],
                                          ["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), run.asNondeterministic()(F.col("text")).alias("_digest"))


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@registered("op4_sentencepiece")
def op4(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_model()).select("_doc.doc_id", "_digest.*")
