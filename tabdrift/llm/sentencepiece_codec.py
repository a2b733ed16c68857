"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised by longest-prefix matches through the model's compiled
character map while each output byte remembers where it came from. The pieces,
laid end to end, are the normalised text, so every piece projects to a span of
bytes of the original.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tabdrift.llm.common import in_blocks, small_batches

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Piece types of a model file.
CONTROL, USER_DEFINED, BYTE = 3, 4, 6
#: Tokens per block that a task hands back.
BLOCK = 200_000


def charmap_rules(blob: bytes) -> dict[bytes, bytes]:
    """The replacements of a compiled character map.

    The map is a 32-bit length, a double-array trie of that many bytes whose values
    are offsets, and the replacements, each ended by a zero byte. The trie is walked
    once from its root; every label byte that leads back to its unit is a child.
    """
    if not blob:
        return {}
    (length,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", length // 4, 4)
    text, labels = blob[4 + length :], np.arange(1, 256)
    child = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    rules: dict[bytes, bytes] = {}
    todo = [(0, b"")]
    while todo:
        at, key = todo.pop()
        unit = int(units[at])
        base = at ^ child(unit)
        if unit >> 8 & 1:
            value = int(units[base]) & 0x7FFFFFFF
            rules[key] = text[value : text.index(b"\0", value)]
        to = base ^ labels
        near = to < len(units)
        fits = units[to[near]] & 0x800000FF == labels[near]
        todo += [(t, key + bytes([c])) for t, c in zip(to[near][fits].tolist(), labels[near][fits].tolist(), strict=True)]
    return rules


class Normalizer:
    """Rewrites text by the longest rule that starts at each place and aligns the result."""

    def __init__(self, rules: dict[bytes, bytes], dummy_prefix: bool = True, collapse: bool = False, escape: bool = True, fixed: tuple[bytes, ...] = ()):
        self.rules = rules | {f: f for f in fixed}
        self.dummy_prefix, self.collapse = dummy_prefix, collapse
        self.space = SPACE_BYTES if escape else b" "
        self.longest = max(map(len, self.rules), default=0)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and their end, an offset in the original bytes."""
        raw = text.encode()
        return self._mapped(text, raw) if self.rules or self.collapse else self._plain(raw)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        if not raw:
            return b"", np.zeros(1, np.int64)
        wide = len(self.space)
        counts = np.where(np.frombuffer(raw, np.uint8) == 0x20, wide, 1)
        align = np.repeat(np.arange(len(raw)), counts)
        front = wide if self.dummy_prefix else 0
        return (self.space if front else b"") + raw.replace(b" ", self.space), np.concatenate([np.zeros(front, np.int64), align, [len(raw)]])

    def _steps(self, text: str, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(raw):
            for size in range(min(self.longest, len(raw) - at), 0, -1):
                if (put := self.rules.get(raw[at : at + size])) is not None:
                    break
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                put = raw[at : at + size]
            yield at, at + size, put
            at += size

    def _mapped(self, text: str, raw: bytes) -> tuple[bytes, np.ndarray]:
        out, align, end, spaced, begun = bytearray(), [], 0, self.collapse, False
        for start, stop, put in self._steps(text, raw):
            if self.collapse and spaced:
                put = put.lstrip(b" ")
            if not begun and (put or not self.collapse):
                begun = True
                if self.dummy_prefix:
                    out += self.space
                    align += [start] * len(self.space)
            for byte in put:
                got = self.space if byte == 0x20 else bytes([byte])
                out += got
                align += [start] * len(got)
            if put:
                end, spaced = stop, put.endswith(b" ")
        if self.collapse:
            kept = len(out)
            while out[:kept].endswith(self.space):
                kept -= len(self.space)
                end = align[kept]
            del out[kept:], align[kept:]
        return bytes(out), np.array([*align, end], np.int64)


class Codec:
    """A SentencePiece model with the parts that offsets need."""

    def __init__(self, model: bytes):
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, pieces = proto.normalizer_spec, proto.pieces
        fixed = tuple(p.piece.encode() for p in pieces if p.type == USER_DEFINED)
        self.normalize = Normalizer(charmap_rules(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, fixed)
        self.eos = self.lib.eos_id()
        self.lengths = np.array([1 if p.type == BYTE else 0 if p.type == CONTROL else len(p.piece.encode()) for p in pieces], np.int64)
        self.bytes_back = any(p.type == BYTE for p in pieces)

    def _ids(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids of ``text`` and the normalised byte length of each piece."""
        ids = self.lib.encode(text)
        if self.bytes_back:
            return ids, self.lengths[ids] if ids else np.empty(0, np.int64)
        return ids, np.array([len(p.encode()) for p in self.lib.encode(text, out_type=str)], np.int64)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the end id, and the span of each in UTF-8 bytes of ``text``.

        A byte of a normalised character that a rule made belongs to the whole source
        of the rule. Each span begins where the one before it ends; blanks that the model
        drops at either end of the text are in none. The end id has the empty span at the end. Should pieces not make up the normalised text, as with a model whose
        own normaliser does more than its map says, the spans are the library's.
        """
        normal, align = self.normalize(text)
        ids, lengths = self._ids(text)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        size = len(text.encode())
        places = align[edges] if edges[-1] == len(normal) else self._surfaces(text, len(ids))
        return [*ids, self.eos], np.append(places[:-1], size), np.append(places[1:], size)

    def _surfaces(self, text: str, n: int) -> np.ndarray:
        """Where each of ``n`` pieces and their end begin, by the library's own spans of bytes."""
        ends = [p.end for p in self.lib.encode(text, return_type="proto").pieces]
        return np.maximum.accumulate(np.array([0, *ends[:n]], np.int64))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=1)
def codec_of(model: bytes) -> Codec:
    """The codec of a model, made once in a worker and not in each of its tasks."""
    return Codec(model)


OUTPUT = "sp_ids array<int>, sp_begins array<int>, sp_ends array<int>, sp_decoded string"


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with sp_ids, sp_begins, sp_ends and sp_decoded.

    sp_ids are the library's ids of the whole text with an end id only, without
    sampling; spans are byte offsets in the text; sp_decoded is the library's
    decoding of the ids. A null text counts as empty: the end id, one empty span, an
    empty decoding. Rows are independent, so repeated rows repeat and an empty table
    gives an empty result. Texts of any length are encoded whole; columns that are not in
    ``keep`` are dropped, so their names may clash with nothing. The model is read where
    the query is built and shipped with the tasks.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    kept = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text), F.lit("")).alias("sp_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            coded = (codec.encode(t.as_py()) for t in batch.column(len(keep)))
            for first, block in in_blocks(coded, lambda c: len(c[0]), BLOCK):
                ends = pa.array(np.cumsum([0, *(len(c[0]) for c in block)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(c[k], np.int32) for c in block]))) for k in range(3)]
                decoded = pa.array([codec.decode(c[0]) for c in block], pa.string())
                columns = [batch.column(i).slice(first, len(block)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *lists, decoded], names=[*keep, "sp_ids", "sp_begins", "sp_ends", "sp_decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), OUTPUT])
    return source.mapInArrow(run, schema)
