"""SentencePiece encoding and decoding: exact BPE by backtracking over longest matches.

A BPE encoding is the one sequence of pieces in which every adjacent pair is compatible: merging the characters of the
two pieces by rank gives back exactly the two. So the encoder takes the longest piece at a place (all matches come from
one Aho-Corasick pass), keeps it if it is compatible with the piece before, else tries the next shorter one, and where
none is left marks the place in a bitfield as failed and goes back one piece.

A text is first cut where no merge can reach across: at characters outside the vocabulary and between two characters
that stand side by side in no piece. The encoding of a text is the concatenation of those of its parts, and parts
(mostly words) are kept in a bounded table.

Characters without a piece become their UTF-8 bytes. Supported are models with the identity normaliser, a dummy prefix,
kept white space, byte pieces, begin and end ids and no user-defined pieces; others raise ValueError.

Defined cases: null text: as empty; empty text: begin and end only; texts of any length are encoded whole; repeated rows:
each; ties of rank: from the left, as in the library; no rows: no rows; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.common import free_name, small_batches

SPACE = "▁"
#: Parts kept at once by a worker, and the longest part that is kept.
PARTS, LONGEST = 150_000, 40


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, message[at : at + size]
            at += size


def checked(model: bytes) -> bytes:
    """The model, if its settings are those that the encoder knows."""
    top = dict(fields(model))
    normalizer, trainer = dict(fields(top[3])), dict(fields(top[2]))
    # Field numbers of the public format: normaliser 2 charsmap, 3 dummy prefix, 4 remove extra spaces; trainer 3 model type, 35 byte fallback, 24 treat space as suffix.
    if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
        raise ValueError("only BPE models with byte pieces, a dummy prefix and no other normalisation are supported")
    # A piece's field 3 is its type; 4: user-defined, which the library matches before it merges.
    if any(dict(fields(piece)).get(3) == 4 for number, piece in fields(model) if number == 1):
        raise ValueError("models with user-defined pieces are not supported")
    return model


class Encoder:
    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = given.get_piece_size()
        self.bos, self.eos = given.bos_id(), given.eos_id()
        if self.bos < 0 or self.eos < 0:
            raise ValueError("only models with begin and end ids are supported")
        special = {i for i in range(size) if given.is_control(i) or given.is_unknown(i) or given.is_byte(i)}
        pieces = [given.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.rank = {p: -given.get_score(i) for p, i in self.ids.items()}
        self.bytes_of = [bytes([int(pieces[i][3:5], 16)]) if given.is_byte(i) else b"" if i in special else pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.byte_ids = {self.bytes_of[i]: i for i in range(size) if given.is_byte(i)}
        # Only pieces that merging their own characters gives can come out of the encoder.
        self.kept: dict[str, int] = {}
        for p, i in self.ids.items():
            if self.merge(p) == [p]:
                self.kept[p] = i
        self.automaton = ahocorasick.Automaton()
        for p in self.kept:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        inside: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                inside.setdefault(a, set()).add(b)
        self.inside = inside
        # Cuts made by one pattern: around line breaks, before SPACE runs, and around marks that touch no letter in any piece.
        # The pattern's letters are all of [^\W\d_] but the vocabulary's superscripts, fractions and the like, which stand before marks in pieces.
        known = {c for p in self.ids for c in p if re.match(rf"[^\W\d_{SPACE}]", c)}
        letters = [c for c in known if c.isalpha()]
        others = "".join(re.escape(c) for c in sorted(known.difference(letters)))
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
        self.before_mark = "".join(re.escape(m) for m in marks if not any(m in inside.get(a, ()) for a in letters))
        mark = f"[{self.before_mark}]" if self.before_mark else r"(?!)"
        self.cut = re.compile(rf"{SPACE}*[^\W\d_{SPACE}{others}]+(?={mark}|[{SPACE}\n]|\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        # A piece that a cut would divide: texts of such a vocabulary are not cut.
        if any(b == SPACE != a or (a == "\n") != (b == "\n") for a, after in inside.items() for b in after):
            self.cut = re.compile(r".+", re.S)
        self.parts = _Parts(self)

    def merge(self, text: str) -> list[str]:
        """Plain merging of characters, the lowest rank first, ties from the left."""
        symbols = list(text)
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PARTS:
                self.pairs.clear()
            known = self.pairs[a, b] = a + b not in self.ids and self.merge(a + b) == [a, b]
        return known

    def encode_part(self, text: str) -> list[int]:
        """Ids of a part of a text, by backtracking; characters without a piece separate what can be merged."""
        out: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.kept:
                if start < i:
                    out += self._known(text[start:i])
                out += [self.byte_ids[bytes([b])] for b in c.encode()]
                start = i + 1
        if start < len(text):
            out += self._known(text[start:] if start else text)
        return out

    def _known(self, text: str) -> list[int]:
        if text in self.kept:
            return [self.kept[text]]
        # lengths[i]: of the pieces that start at i, the shortest first.
        n = len(text)
        lengths: list[list[int]] = [[1] for _ in range(n)]
        for end, size in self.automaton.iter(text):
            if size > 1:
                lengths[end - size + 1].append(size)
        failed = bytearray(n // 8 + 1)
        taken: list[str] = []
        at, choice = 0, len(lengths[0]) - 1
        while at < n:
            before = taken[-1] if taken else None
            while choice >= 0:
                size = lengths[at][choice]
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1 and (before is None or self.compatible(before, text[at:end])):
                    break
                choice -= 1
            if choice >= 0:
                taken.append(text[at:end])
                at = end
                choice = len(lengths[at]) - 1 if at < n else 0
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if not taken:  # cannot happen with a complete vocabulary; plain merging is exact in any case
                return [self.ids[p] for p in self.merge(text)]
            last = taken.pop()
            at -= len(last)
            choice = lengths[at].index(len(last)) - 1
        return [self.kept[p] for p in taken]

    def encode(self, text: str) -> bytes:
        """Ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        parts = self.parts
        if len(parts) > PARTS:
            parts.clear()
        body = b"".join(map(parts.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE)))) if text else b""
        return self.bos.to_bytes(4, "little") + body + self.eos.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that the dummy prefix added goes."""
        import numpy as np

        of = self.bytes_of
        text = b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Parts(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        found = b"".join([i.to_bytes(4, "little") for i in self.encoder.encode_part(part)])
        if len(part) <= LONGEST:
            self[part] = found
        return found


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(spark: SparkSession, docs: DataFrame, model_path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs without `text`, and with `ids` (array of ints, if wanted), n_tokens, ids_sha256, decoded (if wanted) and decoded_sha256.

    The vocabulary file (its size is bounded by the vocabulary) is read on the driver and sent to the executors.
    """
    small_batches(spark)
    with open(model_path, "rb") as f:
        model = checked(f.read())
    encoder(model)  # raises here, not in a task, if the model is not supported
    shared = spark.sparkContext.broadcast(model)
    added = ["ids", "decoded"] if keep_ids else []
    rest = [f for f in docs.schema.fields if f.name not in (text, "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = T.StructType([*rest, *([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if keep_ids else []), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    names, given = [f.name for f in rest], free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = encoder(shared.value)
        for batch in batches:
            column, cols = batch.column(given), [batch.column(n) for n in names]
            n_tokens, id_hex, text_hex, all_ids, texts = [], [], [], [], []
            for x in column:
                ids = coder.encode(x.as_py() or "")
                back = coder.decode(ids)
                n_tokens.append(len(ids) // 4)
                id_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(back.encode()).hexdigest())
                if added:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                    texts.append(back)
            new = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if added else []
            yield pa.RecordBatch.from_arrays([*cols, *new, pa.array(n_tokens, pa.int64()), pa.array(id_hex, pa.string()), pa.array(text_hex, pa.string())], [*names, *added, "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.parts.clear()  # workers live on after a task
        coder.pairs.clear()

    return docs.select(*names, F.col(text).alias(given)).mapInArrow(run, schema)
