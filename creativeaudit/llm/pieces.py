"""SentencePiece encoding and decoding of models of the merge type.

A text is encoded without a merge queue. The longest piece at every place
comes from an Aho-Corasick automaton over the reversed pieces. From the left,
the longest piece is taken that the piece before allows: two neighbours are
compatible when merging their joint text anew gives the two again. At a place
from which no piece leads on, a bit is set and the piece before is shortened.
A sequence whose neighbours are all compatible is the one that merging yields.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from creativeaudit.llm.common import pieces_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a Python worker remembers with their ids, the latest half of them at least.
REMEMBERED = 700_000
#: Fewer where ids are the result: their lists need the memory.
REMEMBERED_WITH_IDS = 60_000


class Codec:
    """The tables of one model, and encoding and decoding with them."""

    def __init__(self, model: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if (spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix
                or kinds & {USER, UNUSED}):
            raise ValueError("only merge-type models without text normalisation and user-defined pieces are handled")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == CONTROL}
        self.unknown = next((i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN), 0)
        self.fallback = len(self.bytes) == 256
        self.unk_surface = spec.trainer_spec.unk_surface
        # Where no piece holds two characters side by side, a text can be cut: nothing merges across.
        self.cut_before_space = not any(b == SPACE != a for p in self.ids for a, b in zip(p, p[1:]))
        self.lines_alone = not any("\n" in p and len(p) > 1 for p in self.ids)
        # Words can be encoded and decoded one by one.
        self.plain = self.fallback and self.prefix and self.cut_before_space and self.lines_alone
        # A piece that merging its own text does not give back never occurs.
        usable = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self.usable = set(usable)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in usable:
            self.automaton.add_word(p[::-1])
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.usable), None) for p in usable}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.most = REMEMBERED
        self.recent: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.number = {p: (str(i), i) for p, i in self.ids.items()}
        #: What each id of a usual piece stands for.
        self.surface = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}

    # ------------------------------------------------------------- encoding

    def merged(self, text: str) -> list[str]:
        """Best score first, leftmost of equals. For short texts: pairs of pieces and pieces."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= 4 * REMEMBERED:
                self.compatible.clear()
            known = self.compatible[pair] = self.merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text in which spaces are escaped; characters without a piece stand alone."""
        n = len(text)
        if n < 2:
            return [text] if n else []
        longest = [1] * n
        last = -1
        for end, length in self.automaton.iter(text[::-1]):
            if end != last:  # of all that end here the longest comes first
                longest[n - 1 - end] = length
                last = end
        if longest[0] == n:
            return [text]
        failed = 0  # bit i: no sequence leads from place i to the end
        out: list[str] = []
        compatible = self.compatible.get
        at, piece = 0, text[:longest[0]]
        while True:
            end = at + len(piece)
            if out and (good := compatible((out[-1], piece))) is None:
                good = self.fits(out[-1], piece)
            if (not out or good) and not (failed and failed >> end & 1):
                out.append(piece)
                if end == n:
                    return out
                at, piece = end, text[end:end + longest[end]]
                continue
            piece = self.shorter.get(piece)
            while piece is None:
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                piece = self.shorter.get(last)

    def _unit(self, unit: str) -> tuple[str, bytes]:
        """(ids joined by commas, the bytes decoded from them) of a unit that nothing merges out of."""
        try:
            found = [self.number[p] for p in self.split(unit)]
        except KeyError:  # characters without a piece
            ids = self.ids_of(unit)
            return ",".join(map(str, ids)), self.decoded(ids)
        return ",".join([text for text, _ in found]), b"".join([self.surface[i] for _, i in found])

    def ids_of(self, unit: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(unit):
            known = self.ids.get(piece)
            if known is not None:
                ids.append(known)
            elif self.fallback:
                ids += [self.bytes[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def units(self, text: str) -> list[str]:
        """A text cut where no piece reaches across."""
        if not text:
            return []
        text = (SPACE + text if self.prefix else text).replace(" ", SPACE)
        parts = re.split("(\n)", text) if self.lines_alone and "\n" in text else [text]
        if not self.cut_before_space:
            return [p for p in parts if p]
        return [u for p in parts for u in _BEFORE_SPACE.findall(p)]

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.ids_of(u)]

    # ------------------------------------------------------------- decoding

    def decoded(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8, with the space that was put before it."""
        try:
            return b"".join([self.surface[i] for i in ids])
        except KeyError:  # ids that are no usual pieces
            pass
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i is None or i in self.silent:
                continue
            out.append(self.unk_surface if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out).encode()

    def decode(self, ids: list[int]) -> str:
        first = next((self.pieces[i] for i in ids if i not in self.silent), "")
        text = self.decoded(ids)
        return (self.bare(text) if first.startswith(SPACE) else text).decode()

    def bare(self, decoded: bytes) -> bytes:
        """Without the space that encoding puts before a text."""
        return decoded[1:] if self.prefix and decoded.startswith(b" ") else decoded

    # ------------------------------------------------------------- whole texts

    def joined(self, text: str | None) -> tuple[int, str, bytes]:
        """(number of ids, ids joined by commas, the text decoded from them in UTF-8)."""
        text = text or ""
        if not text or not self.plain or SPACE in text:
            found = [u for u in map(self._unit, self.units(text)) if u[0]]
        else:
            # A word stands for itself and the space before it, a line break for itself and the word after it. More spaces
            # than one stay with the word that they stand before.
            if "  " in text or text[0] == " ":
                words = _SPACED.findall(" " + text)
            else:
                words = text.replace("\n", " \n").split(" ")
            found = list(map(self.recent.get, words))
            if None in found:
                found = [hit or self._remembered(word) for hit, word in zip(found, words)]
        if not found:
            return 0, "", b""
        ids, back = zip(*found)
        ids = ",".join(ids)
        return ids.count(",") + 1, ids, self.bare(b"".join(back))

    def _remembered(self, word: str) -> tuple[str, bytes]:
        hit = self.recent.get(word) or self.older.get(word) or self._word(word)
        if len(word) < 64:
            self.recent[word] = hit
            if len(self.recent) >= self.most // 2:
                self.older, self.recent = self.recent, {}
        return hit

    def _word(self, word: str) -> tuple[str, bytes]:
        """The ids of a word, and what these ids give back."""
        if word[:1] != "\n":
            return self._unit((word if word[:1] == " " else " " + word).replace(" ", SPACE))
        ids, back = zip(*map(self._unit, ("\n", word[1:])))
        return ",".join(filter(None, ids)), b"".join(back)

    def rest(self) -> None:
        """After a task: the worker stays, and other work needs its memory."""
        self.recent, self.older = {}, {}

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them)."""
        n, ids, back = self.joined(text)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


_SPACED = re.compile(r" +[^ \n]*|\n[^ \n]*")
_BEFORE_SPACE = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _utf8(raw: bytes) -> str:
    """Each byte that begins no whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode())
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The codec of a model file, made once in each Python process."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", keep_text: bool = True, digest: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text in an array column; a null text has none.

    Without ``keep_text`` the text goes to Python once and does not come back.
    ``digest`` names a further column for the SHA-256 of the text that the ids decode to.

    No begin or end ids, no sampling. A column of these names is replaced.
    ``model`` must be readable by this path on every machine.
    """
    made_here = [ids] + ([digest] if digest else [])
    kept = [c for c in docs.columns if c not in (*made_here, "__text") and (keep_text or c != text)]

    def run(batches):
        made = codec(model)
        made.most = REMEMBERED_WITH_IDS
        pa.default_memory_pool().release_unused()  # what earlier work of this process left
        for batch in batches:
            row = 0
            for piece in pieces_of([batch.select([batch.num_columns - 1]).rename_columns(["text"])]):
                found = [made.joined(t) for t in piece.column(0).to_pylist()]
                at = np.concatenate(([0], np.cumsum([n for n, _, _ in found]))).astype(np.int32)
                flat = np.fromstring(",".join([x for n, x, _ in found if n]), dtype=np.int32, sep=",") if at[-1] else np.zeros(0, np.int32)
                coded = [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                if digest:
                    coded.append(pa.array([hashlib.sha256(back).hexdigest() for _, _, back in found]))
                yield pa.RecordBatch.from_arrays([*[c.slice(row, piece.num_rows) for c in batch.columns[:-1]], *coded], names=[*kept, *made_here])
                row += piece.num_rows
        made.rest()

    out = docs.select(*kept, F.col(text).alias("__text"))
    made_fields = [StructField(ids, ArrayType(IntegerType()))] + ([StructField(digest, StringType())] if digest else [])
    return out.mapInArrow(run, StructType([*docs.select(*kept).schema.fields, *made_fields]))


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of its ids; null ids have the empty text."""
    @F.pandas_udf("string")
    def run(values):
        made = codec(model)
        return values.map(lambda v: made.decode([] if v is None else [int(i) for i in v]))

    return docs.withColumn(text, run(F.col(ids)))


def encoded_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text, decodes it again and returns digests of both; rows stay where they are.

    A null text is empty and has no ids. Ids may be null or repeat. No rows
    give no rows; further columns are ignored.
    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256.
    """
    def run(batches):
        made = codec(model)
        made.most = REMEMBERED
        for batch in batches:
            found = [made.digests(t.as_py()) for t in batch.column(1)]
            n, ids, back = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        made.rest()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
