"""SentencePiece encoding and decoding for merge-type (BPE) models, equal to the library's own.

A text's encoding is the one sequence of pieces in which every two neighbours are compatible: merged anew from their
characters, the two come out as they are. So no merge queue over the text is needed. An Aho-Corasick automaton gives the
longest piece at each position; pieces are laid one after the other, each checked against the one before; where none fits, the
last is taken back for a shorter one, and a bitfield remembers positions from which no sequence reaches the end.

Where no piece holds two neighbouring characters in a row, a text falls into segments that are encoded alone: which these are
is read from the vocabulary. Distinct segments are encoded once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperproof.llm.common import parts, slices

# The mark that stands for a space, and what an unknown piece reads as.
SPACE = "▁"
UNKNOWN = " ⁇ "


class Pieces:
    """One model's pieces. ``keep`` bounds the remembered segments and pairs, which only save time."""

    def __init__(self, path: str, keep: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        if model.normalize("ﬁ Å  ") != f"{SPACE}ﬁ{SPACE}Å{SPACE}{SPACE}" or not model.is_byte(model.piece_to_id("<0x00>")):
            raise ValueError("the model must leave texts as they are but for a leading space, and fall back to bytes")
        own = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.half: dict[str, tuple[str, str] | None] = {}
        self.keep, self.piece = keep, [model.id_to_piece(i) for i in every]
        self.id = {self.piece[i]: i for i in own}
        self.order = {self.piece[i]: -model.get_score(i) for i in own if len(self.piece[i]) > 1}
        self.single = {p for p in self.id if len(p) == 1}
        if not all(set(p) <= self.single for p in self.order):
            raise ValueError("characters of a piece must be pieces themselves")
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None) for p in self.id}
        self.joined = self._joined({p[i : i + 2].replace(SPACE, " ") for p in self.order for i in range(len(p) - 1)})
        self._tables(model, every)
        self.clear()

    @staticmethod
    def _joined(pairs: set[str]) -> np.ndarray:
        """Whether a piece may hold one byte right before another. Bytes of characters beyond ASCII count as one class each side."""
        out = np.zeros((256, 256), bool)
        out[128:, 128:] = True
        for x, y in pairs:
            out[ord(x) if x < "\x80" else slice(128, 256), ord(y) if y < "\x80" else slice(128, 256)] = True
        return out

    def _tables(self, model, every: range) -> None:
        say = [b"" if model.is_control(i) else UNKNOWN.encode() if model.is_unknown(i) else bytes([self.byte.index(i)]) if model.is_byte(i) else self.piece[i].replace(SPACE, " ").encode() for i in every]
        self.said = np.frombuffer(b"".join(say), np.uint8)
        self.said_at = np.concatenate(([0], np.cumsum([len(x) for x in say])))
        self.spaced = np.array([self.piece[i].startswith(SPACE) and not model.is_control(i) for i in every])
        self.silent, self.is_byte = np.array([not x for x in say]), np.array([model.is_byte(i) for i in every])

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])
        self.pairs: dict[tuple[str, str], bool] = {}

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes a piece, None if its characters merge to something else. One character has no halves: ('', '')."""
        if piece not in self.half:
            symbols, last = list(piece), ("", "")
            while len(symbols) > 1:
                ranks = [self.order.get(a + b, np.inf) for a, b in zip(symbols, symbols[1:], strict=False)]
                i = ranks.index(min(ranks))
                if ranks[i] == np.inf:
                    last = None
                    break
                last = symbols[i], symbols[i + 1]
                symbols[i : i + 2] = ["".join(last)]
            self.half[piece] = last
        return self.half[piece]

    def fits(self, last: str, piece: str) -> bool:
        """Whether two neighbours come out of a merge of their characters; the first piece has '' before it.

        The merges that made the two are replayed from the last one back. Between two of them the symbols that meet at the
        boundary stay, and no merge across it may come before the next one inside: order decides, then what stands further left."""
        key = last, piece
        said = self.pairs.get(key)
        if said is None:
            if len(self.pairs) > self.keep:
                self.pairs.clear()
            said = self.pairs[key] = self.halves(piece) is not None and (not last or (self.halves(last) is not None and self._apart(last, piece)))
        return said

    def _apart(self, a: str, b: str) -> bool:
        order, get = self.order, self.order.get
        if a + b in order:
            return False
        while True:
            made_a, made_b = get(a, -np.inf), get(b, -np.inf)  # single characters are there from the start
            if made_a == made_b == -np.inf:
                return True
            if made_a > made_b:  # a was made last
                a = self.halves(a)[1]
                if get(a + b, np.inf) < made_a:
                    return False
            else:
                b = self.halves(b)[0]
                if get(a + b, np.inf) <= made_b:
                    return False

    def covered(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces."""
        out = [p for _, p in self.automaton.iter_long(text)]
        fits, pairs = self.fits, self.pairs
        at, last = 0, ""
        for i, p in enumerate(out):  # longest matches one after the other, as far as they go
            if not (pairs.get((last, p)) or fits(last, p)):
                break
            at += len(p)
            last = p
        else:
            return out
        piece = out[i]
        del out[i:]
        open_ = bytearray(b"\1") * (len(text) + 1)
        longest: dict[int, str] = {}
        while True:
            last = out[-1] if out else ""
            while piece and not (open_[at + len(piece)] and fits(last, piece)):
                piece = self.shorter[piece]
            if piece:
                out.append(piece)
                at += len(piece)
                if at == len(text):
                    return out
                piece = longest.get(at)
                if piece is None:
                    piece = longest[at] = next(self.automaton.iter_long(text, at))[1]
            else:  # no way on from here
                open_[at] = 0
                piece = out.pop()
                at -= len(piece)

    def segment(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already; characters without a piece become bytes."""
        if self.single.issuperset(text):
            return [self.id[p] for p in self.covered(text)]
        ids: list[int] = []
        run = 0
        for i, c in enumerate(text):
            if c not in self.single:
                ids += [self.id[p] for p in self.covered(text[run:i])] if i > run else ()
                ids += [self.byte[b] for b in c.encode()]
                run = i + 1
        return ids + [self.id[p] for p in self.covered(text[run:])] if run < len(text) else ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one UTF-8 text after the other, and the number of each text's."""
        spaced = [b" " + t.replace(SPACE.encode(), b" ") if t else t for t in texts]
        cuts = np.concatenate(([0], np.cumsum([len(t) for t in spaced])))
        raw = b"".join(spaced)
        data = np.frombuffer(raw, np.uint8)
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        edge[1:-1] |= ~self.joined[data[:-1], data[1:]]
        edges = np.flatnonzero(edge).astype(np.int64)
        if len(data) == 0:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        segments = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        if len(self.slots) > self.keep:
            self.clear()
        slot = np.empty(len(segments.dictionary), np.int64)
        for i, s in enumerate(segments.dictionary.to_pylist()):
            at = self.slots.get(s)
            if at is None:
                self.ids.extend(self.segment(s.decode().replace(" ", SPACE)))
                self.ends.append(len(self.ids))
                at = self.slots[s] = len(self.ends) - 2
            slot[i] = at
        ids, ends = np.frombuffer(self.ids, np.int32), np.frombuffer(self.ends, np.int64)  # views; what is taken from them is copied
        at = slot[segments.indices.to_numpy()]
        n = ends[at + 1] - ends[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        got = ids[np.repeat(ends[at] - upto[:-1], n) + np.arange(upto[-1])]
        return got, np.diff(upto[np.searchsorted(edges, cuts)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of id sequences that offsets part: the leading space goes, bytes join to characters, broken ones read U+FFFD."""
        begin, n = self.said_at[ids], np.diff(self.said_at)[ids]
        loud = np.flatnonzero(~self.silent[ids])
        first = loud[np.minimum(np.searchsorted(loud, offsets[:-1]), len(loud) - 1)] if len(loud) else np.empty(0, np.int64)
        first = first[(first >= offsets[:-1]) & (first < offsets[1:])] if len(loud) else first
        first = first[self.spaced[ids[first]]]
        begin[first] += 1
        n[first] -= 1
        upto = np.concatenate(([0], np.cumsum(n)))
        raw = self.said[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cuts, at = upto[offsets].tolist(), offsets.tolist()
        quiet = np.concatenate(([0], np.cumsum(self.silent[ids])))[offsets].tolist()
        out = []
        for i, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
            try:
                out.append(raw[p:q].decode() if quiet[i] == quiet[i + 1] else self._repaired(ids[at[i] : at[i + 1]].tolist()))
            except UnicodeDecodeError:
                out.append(self._repaired(ids[at[i] : at[i + 1]].tolist()))
        return out

    def _repaired(self, ids: list[int]) -> str:
        """The text of ids whose bytes are no characters: each such byte reads U+FFFD; runs of byte pieces end at any other piece."""
        out, run, begun = "", b"", False
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.said[self.said_at[i] : self.said_at[i + 1]].tobytes()
                begun = True
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out += run[:n].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out, n = out + "\ufffd", 1
                run = run[n:]
            if i is not None:
                said = self.said[self.said_at[i] : self.said_at[i + 1]].tobytes().decode()
                out += said[1:] if not begun and self.spaced[i] else said
                begun = begun or not self.silent[i]
        return out

_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process and model file."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))


def encoded(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", back: str | None = None) -> DataFrame:
    """docs with a column of token ids, without begin or end id, and with ``back`` one of the texts that the ids decode to.

    A null text is empty; all other columns stay as they are, but those named like a new one are replaced."""
    keep = [f for f in docs.schema.fields if f.name not in (ids, back)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for b in parts(batches, text):
            got, n = coder.encode([x or b"" for x in b[text].cast(pa.large_binary()).to_pylist()])
            new = {ids: _lists(got, n)}
            if back:
                new[back] = pa.array(coder.decode(got, np.concatenate(([0], np.cumsum(n)))), pa.string())
            yield pa.record_batch([*(b[f.name] for f in keep), *new.values()], names=[*(f.name for f in keep), *new])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(back, T.StringType())] if back else [])]))


def decoded(tokens: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with a column of the texts of their ids. Null ids read as none; all other columns stay as they are, but one named like ``text`` is replaced."""
    keep = [f for f in tokens.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            for p, q in slices(batch[ids].value_lengths().to_pylist(), 1 << 20):
                b = batch.slice(p, q - p)
                offsets = np.concatenate(([0], np.cumsum(b[ids].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                said = coder.decode(b[ids].flatten().to_numpy(zero_copy_only=False), offsets)
                yield pa.record_batch([*(b[f.name] for f in keep), pa.array(said, pa.string())], names=[*(f.name for f in keep), text])

    return tokens.mapInArrow(run, T.StructType([*keep, T.StructField(text, T.StringType())]))


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text's encoding and of what it decodes to."""
    told = encoded(docs.select("doc_id", "text"), model, back="decoded")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
