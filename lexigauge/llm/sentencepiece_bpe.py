"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For byte-pair encodings every prefix of a text has one last token, and the encoding of the whole text is read off
backwards: the last token of the text, then the last token of what precedes it, and so on. A token t that ends at
position i is the last token of that prefix exactly if it may follow the last token of the prefix before t. The tokens
that end at i come from an automaton over the vocabulary; whether two tokens may stand side by side is a property of
the pair, found once by merging their joint text and kept in a table. The work is linear in the text, whatever its
words look like.

A text is cut where a space mark follows another character, since no piece reaches over such a place (this is checked
when the vocabulary is loaded; where a vocabulary has such pieces the text stays whole). Parts that come again are kept
in a bounded table with their ids.

Defined cases: null texts are empty; an empty text has the begin and end ids only; characters outside the vocabulary
become byte pieces; repeated rows keep a row each; null ids stay; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

SPACE = "▁"
#: Entries of the table of parts and of the table of pairs; either is emptied when it is full.
KEPT = 800_000


def load(model: bytes) -> dict:
    """What encoding needs of a model file: plain values, so that workers need no library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte = {i: int(pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
    hidden = [i for i in range(n) if sp.is_control(i)]
    out = [i for i in range(n) if sp.is_unknown(i) or sp.is_unused(i) or sp.is_control(i) or sp.is_byte(i)]
    return {"pieces": pieces, "scores": [sp.get_score(i) for i in range(n)], "byte": byte, "hidden": hidden, "out": out, "bos": sp.bos_id(), "eos": sp.eos_id(), "unk": sp.unk_id()}


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: dict, kept: int = KEPT):
        self.__dict__.update(vocabulary)
        out = set(self.out)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in out}
        self.score = {p: self.scores[i] for p, i in self.ids.items()}
        self.byte_ids = {b: i for i, b in self.byte.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in self.ids:
            self.automaton.add_word(p)
        self.automaton.make_automaton()
        whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.parts = re.compile(r"[\s\S]+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}
        self.kept = kept
        hidden = set(self.hidden)
        self.raw = [b"" if i in hidden else bytes([self.byte[i]]) if i in self.byte else (" ⁇ " if i == self.unk else p.replace(SPACE, " ")).encode() for i, p in enumerate(self.pieces)]

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: join the best-scored neighbours, the leftmost first, until none can be joined. For short texts."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, a: str, b: str) -> bool:
        """Whether b is a token of its own and a and b stay as they are side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= self.kept:
                self.pairs.clear()
            found = self.pairs[a, b] = self.stands(b) and self.merged(a + b) == [a, b]
        return found

    def stands(self, a: str) -> bool:
        """Whether the token's own text is encoded as the token."""
        found = self.single.get(a)
        if found is None:
            found = self.single[a] = len(a) == 1 or self.merged(a) == [a]
        return found

    def last_tokens(self, text: str) -> list[int]:
        """The prefix table: the length of the last token of each prefix."""
        last = [0] * (len(text) + 1)
        pairs, stands, may = self.pairs, self.stands, self.may_follow
        for end, n in self.automaton.iter(text):
            i = end + 1
            if last[i]:
                continue
            j = i - n
            t = text[j:i]
            if j:
                p = text[j - (last[j] or 1) : j]  # no token of the vocabulary ends there: a character outside it
                ok = pairs.get((p, t))
                if ok is None:
                    ok = may(p, t)
            else:
                ok = stands(t)
            if ok:
                last[i] = n
        return last

    def part_ids(self, part: str) -> tuple[int, ...]:
        last, i, tokens = self.last_tokens(part), len(part), []
        while i:
            n = last[i] or 1
            tokens.append(part[i - n : i])
            i -= n
        out: list[int] = []
        for t in reversed(tokens):
            n = self.ids.get(t)
            if n is not None:
                out.append(n)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in t.encode("utf-8", "replace")]
            else:
                out.append(self.unk)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        out = [self.bos]
        if text:
            known = self.known
            for part in self.parts(SPACE + text.replace(" ", SPACE)):
                ids = known.get(part)
                if ids is None:
                    ids = self.part_ids(part)
                    if len(part) <= 64:
                        if len(known) >= self.kept:
                            known.clear()
                        known[part] = ids
                out += ids
        out.append(self.eos)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8, and a byte that is none gives U+FFFD."""
        raw = self.raw
        try:
            text = b"".join([raw[i] for i in ids]).decode("utf-8")
        except UnicodeDecodeError:
            text = self.decode_broken(ids)
        first = next((i for i in ids if i not in self.hidden), None)
        return text[1:] if first is not None and first not in self.byte and self.pieces[first].startswith(SPACE) else text

    def decode_broken(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i in self.byte:
                run += self.raw[i]
                continue
            while run:
                for n in range(min(4, len(run)), 0, -1):
                    try:
                        out.append(run[:n].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        if n == 1:
                            out.append("�")
                run = run[n:]
            if i >= 0:
                out.append(self.raw[i].decode("utf-8"))
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(key: str, vocabulary: dict) -> Codec:
    """One codec for each vocabulary in a worker process."""
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _vocabulary(spark, model_path: str):
    with open(model_path, "rb") as f:
        model = f.read()
    return hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(load(model))  # the vocabulary's size is fixed


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with begin and end ids for every row."""
    small_batches(docs.sparkSession)
    key, shared = _vocabulary(docs.sparkSession, model_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(key, shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for every row of ids; null ids give an empty text."""
    key, shared = _vocabulary(tokens.sparkSession, model_path)
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(key, shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes its ids in one pass, so that the ids of the corpus need not be kept."""
    small_batches(docs.sparkSession)
    key, shared = _vocabulary(docs.sparkSession, model_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(key, shared.value)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(le32(ids)).hexdigest())
                text_hash.append(hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def le32(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    import sys

    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()
