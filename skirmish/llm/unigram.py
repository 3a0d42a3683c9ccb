"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton holds the pieces of a model. One pass over a run of text follows its output links: for every piece that
ends at a place, the best score there is relaxed. Characters that no piece covers fall back to bytes.

The scores of a unigram model are log-probabilities and are added up. Those of a BPE model are numbers of merges, no
likelihood: there the best segmentation is the one of fewest pieces, and of those the one whose merges come first. That is near what
the library's merges give, not the same.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts

SPACE = "▁"
CACHE = 500_000
LONGEST = 64
#: What a piece of a BPE model costs, more than all its run's merge numbers together (runs of up to 500,000 pieces add up
#: exactly in doubles), and the largest merge number that counts.
STEP, LAST_MERGE = float(1 << 34), float(1 << 15)
_RUNS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_state: dict = {}


class Model:
    """Pieces, scores and byte pieces of a sentencepiece model file of type unigram or BPE."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.pieces = [p.piece for p in spec.pieces]
        kinds = [p.type for p in spec.pieces]
        if 4 in kinds:
            raise ValueError("user-defined pieces would have to be matched before all others; this operator does not")
        scores = [p.score for p in spec.pieces]
        bpe = spec.trainer_spec.model_type == 2
        if bpe:
            scores = [-STEP + max(v, -LAST_MERGE) for v in scores]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == 6}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        self.unk = kinds.index(2)
        normal = [i for i, k in enumerate(kinds) if k == 1]
        self.unknown = -5 * STEP if bpe else min(scores[i] for i in normal) - 10.0
        self.auto = ahocorasick.Automaton()
        for i in normal:
            self.auto.add_word(self.pieces[i], (len(self.pieces[i]), scores[i], i))
        self.auto.make_automaton()
        # cuts before runs of spaces and around newlines are safe when no piece reaches across one
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|\n", self.pieces[i]) for i in normal)
        self.surface = [b"" if k == 3 else bytes([self.byte_of[i]]) if k == 6 else " ⁇ ".encode() if k == 2 else self.pieces[i].replace(SPACE, " ").encode() for i, k in enumerate(kinds)]
        self.is_byte = np.array([k == 6 for k in kinds])
        self.cache: dict[str, tuple[int, ...]] = {}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation of one run (spaces already marked); ties go to the longer last piece.

        A place that no piece reaches is reached by one unknown character: the pass stops short there, takes that step
        and goes on.
        """
        n = len(text)
        best, size_of, id_of = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        unknown, done = self.unknown, 0  # places up to ``done`` are settled
        for last, (size, score, i) in self.auto.iter(text):
            end = last + 1
            if done < last:
                while done < last:
                    done += 1
                    if not size_of[done]:
                        best[done], size_of[done] = best[done - 1] + unknown, 1
            s = best[end - size] + score
            if s > best[end] or (s == best[end] and size > size_of[end]):
                best[end], size_of[end], id_of[end] = s, size, i
        out: list[int] = []
        end = n
        while end:
            size, i = size_of[end] or 1, id_of[end]
            if i >= 0:
                out.append(i)
            elif self.bytes_at:
                out += [self.bytes_at[b] for b in reversed(text[end - 1].encode())]
            else:
                out.append(self.unk)
            end -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text: a space is put in front, spaces become marks, each run is encoded once and kept."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        out: list[int] = []
        for run in _RUNS.findall(text) if self.cuts else [text]:
            ids = self.cache.get(run)
            if ids is None:
                ids = self.viterbi(run)
                if len(run) <= LONGEST:
                    if len(self.cache) >= CACHE:
                        self.cache.clear()
                    self.cache[run] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes join to characters, marks become spaces, the space in front goes."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def model(path: str) -> Model:
    return _state.get(path) or _state.setdefault(path, Model(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. Null and empty texts have no ids; a text of spaces has those of its marks; texts of any length
    are read whole, run by run; among segmentations of equal score the longer last piece wins. Repeated rows and null ids
    are all returned; other columns of ``docs`` are not read; no rows give no rows."""

    def run(cols: dict) -> dict:
        m = model(path)
        return {"doc_id": cols["doc_id"], "ids": [m.encode(t) for t in cols["text"]]}

    return map_texts(id_text(docs, id_col, text_col), run, "doc_id long, ids array<int>", 1_000_000)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null and empty ids give an empty text. ``▁`` in a text comes back as a space, as the marks
    do; bytes that are no UTF-8 come back as replacement characters. Lists of any length, repeated rows and null doc_ids are
    all returned; other columns are not read; no rows give no rows."""

    def run(cols: dict) -> dict:
        m = model(path)
        return {"doc_id": cols["doc_id"], "text": [m.decode(x or []) for x in cols["ids"]]}

    return map_texts(tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_byte_pieces, decoded): encodes and decodes every whole text in one pass. Nulls, empty and
    long texts, ties, repeated rows, other columns and empty tables: as encode() and decode()."""

    def run(cols: dict) -> dict:
        m = model(path)
        ids = [m.encode(t) for t in cols["text"]]
        arrays = [np.array(x, "<u4") for x in ids]
        return {
            "doc_id": cols["doc_id"],
            "n_tokens": [len(x) for x in ids],
            "ids_crc32": [zlib.crc32(x.tobytes()) for x in arrays],
            "n_byte_pieces": [int(m.is_byte[x].sum()) for x in arrays],
            "decoded": [m.decode(x) for x in ids],
        }

    return map_texts(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_crc32 long, n_byte_pieces long, decoded string")
