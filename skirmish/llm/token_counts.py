"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the token counts of frequent pre-tokens, bounded by ``TABLE`` entries; tier two a cache
in each Python worker, bounded by ``CACHE`` entries, filled by the tokenizer itself. The table changes speed only, never
counts, so it may come from a bounded sample of documents (``SAMPLE_DOCS``); every document is counted, and no pre-token of
any is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts

TABLE = 32_768
#: About so many documents, by a hash of their ids and texts, say which pre-tokens are frequent; more would add nothing
#: that the worker caches do not learn anyway.
SAMPLE_DOCS, SAMPLE_PARTS = 20_000, 8
CACHE = 400_000
LONGEST = 64
_state: dict = {}


def pre_tokens(text: str) -> list[str]:
    """Cuts a text where no piece can reach across: before a run of spaces and before each newline.

    Every item stands for itself behind one space, but those that begin with a newline, which follow directly.
    """
    if not text:
        return []
    text = text.replace("▁", " ")
    out: list[str] = []
    for i, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if i:
            words[0] = "\n" + words[0]
        if "" in words:
            # runs of spaces: an item keeps all but the first of its spaces
            words = [m[1:] for m in re.findall(r" +[^ ]*", " " + line)] if not i else ["\n" + re.match(r"[^ ]*", line)[0], *(m[1:] for m in re.findall(r" +[^ ]*", line))]
        out += words
    return out


def splits_safely(pieces: list[str]) -> bool:
    """Whether pre_tokens() is exact for these pieces: none has a space mark behind another character, none a newline."""
    return not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)


class Lengths(dict):
    """pre-token -> number of tokens; misses go to the tokenizer and stay until the cache is full."""

    def __init__(self, model: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.frequent = frequent
        if not splits_safely([self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]):
            raise ValueError("pieces of this model reach across words")

    def __missing__(self, word: str) -> int:
        # behind a newline no space is added: the one the library puts there is not counted
        n = 1 if word == "" else len(self.sp.encode(word)) - (word[0] == "\n")
        if len(word) <= LONGEST:
            if len(self) > CACHE:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def frequent_pretokens(docs: DataFrame, size: int = TABLE, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """The most frequent pre-tokens of about ``sample_docs`` documents, at most ``size``. SAMPLE_PARTS tasks read the sampled
    texts and each gives its 2 ``size`` most frequent ones with their counts; the driver adds those up."""

    def summary(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(w for w in pre_tokens(text) if len(w) <= LONGEST)
                if len(seen) > 32 * size:
                    seen = Counter(dict(seen.most_common(8 * size)))
        top = seen.most_common(2 * size)
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "n": [n for _, n in top]})

    share = min(1.0, sample_docs / max(1, docs.count()))
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = docs.where(u < int(share * (1 << 30))).select("text").repartition(SAMPLE_PARTS)
    total: Counter = Counter()
    for row in some.mapInArrow(summary, "word string, n long").toLocalIterator():  # at most 2 ``size`` rows a task
        total[row["word"]] += row["n"]
    return [w for w, n in total.most_common(size) if n > 1]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as sentencepiece counts the whole text with ``model``.

    Null and empty texts have 0 tokens; texts of any length count whole; repeated rows are counted each; other columns of
    ``docs`` are not read; an empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col)
    lengths = Lengths(model, {})
    words = frequent_pretokens(rows)
    sizes = np.fromiter((lengths[w] for w in words), np.uint16, len(words))
    shared = docs.sparkSession.sparkContext.broadcast((words, sizes.tobytes()))  # at most TABLE words of LONGEST characters

    name = uuid.uuid4().hex

    def count(cols: dict) -> dict:
        at = _state.get("lengths")
        if at is None or at[0] != name:
            keys, raw = shared.value
            _state["lengths"] = at = (name, Lengths(model, dict(zip(keys, np.frombuffer(raw, np.uint16).tolist(), strict=True))))
        get = at[1].__getitem__
        n = [sum(map(get, pre_tokens(t))) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in cols["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
