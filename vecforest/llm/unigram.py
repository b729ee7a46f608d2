"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton gives every vocabulary piece that ends at a place; the
best score of a prefix and the number of pieces on the way to it are carried along.
Rules of the tokenizer, kept exactly: a leading blank is added to a text that is
not empty; blanks are piece characters; a character that is no piece costs the
least score less 10, and counts as many tokens as it has bytes; at equal scores
the longer last piece wins. No piece has a blank after another character and none
has a line feed, so texts are cut at such places, and a batch's distinct parts are
counted once. Scores are added in whole or double numbers, which is exact where
the library's single precision rounds (totals above 2**24).

Scores below -1e8 mark pieces that are never to be preferred; they count as one
less than the least other score.

Defined results: null text counts as empty and has no tokens; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecforest.llm.common import text_rows
from vecforest.llm.textops import LARGE_PART, buffer_of, parts_by_bytes

BLANK, UNKNOWN_PENALTY, MEMO_PARTS = "▁", 10.0, 500_000


class Counter:
    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in scores):
            raise ValueError("a piece goes on across a place where texts are cut")
        usual = [s for s in scores.values() if s > -1e8]
        least = min(usual, default=0.0)
        scores = {p: s if s > -1e8 else least - 1 for p, s in scores.items()}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a part; blanks are in place."""
        n = len(text)
        best, tokens = [0.0] + [-np.inf] * n, [0] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text) if len(self.automaton) else ():
            matches[end].append(match)
        for end in range(n):
            top, count = -np.inf, 0
            for size, score in sorted(matches[end], reverse=True):
                if (s := best[end + 1 - size] + score) > top:
                    top, count = s, tokens[end + 1 - size] + 1
            if text[end] not in self.single and (s := best[end] + self.unknown) > top:
                top, count = s, tokens[end] + len(text[end].encode())
            best[end + 1], tokens[end + 1] = top, count
        return tokens[n]

    def counts(self, distinct: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO_PARTS:
            self.memo.clear()
        memo, out = self.memo, np.empty(len(distinct), np.int64)
        for i, part in enumerate(distinct):
            if (n := memo.get(part)) is None:
                n = memo[part] = self.count(part.replace(" ", BLANK))
            out[i] = n
        return out

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Token counts of some texts."""
        found = []
        for part in parts_by_bytes(texts, LARGE_PART):
            raw, off = buffer_of(part)
            filled = off[:-1][np.diff(off) > 0]
            raw = np.insert(raw, filled, 0x20)
            off = off + np.searchsorted(filled, off)
            n = len(raw)
            if not n:
                found.append(np.zeros(len(part), np.int64))
                continue
            cut = np.zeros(n + 1, bool)
            cut[off] = True
            blank = np.flatnonzero(raw == 0x20)
            blank = blank[blank > 2]
            mark = (raw[blank - 1] == 0x81) & (raw[blank - 2] == 0x96) & (raw[blank - 3] == 0xE2)
            cut[blank[(raw[blank - 1] != 0x20) & ~mark]] = True
            feed = np.flatnonzero(raw == 0x0A)
            cut[feed] = True
            cut[feed + 1] = True
            cuts = np.flatnonzero(cut)
            coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
            each = self.counts(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            found.append(np.diff(np.append(0, np.cumsum(each))[np.searchsorted(cuts, off)]))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Counter({sp.id_to_piece(i): sp.get_score(i) for i in ordinary})


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = buffer_of(batch["text"])
            yield pa.record_batch([batch["doc_id"], pa.array(np.diff(off)), pa.array(counter(model_file).batch(batch["text"]))], ["doc_id", "n_bytes", "n_tokens"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
