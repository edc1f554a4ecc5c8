"""Counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces
inside one. A node's failure link leads to where matching goes on when no piece
goes further, and its number says how many pieces are complete by then, so a
word is read once, character by character, and no piece is ever built. A word
that can't be made of pieces counts as one unknown token.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null or empty text has no
words; equal rows are counted each; an empty table gives an empty table; columns
other than id and text are not read; a word of any length takes linear time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import key_and_text, slices

#: What sentencepiece puts before a word.
MARK = "▁"
#: Words whose counts a task remembers.
CACHE = 250_000
#: Added to a word's count if it is unknown.
UNKNOWN = 1 << 40


def sentencepiece_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word (with MARK), and the others; without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in own if p.startswith(MARK)], [p for p in own if not p.startswith(MARK)]


class Automaton:
    """Node 0 is the root of pieces that begin a word, node 1 of those inside it."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = {}
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                u = root
                for c in piece:
                    v = self.next[u].get(c)
                    if v is None:
                        v = self.next[u][c] = len(self.next)
                        self.next.append({})
                    u = v
                if u > 1:
                    ends[u] = True
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.pops: list[int] = [0] * n
        level = [0, 1]
        while level:  # by depth: the failure of a node is never deeper than the node
            below = []
            for v in level:
                for c, u in self.next[v].items():
                    below.append(u)
                    if u in ends:
                        self.fail[u], self.pops[u] = 1, 1
                        continue
                    z, popped = self.fail[v], self.pops[v]
                    while z >= 0 and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[u], self.pops[u] = self.next[z][c], popped
            level = below

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 if it is unknown."""
        step, fail, pops, u, n = self.next, self.fail, self.pops, 0, 0
        for c in word:
            while (v := step[u].get(c)) is None:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return -1
            u = v
        while u != 1:
            if u == 0 or fail[u] < 0:
                return -1
            n += pops[u]
            u = fail[u]
        return n


def token_counts(df: DataFrame, first: list[str], inner: list[str], mark: str = MARK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown. mark: stands before each word when it is matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Automaton(first, inner).count

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                n = count(mark + word.decode())
                out = self[word] = n if n >= 0 else UNKNOWN + 1
                return out

        known = Known()
        for b in slices(batches):
            rows = []
            if len(known) > CACHE:
                known.clear()
            for text in b.column(1).to_pylist():
                words = text.encode().split()  # of bytes: at the six ASCII spaces only
                unknown, n = divmod(sum(map(known.__getitem__, words)), UNKNOWN)
                rows.append((len(words), n, unknown))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return key_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
