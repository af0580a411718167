"""Token counts by greedy longest match, in one pass over the characters: a trie with failure links.

Where the trie has no edge for the next character, the pieces that the longest match would have cut by then are
known beforehand: each node keeps how many that are and the node from which to go on. Pieces are never built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts are kept per Python worker, and the longest kept.
CACHE_WORDS, CACHE_CHARS = 500_000, 40


class LongestMatch:
    """Counts of greedy longest-match pieces. A character that is no piece counts as its UTF-8 bytes, as in vocabularies with byte fallback."""

    def __init__(self, pieces: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        weight: dict[int, int] = {}
        known = {p for p in pieces if p}
        for piece in known | {c for p in known for c in p}:
            at = 0
            for c in piece:
                at = self.edges[at].get(c) or self._grow(at, c)
            weight[at] = 1 if piece in known else len(piece.encode())
        # every character of the trie is a piece by now, so each node but the root has a link
        self.link, self.popped = [0] * len(self.edges), [0] * len(self.edges)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                queue.append(v)
                if v in weight:
                    self.link[v], self.popped[v] = 0, weight[v]
                    continue
                at, n = self.link[u], self.popped[u]
                while c not in self.edges[at]:
                    n += self.popped[at]
                    at = self.link[at]
                self.link[v], self.popped[v] = self.edges[at][c], n

    def _grow(self, at: int, c: str) -> int:
        self.edges.append({})
        self.edges[at][c] = len(self.edges) - 1
        return len(self.edges) - 1

    def count(self, word: str) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        at = n = 0
        for c in word:
            while (to := edges[at].get(c)) is None and at:
                n += popped[at]
                at = link[at]
            if to is None:
                n += len(c.encode())
            else:
                at = to
        while at:
            n += popped[at]
            at = link[at]
        return n


def sentence_pieces(path: str) -> list[str]:
    """The plain pieces of a SentencePiece vocabulary: neither control, unknown nor byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


_matchers: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def matcher(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The automaton and the word counts of this Python worker."""
    if path not in _matchers:
        _matchers[path] = LongestMatch(sentence_pieces(path)), {}
    return _matchers[path]


def count_tokens(docs: DataFrame, vocabulary: str, mark: str = "▁", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_tokens: greedy longest-match pieces of each word with `mark` before it.

    Null and empty texts count 0; null ids stay; repeated rows stay rows of their own; an empty table gives no
    rows. A very long text is one string in one task, and takes time in proportion to its length. Other columns are
    not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = matcher(vocabulary)

        def one(word: bytes) -> int:
            n = automaton.count(mark + word.decode())
            if len(word) <= CACHE_CHARS:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known[word] = n
            return n

        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                own = (text.as_py() or "").encode().split()
                counts = list(map(known.get, own))
                if None in counts:
                    counts = [one(w) if n is None else n for w, n in zip(own, counts, strict=True)]
                words.append(len(own))
                tokens.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
