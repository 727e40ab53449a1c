"""Token counts of a unigram model, by dynamic programming over a trie of pre-tokens.

A text is cut at white space into pre-tokens.  The distinct pre-tokens of a
batch are sorted, which lays the trie out in depth-first order: consecutive
ones share the prefix that lies on the current path, and the forward scores of
that prefix (the best segmentation of its first i characters) are kept on a
stack and computed once.  The end of a pre-token is a terminal node, where its
token count and score are stored.  A document's count is the sum over its
pre-tokens.

The vocabulary is a public one with its own scores, which is read and not
trained.  Scores that are negative ranks become log probabilities by Zipf's
law, log(1 / ((rank + 1) * H)), with H the harmonic number of the size.  A
character that no piece covers costs its UTF-8 bytes as tokens at
``byte_score`` each.  Ties go to fewer tokens.

Defined results: null and empty texts have no pre-tokens and no tokens; a very
long pre-token costs its length times the longest piece; repeated rows each get
their own counts; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "▁"
#: Distinct pre-tokens whose terminal counts a worker keeps; the table is emptied when full.
KEPT = 400_000
LONGEST_KEPT = 64
ROWS = 500


class Unigram:
    def __init__(self, scores: dict[str, float], byte_score: float | None = None):
        self.byte_score = min(scores.values(), default=0.0) - 2.0 if byte_score is None else byte_score
        self.longest = max(map(len, scores), default=1)
        # Reversed trie: walked backwards from a position, it gives all pieces that end there.
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.terminals: dict[str, tuple[int, float]] = {}

    def extend(self, text: str, scores: list[float], counts: list[int]) -> None:
        """Append the forward score and count of the prefix that ends with text's character number len(scores)."""
        end = len(scores)
        width = len(text[end - 1].encode("utf-8", "surrogatepass"))
        best, tokens = scores[end - 1] + width * self.byte_score, counts[end - 1] + width
        node, i = self.root, end - 1
        while i >= 0 and (node := node.get(text[i])) is not None:
            score = node.get("")
            if score is not None:
                score += scores[i]
                if score > best or score == best and counts[i] + 1 < tokens:
                    best, tokens = score, counts[i] + 1
            i -= 1
        scores.append(best)
        counts.append(tokens)

    def count(self, distinct: list[str]) -> None:
        """Store the terminal count and score of each pre-token, prefixes being shared in sorted order."""
        scores, counts, before = [0.0], [0], ""
        for word in sorted(distinct):
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :], counts[shared + 1 :]
            for _ in range(len(word) - shared):
                self.extend(word, scores, counts)
            before = word
            self.terminals[word] = (counts[-1], scores[-1])

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        cut = [[START + w for w in (t or "").split()] for t in texts]
        if len(self.terminals) > KEPT:
            self.terminals.clear()
        done = self.terminals
        self.count(list({w for ws in cut for w in ws if w not in done}))
        out = []
        for ws in cut:
            got = [done[w] for w in ws]
            out.append((len(ws), sum([g[0] for g in got]), math.fsum([g[1] for g in got])))
        for w in [w for ws in cut for w in ws if len(w) > LONGEST_KEPT]:
            done.pop(w, None)
        return out


def read_scores(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece file and their log probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if all(s <= 0 and s == int(s) for s in pieces.values()):
        h = sum(1 / (r + 1) for r in range(len(pieces)))
        pieces = {p: -math.log((1 - s) * h) for p, s in pieces.items()}
    return pieces


@cache
def model(path: str) -> Unigram:
    """One model for each worker process and file."""
    return Unigram(read_scores(path))


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens, log_prob for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, tokens, score = zip(*m.texts(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, log_prob double")
