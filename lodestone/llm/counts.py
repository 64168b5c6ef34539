"""Operator 5: token counts by dynamic programming over a trie.

Texts are cut at ASCII white space into pre-tokens, each with the word mark in front. The distinct pre-tokens of a batch that the worker hasn't met
go into a trie, depth by depth; a node's best unigram score is computed once from the scores of the nodes above it,
over all vocabulary pieces that end there, so a prefix that words share costs once. The count stored at a word's last
node is the number of pieces on its best way (ties: fewer pieces). Pieces are those of a public SentencePiece file,
whose own numbers are ranks of merges and no probabilities; fit_scores gives unigram scores: a piece's score is
ln((n + 1) / (N + V)), n being how often it comes when the file's own merges cut all pre-tokens of all texts, N the sum
of these and V the vocabulary's size. A single byte that is no piece scores BYTE.

A pre-token of over LONGEST bytes is scored whole by the same recurrence along its bytes, without the trie.

Null or empty texts have 0 tokens; repeated rows are counted each; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.vocab import WordTable
from lodestone.llm.words import _BASE, SPACES, Texts, mix, pieces, span_hashes, word_spans

MARK = "▁".encode()
LONGEST = 256
BYTE = -40.0
_READY: dict[str, Unigram] = {}
_CUTS: dict[str, Merges] = {}


def ordinary_pieces(path: str) -> dict[int, bytes]:
    """The ordinary pieces of a SentencePiece file by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {i: model.id_to_piece(i).encode() for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class Merges:
    """The file's own cuts of words, met once a worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = WordTable(lambda words: self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1))

    def tally(self, texts: Texts) -> np.ndarray:
        """How often each id comes in these texts."""
        out = np.zeros(self.model.vocab_size(), np.int64)
        starts, ends, _ = word_spans(texts, SPACES)
        if len(starts):
            at, size = self.table.look(texts, starts, ends, span_hashes(texts, starts, ends, lower=False))
            total = np.concatenate(([0], np.cumsum(size)))
            out += np.bincount(self.table.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])], minlength=len(out))
        return out


def fit_scores(df: DataFrame, vocabulary: str, text_col: str = "text") -> dict[bytes, float]:
    """The unigram score of each ordinary piece, from all texts; the driver gets one number a piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _CUTS:
            _CUTS[vocabulary] = Merges(vocabulary)
        cuts = _CUTS[vocabulary]
        tally = np.zeros(cuts.model.vocab_size(), np.int64)
        for batch in pieces(batches, limit=4 << 20):
            tally += cuts.tally(Texts(batch.column("text")))
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tally[at])], names=["piece", "n"])

    known = ordinary_pieces(vocabulary)
    rows = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(work, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    seen = {r["piece"]: r["n"] for r in rows.collect()}
    total = sum(seen.values()) + _size(vocabulary)
    return {piece: float(np.log((seen.get(i, 0) + 1) / total)) for i, piece in known.items()}


def _size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()


class Unigram:
    """The trie's programme for one vocabulary."""

    def __init__(self, scores: dict[bytes, float]):
        self.pieces = scores
        self.table = WordTable(self._fill)
        keys = list(scores)
        texts = Texts(pa.array(keys, pa.binary()))
        hashes = self._of(texts)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.scores = np.array([scores[k] for k in keys])[order]
        self.lengths = sorted({len(k) for k in keys} | {1})
        self.slots = np.zeros(1 << 20, bool)
        self.slots[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _of(texts: Texts) -> np.ndarray:
        """Hashes of whole strings: polynomials with the first byte's power highest, mixed with their lengths."""
        sizes, data = texts.sizes, mix(texts.data.astype(np.uint64), 9)
        out = np.zeros(len(texts), np.uint64)
        with np.errstate(over="ignore"):
            for d in range(int(sizes.max(initial=0))):
                live = np.flatnonzero(sizes > d)
                out[live] = out[live] * np.uint64(_BASE) + data[texts.offsets[:-1][live] + d]
        return mix(out + sizes.astype(np.uint64))

    def _look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these hashes are pieces, and their scores there."""
        some = np.flatnonzero(self.slots[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        good = self.hashes[at] == h[some]
        return some[good], self.scores[at[good]]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces on the best way through each distinct string."""
        texts = Texts(pa.array(words, pa.binary()))
        sizes, start = texts.sizes, texts.offsets[:-1]
        data = mix(texts.data.astype(np.uint64), 9)
        n = len(words)
        # By depth: the node of each word, and the nodes' hash, best score and count; the last len(longest piece) depths are needed.
        node = np.zeros(n, np.int64)
        depth = [(node, np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
        keep, out, power = self.lengths[-1], np.zeros(n, np.int64), [1]
        live = np.arange(n)
        for d in range(1, int(sizes.max(initial=0)) + 1):
            live = live[sizes[live] >= d]
            before = depth[-1]
            with np.errstate(over="ignore"):
                h = before[1][before[0][live]] * np.uint64(_BASE) + data[start[live] + d - 1]
            hashes, first, back = np.unique(h, return_index=True, return_inverse=True)
            node = np.zeros(n, np.int64)
            node[live] = back.reshape(-1)
            word = live[first]
            best, count = np.full(len(hashes), -np.inf), np.zeros(len(hashes), np.int64)
            power.append(power[-1] * _BASE & (1 << 64) - 1)
            for size in self.lengths:
                if size > d:
                    break
                above = depth[-size]
                at = above[0][word]
                with np.errstate(over="ignore"):
                    part = mix(hashes - above[1][at] * np.uint64(power[size]) + np.uint64(size))
                hit, score = self._look(part)
                if size == 1:
                    value = np.full(len(hashes), BYTE)
                    value[hit] = score
                    hit, score = np.arange(len(hashes)), value
                total, pieces_n = above[2][at[hit]] + score, above[3][at[hit]] + 1
                better = (total > best[hit] + 1e-9) | (np.abs(total - best[hit]) <= 1e-9) & (pieces_n < count[hit])
                best[hit[better]], count[hit[better]] = total[better], pieces_n[better]
            depth.append((node, hashes, best, count))
            if len(depth) > keep + 1:
                depth.pop(0)
            done = live[sizes[live] == d]
            out[done] = count[node[done]]
        return out

    def long_count(self, word: bytes) -> int:
        """Pieces on the best way through one string, byte by byte; the last len(longest piece) places are needed."""
        keep = self.lengths[-1] + 1
        best, count = [0.0] * keep, [0] * keep
        for d in range(1, len(word) + 1):
            top, least = -np.inf, 0
            for size in self.lengths:
                if size > d:
                    break
                score = self.pieces.get(word[d - size : d], BYTE if size == 1 else None)
                if score is None:
                    continue
                total, n = best[(d - size) % keep] + score, count[(d - size) % keep] + 1
                if total > top + 1e-9 or abs(total - top) <= 1e-9 and n < least:
                    top, least = total, n
            best[d % keep], count[d % keep] = top, least
        return count[len(word) % keep]

    def _fill(self, words: list[bytes]) -> list[list[int]]:
        short = [MARK + w for w in words if len(w) <= LONGEST]
        known = iter(self.counts(short).tolist())
        return [[next(known) if len(w) <= LONGEST else self.long_count(MARK + w)] for w in words]

    def totals(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        starts, ends, first = word_spans(texts, SPACES)
        if not len(starts):
            return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        at, _ = self.table.look(texts, starts, ends, span_hashes(texts, starts, ends, lower=False))
        total = np.concatenate(([0], np.cumsum(self.table.pool[at], dtype=np.int64)))
        return total[first[1:]] - total[first[:-1]], np.diff(first)


def token_counts(df: DataFrame, vocabulary: str, scores: dict[bytes, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pretokens, n_tokens; vocabulary is a SentencePiece file that each executor has, scores are fit_scores(df) unless given."""
    scores = fit_scores(df, vocabulary, text_col) if scores is None else scores
    # One number a piece of the vocabulary.
    held = df.sparkSession.sparkContext.broadcast(scores)
    key = hashlib.md5(repr(sorted(scores.items())).encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Unigram(held.value)
        for batch in pieces(batches, limit=4 << 20):
            tokens, words = _READY[key].totals(Texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words), pa.array(tokens)], names=["id", "n_pretokens", "n_tokens"])

    rows = df.selectExpr(f"`{id_col}` id", f"`{text_col}` text")
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("id", id_col)
