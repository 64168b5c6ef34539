"""Operator 3: packing by power-of-two decomposition.

A document's token ids, with a closing id, are cut into pieces of 2048 and of the powers of two of what is left;
each piece is one sequence of its own length, pieces of equal length share a bucket, and no sequence holds two
documents or any padding. Ids are exact: texts are cut at ASCII white space, which the vocabulary's tokenizer drops
and never joins over, and each distinct word goes through the tokenizer once for each worker. Where the tokenizer's file
says that it lower-cases and cuts between letters, digits and signs (`cuts_by_kind`), words are cut there too and A-Z
lowered first, so that "Word", "word," and "(word)" share one unit; units of one kind go through the tokenizer many at
once.

A null or empty text has the closing id alone: one piece of length 1. Repeated rows are packed again. Sequence ids are
unique over the result (task number and place); input columns besides the two named aren't read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.vocab import WordTable
from lodestone.llm.words import LOWER, SPACES, Texts, pieces, span_hashes, word_spans

LONGEST = 2048
CLOSE = 1
_READY: dict[str, TextIds] = {}


#: How a tokenizer's file says that it normalises and cuts by kind of character.
NORMALS = ["NFC", "Replace", "Lowercase"]
KINDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Kinds of bytes: other ASCII (also | of added tokens), ASCII and Latin letters (U+00C0 to U+027F), digits, signs, the
#: apostrophe (which may begin a contraction), beyond ASCII.
_OTHER, _LETTER, _DIGIT, _SIGN, _QUOTE, _WIDE = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x80:] = _WIDE
for _c in range(0x21, 0x7F):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _QUOTE if chr(_c) == "'" else _OTHER if chr(_c) == "|" else _SIGN
#: Whether a word is always cut between two kinds: no match of KINDS goes over these, and nothing composes over them.
_CUT = np.zeros((6, 6), bool)
_CUT[:, _DIGIT] = _CUT[_DIGIT, :_WIDE] = _CUT[_LETTER, [_SIGN, _QUOTE]] = _CUT[_SIGN, _LETTER] = True
_LATIN = rb"\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|\xC4[\x80-\xAF\xB1-\xBF]|[\xC5-\xC9][\x80-\xBF]"
#: What is one match of KINDS whatever stands beside it, white space between.
_ONE = re.compile(rb"(?:[A-Za-z]|" + _LATIN + rb")+|[0-9]|[!-/:-@\[-`{}~]+")
#: Units that go through the tokenizer as one text.
TOGETHER = 256


def cuts_by_kind(file: dict) -> bool:
    """Whether a tokenizer's file says that texts are cut as KINDS says, after NFC and lower-casing by character."""
    normal = (file.get("normalizer") or {}).get("normalizers") or []
    before = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    spaces = all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal if x["type"] == "Replace")
    parts = [x["type"] for x in before] == ["Split", "ByteLevel"] and before[0]["pattern"] == {"Regex": KINDS} and before[0]["behavior"] == "Removed" and before[0]["invert"] and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
    model = file["model"]
    ends = model["type"] == "BPE" and model.get("end_of_word_suffix") == END and not model.get("dropout") and not file.get("post_processor")
    added = all(re.fullmatch(r"<\|[a-z]+\|>", x["content"]) and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in file.get("added_tokens") or [])
    return [x["type"] for x in normal] == NORMALS and spaces and parts and ends and added


def kind_cuts(data: np.ndarray) -> np.ndarray:
    """Whether the kinds of bytes cut a word before each byte."""
    kind = _KIND[data]
    first = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    lead, next_ = data[first], data[first + 1]
    # Multiplication and division signs are no letters; a dotted capital I becomes a letter and a mark.
    first = first[(next_ >> 6 == 2) & ~((lead == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7))) & ~((lead == 0xC4) & (next_ == 0xB0))]
    kind[first] = kind[first + 1] = _LETTER
    out = np.zeros(len(data), bool)
    out[1:] = _CUT.reshape(-1)[kind[:-1] * np.uint8(6) + kind[1:]]
    return out


def lowered(data: np.ndarray, longest: int) -> np.ndarray:
    """A-Z in lower case, but before what may be a mark that composes with the letter, and where an added token could
    come about (of `longest` bytes at most)."""
    out = LOWER[data]
    mark = np.flatnonzero(data[1:] >= 0xCA)
    out[mark] = data[mark]
    token = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    for k in range(longest):
        at = np.minimum(token + k, len(data) - 1)
        out[at] = data[at]
    return out


class TextIds:
    """Token ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = WordTable(self._fill)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.by_kind = cuts_by_kind(file)
        self.longest = max((len(x["content"]) for x in file.get("added_tokens") or []), default=0)
        if self.by_kind:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for w, i in file["model"]["vocab"].items() if w.endswith(END)]] = True

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in texts], add_special_tokens=False)]

    def _fill(self, words: list[bytes]) -> list[list[int]] | tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.by_kind:
            return self._encoded(words)
        one = _ONE.fullmatch
        alone, together = [], []
        for i, w in enumerate(words):
            (together if one(w) else alone).append(i)
        order, flat, sizes = [], [], []
        for k in range(0, len(together), TOGETHER):
            some = together[k : k + TOGETHER]
            (ids,) = self._encoded([b" ".join([words[i] for i in some])])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some) or last[-1] != len(ids) - 1:
                alone += some
                continue
            order += some
            flat += ids
            sizes.append(np.diff(last, prepend=-1))
        lists = self._encoded([words[i] for i in alone])
        flat += [x for v in lists for x in v]
        sizes = np.concatenate([*sizes, np.fromiter(map(len, lists), np.int64, len(lists))])
        out = np.empty((2, len(words)), np.int64)
        out[:, order + alone] = np.cumsum(sizes) - sizes, sizes
        return np.array(flat, np.int32), out[0], out[1]

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the closing one after each text, and each text's count."""
        starts, ends, first = word_spans(texts, SPACES, kind_cuts(texts.data) if self.by_kind and len(texts.data) else None)
        n = len(texts)
        if self.by_kind and len(starts):
            texts = copy(texts)
            texts.data = lowered(texts.data, self.longest)
        if len(starts):
            at, size = self.table.look(texts, starts, ends, span_hashes(texts, starts, ends, lower=False))
            total = np.concatenate(([0], np.cumsum(size)))
            flat = self.table.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
            counts = total[first[1:]] - total[first[:-1]]
        else:
            flat, counts = np.zeros(0, np.int32), np.zeros(n, np.int64)
        out = np.empty(len(flat) + n, np.uint32)
        close = np.cumsum(counts + 1) - 1
        keep = np.ones(len(out), bool)
        keep[close] = False
        out[keep], out[close] = flat, CLOSE
        return out, counts + 1


def cuts(n: int) -> list[int]:
    """The binary lengths of a document of n ids."""
    rest = n % LONGEST
    return [LONGEST] * (n // LONGEST) + [1 << k for k in range(10, -1, -1) if rest >> k & 1]


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, bucket, bucket_slot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _READY:
            _READY[tokenizer] = TextIds(tokenizer)
        encoder, task = _READY[tokenizer], TaskContext.get().partitionId() << 33
        done, slots = 0, np.zeros(12, np.int64)
        for batch in pieces(batches, limit=4 << 20):
            ids, counts = encoder.ids(Texts(batch.column("text")))
            own = [cuts(n) for n in counts.tolist()]
            lengths = np.fromiter((x for o in own for x in o), np.int64)
            rows = np.repeat(np.arange(len(own)), [len(o) for o in own])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            base = np.concatenate(([0], np.cumsum(counts)[:-1]))
            bucket = np.log2(lengths).astype(np.int64)
            slot = np.empty(len(lengths), np.int64)
            for b in range(12):
                mine = bucket == b
                k = int(mine.sum())
                slot[mine] = task + slots[b] + np.arange(k)
                slots[b] += k
            step = max(1, (64 << 20) // (4 * LONGEST))
            for i in range(0, len(lengths), step):
                part = slice(i, i + step)
                offsets = np.concatenate((starts[part], ends[part][-1:])) * 4
                data = pa.py_buffer(ids[starts[i] : ends[part][-1]].astype("<u4", copy=False).tobytes())
                at = pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes())
                k = len(lengths[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(rows[part])), pa.array(starts[part] - base[rows[part]]), pa.array(lengths[part]),
                        pa.Array.from_buffers(pa.binary(), k, [None, at, data]), pa.array(counts[rows[part]]), pa.array(task + done + np.arange(k)),
                        pa.array(np.zeros(k, np.int64)), pa.array(bucket[part].astype(np.int32)), pa.array(slot[part]),
                    ],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket", "bucket_slot"],
                )
                done += k

    rows = df.selectExpr(f"`{id_col}` id", f"`{text_col}` text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, bucket_slot bigint").withColumnRenamed("id", id_col)
