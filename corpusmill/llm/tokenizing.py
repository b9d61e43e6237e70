"""Per-process tokenizers: loaded once, with a bounded memo of words where words are independent of their neighbours."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Words a process remembers before it starts anew.
MEMO_WORDS = 1_000_000
#: Characters of a text encoded in one call where the text may be cut.
PIECE_CHARS = 1 << 16
#: A cut before white space that follows a letter or digit: byte-level patterns never match across it.
_CUT = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")


def safe_pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Cut a long text where an ASCII letter or digit is followed by a space or line feed.

    Patterns of the ` ?\\p{L}+|...|\\s+` family have no match that holds white space
    after another character, and no look-behind, so matches left and right
    of such a cut are those of the whole text; so are those of patterns that drop white space.
    A stretch without a cut stays whole.
    """
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        found = _CUT.search(text, start + most)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str):
    """A tiktoken encoding from a local rank file, without special tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _drops_space(spec: dict) -> bool:
    """Whether the file's pre-tokenizer throws white space away, so that words are encoded independently."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    if first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    pattern = first.get("pattern", {}).get("Regex", "")
    return not re.search(r"(?<!\[\^)\\s|\s", pattern)


class _Memo(dict):
    """Word to its number; an unknown word gets the next number and is noted as pending."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.pending.append(word)
        return n


class JsonTokenizer:
    """A `tokenizers` file. counts(texts) gives the number of ids of each text, by the library's batch encoding.

    ids(texts) gives for each text its ids as little-endian uint32 bytes; where white space is dropped, each distinct word is
    encoded by the library once.
    Words have numbers in a bounded memo; ids and counts of a text are gathered by number from flat arrays.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_word = _drops_space(json.load(f))
        self._clear()

    def _clear(self) -> None:
        self.memo, self.size, self.flat, self.first = _Memo(), np.zeros(0, np.int32), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        number, cut = self._numbers(texts)
        size = self.size[number]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = np.arange(ends[-1]) + np.repeat(self.first[number] - ends[:-1], size)
        raw, edge = self.flat[at].tobytes(), (4 * ends[cut]).tolist()
        return [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, and where each text's begin."""
        if len(self.memo) > MEMO_WORDS:
            self._clear()
        number: list[int] = []
        cut = [0]
        known = self.memo.__getitem__
        for t in texts:
            number += map(known, t.encode().split())
            cut.append(len(number))
        if self.memo.pending:
            self._learn()
        return np.asarray(number, np.int64), np.asarray(cut)

    def _learn(self) -> None:
        words, self.memo.pending = [w.decode() for w in self.memo.pending], []
        sizes, flat = np.zeros(len(words), np.int32), [self.flat]
        # Words with special strings or of great length go alone, others joined by spaces; offsets tell them apart again.
        alone = [i for i, w in enumerate(words) if "<" in w or len(w) > 200]
        rest = np.setdiff1d(np.arange(len(words)), alone)
        groups = [rest[i : i + 400].tolist() for i in range(0, len(rest), 400)]
        order: list[int] = []
        for a in range(0, len(groups), 16):
            part = groups[a : a + 16]
            for g, e in zip(part, self.tok.encode_batch([" ".join([words[i] for i in g]) for g in part], add_special_tokens=False), strict=True):
                starts = np.cumsum([0, *[len(words[i]) + 1 for i in g]])
                at = np.fromiter((x[0] for x in e.offsets), np.int64, len(e.offsets))
                sizes[g] = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(g))
                flat.append(np.asarray(e.ids, "<u4"))
                order += g
        for i in alone:
            ids = self.tok.encode(words[i], add_special_tokens=False).ids
            sizes[i] = len(ids)
            flat.append(np.asarray(ids, "<u4"))
            order.append(i)
        first = np.zeros(len(words), np.int64)
        first[order] = len(self.flat) + np.concatenate([[0], np.cumsum(sizes[order], dtype=np.int64)])[:-1]
        self.flat, self.size, self.first = np.concatenate(flat), np.concatenate([self.size, sizes]), np.concatenate([self.first, first])


class PieceTokenizer:
    """A sentencepiece model; texts are encoded whole, as its white-space marks depend on the neighbours."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x, "<u4").tobytes() for x in self.sp.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """By the ending: sentencepiece for .model, tokenizers otherwise."""
    return PieceTokenizer(path) if path.endswith(".model") else JsonTokenizer(path)
