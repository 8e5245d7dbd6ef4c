"""Token counts with a whole-token shortcut, and token ids word by word."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introngrid.llm.words import by_batches, encoded, slices

#: The white space of the tokenizer's patterns, and its pattern for pre-tokens.
SPACE = "\t-\r \x85\xa0  -     　"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A piece of text that no pre-token crosses: a word with at most one space before it, or white space.
PIECE = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"
#: Distinct pieces whose counts a worker keeps.
CACHE = 500_000


def whole_tokens(tokenizer) -> frozenset[str]:
    """The vocabulary's strings that encode alone as exactly one token, and are one pre-token: proved once, before any text is read."""
    from tokenizers import pre_tokenizers

    decode = {c: b for b, c in byte_letters().items()}
    found = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            found.append(bytes(decode[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    alone = regex.compile(PRE_TOKEN)
    found = [x for x in found if (m := alone.match(x)) and m.end() == len(x)]
    return frozenset(x for x, e in zip(found, tokenizer.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return out


def merge_encoder(path: str, suffix: bytes = b""):
    """A tiktoken encoder of single pre-tokens with the file's vocabulary as ranks, or None if its ids don't follow the order of its merges.

    The file marks the end of a word by a suffix of its own; here that is the byte 0xFF, which no UTF-8 text holds.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, vocab = model["end_of_word_suffix"] or "", model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    if bool(end) != bool(suffix) or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        return None
    decode = {c: b for b, c in byte_letters().items()}
    ranks = {}
    for token, i in vocab.items():
        body = token.removesuffix(end) if end else token
        if all(c in decode for c in body):
            ranks[bytes(decode[c] for c in body) + (suffix if end and token.endswith(end) else b"")] = i
    return tiktoken.Encoding("single", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


#: Up to here Python, the patterns and the tokenizers agree on letters, case and composed forms.
PLAIN = regex.compile("[\x00-\u012F\u0131-\u017F]*")


class TokenCounter(dict):
    """Token count by piece: whole tokens directly, other pre-tokens by merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = whole_tokens(self.tokenizer)
        self.merge = merge_encoder(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.piece, self.pre = re.compile(PIECE), regex.compile(PRE_TOKEN)

    def __missing__(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        if self.merge is None or not PLAIN.fullmatch(piece):
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        else:
            n, whole = 0, self.whole
            for token in self.pre.findall(piece):
                n += 1 if token in whole else len(self.merge(token.encode()))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        n, at = 0, 0
        if any(s in text for s in self.specials):
            for m in self.cut.finditer(text):
                n += 1 + sum(map(self.__getitem__, self.piece.findall(text[at : m.start()])))
                at = m.end()
            text = text[at:]
        n += sum(map(self.__getitem__, self.piece.findall(text)))
        if len(self) > CACHE:
            self.clear()
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are the tokenizer's for the whole text without added special tokens; a special
    token's string inside a text is one token. Null text counts as empty: no bytes, no
    tokens. Rows are kept with repeats; an empty table gives no rows. tokenizer_path must
    be a byte-level BPE file that every worker can read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer_path)
        for part in slices(frames):
            texts = ["" if x is None else x for x in part["text"]]
            n = [counter.count(x) for x in texts]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_bytes": [len(encoded(x)) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return by_batches(narrow, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


class WordIds:
    """Ids of texts under a tokenizer that drops white space and so encodes words one by one; known words are looked up."""

    PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge, self.pre = merge_encoder(path, b"\xff"), regex.compile(self.PRE_TOKEN)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _many(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The words' ids in a row, and each word's number of ids."""
        texts = [w.decode("utf-8", "replace") for w in words]
        joined = "\n".join(texts)
        if self.merge is None or not PLAIN.fullmatch(joined) or any(s in joined for s in self.specials):
            if len(words) > 64:  # the odd words are in a few of the parts
                parts = [self._many(words[k : k + 64]) for k in range(0, len(words), 64)]
                return [i for ids, _ in parts for i in ids], [n for _, sizes in parts for n in sizes]
            lists = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
            return [i for ids in lists for i in ids], list(map(len, lists))
        ids, sizes, before, merge = [], [], 0, self.merge
        for token in self.pre.findall(joined.lower()):
            if token == "\n":
                sizes.append(len(ids) - before)
                before = len(ids)
            else:
                ids += merge(token.encode() + b"\xff")
        return ids, [*sizes, len(ids) - before]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids."""
        if len(self.index) > CACHE:
            self.clear()
        lists = [t.split() for t in texts]
        words = [w for ws in lists for w in ws]
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            ids, sizes = self._many(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.flat = np.concatenate((self.flat, np.array(ids, dtype=np.uint32)))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        first = self.ends[at]
        n = self.ends[at + 1] - first
        stop = np.cumsum(n)
        out = self.flat[np.repeat(first - (stop - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate(([0], stop))[np.cumsum([0, *map(len, lists)])]
        return out, np.diff(ends)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
