"""BPE by automaton: merges compiled, gadget by gadget, into a deterministic automaton over tokens; words are encoded by its
transitions and decoded by the labels of its arcs.

The automaton accepts the token sequences that BPE gives and no others. Before any merge one state loops on every base symbol.
The gadget of the merge (u, v) -> uv at rank r, laid over the automaton so far:

* every arc labelled u that enters a state t with an arc v is led to a copy of t without that arc: u is no more followed by v;
* every state with an arc u gets an arc uv to the state that v led to.

All arcs with one label enter one state, before and after a gadget, so a state is "after x as of rank r", copies share what they
don't change, and the compiled form is three tables: for each token its two parts and the rank that made it, and the set of arcs
removed, (u, v) with r. A transition x -> y is looked up by following the copies back: it is gone if (x, y) was removed in time;
else the younger of both tokens is replaced by the part that faced the other when it was made (y by its left part, x by its right
one), until two base symbols are left, which always have an arc. Answers are kept in a bounded transition table.

A word is read left to right. As every prefix of a word has exactly one accepted sequence, each position holds the one token that
ends there and the position before it; candidates come from a trie of reversed tokens and the transition from the token before
decides. Words are pre-split first, as the tokenizer file says, and a bounded table keeps the arcs of words seen.

Cases: null or empty text has no tokens; very long texts go through piece by piece; a token's string inside a text that the file
lists as added token is that token.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, ship, with_row

#: Entries of a worker's table of words, and of transitions; it starts anew beyond them.
MAX_WORDS = 300_000
MAX_ARCS = 300_000
#: Symbols of a word up to which positions are filled by recursion, as they are asked for.
DEEP = 200
#: White space as Unicode's property has it, which is what the file's \s means.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """The compiled merges; see the module's docstring."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_of_word: str):
        self.vocab, self.end_of_word = vocab, end_of_word
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        #: answers by x * size + y
        self.arcs: dict[int, bool] = {}
        self.size = max(vocab.values()) + 1
        for rank, (a, b) in enumerate(merges, 1):
            u, v = vocab[a], vocab[b]
            # the gadget is laid only where an arc v follows u by now, and a token has the gadget that made it first
            if not self.follows(u, v, rank - 1):
                continue
            self.removed[u, v] = rank
            x = vocab[a + b]
            if x not in self.born:
                self.left[x], self.right[x], self.born[x] = u, v, rank
        #: tokens that some gadget made, and the base symbols: the others of the vocabulary have no arc at all
        self.whole = {t for x, t in vocab.items() if t in self.born or len(x) - len(end_of_word) * x.endswith(end_of_word) == 1}
        self.ends: dict = {}
        for text, token in vocab.items():
            if token not in self.whole:
                continue
            node, last = self.ends, text.endswith(end_of_word) if end_of_word else False
            symbols = [*text[: -len(end_of_word) - 1], text[-len(end_of_word) - 1 :]] if last else list(text)
            for s in reversed(symbols):
                node = node.setdefault(s, {})
            node[None] = token

    def follows(self, x: int, y: int, rank: int) -> bool:
        """Whether the state after x has an arc y once the gadgets up to rank are laid."""
        born, removed = self.born, self.removed
        while True:
            if removed.get((x, y), rank + 1) <= rank:
                return False
            bx, by = born.get(x, 0), born.get(y, 0)
            if bx == by == 0:
                return True
            if x == y:  # its target, as of the rank before, had an arc to the left part
                x, y, rank = self.right[x], self.left[y], bx - 1
            elif by > bx:
                y, rank = self.left[y], by
            else:
                x, rank = self.right[x], bx - 1

    def arc(self, x: int, y: int) -> bool:
        """The final automaton's transition, from the table."""
        found = self.arcs.get(x * self.size + y)
        if found is None:
            if len(self.arcs) >= MAX_ARCS:
                self.arcs.clear()
            self.arcs[x * self.size + y] = found = self.follows(x, y, 1 << 60)
        return found

    def encode(self, symbols: list[str]) -> list[int]:
        """The tokens of a word given as base symbols, the last with the end-of-word suffix."""
        n = len(symbols)
        token: list[int | None] = [None] * (n + 1)
        before = [0] * (n + 1)
        if n > DEEP:  # fill the positions in order, so that last_token() never goes deep
            for i in range(1, n):
                self.last_token(symbols, i, token, before)
        self.last_token(symbols, n, token, before)
        out, i = [], n
        while i:
            out.append(token[i])
            i = before[i]
        return out[::-1]

    def last_token(self, symbols: list[str], i: int, token: list[int | None], before: list[int]) -> int:
        """The last token of the accepted sequence of the first i symbols; token and before keep it and its start."""
        node, at, found = self.ends, i, []
        while at:
            node = node.get(symbols[at - 1])
            if node is None:
                break
            at -= 1
            end = node.get(None)
            if end is not None:
                if not at:
                    token[i], before[i] = end, 0
                    return end
                found.append((end, at))
        arcs, size = self.arcs, self.size
        for end, at in reversed(found):
            if at:
                last = token[at]
                if last is None:
                    last = self.last_token(symbols, at, token, before)
                ok = arcs.get(last * size + end)
                if ok is None:
                    ok = self.arc(last, end)
                if not ok:
                    continue
            token[i], before[i] = end, at
            return end
        raise ValueError(f"no token ends at symbol {i} of {symbols}")


class WordTable(dict):
    """pre-split word -> ids as little-endian 32-bit integers."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.table = dict(enumerate(byte_symbols()))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        symbols = list(word.encode().decode("latin-1").translate(self.table))
        symbols[-1] += self.automaton.end_of_word
        self[word] = found = np.array(self.automaton.encode(symbols), dtype="<u4").tobytes()
        return found


class Codec:
    """A tokenizer file's normaliser, pre-split, automaton and labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"] or not split["invert"] or model["dropout"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path}: not a lower-case word-end BPE file")
        self.path, self.library = path, None
        self.white = regex.compile(f"[{WHITE}]+")
        self.rare = regex.compile("[^\\x00-\\u052f]")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", WHITE))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocab = model["vocab"]
        self.labels = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for text, i in [*vocab.items(), *self.added.items()]:
            self.labels[i] = text
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.table = WordTable(Automaton(vocab, merges, model["end_of_word_suffix"] or ""))

    def normal(self, text: str) -> str:
        if not text.isascii():
            # a capital sigma has one lower form here, wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.white.sub(" ", text).lower() if not text.isascii() else text.lower()

    def split(self, text: str) -> list[str]:
        """The normal form's words. Letters beyond Cyrillic are told from others by the tokenizer library's own tables, as its
        version of Unicode is not the one of regex; encoding remains the automaton's."""
        if text.isascii() or not self.rare.search(text):
            return self.words.findall(self.normal(text))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in piece]).decode() for piece, _ in pieces]

    def encode_text(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        get = self.table.__getitem__
        if self.cut and any(a in text for a in self.added):
            out = []
            for i, part in enumerate(self.cut.split(text)):
                out += [np.array([self.added[part]], dtype="<u4").tobytes()] if i % 2 else map(get, self.split(part))
            return b"".join(out)
        return b"".join(map(get, self.split(text)))

    def decode_ids(self, ids: bytes) -> str:
        """The labels of the arcs that ids stand for, joined by a space."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The file's codec, compiled once per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _spread(docs: DataFrame, text_col: str, path: str, columns: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    """docs with columns that make(codec, text) gives row by row, all other columns passed through as they are."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in {name for name, _, _ in columns}]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("t"))
    fields = ", ".join(f"{name} {sql}" for name, _, sql in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            made = [make(own, t) for t in byte_rows(batch.column("t"))]
            cols = list(zip(*made, strict=True)) if made else [()] * len(columns)
            arrays = [pa.array(c, type=kind) for c, (_, kind, _) in zip(cols, columns, strict=True)]
            yield pa.record_batch([batch.column("row"), *arrays], names=["row", *[name for name, _, _ in columns]])

    out = inner.mapInArrow(run, with_row(inner, fields))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[name for name, _, _ in columns])


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs plus ids (array<int>) of each whole text."""
    return _spread(docs, text_col, path, [("ids", pa.list_(pa.int32()), "array<int>")], lambda c, t: (np.frombuffer(c.encode_text(t.decode()), dtype="<i4"),))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens plus decoded (string); null ids decode to ''."""
    ship(tokens.sparkSession)
    raw = F.pandas_udf(lambda s: s.map(lambda x: codec(path).decode_ids(np.asarray(x if x is not None else [], dtype="<u4").tobytes())), "string")
    return tokens.withColumn("decoded", raw(F.col(ids_col)))


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs plus n_tokens, ids_sha256 and decoded_sha256: what encode() and then decode() give, reduced where they are made."""

    def make(c: Codec, text: bytes) -> tuple[int, str, str]:
        ids = c.encode_text(text.decode())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode_ids(ids).encode()).hexdigest()

    return _spread(docs, text_col, path, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], make)


def tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs plus n_tokens, ids (array<int>), ids_sha256 and decoded_sha256, from one pass over the texts."""

    def make(c: Codec, text: bytes) -> tuple[int, np.ndarray, str, str]:
        ids = c.encode_text(text.decode())
        return len(ids) // 4, np.frombuffer(ids, dtype="<i4"), hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode_ids(ids).encode()).hexdigest()

    columns = [("n_tokens", pa.int64(), "long"), ("ids", pa.list_(pa.int32()), "array<int>"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _spread(docs, text_col, path, columns, make)
