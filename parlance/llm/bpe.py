"""Byte-pair encoding and decoding of whole texts.

The encoder finds every vocabulary entry in a word with an Aho-Corasick automaton, takes the longest one at each
position and keeps it if the pair with the token before it is compatible: the two would not have been merged
differently across their border. Where no entry fits it steps back one token. Each position is given up at most once,
so the time is linear, and the result is that of applying the merges by rank. Decoding reads slices of one string of
all entries by a table of offsets.

Texts: null counts as empty; an empty text has no tokens. Words are memoised within a worker, in a bounded table.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from parlance.llm.common import TwoGenerations, begin, in_arrow, slices, table

#: Stands for the end of a word inside the automaton; a private-use character that no byte is written as.
END = ""

#: Pairs of tokens whose compatibility is remembered.
PAIRS = 120_000


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write each byte as."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Words that a worker remembers in each of two generations, and in op1, where no other operator's memos are beside them.
MEMO, ROOMY = 80_000, 240_000


class WordBpe:
    """A vocabulary with end-of-word entries, as the tokenizers library's JSON files hold it. memo: words remembered, by which only the time and the memory change."""

    def __init__(self, path: str, memo: int = 0):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        normalizers = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if not self.suffix or normalizers != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"not a lower-case vocabulary with word ends: {path}")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.byte = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}

        inner = lambda s: s[: -len(self.suffix)] + END if s.endswith(self.suffix) else s
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            strings[i] = s
        # decoding: entry i is blob[offsets[i]:offsets[i + 1]]
        self.blob = "".join(strings)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).tolist()

        self.numbers = list(map(str, range(size)))
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            t = inner(s)
            self.length[i] = len(t)
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.before = [n - 1 for n in self.length]
        # the longest entry that an entry begins with, or -1
        known = {inner(s): i for s, i in vocab.items()}
        self.prefix = [-1] * size
        for t, i in known.items():
            self.prefix[i] = next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1)
        self.left, self.right = list(range(size)), list(range(size))
        # pairs of ids as one integer
        self.merged: dict[int, int] = {}
        last = -1
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            c = vocab[a + b if not a.endswith(self.suffix) else a]
            if c <= last:
                raise ValueError("ids do not follow the order of the merges")
            last = c
            self.left[c], self.right[c] = vocab[a], vocab[b]
            self.merged[vocab[a] << 32 | vocab[b]] = c
        self.whole = {inner(s): (i,) for s, i in vocab.items() if s.endswith(self.suffix)}
        self.path = path
        self.library = None
        self.memo = memo or MEMO
        self.forget()

    def forget(self) -> None:
        """Empties the memos."""
        self.compatible: dict[int, bool] = {}
        self.piece = TwoGenerations(self._piece, self.memo * 3 // 4)
        self.words = TwoGenerations(self._word, self.memo)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether both tokens stay as they are when they meet: no merge across their border comes before the merges that made them."""
        merged, left, right = self.merged.get, self.left, self.right
        limit = 1 << 60
        while True:
            c = merged(a << 32 | b)
            if c is not None and c < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece between borders, such as a run of letters, given as byte characters."""
        text = piece + END
        if text in self.whole:  # the longest entry at the first position, with no token before it
            return self.whole[text]
        n = len(text)
        at = [-1] * (n + 1)
        before = self.before
        for end, i in self.automaton.iter(text):
            at[end - before[i]] = i  # longer entries end later, so the longest one stays
        open_ = [True] * (n + 1)
        open_[n - 1] = False  # the last character takes the end mark with it
        length, prefix, compatible = self.length, self.prefix, self.compatible
        if len(compatible) > PAIRS:
            compatible.clear()
        tokens: list[int] = []
        pos, t, last = 0, at[0], -1
        while pos < n:
            while t >= 0:
                if open_[pos + length[t]]:
                    if last < 0:
                        break
                    pair = last << 32 | t
                    fits = compatible.get(pair)
                    if fits is None:
                        fits = compatible[pair] = self._compatible(last, t)
                    if fits:
                        break
                t = prefix[t]
            if t >= 0:
                tokens.append(t)
                pos += length[t]
                last, t = t, at[pos]
            else:  # nothing fits here: give the position up and go on to shorter entries before it
                open_[pos] = False
                t = tokens.pop()
                pos -= length[t]
                last = tokens[-1] if tokens else -1
        return tuple(tokens)

    def _in_bytes(self, piece: str) -> str:
        """A piece in byte characters."""
        return piece.encode().decode("latin-1").translate(self.byte)

    def _pieces(self, word: str) -> list[str]:
        """The pieces of a word in byte characters."""
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha():  # no apostrophe before the last character, so nothing is split off but that
                return [low[:-1], low[-1].translate(self.byte)]
            return self.pieces(low) if low.isprintable() else [p.translate(self.byte) for p in self.pieces(low)]
        if max(word) < "\u0250":  # letters of which every Unicode version says the same
            low = unicodedata.normalize("NFC", word).lower()
            return [self._in_bytes(low)] if low.isalpha() else [self._in_bytes(p) for p in self.pieces(low)]
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_file(self.path)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]

    def _piece(self, piece: str) -> tuple[str, int, str, tuple[int, ...]]:
        ids = self.encode_piece(piece)
        numbers = self.numbers
        return " ".join([numbers[i] for i in ids]), len(ids), self.decode(ids), ids

    def _word(self, word: str) -> tuple[str, int, str, tuple[int, ...]]:
        pieces = self._pieces(word)
        if not pieces:
            return "", 0, "", ()
        out = self.piece[pieces[0]]
        if len(pieces) == 2:  # most often a word and the mark after it
            a, n, b, ids = out
            c, k, d, more = self.piece[pieces[1]]
            return f"{a} {c}", n + k, f"{b} {d}", ids + more
        if len(pieces) > 2:
            a, n, b, ids = zip(*[self.piece[p] for p in pieces])
            return " ".join(a), sum(n), " ".join(b), tuple(itertools.chain.from_iterable(ids))
        return out

    def parts(self, text: str) -> list[tuple[str, int, str, tuple[int, ...]]]:
        """Of each word of a text: its ids as text, their number, what they decode to, and the ids. Words without ids are left out."""
        if self.specials is not None and "<|" in text and self.specials.search(text):
            out, start = [], 0
            for m in self.specials.finditer(text):
                out += self.parts(text[start : m.start()])
                i = self.special[m[0]]
                out.append((str(i), 1, self.decode((i,)), (i,)))
                start = m.end()
            return out + self.parts(text[start:])
        words = text.split() if not _ODD_SPACE.search(text) else _SPACE.split(text)
        return [x for x in map(self.words.__getitem__, words) if x[1]]

    def encode(self, text: str | None) -> list[int]:
        return [i for x in self.parts(text or "") for i in x[3]]

    def decode(self, ids) -> str:
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[i] : at[i + 1]] for i in ids])


#: Python's split() also takes these control characters for white space.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


@functools.lru_cache(maxsize=2)
def load(path: str, memo: int = MEMO) -> WordBpe:
    """One vocabulary for each worker process."""
    return WordBpe(path, memo)


def _fields(df: DataFrame, keep: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in keep)


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] = ("doc_id",), ids: bool = True, digests: bool = False, memo: int = MEMO) -> DataFrame:
    """Tokens of every text: keep's columns, n_tokens, ids (if asked for), and digests of the ids and of the decoded text (if asked for).

    One pass without a shuffle. Null and empty texts: no tokens. Rows, repeated ones too, stay one for one; other
    columns than keep's are left out, so that names can't clash.
    """
    keep = list(keep)
    schema = _fields(df, keep) + ", n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", load.cache_clear)
        bpe = load(path, memo)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        names = [*keep, "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
        for whole in batches:
            for batch in slices(whole, len(keep)):
                n, flat, ends, a, b = [], array("i"), [0], [], []
                for text in batch.column(len(keep)):
                    parts = bpe.parts(text.as_py() or "")
                    n.append(sum([x[1] for x in parts]))
                    if ids:
                        for x in parts:
                            flat.extend(x[3])
                        ends.append(len(flat))
                    if digests:
                        a.append(sha(" ".join([x[0] for x in parts])))
                        b.append(sha(" ".join([x[2] for x in parts])))
                columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32))))
                columns += [pa.array(x, pa.string()) for x in (a, b)] * digests
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*[df[c] for c in keep], df[text_col]).transform(in_arrow, run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep's columns and decoded: the entries of the ids, joined as the library does without a decoder. Null ids: an empty text."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", load.cache_clear)
        bpe = load(path)
        for batch in batches:
            out = [bpe.decode(x.as_py() or []) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, "decoded"])

    return df.select(*[df[c] for c in keep], df[ids_col]).transform(in_arrow, run, _fields(df, keep) + ", decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Numbers of tokens and digests of tokens and decoded texts, of all documents."""
    return encode(table(spark, sf_dir, "documents"), path or default_path(), ids=False, digests=True, memo=ROOMY)
