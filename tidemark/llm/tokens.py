"""BPE encoding and decoding: texts in parallel, long unsplit stretches by tree concatenation.

White space never enters a token, so a text is encoded chunk by chunk and equal chunks are encoded once per worker. A text
longer than `segment` characters is cut at spaces into rows of their own. A stretch that the pre-tokenizer leaves whole
for more than `leaf` characters is cut in half again and again; the leaves are encoded in parallel tasks, and neighbours
are joined by encoding growing windows around the cut until the outermost tokens of both sides come out as they were.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, parts, text_bytes, written

SEGMENT = 50_000  # characters of a row that is encoded in one go
LEAF = 4_000  # characters of an unsplit stretch that is encoded in one go
CACHED = 400_000  # words whose ids a worker remembers
WINDOW = 8  # tokens on either side of a cut in the first window


PLAIN = re.compile("[ \\n\\r\\t!-~À-ÖØ-öø-įĴ-ňŊ-ž]*")
SPLIT = re.compile("[a-zß-öø-įĴ-ňŊ-ž]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[!-/:-@\\[-`{-~]+")


def byte_chars() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 ones as themselves, the others
    in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


BYTE_CHARS = byte_chars()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Word of the pre-tokenizer -> its ids, worked out once per distinct word; emptied when it holds too many."""

    def __init__(self, enc: Encoder):
        super().__init__()
        self.model = enc.whole.model
        self.enc = enc

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        spelled = word if word.isascii() else "".join(map(BYTE_CHARS.__getitem__, word.encode()))
        if len(word) > self.enc.leaf:
            return self.enc.unsplit(word)
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids


class Encoder:
    """The tokenizers library's encoding of whole texts, with a memory of chunks; one per worker."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.path = path
        self.leaf = leaf
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.strings = [self.whole.id_to_token(i) for i in range(size)]
        self.known: dict[str, bytes] = {"": b""}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # on plain texts this library's normalizer and word split are lower-casing and SPLIT
        form = f"{self.whole.normalizer} {self.whole.pre_tokenizer}"
        self.words = Words(self) if all(x in form for x in ("Lowercase", "ByteLevel", "p{N}]|")) else None

    def stretch_models(self) -> tuple:
        """Tokenizers of the same merges for pieces of a stretch: without a word end, and for the last piece with it. Built
        when a stretch is first met."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        out = []
        for end in ({}, {"end_of_word_suffix": model.get("end_of_word_suffix") or ""}):
            own = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **end))
            own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            out.append(own)
        return tuple(out)

    @cached_property
    def inner_and_last(self) -> tuple:
        return self.stretch_models()

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not remembered."""
        if len(self.known) > CACHED // 4:
            self.known = {"": b""}
        rest = []
        for c in chunks:
            if len(c) > self.leaf:
                self.known[c] = self.long_chunk(c)
            else:
                rest.append(c)
        if rest:
            found = self.whole.encode(rest, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, dtype="<u4").tobytes()
            at = np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
            ends = np.searchsorted(at, np.arange(len(rest) + 1))
            for i, c in enumerate(rest):
                self.known[c] = raw[4 * ends[i]:4 * ends[i + 1]]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.words is not None and PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, SPLIT.findall(text.lower())))
        chunks = text.replace("\n", " ").split(" ")
        own = set(chunks)
        self.learn(sorted(own.difference(self.known)))
        if not self.known.keys() >= own:  # emptied before
            self.learn(sorted(own.difference(self.known)))
        return b"".join(map(self.known.__getitem__, chunks))

    def stretches(self, chunk: str) -> list[tuple[str, bool]]:
        """A chunk as (text, unsplit) in order: unsplit stretches of more than `leaf` characters apart from the rest."""
        if any(s in chunk for s in self.special):
            return [(chunk, False)]
        plain = self.whole.normalizer.normalize_str(chunk)
        out: list[tuple[str, bool]] = []
        from tokenizers import pre_tokenizers  # the word split alone, before bytes become characters

        words = self.whole.pre_tokenizer[0] if hasattr(self.whole.pre_tokenizer, "__getitem__") else pre_tokenizers.Split("", "isolated")
        for word, _ in words.pre_tokenize_str(plain):
            unsplit = len(word) > self.leaf
            if not unsplit and out and not out[-1][1]:
                out[-1] = (f"{out[-1][0]} {word}", False)
            else:
                out.append((word, unsplit))
        return out

    def halves(self, word: str) -> list[str]:
        """Leaves of the tree of halves of an unsplit stretch."""
        if len(word) <= self.leaf:
            return [word]
        mid = len(word) // 2
        return self.halves(word[:mid]) + self.halves(word[mid:])

    def piece(self, word: str, last: bool) -> list[int]:
        return self.inner_and_last[last].encode(word, add_special_tokens=False).ids

    def spelled(self, ids: list[int]) -> str:
        return "".join(self.strings[i] for i in ids)

    def joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Ids of two neighbouring pieces of a stretch together. Two adjacent tokens of an encoding stay as they are
        whatever stands around them, so a window whose outermost tokens come out unchanged settles the join."""
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            text = self.spelled(a + b)
            ends = last and all_right
            suffix = "</w>"
            text = text.removesuffix(suffix) if ends else text
            again = self.bytes_piece(text, ends)
            if (all_left or again[0] == a[0]) and (all_right or again[-1] == b[-1]):
                return left[:len(left) - len(a)] + again + right[len(b):]
            size *= 2

    def bytes_piece(self, text: str, last: bool) -> list[int]:
        """Ids of text that is in the vocabulary's byte characters already."""
        model = self.inner_and_last[last].model
        return [t.id for t in model.tokenize(text)]

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Ids of a stretch from those of its leaves, joined in pairs level by level."""
        level = [(p, k == len(leaves) - 1) for k, p in enumerate(leaves)]
        while len(level) > 1:
            up = [(self.joined(level[k][0], level[k + 1][0], level[k + 1][1]), level[k + 1][1]) for k in range(0, len(level) - 1, 2)]
            level = up + level[len(level) - len(level) % 2:]
        return level[0][0]

    def long_chunk(self, chunk: str) -> bytes:
        out = b""
        for text, unsplit in self.stretches(chunk):
            out += self.unsplit(text) if unsplit else np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def unsplit(self, word: str) -> bytes:
        leaves = self.halves(word)
        return np.array(self.tree([self.piece(x, k == len(leaves) - 1) for k, x in enumerate(leaves)]), dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: its token strings with spaces."""
        if self.whole.decoder is not None:
            return self.whole.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """The worker's encoder; Spark reuses workers, so later tasks find its memory filled."""
    if (path, leaf) not in _ENCODERS:
        _ENCODERS[path, leaf] = Encoder(path, leaf)
    return _ENCODERS[path, leaf]


def encode(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", ids_col: str = "ids", segment: int = SEGMENT,
           leaf: int = LEAF) -> DataFrame:
    """docs with the token ids of every whole text in ids_col: binary, little-endian unsigned 32-bit integers.

    Texts of at most `segment` characters take one narrow pass. The rows of longer ones are written once with a row number,
    cut into rows at spaces and in halves, encoded in parallel and put together per row; what moves is those texts alone.
    A null or empty text has no ids. Repeated rows stay. A column named ids_col is replaced.
    """
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.drop(ids_col) if ids_col.lower() in {c.lower() for c in docs.columns} else docs

    @F.pandas_udf(T.BinaryType())
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary, leaf)
        for part in parts(texts):
            yield pd.Series([enc.encode(bytes(t).decode("utf-8", "replace")) for t in part], dtype=object)

    size = F.coalesce(F.length(F.col(text_col)), F.lit(0))
    short = docs.filter(size <= segment).withColumn(ids_col, whole(text_bytes(F.col(text_col))))
    row, part, kind, piece = (fresh(docs, c) for c in ("__row", "__part", "__kind", "__piece"))
    # a written table fixes the row numbers, whatever is computed again
    long = written(docs.filter(size > segment).withColumn(row, F.monotonically_increasing_id()), "long-texts")

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, leaf)
        for frame in it:
            for r, t in zip(frame[row], frame[text_col]):
                pieces = list(segments(enc, t, segment))
                for at in range(0, len(pieces), 256):
                    own = pieces[at:at + 256]
                    yield pd.DataFrame({row: r, part: range(at, at + len(own)), kind: [k for k, _ in own], piece: [x for _, x in own]})

    def ids_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, leaf)
        for frame in it:
            out = [enc.encode(x) if k == 0 else np.array(enc.piece(x, k == 3), dtype="<u4").tobytes() for k, x in zip(frame[kind], frame[piece])]
            yield frame[[row, part, kind]].assign(**{ids_col: out})

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(vocabulary, leaf)
        out, leaves = [], []
        frame = frame.sort_values(part)
        for k, ids in zip(frame[kind], frame[ids_col]):
            if k == 0:
                out.append(bytes(ids))
                continue
            leaves.append(np.frombuffer(bytes(ids), dtype="<u4").tolist())
            if k == 3:
                out.append(np.array(enc.tree(leaves), dtype="<u4").tobytes())
                leaves = []
        return pd.DataFrame({row: [frame[row].iloc[0]], ids_col: [b"".join(out)]})

    pieces = long.select(row, text_col).mapInPandas(cut, f"`{row}` long, `{part}` long, `{kind}` int, `{piece}` string")
    coded = pieces.repartition(row, part).mapInPandas(ids_of, f"`{row}` long, `{part}` long, `{kind}` int, `{ids_col}` binary")
    ids = coded.groupBy(row).applyInPandas(together, f"`{row}` long, `{ids_col}` binary")
    joined = long.join(ids, row, "left").withColumn(ids_col, F.coalesce(F.col(ids_col), F.lit(b"")))
    return short.unionByName(joined.drop(row))


def segments(enc: Encoder, text: str, segment: int) -> Iterator[tuple[int, str]]:
    """(kind, text) pieces of a long text in order: 0 encoded as it is, 1 a leaf of an unsplit stretch, 3 its last leaf."""
    held: list[str] = []
    size = 0
    for chunk in text.replace("\n", " ").split(" "):
        if len(chunk) > enc.leaf:
            if held:
                yield 0, " ".join(held)
                held, size = [], 0
            for part, unsplit in enc.stretches(chunk):
                if not unsplit:
                    yield 0, part
                    continue
                leaves = enc.halves(part)
                for k, leaf in enumerate(leaves):
                    yield (3 if k == len(leaves) - 1 else 1), leaf
            continue
        held.append(chunk)
        size += len(chunk) + 1
        if size >= segment:
            yield 0, " ".join(held)
            held, size = [], 0
    if held:
        yield 0, " ".join(held)


def decode(docs: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the decoded text of ids_col in text_col, which replaces a column of that name; null ids decode to ''."""
    vocabulary = vocabulary or default_vocabulary()

    @F.pandas_udf(T.StringType())
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for part in parts(ids):
            yield pd.Series([enc.decode(bytes(x) if x is not None else b"") for x in part], dtype=object)

    return docs.withColumn(text_col, text(F.col(ids_col)))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
