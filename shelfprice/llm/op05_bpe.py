"""BPE encoding and decoding by batched merge rounds in numpy."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import map_batches, read_table

#: Words whose ids a Python worker remembers before it starts anew.
CACHE_WORDS = 200_000
#: Bytes of text that are encoded at once: the words and the arrays of a run take many times its bytes.
RUN_BYTES = 512 << 10
NO_RANK = np.iinfo(np.int32).max

# Fixed values of the vocabulary's pre-tokenizer: what a word is, in any script and in plain ASCII.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+", re.ASCII)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free code from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A word-end BPE vocabulary as arrays: merge pairs sorted by key, symbols of bytes, strings of ids."""

    tokens: list[str]
    special: dict[str, int]
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    inner: np.ndarray
    final: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, suffix = content["model"], content["model"]["end_of_word_suffix"]
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for text, i in [*ids.items(), *special.items()]:
            tokens[i] = text
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([ids[a] * len(tokens) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return Vocabulary(
            tokens, special, keys[order], order.astype(np.int32),
            np.array([ids[a + b] for a, b in pairs], np.int32),
            np.array([ids[c] for c in byte_letters()], np.int32),
            np.array([ids[c + suffix] for c in byte_letters()], np.int32),
        )


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words, end to end, and the number of ids of each word. No word is empty.

    All symbols lie in one flat array. A round looks up the keys of all neighbouring pairs by binary search, finds
    each word's lowest rank and merges that pair wherever the word has it, from left to right.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    symbols = vocabulary.inner[data]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = vocabulary.final[data[ends - 1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_at, done_ids, done_owner = [], [], []
    position = np.arange(len(symbols))
    while len(symbols):
        keys = symbols[:-1].astype(np.int64) * len(vocabulary.tokens) + symbols[1:]
        place = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
        known = (vocabulary.keys[place] == keys) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(known, vocabulary.ranks[place], NO_RANK), NO_RANK)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(symbols)))
        lowest = np.repeat(lowest, sizes)
        open_word = lowest < NO_RANK
        if not open_word.all():
            # Words without a known pair are complete and leave the rounds.
            closed = ~open_word
            done_at.append(position[closed])
            done_ids.append(symbols[closed])
            done_owner.append(owner[closed])
            symbols, owner, rank, lowest, position = (x[open_word] for x in (symbols, owner, rank, lowest, position))
            if not len(symbols):
                break
        hit = rank == lowest
        # In a run of overlapping hits, such as of "aa" in "aaaa", every second one counts, from its start.
        starts = hit & ~np.append(False, hit[:-1])
        run_start = np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
        hit &= (np.arange(len(hit)) - run_start) % 2 == 0
        symbols = np.where(hit, vocabulary.merged[np.where(hit, rank, 0)], symbols)
        keep = ~np.append(False, hit[:-1])
        symbols, owner, position = symbols[keep], owner[keep], position[keep]
    order = np.argsort(np.concatenate(done_at), kind="stable") if done_at else np.zeros(0, np.int64)
    ids = np.concatenate(done_ids)[order] if done_at else np.zeros(0, np.int32)
    owners = np.concatenate(done_owner)[order] if done_at else np.zeros(0, np.int64)
    return ids.astype(np.uint32), np.bincount(owners, minlength=len(words))


class Encoder:
    """Encodes texts; remembers the ids of words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.strings = np.array(vocabulary.tokens, object)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.index = {text: i for i, text in enumerate(self.vocabulary.special)}
        self.flat = np.array([*self.vocabulary.special.values()], np.uint32)
        self.sizes = np.ones(len(self.index), np.int64)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        # Lower case goes letter by letter: a sigma at a word's end is no special case.
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; strings of special tokens stand for themselves."""
        if self.split_special is None or not any(s in text for s in self.vocabulary.special):
            return self.words(text)
        found = []
        for part in self.split_special.split(text):
            found += [part] if part in self.vocabulary.special else self.words(part)
        return found

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and the number of ids of each text."""
        counts, words = [], []
        for text in texts:
            pieces = self.pieces(text)
            counts.append(len(pieces))
            words += pieces
        if len(self.index) > CACHE_WORDS:
            self.forget()
        if new := list(dict.fromkeys(w for w in words if w not in self.index)):
            ids, sizes = merge_words([w.encode() for w in new], self.vocabulary)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        begins = (np.cumsum(self.sizes) - self.sizes)[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(sizes.sum()) + np.repeat(begins - ends + sizes, sizes)]
        upto = np.concatenate([[0], ends])[np.cumsum(np.array([0, *counts]))]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own strings with spaces between, as for a vocabulary that names no decoder."""
        return " ".join(self.strings[ids].tolist())


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """Encode whole texts: key, n_tokens, ids (little-endian unsigned 32-bit integers) and, on demand, decoded.

    Null and empty texts have no ids. Every row gives one row, repeated keys and null keys included; other columns
    are left out. Letters newer than Unicode 15.1 may be told apart otherwise than by the tokenizers library. The vocabulary, of fixed size, is read on the driver from path and sent to the tasks.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    encoders: list[Encoder] = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoders[0] if encoders else encoders.append(Encoder(vocabulary.value)) or encoders[0]
        ids, counts = encoder.encode(x or "" for x in batch.column(1).to_pylist())
        ends = np.cumsum(counts)
        parts = [ids[e - n:e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        columns = [
            batch.column(0), pa.array(counts, pa.int64()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()),
        ]
        if decode:
            columns.append(pa.array([encoder.decode(p) for p in parts], pa.string()))
        return pa.record_batch(columns, names=[key, "n_tokens", "ids", "decoded"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids binary" + ", decoded string" * decode
    return map_batches(docs.select(key, text), each, schema, RUN_BYTES)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    coded = encode_documents(read_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), decode=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
