"""BPE encoding and decoding with given public vocabularies.

Merging runs in batched numpy rounds: the symbols of many words lie in one flat array; each round
looks up all neighbouring pairs by binary search over the sorted pair keys, takes each word's
lowest-ranked pair, and merges all its places at once. Distinct words are merged once per batch and
kept in two bounded dictionaries, the words asked for since the last change and those before it.

Splitting into words uses plain regular expressions with spelled-out classes, which agree with the
library's Unicode classes on all but UNSAFE characters (so on Latin letters, common punctuation). A text with any
other character, or with a special token, is normalised and split by the library's own rules, word by word. The merging
is the same for all texts.

Defined cases: null and empty texts have no ids, an empty decoded text, and the hashes of empty
strings. Repeated rows get equal results. Extra columns are ignored. No vocabulary is trained or copied;
its path is a parameter, and every executor has the tokenizers' package.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from tessella.llm.common import slices, table

#: Bytes of a word from which its rounds go by lists of places.
LONG = 256

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "
#: A character on which the spelled-out classes or Python's lower-casing might differ from the library's.
UNSAFE = re.compile("[^\u0000-įı-ɏ‐-‧€]")

# Letters stand first, as most words are of them and none of the branches that the library has before them matches there.
BYTE_LEVEL = re.compile(f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
LOWER_WORDS = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Sorted pair keys of a BPE vocabulary, and merging of many words at once."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        self.of_rank = list(zip(left.tolist(), right.tolist(), made.tolist()))
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int64)
        # Ranks of the pairs that words begin with: a byte within a word, and one within or at its end.
        self.of_bytes = self.ranks(np.repeat(self.inner, 512), np.tile(np.r_[self.inner, self.final], 256))
        # If no merge can make a pair of lower rank than its own, all places of a pair may merge at once.
        first = np.full(max(vocab.values()) + 1, -1, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]
        self.ascending = bool((np.maximum(first[left], first[right]) < np.arange(len(made))).all())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], np.int32(self.NONE))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers. Long words have rounds of their own kind."""
        long = [i for i, w in enumerate(words) if len(w) > LONG] if self.ascending else []
        if not long:
            return self.encode_short(words)
        out = self.encode_short([b"" if len(w) > LONG else w for w in words])
        for i, ids in zip(long, self.encode_long([words[i] for i in long])):
            out[i] = ids
        return out

    def encode_long(self, words: list[bytes]) -> list[bytes]:
        """As encode_short(), for long words: a round takes the places of one pair from a list instead of scanning all symbols.

        Rounds go by rising rank, as no merge makes a pair of lower rank than its own; so each round merges all places of its
        pair in all words, finds the ranks of the pairs that these merges make, and puts their places on the
        lists of those ranks. Work is in proportion to the merges, and rounds to the distinct pairs.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        sym = self.inner[flat]
        sym[ends] = self.final[flat[ends]]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[ends], before[np.r_[0, ends[:-1] + 1]] = -1, -1
        alive = np.ones(len(sym), bool)
        lists: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """Put the pairs that begin at these places on the lists of their ranks."""
            keys = sym[at] << 32 | sym[after[at]]
            found = np.searchsorted(self.keys, keys)
            found[found == len(self.keys)] = 0
            hit = self.keys[found] == keys
            at, rank = at[hit], self.rank[found[hit]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]).tolist() if len(rank) else []
            for a, b, r in zip(edges, [*edges[1:], len(rank)], rank[edges].tolist()):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(ranks, r)
                lists[r].append(at[a:b])

        note(np.flatnonzero(after >= 0))
        while ranks:
            r = heapq.heappop(ranks)
            held = lists.pop(r)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            at = at[alive[at] & (after[at] >= 0)]
            left, right, made = self.of_rank[r]
            at = at[(sym[at] == left) & (sym[after[at]] == right)]
            if left == right and len(at) > 1:  # overlapping places: every second one of a run
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at], alive[gone], after[at] = made, False, after[gone]
            follow = after[at] >= 0
            before[after[at[follow]]] = at[follow]
            lead = before[at]
            note(np.unique(np.r_[lead[lead >= 0], at[follow]]))
        kept = np.r_[0, np.cumsum(np.add.reduceat(alive.astype(np.int64), np.r_[0, ends[:-1] + 1]))].tolist()
        data = sym[alive].astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(kept, kept[1:])]

    def encode_short(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers. A round looks up only the pairs that the last one changed."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        sym = self.inner[flat].astype(np.int32)
        ends = (np.cumsum(lengths) - 1)[lengths > 0]
        sym[ends] = self.final[flat[ends]]
        rank = np.full(len(sym), self.NONE, np.int32)  # of the pair that begins here
        if len(sym) > 1:
            right = flat[1:].astype(np.int64)
            right[ends[1:] - 1] += 256
            if ends[0]:
                right[ends[0] - 1] += 256
            rank[:-1] = self.of_bytes[flat[:-1].astype(np.int64) << 9 | right]
            rank[ends] = self.NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            live = least < self.NONE
            sizes = np.diff(np.r_[starts, len(sym)])
            done = np.repeat(~live, sizes)
            if done.any():  # words without a merge leave
                data = sym[done].astype("<u4").tobytes()
                edge = np.r_[0, np.cumsum(4 * sizes[~live])].tolist()
                for w, a, b in zip(owner[starts[~live]].tolist(), edge, edge[1:]):
                    out[w] = data[a:b]
            if not live.any():
                break
            take = (rank == np.repeat(least, sizes)) & ~done
            at = np.flatnonzero(take)
            if self.ascending:
                fresh = np.r_[True, np.diff(at) > 1]
                if not fresh.all():  # overlapping places of a pair of equal symbols: every second one
                    begin = np.maximum.accumulate(np.where(fresh, at, 0))
                    at = at[(at - begin) % 2 == 0]
            else:
                at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            sym[at] = self.made[rank[at]]
            keep = ~done
            keep[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            sym, owner, rank, changed = sym[keep], owner[keep], rank[keep], np.flatnonzero(changed[keep])
            rank[changed] = self.NONE
            changed = changed[changed < len(sym) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.ranks(sym[changed], sym[changed + 1])
        return out


class Encoder:
    """Texts to id bytes, as the tokenizers library encodes them with add_special_tokens=False."""

    limit = 200_000

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.merges = MergeTable(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.lower = spec["normalizer"] is not None
        self.pattern = LOWER_WORDS if self.lower else BYTE_LEVEL
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        size = max(max(model["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        self.names = [b""] * size
        for name, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.names[i] = name.encode()
        self.known: dict[str, bytes] = dict(self.special_ids)
        self.older: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        """Whether this class encodes the text itself."""
        return text.isascii() or not UNSAFE.search(text)

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if self.plain(text) and not (self.special is not None and self.special.search(text)):
            return self.pattern.findall(text.lower() if self.lower else text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text) if self.special is not None else [text]):
            if i % 2:
                out.append(part)
            elif part:
                part = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                # The library names bytes by printable characters.
                out += [bytes(map(self.of_symbol.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.split(t) for t in texts]
        asked = set().union(*words)
        fresh = asked.difference(self.known)
        if len(self.known) + len(fresh) > self.limit:
            self.older, self.known = self.known, dict(self.special_ids)
            fresh = asked.difference(self.known)
        # Words that are asked for again pass from the older dictionary to the new one, so frequent ones are merged once.
        again = fresh & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = list(fresh - again)
        self.known.update(zip(new, self.merges.encode([w.encode() for w in new])))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False) for a vocabulary without a decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], Encoder]]:
    """Arrow batches with a text column, and each row's id bytes."""
    e = encoder(path)
    for batch in slices(batches):
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            yield part, e.encode([t or "" for t in part.column("text").to_pylist()]), e


def bpe_map(docs: DataFrame, path: str, key: str, text: str, fields: str, row: Callable[[Encoder, bytes], tuple]) -> DataFrame:
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"key {kind}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, e in encoded(batches, path):
            columns = list(zip(*(row(e, x) for x in ids)))
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c) for c in columns)], names=[f.split()[0] for f in schema.split(", ")])

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of each text."""
    return bpe_map(docs, path, key, text, "ids array<int>", lambda e, x: (np.frombuffer(x, "<i4"),))


def bpe_decode(docs: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded text of each row of ids."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(np.array(x or [], "<u4").tobytes()).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "decoded"])

    return docs.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(e: Encoder, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_map(table(spark, sf_dir, "documents"), path, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)
