"""BPE encoding and decoding by prefix-sharing trie traversal.

The last token of a prefix's encoding, together with the encoding of what precedes it, is the whole
encoding; and a token may follow another exactly if encoding their joined text gives back the two.
So each node of a trie over words needs one state, its last token, found among the vocabulary's
tokens that end there. Words are taken in sorted order, which walks the trie depth first: the states
of the path are a stack, and a word starts from the states it shares with the word before it.

Tasks see white-space separated chunks; each distinct chunk of a batch is encoded once, and recent
chunks are remembered up to a bound. No shuffle is needed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kveil.llm.common import col, map_arrow, table
from kveil.llm.tokens import byte_letters

MEMORY = 250_000  # words, chunks and pairs of tokens that a worker remembers, per generation
BATCH = 4 << 20  # bytes of text whose new words share a trie
STRETCH = 1 << 20  # bytes of a text that are split at once

# How the vocabulary's file splits text, narrowed to ASCII and Latin-1 letters.
LATIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordVocabulary:
    """A BPE vocabulary with an end-of-word mark, read from its file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model = spec["model"]
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.token = {i: t for t, i in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.longest = max(len(self.bare(t)) for t in self.ids)
        self.letters = {b: c for c, b in byte_letters().items()}
        self.follows: dict[tuple[str, str], bool] = {}

    def bare(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) and token != self.end else token

    def symbols(self, token: str) -> list[str]:
        bare = self.bare(token)
        if bare is token or bare == token:
            return list(token)
        return [*bare[:-1], bare[-1] + self.end]

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, leftmost first; for the few symbols of two tokens."""
        rank, symbols = self.rank, list(symbols)
        while len(symbols) > 1:
            best, at = min(
                (rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(symbols, symbols[1:]))
            )
            if best == len(rank):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, left: str, right: str) -> bool:
        """Whether encoding the joined text of two tokens gives back these two; of one, it alone."""
        whole = [left, right] if left else [right]
        return self.merged(self.symbols(left) + self.symbols(right)) == whole

    def encode_sorted(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Tokens of distinct words given in sorted order, a depth-first walk of their trie.

        ``last[j]`` is the last token of the path's first j symbols. A word's final symbol carries
        the end mark, so it is a leaf of its own and never part of the shared path. Answers about
        pairs of tokens are remembered.
        """
        ids, end, longest, follows = self.ids, self.end, self.longest, self.follows
        last: list[str] = [""]
        path = ""
        for word in words:
            n = len(word)
            shared = min(len(last) - 1, n - 1)
            if path[:shared] != word[:shared]:
                shared = len(os.path.commonprefix((path[:shared], word[:shared])))
            del last[shared + 1 :]
            for j in range(shared + 1, n + 1):
                leaf = j == n
                for i in range(j - longest if j > longest else 0, j):
                    token = word[i:j] + end if leaf else word[i:j]
                    if token in ids:
                        pair = (last[i], token)
                        good = follows.get(pair)
                        if good is None:
                            if len(follows) >= MEMORY:
                                follows.clear()
                            good = follows[pair] = self.may_follow(*pair)
                        if good:
                            break
                if not leaf:
                    last.append(token)
            path = word
            out = [token]
            while i:
                token = last[i]
                out.append(token)
                i -= len(token)
            out.reverse()
            yield word, out

    def split(self, chunk: str) -> list[str]:
        """Byte-letter words of a chunk without white space, by the file's own rules."""
        if LATIN.fullmatch(chunk):
            letters = self.letters
            return ["".join([letters[b] for b in p.encode()]) for p in PIECES.findall(chunk.lower())]
        plain = self.library.normalizer.normalize_str(chunk)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def is_special(self, chunk: str) -> bool:
        """A special token written out stands for itself, so its chunk goes to the library."""
        return any(s in chunk for s in self.special)

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode for a vocabulary without a decoder: tokens joined by spaces."""
        return " ".join(self.token[i] for i in ids)


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The chunks of a text, some at a time."""
    at = 0
    while at < len(text):
        to = at + STRETCH
        while to < len(text) and not text[to : to + 1].isspace():
            to += 1
        yield text[at:to].split()
        at = to


Cell = tuple[int, bytes, bytes]  # number of ids, ids in decimals, decoded text


class Coder:
    """Codes whole texts, remembering recent words and chunks in two generations each.

    What was not seen since the last change of generation is forgotten.
    """

    def __init__(self, path: str):
        self.vocabulary = WordVocabulary(path)
        self.ids = self.vocabulary.ids | {t: i for i, t in self.vocabulary.token.items()}
        self.words: dict[str, Cell] = {}
        self.old_words: dict[str, Cell] = {}
        self.chunks: dict[bytes, Cell] = {}
        self.old_chunks: dict[bytes, Cell] = {}

    def cell(self, tokens: list[str]) -> Cell:
        ids = [self.ids[t] for t in tokens]
        return len(ids), " ".join(map(str, ids)).encode(), self.vocabulary.decode(ids).encode()

    def learn_words(self, wanted: set[str]) -> None:
        if len(self.words) > MEMORY:
            self.words, self.old_words = {}, self.words
        words, old = self.words, self.old_words
        wanted -= words.keys()
        for w in wanted & old.keys():
            words[w] = old[w]
        for w, tokens in self.vocabulary.encode_sorted(sorted(wanted - words.keys())):
            words[w] = self.cell(tokens)

    def learn(self, wanted: set[bytes]) -> None:
        """Makes every chunk of a set known, encoding its new words in one trie."""
        if len(self.chunks) > MEMORY:
            self.chunks, self.old_chunks = {}, self.chunks
        chunks, old = self.chunks, self.old_chunks
        wanted -= chunks.keys()
        for c in wanted & old.keys():
            chunks[c] = old[c]
        parts: dict[bytes, list[str]] = {}
        for c in wanted - chunks.keys():
            text = c.decode("utf-8", "replace")
            if self.vocabulary.is_special(text):
                chunks[c] = self.cell(self.vocabulary.library.encode(text, add_special_tokens=False).tokens)
            else:
                parts[c] = self.vocabulary.split(text)
        self.learn_words({w for ws in parts.values() for w in ws})
        words = self.words
        for c, ws in parts.items():
            if len(ws) == 1:
                chunks[c] = words[ws[0]]
            else:
                cells = [words[w] for w in ws]
                chunks[c] = (
                    sum([x[0] for x in cells]),
                    b" ".join([x[1] for x in cells]),
                    b" ".join([x[2] for x in cells]),
                )

    def cells(self, texts: list[bytes]) -> Iterator[tuple[int, list[Cell]]]:
        """(number of the text, cells of its next stretch) for all texts in order, some megabytes at once."""
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for number, text in enumerate(texts):
            for chunks in stretches(text):
                held.append((number, chunks))
                size += min(len(text), STRETCH)
                if size > BATCH:
                    yield from self.known_cells(held)
                    held, size = [], 0
        yield from self.known_cells(held)

    def known_cells(self, held: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, list[Cell]]]:
        self.learn(set().union(*(chunks for _, chunks in held)))
        known = self.chunks
        for number, chunks in held:
            yield number, [known[c] for c in chunks]

    def digests(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids in decimals, SHA-256 of the decoded text, per text."""
        sums = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
        for number, cells in self.cells(texts):
            row = sums[number]
            cells = [c for c in cells if c[0]] if any(not c[0] for c in cells) else cells
            if cells:
                n, ids, back = zip(*cells)
                gap = b" " if row[0] else b""
                row[0] += sum(n)
                row[1].update(gap + b" ".join(ids))
                row[2].update(gap + b" ".join(back))
        return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in sums]

    def id_lists(self, texts: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for number, cells in self.cells(texts):
            out[number] += [int(i) for c in cells for i in c[1].split()]
        return out


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    """One per Python worker: what it remembers outlives the task."""
    return Coder(path)


def code_worker(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = coder(path).digests([t.as_py() or b"" for t in batch.column("text")])
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array(back, pa.string()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return work


def encode_worker(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = coder(path).id_lists([t.as_py() or b"" for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"]
            )

    return work


def rows_of(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids) of every row. Null and empty texts have no ids; every row is coded by itself."""
    rows, kind = rows_of(df, id_col, text_col)
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    return map_arrow(rows, encode_worker(path), f"id {kind}, ids array<int>")


def code_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, without keeping ids or decoded text."""
    rows, kind = rows_of(df, id_col, text_col)
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(rows, code_worker(path), schema)


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
