"""Byte-level BPE by depth-first traversal of a word trie.

The encoding of a byte string ends in one last token, and what stands before that token is the encoding of the
shorter prefix. So the state of a trie node is the last token of the prefix it spells: a token that is a suffix of
the prefix and that BPE would not have merged with the last token of what stands before it. Distinct words in byte
order are the leaves of their trie in depth-first order; a word shares the path it has in common with its
predecessor, and the states on that path are computed once.

Texts are split and looked up batch by batch; the words known so far are kept up to a bound, which only decides
what is computed again. Nothing is shuffled.

Cases. A null or empty text has no tokens; a special token's string in a text is that token. Very long texts are
processed whole. Null ids are passed on, columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import small_batches, tidy

#: Fixed value: the pattern of byte-level pre-tokenization.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as in Unicode; the regex module's own \s has the separators 1C to 1F besides.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words kept by a task, pairs of tokens kept by a worker, and characters looked up at a time.
KEPT_WORDS, KEPT_PAIRS, CHUNK_CHARS = 500_000, 250_000, 1 << 18


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, the merges, and which neighbours BPE leaves apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        names = spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in names.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.ids = {self.bytes[i]: i for t, i in names.items() if t not in self.special}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (names[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = names[_joined(pair)]
            self.rank[a, b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        #: Every beginning of a token: the token it is, or -1.
        self.begins = {t[:n]: -1 for t in self.ids for n in range(1, len(t))} | self.ids
        ordered = all(self._rank(a) < r and self._rank(b) < r for a, b, r in self.parts.values())
        self._apart = self._apart_by_spines if ordered else self._apart_by_merging
        self.known_pairs: dict[int, bool] = {}
        self.known_whole: dict[int, bool] = {}
        self.known_spines: tuple[dict, dict] = ({}, {})
        split = SPLIT.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pattern = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _rank(self, token: int) -> int:
        return self.parts[token][2] if token in self.parts else -1

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: the lowest rank first, the leftmost of equals."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            rank, i = min((self.rank.get((out[k], out[k + 1]), 1 << 60), k) for k in range(len(out) - 1))
            if rank == 1 << 60:
                break
            out[i : i + 2] = [self.ids[self.bytes[out[i]] + self.bytes[out[i + 1]]]]
        return out

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        if (known := self.known_whole.get(token)) is None:
            known = self.known_whole[token] = self.merge(self.bytes[token]) == [token]
        return known

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Pieces at one edge of the token from its byte up, each with the rank of the merge that absorbs it."""
        known = self.known_spines[right]
        if token not in known:
            spine, piece = [(token, 1 << 60)], token
            while piece in self.parts:
                a, b, rank = self.parts[piece]
                piece = b if right else a
                spine.append((piece, rank))
            known[token] = spine[::-1]
        return known[token]

    def _apart_by_spines(self, left: int, right: int) -> bool:
        """No merge across the border comes before the merges inside that take its two edges away."""
        a, b = self._spine(left, True), self._spine(right, False)
        i = k = 0
        while True:
            (x, x_gone), (y, y_gone) = a[i], b[k]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_gone and rank <= y_gone:
                return False
            if x_gone <= y_gone:
                if x_gone == 1 << 60:
                    return True
                i += 1
            else:
                k += 1

    def _apart_by_merging(self, left: int, right: int) -> bool:
        return self.merge(self.bytes[left] + self.bytes[right]) == [left, right]

    def encode_words(self, words: list[bytes]) -> Iterator[list[int]]:
        """The tokens of each word; words must be sorted and distinct. Depth-first over their trie."""
        begins, known, pairs = self.begins.get, self.known_pairs.get, self.known_pairs
        apart, whole, single = self._apart, self.whole, self.single
        last: list[int] = [-1]  # state of each node on the path: its prefix's last token
        width: list[int] = [0]
        alive: list[list[int]] = [[]]  # and from where on the path its end may lie within a token
        before = b""
        for word in words:
            size = len(word)
            depth, most = 0, min(size, len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], width[depth + 1 :], alive[depth + 1 :]
            now = alive[-1]
            for end in range(depth + 1, size + 1):
                starts, chosen = [], -1
                for start in now:
                    token = begins(word[start:end])
                    if token is None:
                        continue
                    starts.append(start)
                    if token < 0 or chosen >= 0:
                        continue
                    if start:
                        left = last[start]
                        pair = left << 32 | token
                        fits = known(pair)
                        if fits is None:
                            fits = pairs[pair] = apart(left, token) and whole(token)
                    else:
                        fits = whole(token)
                    if fits:
                        chosen, origin = token, start
                if chosen < 0:  # a prefix has a last token: if no longer one, its last byte
                    chosen, origin = single[word[end - 1]], end - 1
                starts.append(end - 1)
                alive.append(starts)
                last.append(chosen)
                width.append(end - origin)
                now = starts
            before, out, at = word, [], size
            while at:
                out.append(last[at])
                at -= width[at]
            out.reverse()
            yield out


def _joined(pair) -> str:
    return pair.replace(" ", "", 1) if isinstance(pair, str) else "".join(pair)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, one after another."""
    to = _starts(length)
    return values[np.arange(to[-1]) + np.repeat(start - to[:-1], length)]


class Encoder:
    """Texts to token numbers, with the words met so far."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self.vocabulary, self.kept_words = vocabulary(path), kept_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int64)

    def _split(self, text: str) -> list[str]:
        v = self.vocabulary
        if v.specials is None or not v.specials.search(text):
            return v.pattern.findall(text)
        out: list[str] = []
        for k, piece in enumerate(v.specials.split(text)):
            out += [f"\0{piece}"] if k % 2 else v.pattern.findall(piece)
        return out

    def _learn(self, words: set[str]) -> None:
        """Word numbers for new words. A special token goes by its string after a zero byte, alone in its entry."""
        v = self.vocabulary
        special = {w for w in words if w[0] == "\0" and w[1:] in v.special}
        pairs = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words - special)
        coded = [*v.encode_words([b for b, _ in pairs]), *([v.special[w[1:]]] for w in special)]
        for w in [w for _, w in pairs] + list(special):
            self.index[w] = len(self.index)
        self.length = np.concatenate([self.length, np.fromiter(map(len, coded), np.int64, len(coded))])
        self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(coded), np.int32, sum(map(len, coded)))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all tokens, tokens of each text)."""
        split = [self._split(t) for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.index) > self.kept_words:
            self._clear()
        if len(self.vocabulary.known_pairs) > KEPT_PAIRS:
            self.vocabulary.known_pairs.clear()
        if new := set(words).difference(self.index):
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        start, length = _starts(self.length)[:-1][at], self.length[at]
        ends = _starts(length)[_starts(np.fromiter(map(len, split), np.int64, len(split)))]
        return _gather(self.tokens, start, length), np.diff(ends)


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > CHUNK_CHARS:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _encode(path: str, kept_words: int = KEPT_WORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, kept_words)  # its words go with the task: idle workers hold only the vocabulary
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks([len(t) for t in texts]):
                tokens, counts = encoder.encode(texts[a:b])
                ids = pa.ListArray.from_arrays(pa.array(_starts(counts), pa.int32()), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["id", "ids"])

    return run


class Decoder:
    """Token numbers to texts."""

    def __init__(self, path: str):
        v = vocabulary(path)
        size = max(v.bytes) + 1
        self.length = np.fromiter((len(v.bytes.get(i, b"")) for i in range(size)), np.int64, size)
        self.data = np.frombuffer(b"".join(v.bytes.get(i, b"") for i in range(size)), np.uint8)
        self.start = _starts(self.length)[:-1]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """One text for each run of ``counts`` tokens; bytes that are no UTF-8 are replaced."""
        ends, texts = _starts(counts), []
        for a, b in _chunks([int(c) * 4 for c in counts]):
            some = ids[ends[a] : ends[b]]
            raw = _gather(self.data, self.start[some], self.length[some]).tobytes()
            cut = _starts(self.length[some])[ends[a : b + 1] - ends[a]]
            texts += [raw[x:y].decode("utf-8", "replace") for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return texts


def _decode(path: str):
    decoders: list[Decoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not decoders:
            decoders.append(Decoder(path))
        decoder = decoders[0]
        for batch in batches:
            counts = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decoder.decode(batch.column(1).flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    return run


def _both(path: str, kept_words: int):
    """Encode, and decode what came out, in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _decode(path)
        for batch in _encode(path, kept_words)(batches):
            yield from back(iter([batch]))

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the tokens of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tidy(_encode(path)), f"id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(id, ids, decoded) from (id, ids)."""
    kind = coded.schema["id"].dataType.simpleString()
    return coded.select("id", "ids").mapInArrow(_decode(path), f"id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """Number of tokens, digest of the tokens and of what they decode to, for each text. Fewer kept words take less memory and more time."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    back = rows.mapInArrow(tidy(_both(path, kept_words)), f"id {kind}, ids array<int>, decoded string")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return back.select(
        F.col("id").alias(id_col), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_vocabulary())
