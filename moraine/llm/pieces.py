"""Encoding and decoding of a sentencepiece BPE model in numpy: vectorised merge rounds over the distinct words of a batch.

The model's pieces never hold a space mark after another character, so no merge crosses the start of a run
of spaces: a text falls into words (a run of spaces and what follows up to the next one) that are encoded
on their own. All distinct words of a batch lie in one flat symbol array. A round finds the best rank among the pairs
of each word, merges that pair's leftmost occurrences in all words at once, and compacts the array to the
words that still have a pair in the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from moraine.llm.common import bounded_batches

SPACE = "▁"
MAX_WORDS, LONGEST_KEPT, GROUP = 150_000, 48, 1_500_000
_CODECS: dict[str, "PieceCodec"] = {}
NO_RANK = np.iinfo(np.int64).max


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        normal = [i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL]
        self.byte_ids = {int(names[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        vocab = {names[i]: i for i in normal}
        if any(SPACE in n.lstrip(SPACE) for n in vocab):
            raise ValueError("a piece crosses the start of a word")
        self.chars = {n: i for n, i in vocab.items() if len(n) == 1}
        # all ways to make a piece of two pieces: (left, right) -> (rank, merged)
        order = {i: r for r, i in enumerate(sorted(normal, key=lambda i: -model.get_score(i)))}
        left, right, merged = [], [], []
        for n, i in vocab.items():
            for k in range(1, len(n)):
                a, b = vocab.get(n[:k]), vocab.get(n[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        self.size = size
        line = "" if any("\n" in n for n in vocab) else "\n"
        self.split = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + "|\n+" * bool(line))
        keys = np.array(left, dtype=np.int64) * size + np.array(right, dtype=np.int64)
        by = np.argsort(keys)
        self.keys, self.merged = keys[by], np.array(merged, dtype=np.int64)[by]
        self.rank = np.array([order[i] for i in self.merged.tolist()], dtype=np.int64)
        self.piece_of = np.array(sorted(order, key=order.get), dtype=np.int64)
        self.csv = [f"{i}," for i in range(size)]
        self.text = [bytes([int(n[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if i == self.unknown else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Position of each pair in the table of merges, -1 if it is none. Negative symbols are outside the vocabulary."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), at, -1)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """(symbols, word of each, words to redo) after all merges; symbols below 0 stand for characters outside the vocabulary.

        Several merges of a word in one round equal the model's single steps unless one of them makes a pair of a
        better rank; such a word is given back to be redone one merge at a time.
        """
        done_symbols, done_words, redo = [], [], set()
        pair = self.find(symbols[:-1], symbols[1:])
        pair[word[:-1] != word[1:]] = -1
        rank = np.r_[np.where(pair >= 0, self.rank[pair], NO_RANK), NO_RANK]
        before = None
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(rank, first)
            if before is not None and (worse := (best < before) & several).any():
                redo.update(word[first[worse]].tolist())
                best[worse] = NO_RANK
            live = best != NO_RANK
            if not live.all():  # compaction: finished words leave
                stay = np.repeat(live, size)
                done_symbols.append(symbols[~stay])
                done_words.append(word[~stay])
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                size, best = size[live], best[live]
                if not len(symbols):
                    break
            number = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == best[number])
            # of touching hits take every other one from the left
            new_run = np.r_[True, np.diff(at) != 1]
            nth = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            at = at[nth % 2 == 0]
            before, several = best, np.bincount(number[at], minlength=len(size)) > 1
            symbols[at] = self.piece_of[rank[at]]
            rank[at] = -1
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            made = np.flatnonzero(rank == -1)
            for left in (made, made[made > 0] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                pair = self.find(symbols[left], symbols[right])
                pair[(word[left] != word[right]) | (left == right)] = -1
                rank[left] = np.where(pair >= 0, self.rank[pair], NO_RANK)
        if not done_symbols:
            return symbols, word, redo
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        return symbols[by], word[by], redo

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """The model's own order of merges for one word: best rank first, leftmost on ties."""
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else len(symbols)
            if j < len(symbols) and (at := int(self.find(np.array([symbols[i]]), np.array([symbols[j]]))[0])) >= 0:
                heapq.heappush(heap, (int(self.rank[at]), i, symbols[i], symbols[j]))

        for i in range(len(symbols)):
            offer(i)
        gone = set()
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if i in gone or j >= len(symbols) or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = int(self.piece_of[rank])
            gone.add(j)
            right[i] = right[j]
            if right[i] < len(symbols):
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [s for i, s in enumerate(symbols) if i not in gone]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where the second and later words start); characters outside the vocabulary become the ids of their UTF-8 bytes."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        distinct, which = np.unique(points, return_inverse=True)
        known = np.array([self.chars.get(chr(c), -1 - int(c)) for c in distinct.tolist()], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        start = known[which]
        symbols, word, redo = self.merge(start.copy(), word)
        if redo:
            ends = np.cumsum([len(w) for w in words])
            keep = ~np.isin(word, list(redo))
            again = {w: self.one_by_one(start[ends[w] - len(words[w]) : ends[w]].tolist()) for w in sorted(redo)}
            symbols = np.concatenate([symbols[keep], *[np.array(x) for x in again.values()]])
            word = np.concatenate([word[keep], *[np.full(len(x), w) for w, x in again.items()]])
            by = np.argsort(word, kind="stable")
            symbols, word = symbols[by], word[by]
        if (symbols < 0).any():
            spelt = {int(s): [self.byte_ids.get(b, self.unknown) for b in chr(-1 - int(s)).encode()] for s in np.unique(symbols[symbols < 0])}
            times = np.array([len(spelt[s]) if s < 0 else 1 for s in symbols.tolist()])
            word = np.repeat(word, times)
            symbols = np.array([i for s in symbols.tolist() for i in (spelt[s] if s < 0 else (s,))], dtype=np.int64)
        return symbols, np.searchsorted(word, np.arange(1, len(words)))

    def words(self, text: str) -> list[str]:
        """A line end that no piece holds also ends a word."""
        return self.split.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def known(self, words: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """(number of ids, ids with commas, decoded bytes) of each word, from two bounded generations of a cache."""
        if len(self.young) > MAX_WORDS:
            self.old, self.young = self.young, {}
        young, missing = self.young, []
        for w in words:
            if w not in young:
                x = self.old.get(w)
                if x is None:
                    missing.append(w)
                else:
                    young[w] = x
        csv, text = self.csv, self.text
        if missing:
            flat, cuts = self.encode_flat(missing)
            flat, cuts = flat.tolist(), [0, *cuts.tolist(), len(flat)]
            for w, a, b in zip(missing, cuts, cuts[1:], strict=False):
                ids = flat[a:b]
                young[w] = b - a, "".join([csv[i] for i in ids]), b"".join([text[i] for i in ids])
        return young

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        return self.encode_flat(words)[0].tolist() if words else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes of byte pieces join, invalid ones become U+FFFD, and the space put before the text goes."""
        out = b"".join(self.text[i] for i in ids)
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(n_tokens, SHA-256 of the ids joined by commas, SHA-256 of the decoded text) of each text, in groups of bounded size."""
        k = 0
        while k < len(texts):
            group, chars = [], 0
            while k < len(texts) and chars < GROUP:
                group.append(self.words(texts[k]))
                chars += len(texts[k])
                k += 1
            distinct = {w for g in group for w in g}
            known = self.known(distinct)
            for g in group:
                found = [known[w] for w in g]
                decoded = b"".join([x[2] for x in found])
                if self.prefix and decoded[:1] == b" ":
                    decoded = decoded[1:]
                yield sum([x[0] for x in found]), hashlib.sha256("".join([x[1] for x in found])[:-1].encode()).hexdigest(), hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest()
            for w in distinct:
                if len(w) > LONGEST_KEPT:
                    del known[w]


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text, without begin or end ids.

    A null text counts as empty: no ids, the digests of the empty string. Null ids stay null, repeated rows give
    repeated rows, extra columns are ignored. Rows never move between tasks; a worker holds one group of texts of about GROUP
    characters (or one longer text) and a bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = codec(model).digests
        for b in batches:
            n, ids, decoded = zip(*digests([t or "" for t in b.column("text").to_pylist()]), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns and the ids of the whole text as an array of integers (null text: an empty array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(model).encode
        for b in batches:
            ids = pa.array([encode(t or "") for t in b.column(text_col).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, ids_col])

    bounded_batches(docs.sparkSession)
    kept = docs.drop(ids_col)
    return kept.mapInArrow(run, StructType(list(kept.schema.fields)).add(ids_col, ArrayType(IntegerType())))
