"""SentencePiece encoding and decoding over a trie of distinct marked words.

A marked word is a run of word marks and what follows up to the next mark; no piece of the
vocabulary reaches over its end. The distinct new words of some texts (about ``TOGETHER``
characters) are sorted, so that they are the leaves of a trie in depth-first order, and each keeps the forward states of the
prefix that it shares with the word before. The given vocabulary is a BPE model: the forward
state of a prefix is its last piece (the one piece that stays apart from the piece before it
when both are merged together), where a unigram model would keep the best score.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import texts

MARK = "▁"
#: Words that a task keeps encoded, about 200 bytes each, in two generations.
KEEP = 800_000
LONG = 64
#: Characters of the texts whose words are learned together, about.
TOGETHER = 1 << 20


class PieceTrie:
    def __init__(self, path: str, keep: int | None = None):
        self.keep = keep or KEEP
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kinds = sentencepiece_model_pb2.TrainerSpec
        plain = spec.normalizer_spec
        if spec.trainer_spec.model_type != kinds.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix or not plain.escape_whitespaces:
            raise ValueError("a model without normalisation and with a dummy prefix is needed")
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.name = [model.id_to_piece(i) for i in range(size)]
        usual = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(MARK in self.name[i].lstrip(MARK) for i in usual):
            raise ValueError("no piece may have a word mark inside")
        self.ids = {self.name[i]: i for i in usual}
        self.score = {self.name[i]: model.get_score(i) for i in usual}
        self.byte = {int(self.name[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.surface = [b""] * size
        for i in usual:
            self.surface[i] = self.name[i].replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.longest = max(map(len, self.ids))
        #: Only pieces that their own merges build can stand in an encoding.
        self.steps = {i: self._history(piece) for piece, i in self.ids.items()}
        self.whole = {piece: i for piece, i in self.ids.items() if self.steps[i][-1][1] == piece}
        #: Every beginning of such a piece, with the id of the piece that it is, or -1.
        self.stems = {piece[:n]: -1 for piece in self.whole for n in range(1, len(piece) + 1)} | self.whole
        self.apart: dict[int, bool] = {}
        #: Encoded words of this generation and the one before it.
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def _history(self, text: str) -> list[tuple[float, str, str]]:
        """The merges of a text, best first and the left one of equals: each one's score, and
        the first and the last part after it. The last entry has a score below all."""
        parts, made = list(text), []
        score = np.inf
        while True:
            made.append((score, parts[0], parts[-1]))
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            if not scores or (score := max(scores)) == -np.inf:
                return made
            at = scores.index(score)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two pieces: both are built side by side,
        the better merge first, until the parts at the border would merge before either."""
        if len(self.apart) >= 2 * self.keep:
            self.apart.clear()
        lefts, rights = self.steps[left], self.steps[right]
        i = j = 0
        found = True
        while found:
            own = lefts[i + 1][0] if i + 1 < len(lefts) else -np.inf
            other = rights[j + 1][0] if j + 1 < len(rights) else -np.inf
            crossing = self.score.get(lefts[i][2] + rights[j][1], -np.inf)
            if crossing > own and crossing >= other:
                found = False
            elif own == other == -np.inf:
                break
            elif own >= other:
                i += 1
            else:
                j += 1
        self.apart[left << 20 | right] = found
        return found

    @staticmethod
    def _packed(*ids: int) -> bytes:
        return array("I", ids).tobytes()

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Piece ids (four bytes each) of each of the distinct ``words``, depth first over
        their trie.

        last[p] and back[p] are the last piece of the prefix of length p and where it starts;
        -1 is a character without a piece, spelt in bytes, which no merge reaches over.
        """
        found: dict[str, bytes] = {}
        stem, apart, judge, longest, pack = self.stems.get, self.apart.get, self._stays_apart, self.longest, self._packed
        last, back, before = [-1], [0], ""
        for word in sorted(words):
            size, shared = len(word), 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            last[shared + 1 :] = back[shared + 1 :] = [None] * (size - shared)
            for start in range(shared + 1 - longest if shared >= longest else 0, size):
                # Going forward, the first start to reach an end has the longest piece there.
                behind = last[start]
                end = start if start > shared else shared
                while end < size:
                    end += 1
                    own = stem(word[start:end])
                    if own is None or own < 0:
                        if end == start + 1 and last[end] is None:
                            last[end], back[end] = -1, start
                        if own is None:
                            break
                    elif last[end] is None:
                        if behind >= 0:
                            ok = apart(behind << 20 | own)
                            if not (judge(behind, own) if ok is None else ok):
                                continue
                        last[end], back[end] = own, start
            ids: list[int] = []
            at = size
            while at:
                own, start = last[at], back[at]
                if own >= 0:
                    ids.append(own)
                else:
                    ids.extend(self.byte[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass")))
                at = start
            ids.reverse()
            found[word] = pack(*ids)
            before = word
        return found

    _words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def marked(self, text: str) -> list[str]:
        return self._words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)

    def learn(self, words: Iterable[str]) -> None:
        """Make every word of ``words`` known. When the table has half of ``keep`` words it
        becomes the former generation, from which a word that is asked for again moves on
        without being encoded again; what is not asked for is forgotten."""
        asked = set(words)
        new = asked.difference(self.known)
        if new and len(self.known) + len(new) > self.keep // 2:
            self.former, self.known, new = self.known, {}, asked
        again = new.intersection(self.former)
        self.known.update((w, self.former[w]) for w in again)
        self.known.update(self.encode_words(new.difference(again)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def trie(path: str, keep: int = KEEP) -> PieceTrie:
    return PieceTrie(path, keep)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, held_words: int) -> Iterator[pa.RecordBatch]:
    own = trie(path, held_words)

    def out(part: pa.RecordBatch, held: list[str]) -> pa.RecordBatch:
        lists = [own.marked(t) for t in held]
        own.learn(chain.from_iterable(lists))
        values, ends, same = [], [0], []
        for text, words in zip(held, lists, strict=True):
            ids = own.encode(words)
            same.append(own.decode(ids.tolist()) == text.replace(MARK, " "))
            values.append(ids)
            ends.append(ends[-1] + len(ids))
        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
        more = [made, pa.array(np.diff(ends).astype(np.int64)), pa.array(same)]
        return pa.RecordBatch.from_arrays([*part.columns, *more], names=[f"c{i}" for i in range(part.num_columns + 3)])

    for batch in batches:
        low, held, size = 0, [], 0
        for n, text in enumerate(texts(batch)):
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER or n == batch.num_rows - 1:
                yield out(batch.slice(low, n + 1 - low), held)
                low, held, size = n + 1, [], 0


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), held_words: int = KEEP) -> DataFrame:
    """The columns ``keep`` with piece_ids (array of int), n_pieces, round_trip.

    round_trip says that decoding the ids gives the text back (a word mark in the text
    decodes as a space, as in the library). Null and empty texts have no pieces. Rows with a
    null or repeated doc_id are encoded like others; an empty table gives no rows. A kept
    column that is named like one of the three new ones is replaced by it. Each task keeps
    ``held_words`` words encoded at most; fewer take less memory and more time.
    """
    # Columns travel by number, so that no name can clash.
    kept = [docs[c] for c in keep]
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(kept)], F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields))
    n = len(kept)
    made = rows.mapInArrow(partial(_encoded, path=path, held_words=held_words), f"{kinds}, c{n + 1} array<int>, c{n + 2} long, c{n + 3} boolean")
    own = ("piece_ids", "n_pieces", "round_trip")
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in own]
    return made.select(*named, *[F.col(f"c{n + 1 + i}").alias(c) for i, c in enumerate(own)])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = trie(path)
    for batch in batches:
        out = [None if ids is None else own.decode(ids) for ids in (v.as_py() for v in batch.column("piece_ids"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, piece_ids); null ids give a null text."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids")
    return rows.mapInArrow(partial(_decoded, path=path), "doc_id long, text string")
