"""Byte-pair encoding by speculation and verification, and decoding.

For all words of a slice of texts that a worker does not remember:

1. *Speculate*: the longest token of the vocabulary that fits is taken, again and again; an automaton of all
   tokens reads the words as one string. The last character of a word stands for itself and the word-end mark, so
   no token crosses words.
2. *Verify*: a sequence of tokens is what merging in rank order gives if and only if each
   adjacent pair, merged alone from its symbols, gives those two tokens. All adjacent pairs
   of all new words are looked up at once in a sorted table of judged pairs; pairs that the table
   lacks are judged by merging their symbols, once.
3. Only words with a failing pair are merged exactly: those up to ``LONG`` symbols in lockstep, one merge a word
   and step, longer ones by a heap over a linked list, so that the time grows with n log n.

A text is cut at white space first; no token and no normal form crosses it, so a piece
always gives the same ids. Pieces and words are remembered in two generations: what is met again moves to the younger
one, and when that has ``remember`` entries the older one is forgotten (results do not depend on it). The vocabulary file is
read on the executors from the path given; its normaliser and its splitting rule are used as the file states them.
Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MARK = "</w>"
LAST = 0x400  # added to the last character of a word; byte characters lie below
NONE = 1 << 60
LONG = 64
UNSETTLED = re.compile("[\u0250-\U0010ffff]|<\\|").search  # from U+0250 on letters may compose; special tokens begin with "<|"


class Recent:
    """Values of the keys met last, in two generations of up to ``limit`` entries."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Keys without a value; all others are in ``young`` from here until the next call."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = [k for k in keys if k not in young]
        young.update((k, old[k]) for k in new if k in old)
        return [k for k in new if k not in young]

    def shrink(self) -> None:
        """Keep the younger generation only."""
        self.old = {}


class Bpe:
    """Encoder and decoder of one vocabulary file with word-end marks."""

    def __init__(self, path: str, remember: int = 50_000, most_judged: int = 1_000_000):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        written, self.symbols = [""] * size, [""] * size
        for token, k in [*model["vocab"].items(), *self.special.items()]:
            written[k] = token
        self.strings = pa.array(written, pa.string())
        rules = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.find = regex.compile(f"(?:{rules[0]})| ").findall  # a blank ends a piece
        # byte characters as the file's byte level writes them: printable Latin-1 bytes as they are, the others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [k for k in range(256) if k not in shown]
        self.bytes = {k: 0x100 + n for n, k in enumerate(hidden)}
        self.automaton, self.base = ahocorasick.Automaton(), np.zeros(2 * LAST, np.int64)
        vocab = {self._marked(t): k for t, k in model["vocab"].items()}
        for token, k in vocab.items():
            self.symbols[k] = token
            self.automaton.add_word(token, k)
            if len(token) == 1:
                self.base[ord(token)] = k
        self.automaton.make_automaton()
        self.width, self.kind = size + 1, np.uint16 if size <= 1 << 16 else np.int32
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[self._marked(a)] * self.width + vocab[self._marked(b)] for a, b in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.pairs = keys[self.rank]
        self.results = np.array([vocab[self._marked(a + b)] for a, b in pairs], np.int64)
        self.judged, self.sound = np.zeros(0, np.int64), np.zeros(0, bool)
        self.pieces, self.words, self.most_judged = Recent(remember), Recent(remember), most_judged
        self._library = self._ranks = None

    @staticmethod
    def _marked(token: str) -> str:
        """A token of the file in symbols: one character each, the mark joined to the one before it."""
        return token[: -len(MARK) - 1] + chr(ord(token[-len(MARK) - 1]) + LAST) if token.endswith(MARK) and token != MARK else token

    @property
    def library(self):
        """Normaliser and splitting of the file, without its model; only letters that may compose need them."""
        if self._library is None:
            from tokenizers import Tokenizer

            with open(self.path, encoding="utf-8") as f:
                spec = json.load(f)
            names = {t["content"]: k for k, t in enumerate(spec["added_tokens"])}
            spec["model"] |= {"vocab": names, "merges": []}
            spec |= {"added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
            self._library = Tokenizer.from_str(json.dumps(spec))
        return self._library

    def bare(self, symbols: str) -> np.ndarray:
        """Ids of single symbols."""
        return self.base[np.frombuffer(symbols.encode("utf-32-le"), np.uint32)]

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NONE`` where they do not merge."""
        keys = left * self.width + right
        spot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[spot] == keys, self.rank[spot], NONE)

    def merged_long(self, ids: list[int]) -> list[int]:
        """Exact merging of one word: the pair of lowest rank first, the leftmost of equals."""
        if self._ranks is None:
            self._ranks = dict(zip(self.pairs.tolist(), self.rank.tolist()))
        ids, width, rank = list(ids), self.width, self._ranks.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(ids[k] * width + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] < 0 or nxt >= n or rank(ids[k] * width + ids[nxt]) != r:
                continue  # an entry of a pair that is no more
            ids[k], ids[nxt] = int(self.results[r]), -1
            after[k] = end = after[nxt]
            if end < n:
                before[end] = k
                if (r := rank(ids[k] * width + ids[end])) is not None:
                    heapq.heappush(heap, (r, k))
            if (start := before[k]) >= 0 and (r := rank(ids[start] * width + ids[k])) is not None:
                heapq.heappush(heap, (r, start))
        return [t for t in ids if t >= 0]

    def merged(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words, laid end to end, in lockstep: ids and how many each word has."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ids, rank, done = ids.copy(), np.full(len(ids), NONE), []
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranked(ids[inner], ids[inner + 1])
        lengths = sizes[sizes > 0]
        while len(ids):
            low = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            live = low < NONE
            if not live.all():
                rest = np.repeat(live, lengths)
                done.append((owner[~rest], ids[~rest]))
                ids, owner, rank, lengths, low = ids[rest], owner[rest], rank[rest], lengths[live], low[live]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, lengths))
            first = hits[np.diff(owner[hits], prepend=-1) != 0]
            ids[first] = self.results[low]
            stay = np.ones(len(ids), bool)
            stay[first + 1] = False
            ids, owner, rank, lengths = ids[stay], owner[stay], rank[stay], lengths - 1
            at = first - np.arange(len(first))
            rank[at] = NONE
            for left in (at[at > 0] - 1, at[at < len(ids) - 1]):
                left = left[owner[left] == owner[left + 1]]
                rank[left] = self.ranked(ids[left], ids[left + 1])
        if not done:
            return ids, sizes
        owner, ids = (np.concatenate(parts) for parts in zip(*done))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def proposed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left of words in symbols: ids and how many each word has."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long("".join(words))), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1
        return found[:, 1], np.diff(np.searchsorted(found[:, 0], ends, side="right"), prepend=0)

    def verified(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which proposals are what exact merging gives."""
        owner = np.repeat(np.arange(len(size)), size)
        inner = owner[:-1] == owner[1:]
        alone = np.flatnonzero(size == 1)
        keys = np.concatenate([flat[:-1][inner] * self.width + flat[1:][inner] + 1, flat[np.cumsum(size)[alone] - 1] * self.width])
        owners = np.concatenate([owner[:-1][inner], alone])
        distinct = np.unique(keys)
        if len(self.judged) > self.most_judged:
            self.judged, self.sound = self.judged[:0], self.sound[:0]
        new = distinct[~np.isin(distinct, self.judged)]
        if len(new):
            left, right = np.divmod(new, self.width)
            names = [self.symbols[a] + (self.symbols[b - 1] if b else "") for a, b in zip(left.tolist(), right.tolist())]
            ids, sizes = self.merged(self.bare("".join(names)), np.fromiter(map(len, names), np.int64, len(names)))
            end = np.cumsum(sizes)
            right_as_is = (right == 0) | (ids[end - 1] == right - 1)
            answers = (sizes == 1 + (right > 0)) & (ids[end - sizes] == left) & right_as_is
            order = np.argsort(np.concatenate([self.judged, new]), kind="stable")
            self.judged, self.sound = np.concatenate([self.judged, new])[order], np.concatenate([self.sound, answers])[order]
        good = np.ones(len(size), bool)
        good[owners[~self.sound[np.searchsorted(self.judged, keys)]]] = False
        return good

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids, as bytes of ``kind``, of words given as byte characters without mark."""
        if not words:
            return []
        words = [w[:-1] + chr(ord(w[-1]) + LAST) for w in words]
        flat, size = self.proposed(words)
        failing = np.flatnonzero(~self.verified(flat, size))
        out = self._cut(flat, size)
        short = [k for k in failing.tolist() if len(words[k]) <= LONG]
        ids, sizes = self.merged(self.bare("".join([words[k] for k in short])), np.array([len(words[k]) for k in short], np.int64))
        for k, exact in zip(short, self._cut(ids, sizes)):
            out[k] = exact
        for k in failing.tolist():
            if len(words[k]) > LONG:
                out[k] = np.array(self.merged_long(self.bare(words[k]).tolist()), self.kind).tobytes()
        return out

    def _cut(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        raw, ends = ids.astype(self.kind).tobytes(), np.cumsum(sizes) * np.dtype(self.kind).itemsize
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def split(self, text: str) -> list[str | bytes]:
        """Words of a piece as byte characters, special tokens as their ids."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        out: list[str | bytes] = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], self.kind).tobytes())
            else:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)) if w]
        return out

    def learn(self, pieces: set[bytes]) -> None:
        """Encode pieces not met before, all their new words at once."""
        plain, found = [], []
        hard, parts = [], []
        for piece in self.pieces.missing(pieces):
            text = piece.decode("utf-8", "replace")
            if text.isprintable() and not UNSETTLED(text):
                plain.append(piece)
                found.append(text)
            else:
                hard.append(piece)
                parts.append(self.split(text))
        found = self.find(" ".join([*found, ""]).lower())
        if plain and any(not p.isascii() for p in plain):
            found = [w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in found]
        new = self.words.missing({*found, *[w for p in parts for w in p if isinstance(w, str)]} - {" "})
        known = self.words.young
        known.update(zip(new, self.encoded(new)))
        known[" "] = b""
        values = list(map(known.__getitem__, found))
        total = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))
        ends = total[[k for k, w in enumerate(found) if w == " "]].tolist()
        raw, young = b"".join(values), self.pieces.young
        young.update((piece, raw[a:b]) for piece, a, b in zip(plain, [0, *ends[:-1]], ends))
        young.update((piece, b"".join([known[w] if isinstance(w, str) else w for w in p])) for piece, p in zip(hard, parts))

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and how many each has."""
        pieces = [t.split() for t in texts]
        self.learn(set().union(*pieces))
        value = self.pieces.young.__getitem__
        raw = [b"".join(map(value, p)) for p in pieces]
        counts = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(raw), self.kind).astype(np.int32), counts

    def rest(self) -> None:
        """Give back what the next task of this worker may need."""
        self.pieces.shrink()
        self.words.shrink()
        pa.default_memory_pool().release_unused()

    def decoded(self, lists: pa.Array) -> pa.Array:
        """Token strings of lists of ids joined by spaces, special tokens included."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.strings.take(lists.values)), " ")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1_000_000) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every row.

    ``vocabulary`` is the path of the vocabulary file on every executor. Texts are encoded in slices of
    about ``slice_bytes``.

    Cases: a null or empty text, or one of white space only, has no ids and decodes to an empty text; strings of special tokens
    in a text become their ids; repeated rows are encoded each; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // slice_bytes
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
            for a, b in zip(cuts, cuts[1:]):
                ids, per_text = bpe.batch(texts.slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists, bpe.decoded(lists)], ["doc_id", "ids", "decoded"])
        bpe.rest()

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the decoded text of ``ids_col``; null ids give a null text."""
    @F.pandas_udf("string")
    def apply(ids):
        lists = pa.array(ids.tolist(), pa.list_(pa.int32()))
        return pc.if_else(lists.is_null(), None, loaded(vocabulary).decoded(lists)).to_pandas()

    return rows.withColumn(out_col, apply(F.col(ids_col)))
