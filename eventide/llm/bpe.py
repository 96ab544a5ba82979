"""BPE encoding and decoding by speculation and verification.

Texts are cut into pieces as the tokenizer file says. For each piece not seen yet, greedy
longest match proposes tokens; one vectorised lookup then tests every adjacent pair of all
proposals. A pair (a, b) is compatible if merging the characters of both gives back exactly
[a, b]; a proposal whose tokens and pairs all pass is the BPE result, since the first merge
across a token border would also happen in that pair alone. Only pieces that fail are merged
exactly, by rank.

Token ids are kept as little-endian unsigned 32-bit integers in a binary column.
Null texts count as empty; an empty text has no tokens and decodes to the empty string.
Rows are independent: repeated rows, ties and extra columns pass through unchanged.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: White space as the tokenizer's regex engine has it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = regex.compile(f"[{_WS}]+")
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
_END = "</w>"
_NONE = 1 << 60
#: Pieces whose tokens a worker remembers, and pairs whose verdict it remembers, at most.
CACHE_PIECES, CACHE_PAIRS = 500_000, 500_000
#: New pieces that are encoded at once, at most, and pieces of texts whose tokens are held at once.
LEARN_PIECES, HELD_PIECES = 25_000, 400_000


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Bpe:
    """One tokenizer file (kind BPE with an end-of-word suffix and byte stand-ins)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.n = len(self.tokens)
        self.reach: dict[str, int] = {}  # the longest token by its first two characters
        for t in self.vocab:
            t = t.removesuffix(_END)
            self.reach[t[:2]] = max(self.reach.get(t[:2], 0), len(t))
        self.bytes = dict(zip(range(256), _byte_chars(), strict=True))
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.pairs: dict[int, bool] = {}

    def symbols(self, piece: str) -> list[str]:
        s = list(piece.encode("utf-8").decode("latin-1").translate(self.bytes))
        s[-1] += _END
        return s

    def merge(self, s: list[str]) -> list[str]:
        """Exact merging: the pair of lowest rank first, the leftmost of equal ones."""
        if len(s) > 100:
            return self._merge_long(s)
        s, get = list(s), self.ranks.get
        ranks = [get(p, _NONE) for p in zip(s, s[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            s[i] += s.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((s[i], s[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((s[i - 1], s[i]), _NONE)
        return s

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and links, so that a piece of any length takes n log n steps."""
        s: list[str | None] = list(symbols)
        after, before = [*range(1, len(s)), -1], [*range(-1, len(s) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [x for x in s if x is not None]

    def propose(self, s: list[str]) -> list[int]:
        """Greedy longest match over the characters of a piece."""
        text, end, i, out, get = "".join(s)[: -len(_END)], len(s), 0, [], self.vocab.get
        while i < end:
            for j in range(min(end, i + self.reach.get(text[i : i + 2], 1)), i, -1):
                if (t := get(text[i:j] + _END if j == end else text[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return []
        return out

    def _split(self, i: int) -> list[str]:
        t = self.tokens[i]
        return [*t[: -len(_END) - 1], t[-len(_END) - 1 :]] if t.endswith(_END) and t != _END else list(t)

    def _fits(self, pair: int) -> bool:
        """Whether the pair a * n + b (or the lone token a, as a * n + a - coded below zero) stands."""
        ids = [-pair - 1] if pair < 0 else [*divmod(pair, self.n)]
        return self.merge([c for i in ids for c in self._split(i)]) == [self.tokens[i] for i in ids]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Encode pieces that no cache has yet, and remember them."""
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.pieces = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs = {}
        marks = [self.symbols(p) for p in new]
        proposals = [self.propose(s) for s in marks]
        counts = np.array([len(p) for p in proposals])
        flat = np.array([i for p in proposals for i in p], np.int64)
        owner = np.repeat(np.arange(len(new)), counts)
        inner = owner[1:] == owner[:-1]
        alone = np.flatnonzero(counts == 1)
        starts = np.cumsum(counts) - counts
        # Every adjacent pair, and the single token of one-token pieces, coded as one integer.
        codes = np.concatenate([flat[:-1][inner] * self.n + flat[1:][inner], -flat[starts[alone]] - 1])
        of = np.concatenate([owner[:-1][inner], alone])
        distinct, back = np.unique(codes, return_inverse=True)
        for c in distinct.tolist():
            if c not in self.pairs:
                self.pairs[c] = self._fits(c)
        good = np.array([self.pairs[c] for c in distinct.tolist()], bool)
        failed = counts == 0
        failed[of[~good[back]]] = True
        learned = {}
        for k, bad in enumerate(failed.tolist()):
            ids = [self.vocab[t] for t in self.merge(marks[k]) if t in self.vocab] if bad else proposals[k]
            learned[new[k]] = np.array(ids, "<u4").tobytes()
        self.pieces |= learned
        return learned

    def cut(self, text: str) -> list[str]:
        """The pieces of a text. Special tokens' own strings are pieces by themselves."""
        parts = self.split.split(text) if self.split else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
                continue
            if not part.isascii():
                # Each character is lowered by itself, so a final sigma stays a plain one.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += _PIECE.findall(_SPACES.sub(" ", part).lower() if not part.isascii() else part.lower())
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Where learning would empty the cache, what these pieces need is held."""
        distinct = set(pieces)
        new = list(distinct.difference(self.pieces))
        room = len(self.pieces) + len(new) <= CACHE_PIECES
        held = self.pieces if room else {p: self.pieces[p] for p in distinct.difference(new)}
        for at in range(0, len(new), LEARN_PIECES):
            learned = self.learn(new[at : at + LEARN_PIECES])
            if not room:
                held |= learned
        return list(map(held.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        flat = list(chain.from_iterable(cuts))
        ids = list(chain.from_iterable(self.ids_of(flat[at : at + HELD_PIECES]) for at in range(0, len(flat), HELD_PIECES)))
        return [b"".join(ids[a:b]) for a, b in pairwise([0, *accumulate(map(len, cuts))])]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by one space, as a tokenizer without a decoder does."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    """One per worker process and file."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_bytes", decoded: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` (binary, little-endian unsigned 32 bit) and, if ``decoded``
    names a column, the text that they decode to.

    A narrow step: no shuffle, a task holds one slice of a batch. ``path`` is the tokenizer file
    on the workers. Columns named like the results are replaced.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    added = [T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, text):
                coded = bpe.encode([t or "" for t in part.column(text).to_pylist()])
                new = [pa.array(coded, pa.binary()), *([pa.array(map(bpe.decode, coded), pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_bytes", decoded: str = "decoded") -> DataFrame:
    """Add the text that a column of token ids decodes to; null decodes to the empty text."""
    keep = [c for c in tokens.columns if c != decoded]
    schema = T.StructType([*(tokens.schema[c] for c in keep), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, ids):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([bpe.decode(i or b"") for i in part.column(ids).to_pylist()], pa.string())], names=schema.names)

    return tokens.select(*keep).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Per row: doc_id, the number of tokens and SHA-256 of the ids and of the decoded text."""
    out = encode(docs.select("doc_id", text), path, text, decoded="decoded")
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(token_bytes) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_bytes", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
