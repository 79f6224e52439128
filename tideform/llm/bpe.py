"""Byte-pair encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Merges apply in the order of their rank, so what lies to the right of a token can still change it, but only through a
chain of merges of ever smaller rank. ``sufficient_lookahead`` walks the merge list once and bounds how many symbols such
a chain reaches. The transducer keeps that many symbols beyond the last token that it emits; everything before is final,
because a token boundary that no merge crossed splits the input into two parts that merge independently. So memory does
not grow with a word's length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import text_or_empty

SCHEMA = "doc_id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
CACHE_ROWS = 500_000  # chunks that a task remembers at most; then it forgets all and goes on
LONG_CHUNK = 200  # longer chunks are encoded as a stream and not remembered
PORTION = 4096  # ids that leave the encoder at once, or a few more
SLICE = 1 << 16  # characters of a text that are split at once


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols beyond a merge's left part that can still decide whether it happens.

    Merge r = (u, v) needs v. A merge of smaller rank can take away v, or one of the tokens along v's right edge that v
    is made of, together with what follows; that again needs its own right part, and so on. Ranks fall along the chain,
    so one pass over the list in rank order finds the longest reach.
    """
    parts = {u + v: (u, v) for u, v in reversed(merges)}
    reach: dict[str, int] = {}  # by left part: the longest reach of the merges so far
    worst = 1
    for u, v in merges:
        edge, x = [v], v
        while x in parts:
            x = parts[x][1]
            edge.append(x)
        need = length[v] + max(reach.get(x, 0) for x in edge)
        reach[u] = max(reach.get(u, 0), need)
        worst = max(worst, need)
    return worst


class Transducer:
    """Streaming encoder of the pieces that pre-tokenising yields; ``text_of`` is what a decoder needs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rank = {m: r for r, m in enumerate(merges)}
        size = lambda s: len(s.removesuffix(self.suffix)) if self.suffix else len(s)
        self.lookahead = sufficient_lookahead(merges, {x: size(x) for m in merges for x in m})
        self.symbols = byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: s for s, i in [*self.vocab.items(), *self.added.items()]}

    def _merge(self, s: list[str]) -> list[str]:
        """Merge by rank, equal ranks from the left: a queue of pairs, over a chain of the symbols that are left."""
        n, rank = len(s), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue  # one of the two is gone by now
            s[i], s[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((s[i], s[k]))) is not None:
                    heapq.heappush(queue, (r, i, s[i], s[k]))
            if (h := before[i]) >= 0 and (r := rank.get((s[h], s[i]))) is not None:
                heapq.heappush(queue, (r, h, s[h], s[i]))
        return [x for x in s if x]

    def stream(self, piece: Iterable[int]) -> Iterator[str]:
        """Tokens of one piece (bytes in order), each emitted once nothing to come can change it."""
        window: list[str] = []
        room, source = 4 * self.lookahead, iter(piece)
        ended = False
        while not ended or window:
            while len(window) < room:
                b = next(source, None)
                if b is None:
                    if not ended and window and self.suffix:
                        window[-1] += self.suffix
                    ended = True
                    break
                window.append(self.symbols[b])
            tokens = self._merge(list(window))
            if ended:
                yield from tokens
                return
            taken, stable = 0, len(window) - self.lookahead - 1
            for t in tokens:  # the last symbol of the piece is not here yet: no token holds the word end
                if taken + len(t) > stable:
                    break
                taken += len(t)
                yield t
            if taken:
                window = window[taken:]
            else:  # one token longer than the stable part: look further
                room *= 2

    def piece(self, text: str) -> Iterator[int]:
        """Ids of one piece; a token that the vocabulary does not hold gives none."""
        for token in self.stream(text.encode("utf-8")):
            if (i := self.vocab.get(token)) is not None:
                yield i


class WordBpe(Transducer):
    """The tokenizer whose normaliser composes, lower-cases and splits at white space, with a word end on each piece."""

    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
    SPACE = regex.compile(r"[\t-\r \x85\p{Z}]+")

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def normal(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # no final form of sigma

    def portions(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in order, in portions of a bounded size: a long piece leaves as its tokens become stable."""
        out: list[int] = []
        for plain, special in self._parts(text):
            for chunk in self._chunks(plain):
                if (got := self.known.get(chunk)) is not None:
                    out += got
                elif len(chunk) <= LONG_CHUNK:
                    if len(self.known) >= CACHE_ROWS:
                        self.known.clear()
                    got = self.known[chunk] = tuple(self._ids(self.normal(chunk)))
                    out += got
                else:
                    for i in self._ids(self.normal(chunk)):
                        out.append(i)
                        if len(out) >= PORTION:
                            yield out
                            out = []
                if len(out) >= PORTION:
                    yield out
                    out = []
            if special is not None:
                out.append(special)
        if out:
            yield out

    def _ids(self, chunk: str) -> Iterator[int]:
        for m in self.PIECE.finditer(chunk):
            piece = m[0]
            if (got := self.words.get(piece)) is not None:
                yield from got
            elif len(piece) <= LONG_CHUNK:
                if len(self.words) >= CACHE_ROWS:
                    self.words.clear()
                got = self.words[piece] = tuple(self.piece(piece))
                yield from got
            else:
                yield from self.piece(piece)

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Text between special tokens, each with the special token that ends it."""
        if not self.special or not any(x in text for x in self.added):
            yield text, None
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], self.added[m[0]]
            at = m.end()
        yield text[at:], None

    def _chunks(self, text: str) -> Iterator[str]:
        """What stands between white space, from slices of the text that end at a space."""
        split = self.SPACE.split if self.SEPARATORS.search(text) else str.split
        at, end = 0, len(text)
        while at < end:
            to = at + SLICE
            if to < end:
                to = m.end() if (m := self.SPACE.search(text, to)) else end
            yield from filter(None, split(text[at:to]))
            at = to


class Decoder:
    """Incremental decoding: ids come in any portions, text leaves as soon as it is complete.

    Without a decoder in its file the tokenizer joins token texts by one space; ``byte_level`` instead turns them back
    into bytes and keeps the bytes of an unfinished character until the rest arrives (invalid ones become U+FFFD). Ids that
    the vocabulary does not know give nothing.
    """

    def __init__(self, bpe: Transducer, byte_level: bool = False) -> None:
        import codecs

        self.bpe, self.byte_level, self.begun = bpe, byte_level, False
        self.bytes_of = {c: b for b, c in enumerate(bpe.symbols)}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        tokens = [t for t in map(self.bpe.text_of.get, ids) if t is not None]
        if not self.byte_level:
            lead = " " if self.begun and tokens else ""
            self.begun = self.begun or bool(tokens)
            return lead + " ".join(tokens)
        out = []
        for token in tokens:
            end = self.bpe.suffix and token.endswith(self.bpe.suffix)
            core = token.removesuffix(self.bpe.suffix) if end else token
            out.append(self.state.decode(bytes(self.bytes_of[c] for c in core)) + " " * bool(end))
        if final:
            out.append(self.state.decode(b"", True))
        return "".join(out)


def digests_of(portions: Iterable[list[int]], decoder: Decoder) -> tuple[int, str, str]:
    """Number of ids, digest of the ids and digest of what they decode to, both fed as the ids come."""
    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
    for ids in portions:
        body = " ".join(map(str, ids))
        ids_sha.update((f" {body}" if n else body).encode())
        text_sha.update(decoder.feed(ids).encode("utf-8"))
        n += len(ids)
    text_sha.update(decoder.feed((), True).encode("utf-8"))
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns one row per input row: ``(id_col, n_tokens, ids_sha256, decoded_sha256)``; ids leave the encoder in portions,
    and the decoder turns each portion back into text before the next comes. Null texts count as empty and give no tokens. Rows are independent, so repeats give equal results; extra columns are ignored; an empty table
    gives an empty result. ``path`` is the tokenizer's file as executors see it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                count, ids, decoded = digests_of(own.portions(text.as_py()), Decoder(own))
                n.append(count)
                a.append(ids)
                b.append(decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA.format(id=kind).replace("doc_id", f"`{id_col}`", 1))


def bpe_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text themselves: ``(id_col, ids array<int>, decoded string)``, under the rules of bpe_digests."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for frame in frames:
            ids = [[i for part in own.portions(t) for i in part] for t in frame["text"]]
            yield pd.DataFrame({id_col: frame.iloc[:, 0], "ids": ids, "decoded": [Decoder(own).feed(x, True) for x in ids]})

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
