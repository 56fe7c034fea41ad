"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1, so that an automaton over characters matches byte strings. For a piece of text the automaton gives
the longest token at each place. The encoder takes it if it may stand beside its left neighbour, else the next shorter token that
starts there, else it steps back. Two tokens may stand side by side if undoing their merges never meets a merge across the border
that ranks before theirs; the answer is memoised. Positions found dead are marked, so each is tried once and the time is linear in
the piece. The result equals applying the merges in rank order.

Defined results: a null or empty text has no ids and decodes to no bytes. Ids, texts and other columns are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh_name, quoted, whole

#: Distinct pieces in each of the two halves of a Python worker's memo; when the young half is full it becomes the old one. Longer
#: pieces aren't kept.
REMEMBERED = 200_000
REMEMBERED_BYTES = 64
#: Pairs whose compatibility a worker remembers.
PAIRS = 1_000_000


class ByteBpe:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.tokens: dict[int, bytes] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.ids = {t: i for i, t in self.tokens.items()}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the ranks must hold all 256 single bytes")
        self.pieces = regex.compile(pattern)
        self.shorter: dict[int, int] = {}  # the longest token that is a proper start of this one
        self.parts: dict[int, tuple[int, int]] = {}  # the last merge behind a token
        self.merges: dict[tuple[int, int], int] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.lengths = {i: len(t) for i, t in self.tokens.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        reachable = self._learn_merges()
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(self.tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()

    def _learn_merges(self) -> list[int]:
        """Find for each token, by rank, the two tokens that merge into it. Tokens that no merge makes are left out."""
        reachable: list[int] = []
        made: set[int] = set()
        for i in sorted(self.tokens):
            token = self.tokens[i]
            if len(token) == 1:
                self.parts[i] = (i, i)
                made.add(i)
                reachable.append(i)
                continue
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is None or right is None or left >= i or right >= i or left not in made or right not in made:
                    continue
                if self._compatible(left, right):
                    self.merges[left, right] = i
                    self.parts[i] = (left, right)
                    made.add(i)
                    reachable.append(i)
                    break
        self.pairs.clear()  # pairs seen while merges were missing
        for i in reachable:
            token = self.tokens[i]
            for cut in range(len(token) - 1, 0, -1):
                if (start := self.ids.get(token[:cut])) is not None and start in made:
                    self.shorter[i] = start
                    break
        return reachable

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging in rank order leaves the border between the two tokens."""
        limit = len(self.tokens) + 1 << 8
        merges, parts = self.merges, self.parts
        while True:
            if merges.get((left, right), limit) < limit:
                return False
            # Undo the later of the two merges; what is merged across before it counts.
            if left > right:
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._compatible(left, right)
        return found

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole_piece := self.ids.get(piece)) is not None:
            return (whole_piece,)
        lengths, shorter, pairs, n = self.lengths, self.shorter, self.pairs, len(piece)
        longest: list[int] = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[i]] = i  # ends rise, so the last one kept is the longest
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + lengths[token]
            if alive[end]:
                fits = not out or pairs.get((out[-1], token))
                if fits is None:
                    fits = self.compatible(out[-1], token)
                if fits:
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    continue
            if token in shorter:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
        return tuple(out)

    def _ids_of(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            found = self.encode_piece(raw)
            if len(raw) > REMEMBERED_BYTES:
                return found
        if len(self.memo) >= REMEMBERED:
            self.older, self.memo = self.memo, {}
        self.memo[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        get, fresh = self.memo.get, self._ids_of  # a half that has become the old one meanwhile is still right
        return list(chain.from_iterable([get(p) or fresh(p) for p in self.pieces.findall(text)]))

    def forget(self) -> None:
        """Give up what was remembered. Spark keeps a worker process for other tasks, which need the memory."""
        self.memo, self.older, self.pairs = {}, {}, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _coder(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def coder(shared: Broadcast) -> ByteBpe:
    """The encoder of a worker process, built once from the broadcast ranks and pattern."""
    return _coder(*shared.value)


def share_ranks(df: DataFrame, path: str, pattern: str) -> Broadcast:
    """Send the rank file, whose size is that of one vocabulary, to all workers."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast((file.read(), pattern))


def encoded(text: Column, shared: Broadcast) -> Column:
    """The ids of a text."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(shared)
        try:
            for part in texts:
                yield pd.Series([bpe.encode(t) for t in part], dtype=object)
        finally:
            bpe.forget()

    return ids(whole(text))


def decoded(ids: Column, shared: Broadcast) -> Column:
    """The bytes of a list of ids."""

    @F.pandas_udf("binary")
    def raw(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(shared)
        for part in lists:
            yield pd.Series([bpe.decode(list(x)) for x in part], dtype=object)

    return raw(F.coalesce(ids, F.array().cast("array<int>")))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in a column ``into``."""
    return docs.withColumn(into, encoded(F.col(quoted(text)), share_ranks(docs, path, pattern)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: the digests are made from the ids and from the bytes that
    they decode to, where they arise, so that neither list leaves its task. Columns of these names are replaced."""
    shared, out = share_ranks(docs, path, pattern), fresh_name(docs, "coded")

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = coder(shared)
        names = {i: str(i) for i in bpe.tokens}
        try:
            for part in texts:
                rows = []
                for t in part:
                    ids = bpe.encode(t)
                    shown = ",".join(map(names.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.forget()

    found = docs.withColumn(out, digest(whole(F.col(quoted(text)))))
    results = ("n_tokens", "ids_sha256", "decoded_sha256")
    return found.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in results], f"{out}.n_tokens", f"{out}.ids_sha256", f"{out}.decoded_sha256")
