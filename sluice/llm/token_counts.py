"""Token counts of a piece model: rank-synchronous merging on ragged arrays.

A text, with spaces as the model writes them and one put before it, is cut at
spaces, and long words also between characters that stand side by side in no
piece.  The pre-tokens of a batch that are new are held together as one ragged
array of symbols; in each step every sequence applies its lowest-rank pair (the
leftmost, if it has it twice), all at once, and sequences without a pair leave.
What survives is counted; a character that the vocabulary lacks counts its
UTF-8 bytes.

A sequence of more than LONG symbols would take as many steps as it has merges.
It is merged alone, rank by rank: a step applies all places of its lowest rank
from the left on, up to the first whose merge makes a pair of no higher rank
(that one's turn comes before the places to the right), and only the pairs
beside the merged places are looked up again.

Defined results.  Null text counts as empty: 0 bytes, 0 tokens.  Null ids are
passed through, repeated rows counted alike; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model

SPACE = "▁"
#: The rank of a pair that makes no piece.
NONE = 1 << 40
LIMIT = 4096
#: Pre-tokens whose counts a worker keeps at most, and their greatest length.
KEPT, KEPT_LENGTH = 300_000, 64
#: Symbols of a sequence that is merged alone, and characters of a word that is cut between unjoined characters.
LONG = 200


class Pieces:
    """The vocabulary of a piece model as symbols and ranked pairs."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [
            (sp.id_to_piece(i), sp.get_score(i))
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        # higher score first; pieces of one score share a rank: the leftmost is merged
        ranks = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.id = {p: i for i, (p, _) in enumerate(pieces)}
        self.rank = {p: ranks[s] for p, s in pieces}
        # a pair of symbols -> (rank, symbol): every split of a piece in two symbols
        chars = sorted({c for p in self.id for c in p})
        self.symbol = {c: i for i, c in enumerate(chars)}
        for p in self.id:
            self.symbol.setdefault(p, len(self.symbol))
        self.missing = len(self.symbol)  # a character of no piece
        pairs = []
        for p in self.id:
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a * (self.missing + 1) + b, self.rank[p], self.symbol[p]))
        pairs.sort()
        self.pairs = np.array([x[0] for x in pairs], np.int64)
        self.ranks = np.array([x[1] for x in pairs], np.int64)
        self.made = np.array([x[2] for x in pairs], np.int64)
        self.known = {c for c in chars if c in self.id}
        # nothing joins another character to a following space
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.cut = regex.compile(rf"(?s).+" if inner else rf"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")

        #: characters that stand side by side in a piece
        self.joined = np.unique(np.array([ord(a) << 32 | ord(b) for p in self.id for a, b in zip(p, p[1:])], np.int64))

    def pre_tokens(self, text: str) -> list[str]:
        words = self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if max(map(len, words), default=0) > LONG:
            words = [x for w in words for x in (self._apart(w) if len(w) > LONG else (w,))]
        return words

    def _apart(self, word: str) -> list[str]:
        c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        cuts = np.flatnonzero(~np.isin(c[:-1] << 32 | c[1:], self.joined)) + 1
        return [word[i:j] for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)])]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, or NONE; symbol made) of each pair of symbols."""
        pair = a * (self.missing + 1) + b
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.ranks[at], NONE), self.made[at]

    def count_long(self, token: str) -> int:
        """Tokens of one long sequence."""
        n = len(token)
        sym = np.fromiter((self.symbol.get(c, self.missing) for c in token), np.int64, n)
        cost = np.fromiter((1 if c in self.known else len(c.encode()) for c in token), np.int64, n)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # the symbols beside each; n and -1: none
        rank, made = np.full(n, NONE), np.zeros(n, np.int64)  # of each symbol with the one after it
        rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
        places: dict[int, list] = {}
        order = np.argsort(rank, kind="stable")
        cuts = np.flatnonzero(np.diff(rank[order], prepend=-1))
        for at in np.split(order, cuts[1:]):
            if len(at) and rank[at[0]] < NONE:
                places[int(rank[at[0]])] = [at]
        queue = sorted(places)
        while queue:
            r = heapq.heappop(queue)
            every = np.unique(np.concatenate(places.pop(r)))
            every = every[rank[every] == r]
            if not len(every):
                continue
            # of places that overlap, every other one from the left
            nth = np.arange(len(every))
            tied = np.zeros(len(every), bool)
            tied[1:] = after[every[:-1]] == every[1:]
            at = every[(nth - np.maximum.accumulate(np.where(tied, 0, nth))) % 2 == 0]
            # what each makes with its neighbours, as they are when the merges to its left are done
            right, new = after[at], made[at]
            left, far = before[at], after[right]
            beside = sym[np.maximum(left, 0)]
            close = np.zeros(len(at), bool)
            close[1:] = far[:-1] == at[1:]
            beside[1:] = np.where(close[1:], new[:-1], beside[1:])
            low = np.where(left >= 0, self._pairs(beside, new)[0], NONE)
            low = np.minimum(low, np.where(far < n, self._pairs(new, sym[np.minimum(far, n - 1)])[0], NONE))
            early = np.flatnonzero(low <= r)
            if len(early):
                some = slice(int(early[0]) + 1)
                at, right, new, far = at[some], right[some], new[some], far[some]
            sym[at], cost[at], cost[right], rank[right] = new, 1, 0, NONE
            after[at] = far
            before[far[far < n]] = at[far < n]
            # each merged symbol and the one before it have a new symbol after them
            look = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            end = after[look] >= n
            rank[look[end]] = NONE
            look = look[~end]
            rank[look], made[look] = self._pairs(sym[look], sym[after[look]])
            if len(early):
                look = np.concatenate([look, every])
            for q in np.unique(rank[look]).tolist():
                if q < NONE:
                    if q not in places:
                        heapq.heappush(queue, q)
                    places.setdefault(q, []).append(look[rank[look] == q])
        return int(cost.sum())

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        if not tokens:
            return out
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if long:
            out[long] = [self.count_long(tokens[i]) for i in long]
            short = [i for i, t in enumerate(tokens) if len(t) <= LONG]
            out[short] = self.count([tokens[i] for i in short])
            return out
        get, base = self.symbol.get, self.missing + 1
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sym = np.fromiter((get(c, self.missing) for t in tokens for c in t), np.int64, int(lens.sum()))
        # what a surviving symbol counts: 1, or the bytes of a character that has no piece of its own
        cost = np.ones(len(sym), np.int64)
        odd = np.fromiter((c not in self.known for t in tokens for c in t), bool, len(sym))
        if odd.any():
            cost[odd] = [len(c.encode()) for c, o in zip((c for t in tokens for c in t), odd) if o]
        owner = np.repeat(np.arange(len(tokens)), lens)
        while len(sym):
            pair = sym[:-1] * base + sym[1:]
            pair[owner[:-1] != owner[1:]] = -1
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            hit = np.flatnonzero(self.pairs[at] == pair)
            if not len(hit):
                break
            # the first place of the lowest rank in each sequence
            rank, own = self.ranks[at[hit]], owner[hit]
            order = np.lexsort((hit, rank, own))
            lead = np.ones(len(order), bool)
            lead[1:] = own[order][1:] != own[order][:-1]
            place = hit[order[lead]]
            sym[place] = self.made[at[place]]
            cost[place] = 1
            stay = np.ones(len(sym), bool)
            stay[place + 1] = False
            # sequences without a pair are done
            live = np.zeros(len(tokens), bool)
            live[own] = True
            done = stay & ~live[owner]
            out += np.bincount(owner[done], cost[done], len(tokens)).astype(np.int64)
            stay &= ~done
            sym, cost, owner = sym[stay], cost[stay], owner[stay]
        return out + np.bincount(owner, cost, len(tokens)).astype(np.int64)


def pieces(data: bytes) -> Pieces:
    return model(("pieces", hash(data)), lambda: Pieces(data))


def _count(batches, sent):
    p, seen = pieces(sent.value), {}
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            lists = [p.pre_tokens(t) for t in part["t"].to_pylist()]
            if len(seen) > KEPT:
                seen.clear()
            new = list({w for ws in lists for w in ws if w not in seen})
            # long sequences take many steps: they go together
            new.sort(key=len)
            for j in range(0, len(new), 20_000):
                seen.update(zip(new[j : j + 20_000], p.count(new[j : j + 20_000]).tolist()))
            n = [sum(map(seen.__getitem__, ws)) for ws in lists]
            for w in new:
                if len(w) > KEPT_LENGTH:
                    del seen[w]
            yield pa.RecordBatch.from_arrays([part["id"], part["n_bytes"], pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit.  path: the model's file, read once on the driver."""
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t"), F.octet_length(t).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_count, sent=sent), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
