"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A token sequence is what the merges give exactly if each two neighbours,
merged alone, stay as they are; and what a prefix's tokens end in fixes what
its extensions can be.  So the nondeterministic transducer guesses where the
token that covers the next byte began: a guess is (place in the trie of
tokens, token before it, tokens not yet put out).  A state of the determinised
one is the set of live guesses; a step reads one byte, at most one guess
completes a token that fits its neighbour, and the tokens that all guesses
share are put out.  Guesses live for at most the longest token's length: that
bounds the lookahead.  A step is worked out when it is taken, and kept, in a
table of bounded size, from its second use on.

The decoder reads ids one by one.  An incremental UTF-8 machine puts out each
character when its last byte is read and U+FFFD for ill-formed parts; its steps
over whole tokens are kept as well.

Defined results.  Null text counts as empty: no ids.  Null ids of documents are
passed through, repeated rows are coded alike, empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model

#: Steps of the transducer, neighbours tried, and coded words that a worker keeps at most.
KEPT_STEPS, KEPT_FITS, KEPT_WORDS = 100_000, 250_000, 400_000
#: Matches of the pattern that are held at once.
HELD = 50_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(a): int(b) for a, b in pairs}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], room: int = 1):
        self.most_steps, self.most_fits = KEPT_STEPS * room, KEPT_FITS * room
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        child, token, inner = {}, [-1], {0}  # the trie: node << 8 | byte -> node
        for t, i in ranks.items():
            node = 0
            for b in t:
                inner.add(node)
                nxt = child.setdefault(node << 8 | b, len(token))
                if nxt == len(token):
                    token.append(-1)
                node = nxt
            token[node] = i
        #: node << 8 | byte -> (node, the token that ends there or -1, whether longer ones go on)
        self.child = {k: (v, token[v], v in inner) for k, v in child.items()}
        self.fits: dict[int, bool] = {}
        self._forget()

    def _forget(self):
        self.states: dict[tuple, int] = {}
        self.guesses: list[tuple] = []
        self.steps: dict[int, tuple] = {}
        self.taken: set[int] = set()
        self._state(((0, -1, ()),))

    def _state(self, guesses: tuple) -> int:
        k = self.states.get(guesses)
        if k is None:
            k = self.states[guesses] = len(self.guesses)
            self.guesses.append(guesses)
        return k

    def merge(self, data: bytes) -> list[bytes]:
        """The merges applied one by one: what defines the coding."""
        parts, none = [data[i : i + 1] for i in range(len(data))], 1 << 60
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fit(self, before: int, t: int) -> bool:
        """Whether token t can follow token ``before`` (-1: stand first)."""
        key = before << 32 | t
        ok = self.fits.get(key)
        if ok is None:
            y = self.bytes_of[t]
            if before < 0:
                ok = self.merge(y) == [y]
            else:
                x = self.bytes_of[before]
                ok = self._fit(-1, t) and self.merge(x + y) == [x, y]
            if len(self.fits) > self.most_fits:
                self.fits.clear()
            self.fits[key] = ok
        return ok

    def _step(self, guesses: tuple, byte: int) -> tuple[tuple, tuple]:
        """(the live guesses after byte, the ids put out)."""
        live, done = [], None
        for node, before, held in guesses:
            node, t, more = self.child.get(node << 8 | byte, (0, -1, False))
            if t >= 0 and done is None and self._fit(before, t):
                done = (*held, t)
            if more:
                live.append((node, before, held))
        same, most = 0, min([len(done), *[len(g[2]) for g in live]])
        while same < most and all(g[2][same] == done[same] for g in live):
            same += 1
        live = [(k, b, held[same:]) for k, b, held in live]
        live.append((0, done[-1], done[same:]))
        return tuple(live), done[:same]

    def _untabled(self, guesses: tuple, data: bytes, ids: list[int]) -> None:
        """The steps over the rest of a match without the table; tokens are put out where one guess is left."""
        child, fits = self.child, self.fits
        live = []
        for node, before, held in guesses:  # a chain: (chain before, token, whether it is still to be put out)
            chain = (None, before, False)
            for t in held:
                chain = (chain, t, True)
            live.append((node, chain))
        done = chain
        for byte in data:
            on, done = [], None
            for node, chain in live:
                nxt = child.get(node << 8 | byte)
                if nxt is None:
                    continue
                node, t, more = nxt
                if t >= 0 and done is None:
                    ok = fits.get(chain[1] << 32 | t)
                    if ok or ok is None and self._fit(chain[1], t):
                        done = (chain, t, True)
                if more:
                    on.append((node, chain))
            if not on:
                self._out(done, ids)
                done = (None, done[1], False)
            on.append((0, done))
            live = on
        self._out(done, ids)

    @staticmethod
    def _out(chain: tuple, ids: list[int]) -> None:
        back = []
        while chain is not None:
            before, t, own = chain
            if own:
                back.append(t)
            chain = before
        ids += back[::-1]

    def encode(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if len(self.steps) > self.most_steps or len(self.taken) > 4 * self.most_steps:
            self._forget()
        steps, state, ids, n, at = self.steps, 0, [], len(data), 0
        while at < n:  # by the table as far as it goes
            s = steps.get(state << 8 | data[at])
            if s is None:
                key = state << 8 | data[at]
                if key not in self.taken:
                    self.taken.add(key)
                    break
                guesses, out = self._step(self.guesses[state], data[at])
                s = steps[key] = (self._state(guesses), out)
            state = s[0]
            if s[1]:
                ids += s[1]
            at += 1
        if at < n:
            self._untabled(self.guesses[state], data[at:], ids)
        else:
            ids += self.guesses[state][-1][2]
        return ids


class Utf8:
    """An incremental UTF-8 machine: feed bytes, get the characters that are complete.

    A state is the bytes of an unfinished, so far well-formed character.
    """

    @staticmethod
    def _wants(held: bytes) -> tuple[int, int, int]:
        """(length of the character, least and largest next byte)."""
        a = held[0]
        n = 2 if 0xC2 <= a < 0xE0 else 3 if 0xE0 <= a < 0xF0 else 4 if 0xF0 <= a < 0xF5 else 0
        lo, hi = 0x80, 0xBF
        if len(held) == 1:
            lo = {0xE0: 0xA0, 0xF0: 0x90}.get(a, lo)
            hi = {0xED: 0x9F, 0xF4: 0x8F}.get(a, hi)
        return n, lo, hi

    def feed(self, held: bytes, data: bytes) -> tuple[bytes, str]:
        out = []
        for b in data:
            if held:
                n, lo, hi = self._wants(held)
                if lo <= b <= hi:
                    held += bytes((b,))
                    if len(held) == n:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xF5:
                held = bytes((b,))
            else:
                out.append("�")
        return held, "".join(out)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.machine = Utf8()
        self.steps: dict[tuple, tuple] = {}
        self.whole: dict[int, str] = {}  # the steps that begin and end between characters

    def stream(self, ids, held: bytes = b""):
        """(unfinished bytes, text so far) after ids, from the unfinished bytes ``held`` on."""
        if not held:
            out = list(map(self.whole.get, ids))
            if None not in out:
                return held, "".join(out)
        out = []
        for i in ids:
            s = self.steps.get((held, i))
            if s is None:
                if len(self.steps) > KEPT_STEPS:
                    self.steps.clear()
                s = self.steps[held, i] = self.machine.feed(held, self.bytes_of[i])
                if not held and not s[0]:
                    self.whole[i] = s[1]
            held = s[0]
            out.append(s[1])
        return held, "".join(out)

    def decode(self, ids) -> str:
        held, text = self.stream(ids)
        return text + "�" * bool(held)


class Coder:
    """Words coded once: (count, ids as text or, if not named, as a tuple, decoded text).

    The latest words are kept in two generations; a word met again moves to the
    younger one, and when that is full the older one goes.
    """

    def __init__(self, ranks: bytes, pattern: str, named: bool = True):
        table = read_ranks(ranks)
        self.named = named
        room = 2 if named else 1  # a summary's entries are all that its worker holds
        self.half = KEPT_WORDS * room // 2
        self.encoder, self.decoder = Encoder(table, room), Decoder(table)
        self.match = regex.compile(pattern)
        self.name = {i: str(i) for i in table.values()}
        self.words: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _word(self, w: str) -> tuple:
        made = self.older.get(w)
        if made is None:
            ids = self.encoder.encode(w.encode())
            back = self.decoder.stream(ids)[1]
            made = (len(ids), ",".join([self.name[i] for i in ids]) if self.named else tuple(ids), w if back == w else back)
        if len(w) <= 64:
            if len(self.words) > self.half:
                self.older, self.words = self.words, {}
            self.words[w] = made
        return made

    def parts(self, text: str):
        """The text's coded words, some at a time.  Each match ends a character, so decoding starts afresh with it."""
        make = self._word
        if len(text) < 4 * HELD:
            yield [self.words.get(w) or make(w) for w in self.match.findall(text)]
            return
        found = (m.group() for m in self.match.finditer(text))
        while some := [self.words.get(w) or make(w) for w in islice(found, HELD)]:
            yield some

    def summary(self, text: str) -> tuple[int, str, str]:
        n, ids, back, first = 0, hashlib.sha256(), hashlib.sha256(), True
        for some in self.parts(text):
            if some:
                n += sum(x[0] for x in some)
                ids.update(("" if first else ",").encode() + ",".join([x[1] for x in some]).encode())
                back.update("".join([x[2] for x in some]).encode())
                first = False
        return n, ids.hexdigest(), back.hexdigest()

    def exact(self, text: str) -> bool:
        """Whether the decoded ids are the text."""
        at = 0
        for some in self.parts(text):
            back = "".join([x[2] for x in some])
            if not text.startswith(back, at):
                return False
            at += len(back)
        return at == len(text)

    def ids(self, text: str) -> np.ndarray:
        return np.fromiter((i for some in self.parts(text) for x in some for i in x[1]), np.int32)


def coder(ranks: bytes, pattern: str, named: bool = True) -> Coder:
    return model(("byte_bpe", hash(ranks), pattern, named), lambda: Coder(ranks, pattern, named))


def _summaries(batches, sent):
    c = coder(*sent.value)
    for b in batches:
        made = [c.summary(t) for t in b["t"].to_pylist()]
        n, ids, back = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n", "ids", "back"])


def _ids(batches, sent):
    c = coder(*sent.value, named=False)
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            texts = part["t"].to_pylist()
            made, exact = [c.ids(t) for t in texts], [c.exact(t) for t in texts]
            off = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            flat = np.concatenate(made) if made else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(exact, pa.bool_()), pa.ListArray.from_arrays(off, flat)], [*part.schema.names[:-1], "round_trip", "token_ids"])


def _decoded(batches, sent):
    c = coder(*sent.value)
    for b in batches:
        made = [c.decoder.decode(x) for x in b["token_ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string())], [*b.schema.names[:-1], "text"])


def _sent(df: DataFrame, path: str, pattern: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and the digests of its ids and of the bytes they decode to."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = rows.mapInArrow(partial(_summaries, sent=_sent(docs, path, pattern)), f"id {_type(rows, 'id')}, n long, ids string, back string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, round_trip (whether the ids decode to the text) and token_ids."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = ", ".join(f"`{c}` {_type(rows, c)}" for c in keep) + ", round_trip boolean, token_ids array<int>"
    return rows.mapInArrow(partial(_ids, sent=_sent(docs, path, pattern)), schema)


def decode(coded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the text of token_ids."""
    rows = coded.select(*keep, F.coalesce("token_ids", F.array().cast("array<int>")).alias("token_ids"))
    schema = ", ".join(f"`{c}` {_type(rows, c)}" for c in keep) + ", text string"
    return rows.mapInArrow(partial(_decoded, sent=_sent(coded, path, pattern)), schema)
