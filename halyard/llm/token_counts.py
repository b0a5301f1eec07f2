"""Token counts from a compiled finite-state tokenizer.

A byte-pair vocabulary is compiled, as far as the texts need it, into a deterministic transducer over
characters. A state holds the shortest tail of the text that a later character can still change: for
each place in that tail where a token may yet begin, the token that ends there and the number of
tokens up to it. A transition carries the number of tokens that become final with it, so a text is
counted without building its tokens.

Two facts keep states small. The tokens of a prefix, up to a place where a token begins, do not
depend on what follows; and two tokens may stand side by side exactly if tokenizing the two together
gives the same two. Characters outside the vocabulary fall back to one token per UTF-8 byte.

Texts are cut into chunks, a short one into one. A chunk becomes a *state map*: from the state that the text
before it leaves, to the state after it and the tokens that became final in between. Maps are made apart from
each other, for the states that the last characters before a chunk can leave, which is one state if a
boundary between words is among them; a state that was not foreseen is added when it is met. They are composed by a
prefix scan in rounds of neighbours. Between two boundaries all states agree, so words are counted
once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import table

MARK = "▁"
CHUNK = 1 << 16
#: Characters before a chunk that are read for the state that they leave.
BEFORE = 64
#: Entries kept of a worker's memory of units and of transitions, beyond which it starts afresh, and the longest unit: together a bound in bytes.
MEMORY, LONGEST = 600_000, 48


class _Memo(dict):
    def __init__(self, count):
        super().__init__()
        self._count = count

    def __missing__(self, unit):
        if len(unit) > LONGEST:
            return self._count(unit)
        if len(self) >= MEMORY:
            self.clear()
        n = self[unit] = self._count(unit)
        return n


class StateMap:
    """{state before: (state after, tokens made final)} of a stretch of text; states not in it yet are added when asked for."""

    def __init__(self, machine: Transducer, text: str, start: int, first: int, between: int | None, after: int, rest: int):
        """``first`` is the first hard boundary, ``between`` the tokens up to the last one, ``after`` and ``rest`` the state and tokens from there."""
        self.known: dict[int, tuple[int, int]] = {}
        self.parts = machine, text, start, first, between, after, rest

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            machine, text, start, first, between, after, rest = self.parts
            to, total = machine.step(state, text[start:first])
            self.known[state] = (to, total) if between is None else (after, total + machine.final[to] + between + rest)
        return self.known[state]

    def then(self, other: StateMap) -> StateMap:
        return _Composed(self, other)


class _Composed(StateMap):
    """One map after another."""

    def __init__(self, one: StateMap, other: StateMap):
        self.one, self.other, self.known = one, other, {}
        for state in one.known:
            self(state)

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            to, total = self.one(state)
            after, more = self.other(to)
            self.known[state] = after, total + more
        return self.known[state]


_BOUNDARY = re.compile(f"[^{MARK}](?={MARK})")


def _last_boundary(text: str, start: int, end: int) -> int:
    """The last place of a mark in ``text[start:end]`` that follows another character; -1 if there is none."""
    at = text.rfind(MARK, start, end)
    while at > 0 and text[at - 1] == MARK:
        at = text.rfind(MARK, start, at)
    return at if at > 0 else -1


class Transducer:
    """Counts the tokens of a byte-pair vocabulary with byte fallback, given as {piece: priority}.

    A lower priority number merges first; among equals the leftmost pair does.
    """

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.heads = {p[:i] for p in ranks for i in range(1, len(p))}
        self.alphabet = {c for p in ranks for c in p}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.busy = False
        self.start()
        self.after_mark, self.plain = _Memo(lambda u: self.run(MARK + u)), _Memo(self.run)

    def start(self) -> None:
        """Forgets all states but the first."""
        self.states = [("", ((0, None, 0),))]
        self.ids = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.final = [0]

    def merge(self, text: str) -> list[str]:
        """The reference way: merge the best adjacent pair until none is left. Only for short strings."""
        parts = list(text)
        while True:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, left: str | None, token: str) -> bool:
        if left is None:
            if token not in self.whole:
                self.whole[token] = len(self.merge(token)) == 1
            return self.whole[token]
        key = (left, token)
        if key not in self.pairs:
            if len(self.pairs) > 4 * MEMORY:
                self.pairs.clear()
            self.pairs[key] = self.merge(left + token) == [left, token]
        return self.pairs[key]

    def move(self, state: int, char: str) -> tuple[int, int]:
        """Compiles one transition: the next state and the tokens made final by it."""
        tail, places = self.states[state]
        if char not in self.alphabet:
            bytes_ = len(char.encode("utf-8", "surrogatepass"))
            return 0, places[-1][2] + bytes_
        text, n = tail + char, len(tail) + 1
        last = next(((n, text[at:], count + 1) for at, left, count in places if text[at:] in self.ranks and self.fits(left, text[at:])), None)
        if last is None:  # a single character is always a token of its own
            last = (n, char, places[-1][2] + 1)
        kept = [p for p in places if text[p[0] :] in self.heads] + [last]
        cut, base = kept[0][0], kept[0][2]
        found = (text[cut:], tuple((at - cut, left, count - base) for at, left, count in kept))
        if found not in self.ids:
            self.ids[found] = len(self.states)
            self.states.append(found)
            self.moves.append({})
            self.final.append(found[1][-1][2])
        return self.ids[found], base

    def step(self, state: int, unit: str) -> tuple[int, int]:
        """The state after ``unit``, and the tokens made final by it."""
        total, moves = 0, self.moves
        for char in unit:
            step = moves[state].get(char)
            if step is None:
                step = moves[state][char] = self.move(state, char)
            state = step[0]
            total += step[1]
        return state, total

    def run(self, unit: str) -> int:
        """Tokens of ``unit``, from the first state to the end of the text."""
        if len(self.states) > MEMORY and not self.busy:
            self.start()
        state, total = self.step(0, unit)
        return total + self.final[state]

    # A hard boundary lies before a mark that follows another character: no piece spans it, so every
    # state moves to the first one there, and its tokens are final.

    def state_map(self, text: str, start: int, end: int) -> StateMap:
        """The map of ``text[start:end]``, for the state that the characters before it leave."""
        found = _BOUNDARY.search(text, max(start - 1, 0), end)
        if found:
            first, last = found.start() + 1, _last_boundary(text, start, end)
            made = StateMap(self, text, start, first, self.between_lines(text[first:last]), *self.step(0, text[last:end]))
        else:
            made = StateMap(self, text, start, end, None, 0, 0)
        if start:
            low = max(0, start - BEFORE)
            made(self.step(0, text[max(low, _last_boundary(text, low, start)) : start])[0])
        else:
            made(0)
        return made

    def between(self, body: str) -> int:
        """Tokens of a text that begins and ends at hard boundaries."""
        if not body:
            return 0
        if MARK * 2 in body:
            return sum(self.plain[u] for u in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", body))
        units = body.split(MARK)
        return (self.plain[units[0]] if units[0] else 0) + sum(map(self.after_mark.__getitem__, units[1:]))

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of ``text``, with the leading mark that the vocabulary's library adds."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if len(self.states) > MEMORY:
            self.start()
        self.busy = True  # states keep their numbers while maps hold them
        maps = [self.state_map(text, i, min(i + chunk, len(text))) for i in range(0, len(text), chunk)]
        while len(maps) > 1:  # a round of the scan
            maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        self.busy = False
        state, total = maps[0](0)
        return total + self.final[state]

    def between_lines(self, text: str) -> int:
        """As :meth:`between`, parting the text at line ends too, which belong to no piece."""
        if "\n" in self.alphabet or "\n" not in text:
            return self.between(text)
        lines = text.split("\n")
        return len(lines) - 1 + sum(map(self.between, lines))


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The transducer of a sentencepiece byte-pair model file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    order = sorted(pieces, key=lambda i: -sp.get_score(i))
    ranks = {sp.id_to_piece(i): k for k, i in enumerate(order)}
    return Transducer(ranks)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``; whole texts, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows stay as they are; other
    columns of ``docs`` are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path or default_path())
        for batch in batches:
            texts = batch.column(1)
            counts = pa.array((machine.count(t) if t else 0 for t in texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, batch.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = found.mapInArrow(count, "doc_id long, n_tokens long, n_bytes long")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
