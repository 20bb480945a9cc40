"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Encoding reads text in chunks. Boundaries of pre-token pieces are certain a few characters
later; inside a piece a token is certain once every way the text can go on agrees on it.
No token is longer than the merge list's longest, so the ways that are still open end in
the last so many bytes: that is the lookahead. Decoding is a state machine from bytes to
text that keeps only an unfinished character.
"""

from __future__ import annotations

import array
import codecs
import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from tokenizers.pre_tokenizers import ByteLevel

from llm.common import documents, in_worker, shipped, without

#: The vocabulary's file; executors read it at the same place.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters that are encoded at once; pieces remembered, and up to how many bytes; bytes that
#: the transducer takes in at a time.
CHUNK, REMEMBERED, SHORT, BLOCK = 1 << 20, 150_000, 256, 4096

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
# White space as regular expressions over Unicode define it. Fixed values.
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, as the pre-tokeniser's pattern tells them apart.

    Two sources of different Unicode versions give the classes; where they differ, the
    tokenizers library's own version decides.
    """
    tables = np.full((2, 0x110000), _OTHER, dtype=np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for point, char in enumerate(every):
        tables[0, point] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(char)[0], _OTHER)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            tables[1, run.start() : run.end()] = kind
    table, split = tables[0], ByteLevel(add_prefix_space=False, use_regex=True)
    for point in np.flatnonzero(tables[0] != tables[1]).tolist():
        parts = [stop - start for _, (start, stop) in split.pre_tokenize_str(f"a{every[point]}1")]
        table[point] = {(2, 1): _LETTER, (1, 2): _NUMBER}.get(tuple(parts), _OTHER)
    table[_BLANKS] = _SPACE
    return table


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin: a flag for each code point of texts that end at ``ends``.

    The pattern's alternatives as rules: a run of one class is a piece; a blank before it
    belongs to it; other white space before a run is a piece without its last character;
    an apostrophe that begins a run takes one of a few endings and nothing else.
    """
    n = len(points)
    kinds = _classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[ends] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # The last of a run of white space, if the text goes on.
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~first[1:])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    stops = np.append(np.flatnonzero(first)[1:], n)
    for at in np.flatnonzero((points == 0x27) & start):
        stop = stops[np.searchsorted(stops, at, "right")] if at < n else n
        for suffix in _SUFFIXES:
            to = at + 1 + len(suffix)
            if to <= stop and all(points[at + 1 + i] == ord(c) for i, c in enumerate(suffix)):
                start[at + 1 : to] = False
                if to < stop:
                    start[to] = True
                break
    return start


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its merges, and what was learnt about pieces so far."""

    def __init__(self, path: str, remembered: int):
        self.remembered = remembered
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        names = _byte_names()
        to_bytes = lambda token: bytes(names[c] for c in token)
        vocabulary = model["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        tokens = {to_bytes(t): i for t, i in vocabulary.items() if t not in specials}
        self.ids, self.specials = tokens, specials
        size = 1 + max([*tokens.values(), *specials.values()])
        self.texts: list[bytes] = [b""] * size
        for token, i in tokens.items():
            self.texts[i] = token
        for token, i in specials.items():
            self.texts[i] = token.encode()
        self.ranks: dict[tuple[int, int], int] = {}
        self.results: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = (to_bytes(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault((tokens[left], tokens[right]), rank)
            self.results.append(tokens[left + right])
        self.single = [tokens.get(bytes([b])) for b in range(256)]
        self.lookahead = max(len(t) for t in tokens)
        self.sizes = [len(t) for t in self.texts]
        self.lengths = np.array(self.sizes, dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(self.texts), np.uint8)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.rules: dict[int, tuple[int, int, int]] = {}
        self.in_order, made = True, set(self.single)
        for (left, right), rank in self.ranks.items():
            token = self.results[rank]
            self.in_order &= left in made and right in made and token not in made
            self.rules[token] = (left, right, rank)
            made.add(token)
        self.sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.prefixes = {t[:i] for t in tokens for i in range(len(t) + 1)}
        self._forget()

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of a short text: the first of the best merges, until none is left."""
        ids = [self.single[b] for b in piece]
        rank_of, none = self.ranks.get, len(self.results)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            ids[at : at + 2] = [self.results[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), none)
        return tuple(ids)

    def _side(self, token: int, part: int) -> list[tuple[int, int]]:
        """What stands at the left (0) or right (1) end of a token's text while it is merged,
        each with the rank of the merge that ends it; empty if its text becomes other tokens."""
        known = self.sides.get((token, part))
        if known is None:
            known = []
            if self.merged(self.texts[token]) == (token,):
                known, at = [(token, len(self.results))], token
                while at in self.rules:
                    rule = self.rules[at]
                    at = rule[part]
                    known.append((at, rule[2]))
                known.reverse()
            self.sides[token, part] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses from one token's text into the other's.

        Merges happen by rank, of equal ones the leftmost first. So the ends that meet at
        the border are known at every rank, and only their pairs can merge across it.
        """
        ends, begins = self._side(left, 1), self._side(right, 0)
        if not ends or not begins:
            return False
        never, i, j = len(self.results), 0, 0
        while True:
            (a, a_stop), (b, b_stop) = ends[i], begins[j]
            rank = self.ranks.get((a, b), never)
            if rank < a_stop and rank <= b_stop and rank < never:
                return False
            if a_stop == b_stop == never:
                return True
            if a_stop <= b_stop:
                i += 1
            else:
                j += 1

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their text is encoded."""
        if self.in_order:  # every token has one rule, after those of its parts
            return self._apart(left, right)
        return self.merged(self.texts[left] + self.texts[right]) == (left, right)

    def _forget(self) -> None:
        """Start the automaton afresh; a state in use stays valid."""
        self.states: dict[bytes, dict] = {}
        self.fits: dict[int, dict[int, bool]] = {}  # by the right token, then the left one
        self.learnt = 0
        self.start = self._state(b"")
        # The piece before, and after each of its bytes the last token and the automaton's state.
        self.before, self.last, self.way = b"", [None], [self.start]

    def _state(self, text: bytes) -> dict:
        """The automaton's state after ``text``: where each byte leads, as far as it was asked,
        under -1 the tokens that end here (size, token, which tokens before are known to fit
        or not), longest first, under -2 the text."""
        while text not in self.prefixes:
            text = text[1:]
        state = self.states.get(text)
        if state is None:
            ends = [self.ids[t] for i in range(len(text)) if (t := text[i:]) in self.ids]
            state = {-1: tuple((len(self.texts[t]), t, self.fits.setdefault(t, {})) for t in ends), -2: text}
            self.states[text] = state
        return state

    def _go(self, state: dict, byte: int) -> dict:
        self.learnt += 1
        state[byte] = to = self._state(state[-2] + bytes((byte,)))
        return to

    def _step(self, text: bytes, last: list, way: list) -> None:
        """Take in the places of ``text`` that ``last`` doesn't have yet, from the last state of ``way`` on.

        For each place, the last token of the text up to there is the one that fits the last
        token before it; exactly one does, most often the longest. -1: no token ends there.
        Where the text kept begins, a token was certain: none before matters but the one that
        ended there, ``last[0]``.
        """
        go, add, pass_by = self._go, last.append, way.append
        state, begin = way[-1], len(last) - 1
        for p, byte in enumerate(text[begin:], begin + 1):
            state = state.get(byte) or go(state, byte)
            pass_by(state)
            found = -1
            for size, token, fits in state[-1]:
                if size > p or (before := last[p - size]) == -1:
                    continue
                if before is None or (known := fits.get(before)):
                    found = token
                    break
                if known is None:
                    self.learnt += 1
                    fits[before] = known = self.fit(before, token)
                    if known:
                        found = token
                        break
            add(found)

    def streamed(self, blocks: Iterator[bytes]) -> Iterator[int]:
        """Tokens of one piece of any length, as soon as they are certain.

        Every way on passes one of the places in the lookahead, so what their chains share
        is certain and leaves the memory.
        """
        text, last, state = b"", [None], self.start  # last[p]: token that ends at p
        for block in blocks:
            text += block
            way = [state]
            self._step(text, last, way)
            state = way[-1]
            if self.learnt > 8 * self.remembered:
                self._forget()
                state = self._state(text[-self.lookahead :])
            open_places = [p for p in range(max(0, len(text) - self.lookahead + 1), len(text) + 1) if last[p] != -1]
            shared = self._shared(last, open_places)
            if shared > 0:
                out = self._chain(last, shared)
                yield from out
                text, last = text[shared:], [out[-1], *last[shared + 1 :]]
        yield from self._chain(last, len(text))

    def _shared(self, last: list, places: list[int]) -> int:
        """The last place that the chains of all the places pass."""
        left = set(places)
        while len(left) > 1:
            top = max(left)
            left.remove(top)
            left.add(top - self.sizes[last[top]])
        return left.pop() if left else 0

    def _chain(self, last: list, p: int) -> list[int]:
        out, sizes = [], self.sizes
        while p > 0:
            out.append(token := last[p])
            p -= sizes[token]
        return out[::-1]

    def _one_block(self, piece: bytes) -> list[int]:
        """Tokens of a piece that is taken in at once: the end is known before anything is certain.

        What it begins with like the piece before was taken in with that.
        """
        if self.learnt > 8 * self.remembered:
            self._forget()
        shared = 0
        for byte, other in zip(piece, self.before):  # noqa: B905
            if byte != other:
                break
            shared += 1
        self.before = piece[:shared]
        del self.last[shared + 1 :], self.way[shared + 1 :]
        self._step(piece, self.last, self.way)
        self.before = piece
        return self._chain(self.last, len(piece))

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of a piece."""
        return tuple(array.array("I", self._coded(piece)))

    def _coded(self, piece: bytes) -> bytes:
        """A piece's tokens as numbers of 32 bits, from the transducer; those of short pieces are
        remembered for a while.

        What was not asked for since the memory was last full is forgotten next time.
        """
        out = self.older.get(piece)
        if out is None:
            if len(piece) > BLOCK:
                ids = self.streamed(piece[i : i + BLOCK] for i in range(0, len(piece), BLOCK))
            elif (token := self.ids.get(piece)) is not None:
                ids = (token,)  # fits nothing but the beginning, and is the longest way there
            else:
                ids = self._one_block(piece)
            out = array.array("I", ids).tobytes()
        if len(piece) <= SHORT:
            if len(self.known) >= self.remembered:
                self.older, self.known = self.known, {}
            self.known[piece] = out
        return out

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts without special tokens, one after the other, and their numbers.

        Equal pieces, by their bytes, are looked up once, and those not known in the order
        of their bytes, so that neighbours begin alike.
        """
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        at = np.flatnonzero(piece_starts(points, ends))
        data = joined.encode()
        # Every byte but a character's later ones begins a character.
        begins = at if len(data) == len(joined) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[at]
        # Equal pieces share a number, in the order that they come up first.
        cuts = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        which = coded.indices.to_numpy()
        _, cuts, held = coded.dictionary.buffers()
        cuts, held = np.frombuffer(cuts, np.int64, len(coded.dictionary) + 1).tolist(), held.to_pybytes()
        pieces = [held[i:j] for i, j in itertools.pairwise(cuts)]
        found = list(map(self.known.get, pieces))
        for i in sorted((i for i, ids in enumerate(found) if ids is None), key=pieces.__getitem__):
            found[i] = self._coded(pieces[i])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        first = np.cumsum(sizes) - sizes
        per_piece = sizes[which]
        to = np.cumsum(per_piece)
        out = flat[np.repeat(first[which] - (to - per_piece), per_piece) + np.arange(int(to[-1]))]
        # Pieces up to each text's end, and so its tokens.
        upto = np.concatenate([[0], to])[np.searchsorted(at, ends, "left")]
        return out, np.diff(np.concatenate([[0], upto]))

    def encode(self, texts: list[str], chunk: int | None = None) -> Iterator[np.ndarray]:
        """Token ids of each text; chunks of ``chunk`` or else ``CHUNK`` characters are encoded together."""
        chunk = chunk or CHUNK
        parts: list[tuple[str, int | None]] = []  # text, special token after it
        counts, held = [], 0
        for text in texts:
            mine = [p for plain, special in self._split(text) for p in _cut(plain, special, chunk)]
            counts.append(len(mine))
            parts += mine
            held += len(text)
            if held >= chunk:
                yield from self._gathered(parts, counts, chunk)
                parts, counts, held = [], [], 0
        yield from self._gathered(parts, counts, chunk)

    def _split(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        if self.special and any(s in text for s in self.specials):
            for found in self.special.finditer(text):
                yield text[at : found.start()], self.specials[found[0]]
                at = found.end()
        yield text[at:], None

    def _gathered(self, parts, counts, chunk: int) -> Iterator[np.ndarray]:
        ids: list[list[np.ndarray]] = []
        batch, size = [], 0

        def flush():
            tokens, numbers = self.chunk([p for p, _ in batch])
            for (_, special), own in zip(batch, np.split(tokens, np.cumsum(numbers)[:-1]), strict=True):
                ids.append([own] if special is None else [own, np.array([special], np.uint32)])

        for part in parts:
            batch.append(part)
            size += len(part[0])
            if size >= chunk:
                flush()
                batch, size = [], 0
        if batch:
            flush()
        at = 0
        for count in counts:
            yield np.concatenate([a for part in ids[at : at + count] for a in part]).astype(np.uint32)
            at += count

    def token_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        to = np.cumsum(sizes)
        total = int(to[-1]) if len(to) else 0
        return self.joined[np.repeat(self.starts[ids] - (to - sizes), sizes) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> Iterator[str]:
        """Text of tokens, block by block; only an unfinished character is carried over."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), block):
            yield state.decode(self.token_bytes(ids[at : at + block]))
        yield state.decode(b"", final=True)


_INNER = re.compile(r"(?<=\S) (?=\S)")


def _cut(text: str, special: int | None, chunk: int) -> Iterator[tuple[str, int | None]]:
    """A long text in parts of about ``chunk`` characters, cut where a piece must begin: at
    a blank between two characters that are none."""
    at = 0
    while len(text) - at > chunk:
        cut = _INNER.search(text, at + chunk)
        if not cut:
            break
        yield text[at : cut.start()], None
        at = cut.start()
    yield text[at:], special


def load(path: str, remembered: int = REMEMBERED) -> Bpe:
    return in_worker(Bpe, path, remembered)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _replaced(df: DataFrame, name: str, function, fields: str) -> DataFrame:
    """``df`` with the column ``name`` replaced by what ``function`` makes of it.

    Columns go by their place, as names may hold dots.
    """
    at = df.columns.index(name)
    places = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    kept = [f for i, f in enumerate(places.schema.fields) if i != at]
    schema = StructType([*kept, *StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*columns, *function(batch.column(at))], names=schema.fieldNames())

    made = shipped(places).mapInArrow(run, schema)
    return made.toDF(*[c for i, c in enumerate(df.columns) if i != at], *StructType.fromDDL(fields).fieldNames())


def encode(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and ``ids`` (32-bit little-endian).

    Special tokens' strings in a text become these tokens. Defined cases: null and empty
    texts have no tokens; equal texts get equal tokens; a text of any length is read in
    chunks; columns of ``docs`` named like a result column are replaced.
    """

    def coded(column: pa.Array) -> list[pa.Array]:
        ids = [a.astype("<u4").tobytes() for a in load(path).encode(_texts(column))]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]

    return _replaced(without(docs, ["n_tokens", "ids"]), text_col, coded, "n_tokens long, ids binary")


def decode(rows: DataFrame, ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``rows`` without its ids, with their text as ``decoded``; null ids are no tokens."""

    def decoded(column: pa.Array) -> list[pa.Array]:
        ids = (np.frombuffer(i or b"", "<u4") for i in column.to_pylist())
        return [pa.array(["".join(load(path).decode(i)) for i in ids], pa.string())]

    return _replaced(without(rows, ["decoded"]), ids_col, decoded, "decoded string")


def _digested(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encode, digest, decode again and digest, a text at a time."""
    model = load(path)
    for batch in batches:
        rows = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), model.encode(_texts(batch.column("text"))), strict=True):
            text = hashlib.sha256()
            for part in model.decode(ids):
                text.update(part.encode())
            rows.append((doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), text.hexdigest()))
        ids, counts, coded, decoded = zip(*rows, strict=True) if rows else ([],) * 4
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them.

    Defined cases: null and empty texts have no tokens and decode to the empty text; equal
    rows give equal results; an empty table gives an empty result; other columns aren't read.
    """
    return shipped(docs.select("doc_id", "text")).mapInArrow(
        lambda it: _digested(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
