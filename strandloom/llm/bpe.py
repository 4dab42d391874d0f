"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

In byte-pair encoding the last token of a prefix decides the rest: encode(prefix) = encode(prefix without its last
token) + [last token], and the last token is the only vocabulary entry that ends there and may stand behind the last
token of what comes before it. The distinct new words of a batch, sorted, are the trie in depth-first order: each word
shares its first nodes with the one before it. The traversal keeps the last-token states of the current path, so a
prefix that words share is worked out once, and the trie never takes more memory than its words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Bounds of a worker's memory; what is dropped beyond them is worked out again.
MOST_WORDS = 300_000
MOST_BORDERS = 250_000
LONG_WORD = 64
TEXTS = 1000
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
TWO_SPACES = re.compile(r"\s\s")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The usual one-letter names of bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieEncoder:
    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        vocab, letters = model["model"]["vocab"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Tokens are numbered by rank: bytes first, then merges in order.
        self.token: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.halves: list[tuple[int, int]] = []
        for c, b in letters.items():
            self.token[bytes([b])] = len(self.ids)
            self.halves.append((len(self.ids), len(self.ids)))
            self.ids.append(vocab[c])
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            whole, left, right = raw(a + b), self.token[raw(a)], self.token[raw(b)]
            t = self.token.get(whole)
            if t is None:
                t = self.token[whole] = len(self.ids)
                self.ids.append(vocab[a + b])
                self.halves.append((left, right))
            self.pair.setdefault((left, right), t)
        #: Bytes of each id, by its decimal digits.
        self.spelled = {b"%d" % vocab[s]: raw(s) for s in vocab if s not in self.special} | {b"%d" % i: s.encode() for s, i in self.special.items()}
        self.digits = [b"%d" % i for i in self.ids]
        #: Whether no special token can lie in a space and letters.
        self.plain = all(re.search("[^ A-Za-z]", x) for x in self.special)
        self._automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _automaton(self) -> None:
        """A state for each beginning of a token: where it goes on a byte, and the tokens that it ends with, longest first,
        each with its length and what is known of the tokens that it may follow.

        A state that no token goes on from with a byte falls back to its longest end that is a state; such steps are
        worked out when they first come and kept in `steps`.
        """
        self.goes: dict[int, int] = {}
        name: dict[bytes, int] = {b"": 0}
        for t in sorted(self.token, key=len):
            for n in range(1, len(t) + 1):
                if t[:n] not in name:
                    name[t[:n]] = state = len(name)
                    self.goes[name[t[: n - 1]] << 8 | t[n - 1]] = state
        self.back, self.ends = [0] * len(name), [()] * len(name)
        self.size = [0] * len(self.ids)
        self.fits: list[dict[int, bool]] = [{} for _ in self.ids]
        self.borders = 0
        for text in sorted(name, key=len)[1:]:
            state, t = name[text], self.token.get(text)
            if len(text) > 1:
                self.back[state] = self.step(self.back[name[text[:-1]]], text[-1])
            self.ends[state] = self.ends[self.back[state]]
            if t is not None:
                self.size[t] = len(text)
                self.ends[state] = ((t, len(text), self.fits[t].get), *self.ends[state])
        self.steps = dict(self.goes)

    def step(self, state: int, byte: int) -> int:
        while state and state << 8 | byte not in self.goes:
            state = self.back[state]
        return self.goes.get(state << 8 | byte, 0)

    def may_follow(self, first: int, second: int) -> bool:
        """Whether merging leaves the border between two tokens alone: no merge across it comes due before both ends are done."""
        a, b, limit, answer = first, second, len(self.ids), True
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < limit:
                answer = False
                break
            # Undo the later of the two merges; what lies across the border must come due after it.
            if a > b or (self.halves[b][0] == b and self.halves[a][0] != a):
                if self.halves[a][1] == a:
                    break
                limit, a = a, self.halves[a][1]
            else:
                if self.halves[b][0] == b:
                    break
                limit, b = b + 1, self.halves[b][0]
        self.borders += 1
        if self.borders > MOST_BORDERS:
            self.borders = 1
            for known in self.fits:
                known.clear()
        self.fits[second][first] = answer
        return answer

    def traverse(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, decimal ids joined by commas) of distinct words in sorted order, depth first through their trie.

        state[d] is the automaton's after the current path's first d bytes, last[d] their last token.
        """
        if len(self.steps) > len(self.goes) + MOST_BORDERS:
            self.steps = dict(self.goes)
        steps, ends, follow, names, size = self.steps, self.ends, self.may_follow, self.digits, self.size
        state, last, before = [0], [-1], b""
        for word in words:
            d, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                d = most
            while d < most and word[d] == before[d]:
                d += 1
            if len(word) >= len(state):
                more = len(word) + 1 - len(state)
                state += [0] * more
                last += [0] * more
            at, end = state[d], d
            for byte in word[d:]:
                key = at << 8 | byte
                try:
                    at = steps[key]
                except KeyError:
                    at = steps[key] = self.step(at, byte)
                end += 1
                for t, n, known in ends[at]:
                    if n == end:
                        break
                    may = known(last[end - n])
                    if may or (may is None and follow(last[end - n], t)):
                        break
                state[end], last[end] = at, t
            out, at = [], end
            while at:
                t = last[at]
                out.append(names[t])
                at -= size[t]
            out.reverse()
            yield word, b",".join(out)
            before = word

    def parts(self, chunk: str) -> list[int | bytes]:
        """Special tokens' ids and, between them, the words that the pattern splits."""
        out: list[int | bytes] = []
        for part in self.split.split(chunk) if self.split else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w.encode("utf-8", "surrogatepass") for w in PATTERN.findall(part)]
        return out

    def encode_texts(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by commas, decoded bytes) of each text.

        A space between two other characters always begins its word, so the text splits at such spaces into pieces that do
        not depend on each other. A piece of plain letters is one word.
        """
        pieces = [LONE_SPACE.split(t) if TWO_SPACES.search(t) else t.split(" ") for t in texts]
        heads = [ps.pop(0) for ps in pieces]
        new = set().union(*pieces).difference(self.young)
        known = {p: ids for p in new if (ids := self.old.get(p)) is not None}
        new.difference_update(known)
        letters = {p: b" " + p.encode() for p in new if self.plain and p.isascii() and p.isalpha()}
        split = {" " + p: self.parts(" " + p) for p in new.difference(letters)}
        heads_split = {h: self.parts(h) for h in set(heads)}
        words = {w for kind in (split, heads_split) for ws in kind.values() for w in ws if isinstance(w, bytes)}
        ids_of = dict(self.traverse(sorted(words.union(letters.values()))))
        joined = lambda ws: b",".join([ids_of[w] if isinstance(w, bytes) else b"%d" % w for w in ws])
        first = {h: joined(ws) for h, ws in heads_split.items()}
        once = {p: ids_of[w] for p, w in letters.items() if len(p) >= LONG_WORD}
        known |= {p: ids_of[w] for p, w in letters.items() if len(p) < LONG_WORD}
        for p, ws in split.items():
            (known if len(p) <= LONG_WORD else once)[p[1:]] = joined(ws)
        if len(self.young) + len(known) > MOST_WORDS:
            self.old, self.young = self.young, {}
        self.young |= known
        out = []
        for t, h, ps in zip(texts, heads, pieces, strict=True):
            try:
                rest = b",".join(map(self.young.__getitem__, ps))
            except KeyError:
                rest = b",".join([self.young.get(p) or self.old.get(p) or once[p] for p in ps])
            ids = first[h] + b"," + rest if h and rest else first[h] or rest
            out.append((ids.count(b",") + 1 if ids else 0, ids, self.decode(ids)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that decimal ids joined by commas stand for."""
        return b"".join(map(self.spelled.__getitem__, ids.split(b","))) if ids else b""


_encoders: dict[str, TrieEncoder] = {}


def encoder_of(spec: str) -> TrieEncoder:
    """One encoder for each worker process and vocabulary, kept between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TrieEncoder(spec)
    return _encoders[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(spec, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(spec.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo in range(0, len(texts), TEXTS):
                out = []
                for n, ids, raw in enc.encode_texts(texts[lo : lo + TEXTS]):
                    decoded = raw.decode("utf-8", "replace")
                    out.append((n, [int(i) for i in ids.split(b",")] if n else [], decoded) if full else (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                n, ids, decoded = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, TEXTS), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32()) if full else pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids" if full else "ids_sha256", "decoded" if full else "decoded_sha256"])

    return run


def _mapped(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, full: bool, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, fixed in size
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode(spec, full), schema)


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    Ids are encoded, decoded again, and only then digested. Null text counts as empty (no ids). Repeated rows, null
    ids and very long texts need nothing special: there is no shuffle, and a worker's trie lives for a
    batch and its table of words is bounded. Further columns are not read; an empty table gives an empty result.
    """
    return _mapped(docs, id_col, text_col, tokenizer, False, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded; cases as in bpe_digests."""
    return _mapped(docs, id_col, text_col, tokenizer, True, "doc_id long, n_tokens long, ids array<int>, decoded string")
