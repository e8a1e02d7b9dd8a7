"""Fast encoding with a byte-level BPE tokenizer file: whole batches are cut into pre-tokens at once, and only those not seen
before go to the tokenizers library."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .common import Texts, identities, mix

_S, _L, _N, _P = range(4)
#: Characters from here on aren't classified; texts with them go to the library as they are.
_PLAIN = 0x3000
#: What the pre-tokenizer's pattern splits off behind an apostrophe.
_AFTER = ("s", "t", "re", "ve", "m", "ll", "d")
#: So many pre-tokens are remembered at most, by process.
KEPT = 2_000_000
#: New pre-tokens that go to the library in one text.
TOGETHER = 500


class PieceEncoder:
    """Ids of texts, as the tokenizer's encode_batch gives them with add_special_tokens=False: none are put around a text, while an
    added token of the file that stands in a text is one id. Texts beside such a one go to the library as they are. Pre-tokens are
    known by their bytes, not by a hash alone."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a.content.encode() for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.kinds = self._kinds()
        blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]  # as the vocabulary writes it
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(blank)]] = True
        self._forget()

    def _kinds(self) -> np.ndarray:
        """The kind of each plain character, as the pre-tokenizer treats it: it joins a run of its own kind."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        kinds = np.full(_PLAIN + 1, _S, np.int8)
        for c in range(_PLAIN):
            for kind, run in ((_L, "a"), (_N, "1"), (_P, "!")):
                if len(split(run + chr(c))) == 1:
                    kinds[c] = kind
                    break
        return kinds

    def _forget(self) -> None:
        """What is known: sorted hashes of pre-tokens, their identities, and where their ids are."""
        self.keys, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _starts(self, t: Texts) -> np.ndarray | None:
        """The bytes where pre-tokens start; None if there are characters beyond the plain ones."""
        chars = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        if len(chars) and chars.max() >= _PLAIN:
            return None
        at = np.flatnonzero((t.data & 0xC0) != 0x80)
        kind = self.kinds[chars]
        begin = np.ones(len(chars), bool)
        begin[1:] = kind[1:] != kind[:-1]
        row = np.zeros(len(chars) + 1, bool)
        row[np.searchsorted(at, t.offsets)] = True
        begin[row[:-1]] = True
        # the last white space before something else is split off, and joins it if it is a blank
        joint = np.flatnonzero((kind[1:] != _S) & (kind[:-1] == _S) & ~row[1:-1]) + 1
        begin[joint - 1] = True
        begin[joint[chars[joint - 1] == 0x20]] = False
        quote = np.flatnonzero((chars[:-1] == 0x27) & begin[:-1] & ~row[1:-1] & (kind[1:] == _L))
        padded = np.concatenate([chars, np.zeros(4, np.uint32)])
        ends = np.concatenate([row, np.ones(4, bool)])
        for after in _AFTER:
            fits = np.ones(len(quote), bool)
            for k, c in enumerate(after, 1):
                fits &= (padded[quote + k] == ord(c)) & ~ends[quote + k]
            here = quote[fits]
            begin[here + 1] = False
            rest = here + 1 + len(after)
            begin[rest[rest < len(chars)]] = True
        return at[begin]

    def _learn(self, t: Texts, pieces: tuple[np.ndarray, ...], starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(starts) > KEPT:
            self._forget()
        raw = t.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new, count = self._encoded(texts)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, new])
        keys, low, high = (np.concatenate([a, b]) for a, b in zip((self.keys, self.low, self.high), pieces, strict=True))
        order = np.argsort(keys, kind="stable")
        self.keys, self.low, self.high = keys[order], low[order], high[order]
        self.first, self.count = np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, end to end, and how many each has. Those of a blank and letters or digits go to the library as texts
        of many, which it splits at the blanks: a token that starts with one starts the next."""
        plain = np.array([len(p) > 1 and p[0] == " " and self.kinds[min(ord(p[1]), _PLAIN)] in (_L, _N) for p in pieces], bool)
        some, rest = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        joined = ["".join([pieces[i] for i in some[k : k + TOGETHER]]) for k in range(0, len(some), TOGETHER)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.uint32)
        begins = np.flatnonzero(self.opens[ids])
        if len(begins) != len(some):
            ids, begins, some, rest = ids[:0], begins[:0], [], list(range(len(pieces)))
        each = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        order = np.array(some + rest, np.int64)
        counts = np.concatenate([np.diff(np.append(begins, len(ids))), np.array([len(x) for x in each], np.int64)]).astype(np.int64)
        ids = np.concatenate([ids, np.array([i for x in each for i in x], np.uint32)])
        count = np.empty(len(pieces), np.int64)
        count[order] = counts
        first = np.empty(len(pieces), np.int64)
        first[order] = np.cumsum(counts) - counts
        after = np.cumsum(count)
        return ids[np.arange(after[-1] if len(after) else 0) + np.repeat(first - (after - count), count)], count

    def _find(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = (self.low[at] == low) & (self.high[at] == high) if len(self.keys) else np.zeros(len(keys), bool)
        return at, known

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each row has."""
        raw = t.data.tobytes()
        starts = None if any(a in raw for a in self.added) else self._starts(t) if len(t.data) else np.zeros(0, np.int64)
        if starts is not None:
            ends = np.append(starts[1:], len(t.data))
            pieces, inverse, once, sound = self._distinct(t, starts, ends)
            at, known = self._find(*pieces)
            if not known.all():
                some = np.flatnonzero(~known)
                self._learn(t, tuple(x[some] for x in pieces), starts[once[some]], ends[once[some]])
                at, known = self._find(*pieces)
                if not known.all():  # forgotten meanwhile
                    self._forget()
                    self._learn(t, pieces, starts[once], ends[once])
                    at, known = self._find(*pieces)
            if sound and known.all():
                count, first = self.count[at][inverse], self.first[at][inverse]
                after = np.cumsum(count)
                ids = self.ids[np.arange(after[-1] if len(after) else 0) + np.repeat(first - (after - count), count)]
                sums = np.concatenate([[0], after])[np.searchsorted(starts, t.offsets)]
                return ids, np.diff(sums)
        rows = [e.ids for e in self.tokenizer.encode_batch_fast([t.raw(i).decode() for i in range(len(t))], add_special_tokens=False)]
        return np.array([i for x in rows for i in x], np.uint32), np.array([len(x) for x in rows], np.int64)

    @staticmethod
    def _distinct(t: Texts, starts: np.ndarray, ends: np.ndarray):
        """Hash and identity of each distinct pre-token, which one each is, one place of each; and whether pre-tokens of one hash
        are indeed the same."""
        low, high = identities(t.data, starts, ends)
        keys, inverse = np.unique(mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high)), return_inverse=True)
        once = np.empty(len(keys), np.int64)
        once[inverse] = np.arange(len(starts))
        sound = bool(np.all((low[once][inverse] == low) & (high[once][inverse] == high)))
        return (keys, low[once], high[once]), inverse, once, sound


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
