"""Token ids and counts of a byte-level BPE, computed once per distinct piece of text.

The vocabulary's splitting pattern puts a boundary before every single space that is followed by
something other than white space, whatever stands before it. So a text without other white space
after its spaces, and without the strings of added tokens, can be cut there: the ids of the whole
are the ids of the pieces, one after the other. Likewise a line's end between two characters that are not
white space is a pre-token of its own. Other texts are given to the library whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rillstore.llm import words as W

#: Distinct pieces a worker remembers; beyond it forgets them all and begins anew.
MEMORY = 450_000
#: Marks a piece that no space stands before; texts that hold it themselves are not cut.
FIRST = "\x00"
def _shown() -> np.ndarray:
    """The character by which byte-level BPE shows each byte: itself if printable, else the next from U+0100 on; line ends stay."""
    own = np.zeros(256, bool)
    own[[*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]] = True
    out = np.where(own, np.arange(256), 0x100 + np.cumsum(~own) - 1)
    out[10] = 10
    return out.astype("<u4")


_SHOWN = _shown()
#: A run of Latin letters, perhaps after the mark that no space is before it, perhaps with a stop.
_WORD_ONLY = r"\A\x00?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"
_WORD = _WORD_ONLY[:-2] + r"[,.]?\z"
# Unicode's white space.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts not to be cut: white space after a space, a space at the end, or the mark below.
_UNSAFE = rf" {_WHITE}| \z|\x00"
#: Texts not to be cut at the ends of lines: one is next to other white space, or to the text's start or end.
_LINES = rf"\A\n|\n\z|\n{_WHITE}|{_WHITE}\n"


def _strings(col: pa.Array) -> list[str]:
    """The texts of a column without nulls (by numpy, which makes them many times faster than ``to_pylist``)."""
    return col.to_numpy(zero_copy_only=False).tolist()


class Pieces:
    """``pre_split``: whether texts may be cut at spaces (byte-level BPE with its usual pattern)."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.pre_split = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec.get("post_processor") is None
            and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        )
        # Whether added tokens take in white space around them, or are looked for in changed text.
        self.entangled = spec.get("normalizer") is not None or any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids whose bytes begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.stops = {c: i for c in ",." if (i := self.tokenizer.token_to_id(c)) is not None}
        self.seen: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)  # the ids of all pieces, end to end
        self.end = np.zeros(1 << 16, np.int64)  # where each piece's ids end; [0] is 0
        self.hits = np.zeros(1 << 16, np.int32)  # how often each piece came since the last cleaning
        self.known = 0

    def _forget(self) -> None:
        """Keep only the pieces that came again since the last cleaning, half of ``MEMORY`` at most."""
        n = self.known
        own = np.flatnonzero(self.hits[:n] >= max(2, int(np.sort(self.hits[:n])[-(MEMORY // 2)]) + 1))
        names = list(self.seen)
        begin, length = self.end[own], self.end[own + 1] - self.end[own]
        place = np.cumsum(length) - length
        ids = self.pool[np.arange(int(length.sum())) + np.repeat(begin - place, length)]
        self.seen = {names[i]: k for k, i in enumerate(own.tolist())}
        self.known = 0
        self._learn(ids, length)
        self.hits[:] = 0

    def _encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _encode_words(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of some pieces, those of Latin letters, perhaps with a comma or full stop: each letters' run is
        one pre-token and goes to the model as such. Gives them, their ids and lengths."""
        col = pa.array(new, pa.string())
        own = col.filter(pc.match_substring_regex(col, _WORD if len(self.stops) == 2 else _WORD_ONLY))
        if not len(own):
            return [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        shown, ends = self._shown_words(own)
        got = list(map(self.tokenizer.model.tokenize, shown))
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.array([t.id for x in got for t in x], np.uint32)
        for stop, number in self.stops.items():
            own_ends = np.flatnonzero(ends == ord(stop))
            ids = np.insert(ids, np.cumsum(lengths)[own_ends], number)
            lengths[own_ends] += 1
        return _strings(own), ids, lengths

    def _encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that follow a space, all in one call, and their lengths: every piece begins,
        and no piece goes on, with an id that begins with a space."""
        joined = " " + " ".join(new)
        ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        first = np.flatnonzero(self.spaced[ids])
        if len(first) != len(new):  # a vocabulary of another kind
            own = self._encode([" " + p for p in new])
            return np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
        return ids, np.diff(np.append(first, len(ids)))

    def _learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, top = self.known, int(self.end[self.known])
        while len(self.pool) < top + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.end) <= n + len(lengths):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.pool[top : top + len(ids)] = ids
        self.end[n + 1 : n + 1 + len(lengths)] = top + np.cumsum(lengths)
        self.known = n + len(lengths)

    def cuttable(self, texts: pa.Array) -> np.ndarray:
        """Which texts may be cut at spaces (empty ones need not be)."""
        n = len(texts)
        if not self.pre_split:
            return np.zeros(n, bool)
        bad = np.asarray(pc.match_substring_regex(texts, _UNSAFE))
        for a in self.added:
            bad = bad | np.asarray(pc.match_substring(texts, a))
        return ~bad & (np.asarray(pc.binary_length(texts)) > 0)

    def _number(self, distinct: list[str]) -> np.ndarray:
        """The number of each piece; new ones are encoded and learnt."""
        seen = self.seen
        numbers = np.fromiter(map(seen.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            new = dict.fromkeys(distinct[i] for i in missing)
            words, ids, lengths = self._encode_words(list(new))
            done = set(words)
            first = [p for p in new if p[:1] == FIRST and p not in done]
            rest = [p for p in new if p[:1] != FIRST and p not in done]
            base = self.known
            if first:
                own = self._encode([p[1:] for p in first])
                self._learn(np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own)))
            if words:
                self._learn(ids, lengths)
            if rest:
                self._learn(*self._encode_pieces(rest))
            seen.update(zip([*first, *words, *rest], range(base, self.known), strict=True))
            numbers[missing] = [seen[distinct[i]] for i in missing]
        return numbers

    def lookup(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For the texts that can be cut: the number of every piece, in order, and how many pieces
        each text has. For the others: their positions and their texts."""
        if self.known > MEMORY:
            self._forget()
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        col = pc.fill_null(col, "") if col.null_count else col
        safe, sizes = self.cuttable(col), np.zeros(len(col), np.int64)
        whole = np.flatnonzero(~safe & (np.asarray(pc.binary_length(col)) > 0))
        own = col.filter(pa.array(safe))
        parted = pc.invert(pc.match_substring_regex(own, _LINES))
        lists = pc.split_pattern(pc.if_else(parted, pc.replace_substring(own, "\n", f" {FIRST}\n {FIRST}"), own), " ")
        sizes[safe] = np.diff(np.asarray(lists.offsets))
        codes = lists.flatten().dictionary_encode()
        numbers = self._number(_strings(codes.dictionary))[np.asarray(codes.indices)] if len(codes) else np.zeros(0, np.int64)
        if len(numbers):  # a text's first piece has no space before it
            at = np.cumsum(sizes[safe]) - sizes[safe]  # no mark yet: a text that begins with a line's end is not parted
            numbers[at] = self._number([FIRST + p for p in _strings(codes.take(pa.array(at)).cast(pa.string()))])
        self.hits[: self.known] += np.bincount(numbers, minlength=self.known).astype(np.int32)
        return numbers, sizes, whole, col.take(pa.array(whole)).to_pylist()

    def _shown_words(self, own: pa.Array) -> tuple[list[str], np.ndarray]:
        """For pieces of ``_WORD``: the letters as the model sees them, and the stop's character or 0."""
        first = pc.starts_with(own, FIRST)
        word = pc.utf8_rtrim(pc.utf8_ltrim(own, FIRST), ",.")
        data, at = W.flat(pc.binary_join_element_wise(pc.if_else(first, "", " "), word, ""))
        stop = np.zeros(len(own), np.int64)
        for c in ",.":
            stop[np.asarray(pc.ends_with(own, c))] = ord(c)
        return _SHOWN[np.insert(data, at[1:-1], 10)].tobytes().decode("utf-32-le").split("\n") if len(own) else [], stop

    def _pre_tokens(self, text: str) -> list[str]:
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer is not None else [text]

    def frequencies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Text, pre-token and how often the text has it; the distinct pre-tokens; and of each text the ids that are not of pre-tokens."""
        import re

        col = pc.fill_null(texts, "") if texts.null_count else texts
        n = len(col)
        safe, added = self.cuttable(col), np.zeros(n, np.int64)
        own, sizes = col.filter(pa.array(safe)), np.zeros(n, np.int64)
        parted = pc.invert(pc.match_substring_regex(own, _LINES))
        lists = pc.split_pattern(pc.if_else(parted, pc.replace_substring(own, "\n", f" {FIRST}\n {FIRST}"), own), " ")
        sizes[safe] = np.diff(np.asarray(lists.offsets))
        codes = lists.flatten().dictionary_encode()
        at = np.cumsum(sizes[safe]) - sizes[safe]
        first = pc.binary_join_element_wise(FIRST, codes.take(pa.array(at)).cast(pa.string()), "") if len(at) else pa.array([], pa.string())
        piece_of = np.asarray(codes.indices).astype(np.int64)
        piece_of[at] = len(codes.dictionary) + np.arange(len(at))  # a text's first piece has no space before it
        every = pa.concat_arrays([codes.dictionary.cast(pa.string()), first.cast(pa.string())])

        plain = np.asarray(pc.match_substring_regex(every, _WORD))
        shown, stop = self._shown_words(every.filter(pa.array(plain)))
        names, lengths = [shown, [chr(c) for c in stop[stop > 0].tolist()]], np.zeros(len(every), np.int64)
        lengths[plain] = 1 + (stop > 0)
        which = [np.flatnonzero(plain), np.flatnonzero(plain)[stop > 0]]  # the piece of each name, in order of names
        odd = np.flatnonzero(~plain)
        for i, p in zip(odd.tolist(), _strings(every.take(pa.array(odd))), strict=True):
            got = self._pre_tokens(p[1:] if p[:1] == FIRST else " " + p)
            names.append(got)
            lengths[i] = len(got)
        which.append(np.repeat(odd, lengths[odd]))
        # Texts that are not cut at spaces are pieces of their own.
        whole, special = np.flatnonzero(~safe & (np.asarray(pc.binary_length(col)) > 0)), None
        if self.added:
            special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        more = np.zeros(len(whole), np.int64)
        for j, text in enumerate(_strings(col.take(pa.array(whole)))):
            if self.entangled and special is not None and special.search(text):  # only the library can tell its ids apart
                names.append([])
                added[whole[j]] = len(self._encode([text])[0])
                continue
            parts = special.split(text) if special is not None else [text]
            got = [x for part in parts if part for x in self._pre_tokens(part)]
            names.append(got)
            more[j], added[whole[j]] = len(got), len(parts) - 1
        which.append(np.repeat(len(every) + np.arange(len(whole)), more))
        lengths = np.concatenate([lengths, more])
        flat = pa.array([x for own_names in names for x in own_names], pa.string()).dictionary_encode()
        order = np.argsort(np.concatenate(which), kind="stable")
        name_of, start = np.asarray(flat.indices).astype(np.int64)[order], np.cumsum(lengths) - lengths

        doc = np.concatenate([np.repeat(np.arange(n), sizes), whole])
        piece = np.concatenate([piece_of, len(every) + np.arange(len(whole))])
        run, place = W.segments(lengths[piece])
        v = max(1, len(flat.dictionary))
        key, number = np.unique(doc[run] * v + name_of[start[piece][run] + place], return_counts=True)
        return key // v, key % v, number, flat.dictionary, added

    def sizes(self, names: list[str]) -> list[int]:
        """The number of the library's ids of each pre-token."""
        return list(map(len, map(self.tokenizer.model.tokenize, names)))

    def token_counts(self, texts: Sequence[str] | pa.Array) -> np.ndarray:
        """Tokens of each text, without its ids."""
        numbers, sizes, at, whole = self.lookup(texts)
        total = np.concatenate([[0], np.cumsum(self.end[numbers + 1] - self.end[numbers])])
        end = np.cumsum(sizes)
        out = total[end] - total[end - sizes]
        if whole:
            out[at] = [len(x) for x in self._encode(whole)]
        return out

    def encode(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each."""
        numbers, sizes, at, whole = self.lookup(texts)
        begin, length = self.end[numbers], self.end[numbers + 1] - self.end[numbers]
        place = np.cumsum(length) - length
        ids = self.pool[np.arange(int(length.sum())) + np.repeat(begin - place, length)]
        total = np.concatenate([[0], np.cumsum(length)])
        end = np.cumsum(sizes)
        counts = total[end] - total[end - sizes]
        if whole:
            rest, stop = self._encode(whole), np.concatenate([[0], np.cumsum(counts)])
            out, done = [], 0
            for i, own in zip(at.tolist(), rest, strict=True):
                out += [ids[done : stop[i]], own]
                done = stop[i]
            counts[at] = [len(x) for x in rest]
            ids = np.concatenate([*out, ids[done:]])
        return ids, counts


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's own copy of a tokenizer: loaded once, with what it has seen."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]
