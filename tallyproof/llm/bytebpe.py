"""Token ids of a byte-level BPE for whole Arrow batches.

A text is split as the vocabulary's pattern splits it (contractions, letters,
digits, other characters, each with one leading space, and white space), but for
all texts of a batch at once in numpy; each distinct piece is then encoded once
and its ids are kept. tiktoken encodes the pieces, with ranks read from the given
tokenizers file: the ids are those of tokenizers, several times faster. Texts
with a special token's string or with characters from BEYOND on are encoded whole
by tokenizers itself.
"""

from __future__ import annotations

import json

import numpy as np

from . import textvec

BEYOND = 0x3000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 1 << 19
_PLACE = textvec.odd(np.arange(256))
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Encoder:
    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        of = _byte_of()
        ranks = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.pieces = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        chars = [chr(i) for i in range(BEYOND)]
        kind = np.full(BEYOND, OTHER, np.uint8)
        for k, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            kind[[i for i, c in enumerate(chars) if regex.fullmatch(p, c)]] = k
        self.kind = kind
        self.char = textvec.mix(np.arange(1, BEYOND + 1, dtype=np.uint64)) | np.uint64(1)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros((2, KEPT), np.uint64)
        self.entry = np.zeros((2, KEPT), np.int32)
        self.chars, self.char_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def starts(self, c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin in the code points c; bounds: of the texts."""
        n = len(c)
        kind = self.kind[c]
        space = kind == SPACE
        first = np.zeros(n, bool)
        inner = bounds[bounds < n]
        first[inner] = True
        last = np.zeros(n, bool)
        last[inner[inner > 0] - 1] = True
        last[-1] = True
        p_kind = np.empty_like(kind)
        p_kind[0], p_kind[1:] = OTHER, kind[:-1]
        p_blank = np.empty(n, bool)
        p_blank[0], p_blank[1:] = False, c[:-1] == 32
        n_space = np.empty(n, bool)
        n_space[-1], n_space[:-1] = True, space[1:]
        words = ~space & (p_kind != kind) & ~p_blank
        spaces = space & ((p_kind != SPACE) | (~n_space & ~last))
        start = words | spaces | first
        at = np.flatnonzero((c == 39) & start & ~last)
        if len(at):
            x = c[at + 1]
            two = np.isin(x, [ord(a) for a in "stmd"])
            y = np.where(last[at + 1], 0, c[np.minimum(at + 2, n - 1)])
            three = ~two & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
            hit = at[two | three]
            start[hit + 1] = False
            after = hit + np.where(two, 2, 3)[two | three]
            keep = ~last[after - 1]
            start[after[keep]] = True
        return np.flatnonzero(start)

    def _hashes(self, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hashes of pieces: their characters' numbers, each times a random odd number
        of its place."""
        out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 15))))
            low, high = starts[i], starts[j] if j < n else len(c)
            at = starts[i:j] - low
            place = np.arange(high - low) - np.repeat(at, np.diff(np.append(at, high - low)))
            far = int(place.max()) + 1
            by_place = _PLACE if far <= len(_PLACE) else textvec.odd(np.arange(far))
            out[i:j] = np.add.reduceat(self.char[c[low:high]] * by_place[place], at)
            i = j
        return textvec.mix(out) | np.uint64(1)

    def _same(self, entries: np.ndarray, c: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether these entries are of the pieces that start there in c."""
        begin = self.char_at[entries]
        out = self.char_at[entries + 1] - begin == sizes
        at = np.flatnonzero(out)
        own = sizes[at]
        if len(at):
            equal = self.chars[textvec.ragged(begin[at], own)] == c[textvec.ragged(starts[at], own)]
            out[at] = np.logical_and.reduceat(equal, np.cumsum(own) - own)
        return out

    def _entries(self, text: str, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each piece's entry; new pieces are encoded. Characters are
        compared, so pieces of one hash don't mix."""
        h, sizes = self._hashes(c, starts), np.diff(np.append(starts, len(c)))
        slots = (h >> np.uint64(45)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(KEPT - 1)).astype(np.int64)
        a = self.keys[0][slots[0]] == h
        found = np.where(a, self.entry[0][slots[0]], self.entry[1][slots[1]])
        known = a | (self.keys[1][slots[1]] == h)
        at = np.flatnonzero(known)
        known[at] = self._same(found[at], c, starts[at], sizes[at])
        while True:
            miss = np.flatnonzero(~known)
            if not len(miss):
                return found
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[where]
            encode = self.pieces.encode_ordinary
            got = [encode(text[i : i + n]) for i, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
            numbers = len(self.begin) - 1 + np.arange(len(new), dtype=np.int32)
            self.ids = np.concatenate([self.ids, np.fromiter((x for g in got for x in g), np.int32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(g) for g in got])])
            self.chars = np.concatenate([self.chars, c[textvec.ragged(starts[at], sizes[at])]])
            self.char_at = np.concatenate([self.char_at, self.char_at[-1] + np.cumsum(sizes[at])])
            found[miss] = numbers[back]
            known[miss] = self._same(found[miss], c, starts[miss], sizes[miss])
            s0, s1 = slots[0][at], slots[1][at]
            free = self.keys[0][s0] == 0
            self.keys[0][s0[free]], self.entry[0][s0[free]] = new[free], numbers[free]
            self.keys[1][s1[~free]], self.entry[1][s1[~free]] = new[~free], numbers[~free]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begin) of all texts, one after another."""
        if len(self.begin) > KEPT:
            self.reset()
        joined = "".join(texts)
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        odd = c >= BEYOND
        apart = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if odd.any():
            apart |= set((np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1).tolist())
            c = np.where(odd, np.uint32(BEYOND - 1), c)
        if not len(c):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.starts(c, bounds)
        if apart:  # their pieces aren't looked at
            use = np.zeros(len(c) + 1, bool)
            use[-1] = True
            skip = np.zeros(len(c), bool)
            for i in apart:
                skip[bounds[i] : bounds[i + 1]] = True
            taken = ~skip[starts]
        else:
            taken = None
        if taken is None:
            entries = self._entries(joined, c, starts)
        else:
            entries = np.zeros(len(starts), np.int32)
            kept = self._some(joined, c, starts, taken)
            entries[taken] = kept
        sizes = np.diff(self.begin)[entries] if len(self.begin) > 1 else np.zeros(len(starts), np.int64)
        if taken is not None:
            sizes = np.where(taken, sizes, 0)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begin[entries] - total[:-1], sizes) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.int32)
        begin = total[np.searchsorted(starts, bounds)]
        if apart:
            parts = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32) if i in apart else ids[begin[i] : begin[i + 1]] for i, t in enumerate(texts)]
            ids, begin = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, begin

    def _some(self, joined: str, c: np.ndarray, starts: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Entries of the taken pieces: text by text, as the others lie between."""
        runs = np.flatnonzero(np.diff(np.concatenate([[0], taken.astype(np.int8), [0]])))
        out = [np.zeros(0, np.int32)]
        for i, j in zip(runs[::2], runs[1::2], strict=True):
            low, high = starts[i], starts[j] if j < len(starts) else len(c)
            out.append(self._entries(joined[low:high], c[low:high], starts[i:j] - low))
        return np.concatenate(out)
