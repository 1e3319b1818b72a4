"""BPE encoding and decoding with a tokenizer file, exact to the tokenizers library, by tree concatenation.

A text is halved until its parts have LEAF bytes at most, whatever stands at the cuts; the leaves are encoded on their
own, and joined two by two up the tree. A join looks at a window around the cut that grows until both sides agree: until
it ends at white space on either side, which no token spans, so that what lies beyond is the same in the part and in the
whole. The window's middle is encoded anew, the rest of both parts stays. Runs between white space are encoded once
(a bounded memo). A run of over LONG characters, which the library would merge as one word, is halved as well: its leaves
are encoded in parallel, and its windows are of tokens and grow until the encodings of both sides agree (`tree_encode`).
"""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from pathlib import Path

from tokenizers import Tokenizer
from tokenizers.models import BPE

#: Pieces that a codec remembers: packing, which shares its workers with other stages of a pipeline, takes fewer.
MEMO, SMALL_MEMO = 500_000, 300_000
#: Bytes of a leaf of the tree over a text, and characters of a leaf, and of the longest run that is none, of the tree over a run.
LEAF = 512
LONG = 512
#: Bytes on each side of a cut in the first window.
REACH = 16
_WHITE = b" \t\n\x0b\x0c\r"
#: Pieces that need no normaliser but lower case: printable ASCII and the letters of Latin-1, which are all composed.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The pre-tokenizer's pattern on such pieces in lower case.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Tokens on each side of a join in the first window; doubled until both sides agree.
MARGIN = 8


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver; it is of fixed size and travels with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


class WordBpe:
    def __init__(self, source: str, room: int = MEMO):
        self.room = room
        self.tok = Tokenizer.from_str(source)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self._inner: BPE | None = None
        self._final: BPE | None = None
        self.names: dict[int, str] = {}
        self.memo: dict[bytes, tuple] = {}
        self.words: dict[str, list[int]] = {}
        # the shortcut holds for this file's normaliser and pre-tokenizer only
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        special = all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
        self.can_skip = special and steps == ["NFC", "Replace", "Lowercase"] and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def name(self, i: int) -> str:
        found = self.names.get(i)
        if found is None:
            found = self.names[i] = self.tok.id_to_token(i)
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a piece without white space at its ends."""
        return self.tok.encode(text, add_special_tokens=False).ids if len(text) <= LONG else self._encode_long(text)

    def _encode_long(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in [*self.specials.finditer(text), None]:
            plain = text[at : m.start() if m else len(text)]
            if plain:
                for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(plain)):
                    ids += self.tree_encode(word) if len(word) > LEAF else self._leaf(word, True)
            if m:
                ids.append(self.tok.token_to_id(m.group()))
                at = m.end()
        return ids

    def _leaf(self, word: str, last: bool) -> list[int]:
        """Plain BPE of (part of) a pre-tokenized word; `last`: it holds the word's end."""
        if self._inner is None:
            self._inner = BPE(self.vocab, self.merges)
            self._final = BPE(self.vocab, self.merges, end_of_word_suffix=self.suffix) if self.suffix else self._inner
        return [t.id for t in (self._final if last else self._inner).tokenize(word)]

    def _spelled(self, ids: list[int]) -> str:
        s = "".join(map(self.name, ids))
        return s.removesuffix(self.suffix) if self.suffix and ids and self.name(ids[-1]).endswith(self.suffix) else s

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Tokens of the concatenation of two encoded parts.

        A window of `margin` tokens on each side is encoded anew. If it begins with the left part's token there and ends
        with the right part's, every pair of neighbours in the whole is one that BPE leaves as it is, and a sequence
        whose neighbours all are is BPE's encoding; else the window grows, up to both parts whole.
        """
        margin = MARGIN
        while True:
            a, b = max(0, len(left) - margin), min(len(right), margin)
            ends = last and b == len(right)
            mid = self._leaf(self._spelled(left[a:] + right[:b]), ends)
            left_ok = a == 0 or (len(mid) > 1 and mid[0] == left[a])
            right_ok = b == len(right) or (len(mid) > 1 and mid[-1] == right[b - 1])
            if left_ok and right_ok:
                return left[:a] + mid + right[b:]
            margin *= 2

    def tree_encode(self, word: str, last: bool = True, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """Ids of a long pre-tokenized word: leaves encoded in parallel, then joined two by two up the tree."""
        if pool is None:
            with ThreadPoolExecutor(2) as pool:
                return self.tree_encode(word, last, pool)
        cuts = list(range(0, len(word), LEAF))
        parts = list(pool.map(lambda c: self._leaf(word[c : c + LEAF], last and c + LEAF >= len(word)), cuts))
        while len(parts) > 1:
            n = len(parts)
            pairs = [(parts[i], parts[i + 1], last and i + 2 >= n) for i in range(0, n - 1, 2)]
            parts = list(pool.map(lambda p: self.join(*p), pairs)) + parts[n - n % 2 :]
        return parts[0] if parts else []

    def _plain(self, text: str) -> list[int]:
        """encode() of a text of PLAIN without special tokens: the library's model on its own words."""
        ids: list[int] = []
        for word in WORD.findall(text.lower()):
            own = self.words.get(word)
            if own is None:
                own = self.words[word] = self._leaf(word if word.isascii() else byte_letters(word), True)
            ids += own
        return ids

    def entry(self, piece: bytes, make):
        """make(ids) of a UTF-8 piece without ASCII white space, memoised."""
        found = self.memo.get(piece)
        if found is None:
            text = piece.decode()
            plain = self.can_skip and len(piece) <= LONG and "<|" not in text and PLAIN.fullmatch(text)
            found = self.memo[piece] = make(self._plain(text) if plain else self.encode(text))
        return found

    def _room(self) -> None:
        for held in (self.memo, self.words):
            if len(held) > self.room:
                held.clear()

    def entries(self, texts: list[bytes], make) -> list[list]:
        """make(ids) of every piece of each UTF-8 text between ASCII white space."""
        self._room()
        entry = self.entry
        return [[entry(p, make) for p in t.split()] for t in texts]

    def tree(self, text: bytes, make) -> list:
        """The same of one text, by tree concatenation."""
        self._room()
        edges = cuts(text)
        parts = []
        for a, b in zip(edges, edges[1:]):
            own = text[a:b].split()
            parts.append((a, b, own, [self.entry(p, make) for p in own]))
        while len(parts) > 1:
            parts = [self._concatenate(text, *parts[i : i + 2], make) for i in range(0, len(parts) - 1, 2)] + parts[len(parts) - len(parts) % 2 :]
        return parts[0][3] if parts else []

    def _concatenate(self, text: bytes, left: tuple, right: tuple, make) -> tuple:
        begin, cut, pieces, made = left
        _, end, after, made_after = right
        if pieces and after and text[cut - 1] not in _WHITE and text[cut] not in _WHITE:
            reach = REACH
            while True:
                a, b = max(begin, cut - reach), min(end, cut + reach)
                before, behind = text[a:cut].split(), text[cut:b].split()
                agree = (a == begin or len(before) > 1 or text[a] in _WHITE) and (b == end or len(behind) > 1 or text[b - 1] in _WHITE)
                if agree:
                    break
                reach *= 2
            middle = before[-1] + behind[0]
            pieces[-1], made[-1] = middle, self.entry(middle, make)
            after, made_after = after[1:], made_after[1:]
        pieces += after
        made += made_after
        return begin, end, pieces, made


def cuts(text: bytes) -> list[int]:
    """Edges of the leaves: halves of halves of LEAF bytes at most; a character stays whole."""
    n = 1 << max(0, -(-len(text) // LEAF) - 1).bit_length()
    out = [0]
    for i in range(1, n):
        at = len(text) * i // n
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        if at > out[-1]:
            out.append(at)
    return [*out, len(text)] if text else []


def byte_letters(word: str) -> str:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the n-th other byte for U+0100 + n."""
    return "".join(_LETTERS[b] for b in word.encode())


_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(_HIDDEN)}


@lru_cache(maxsize=1)
def codec(source: str, use: str, room: int = MEMO) -> WordBpe:
    """One codec for a Python worker and use: its memo holds what that use makes of the ids, over all tasks."""
    return WordBpe(source, room)


def decode_names(codec: WordBpe, ids: list[int]) -> str:
    """The library's decode without a decoder: token strings joined by one space."""
    return " ".join(map(codec.name, ids))
