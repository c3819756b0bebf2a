"""Token ids of whole texts, by the tokenizers library, with each distinct word encoded once.

A tokenizer that splits at white space before its merges gives a text the ids of its words, one
after the other. So a task encodes each word it hasn't met through the library and looks up the
rest; texts in which that cut would not be safe go to the library whole. The table of known words
is bounded: once it is full, words met later are encoded for their batch and forgotten.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import add

import numpy as np

#: Words as they stand in texts, and words without their punctuation, that a task remembers.
KNOWN_WORDS, KNOWN_BASES = 800_000, 1_000_000
#: Words that go to the library in one text.
TOGETHER = 512
#: Texts whose words are looked up together, and the code points at which a long text is cut.
TEXTS, LONG = 256, 500_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin-1 letters, and after them ASCII punctuation without the apostrophe: these two never share a token.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    `keeps_space`: the tokenizer joins a blank to the word after it (byte-level BPE); otherwise it
    drops white space. The strings of added tokens in a text get their ids, as in the library: it
    cuts a text at them before anything else, and the pieces between them are texts of their own.
    """

    def __init__(self, path: str, keeps_space: bool, known_words: int = KNOWN_WORDS, known_bases: int = KNOWN_BASES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must be found as they stand")
        self.added = {t.content: np.uint32(i).astype("<u4").tobytes() for i, t in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.keeps_space, self.known_words, self.known_bases = keeps_space, known_words, known_bases
        # A mark between words whose id no word has: the line feed, or a NUL that stands alone.
        self.mark, self.glue = ("\n", "\n") if keeps_space else ("\x00", " \x00 ")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_bytes = np.uint32(self.mark_id).tobytes()
        # Words after the start of a line, and after a blank; the same without punctuation.
        self.forget()

    def forget(self) -> None:
        """Without any known words, as a task leaves it: a worker that is idle holds no memory for them."""
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.bases: dict[str, dict[str, bytes]] = {"": {"": b""}, " ": {}}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _remembered(known: dict[str, bytes], words: set[str], room: int, encode: Callable[[list[str]], dict[str, bytes]]) -> dict[str, bytes]:
        """A table with the ids of each word. Those that aren't known are encoded, and remembered while there is room."""
        new = words.difference(known)
        if not new:
            return known
        found = encode(list(new))
        if len(known) < room:
            known.update(found)
            return known
        found.update((w, known[w]) for w in words - new)
        return found

    def _ids_of(self, known: dict[str, bytes], words: set[str], lead: str) -> dict[str, bytes]:
        return self._remembered(known, words, self.known_words, lambda new: self._encode_new(new, lead))

    def _encode_new(self, new: list[str], lead: str) -> dict[str, bytes]:
        """Encodes words; a word and the punctuation after it go apart, and each is encoded once."""
        plain, tailed, before, after, whole = [], [], [], [], []
        lower = str if self.keeps_space else str.lower  # a tokenizer that drops blanks lower-cases too
        for w in new:
            base = w.rstrip(_PUNCTUATION)
            if not base.isalpha() or not (base.isascii() or _LATIN.fullmatch(base)):
                whole.append(w)
            elif len(base) == len(w):
                plain.append(w)
            else:  # lists side by side: of tuples the garbage collector would look at each
                tailed.append(w)
                before.append(lower(base))
                after.append(w[len(base) :])
        bases = self._remembered(self.bases[lead], {*map(lower, plain), *before}, self.known_bases, lambda words: self._encode_words(words, lead))
        tails = self._remembered(self.bases[""], set(after), self.known_bases, lambda words: self._encode_words(words, ""))
        out = self._encode_words(whole, lead)
        out.update(zip(plain, map(bases.__getitem__, map(lower, plain))))
        out.update(zip(tailed, map(add, map(bases.__getitem__, before), map(tails.__getitem__, after))))
        return out

    def _encode_words(self, new: list[str], lead: str) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for i in range(0, len(new), TOGETHER):
            part = new[i : i + TOGETHER]
            (found,) = self.tokenizer.encode_batch_fast([lead + (self.glue + lead).join(part)], add_special_tokens=False)  # without places in the text
            ids = np.array(found.ids, "<u4")
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) != len(part) - 1:  # a word holds the mark
                out.update((w, self._whole(lead + w)) for w in part)
                continue
            data, ends = ids.tobytes(), (4 * marks).tolist()
            out.update(zip(part, [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(data)])]))
        return out

    @staticmethod
    def _is_regular(text: str) -> bool:
        """Single blanks and line feeds between words, and no other white space."""
        flat = text.replace("\n", " ")
        return bool(text) and " ".join(flat.split()) == flat

    def _slices(self, text: str) -> Iterator[str]:
        """A long text in parts that can be encoded one by one."""
        at = 0
        while len(text) - at > LONG and (m := _CUT.search(text, at + LONG)):
            yield text[at : m.start()]
            at = m.start() if self.keeps_space else m.end()
        yield text[at:]

    def _batch(self, texts: list[str]) -> list[bytes]:
        if not self.keeps_space:
            split = [t.replace("\n", " ").split(" ") for t in texts]
            get = self._ids_of(self.bare, set().union(*split), "").__getitem__
            return [b"".join(map(get, words)) for words in split]
        plain = [[x.split(" ") for x in t.split("\n")] if self._is_regular(t) else None for t in texts]
        rest: set[str] = set()
        for lines in plain:
            for x in lines or ():
                rest.update(x[1:])
        bare = self._ids_of(self.bare, {x[0] for lines in plain if lines for x in lines}, "")
        get = self._ids_of(self.spaced, rest, " ").__getitem__
        return [self._whole(t) if lines is None else self.mark_bytes.join([bare[x[0]] + b"".join(map(get, x[1:])) for x in lines]) for t, lines in zip(texts, plain)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; null as empty."""
        texts = [t or "" for t in texts]
        for i in range(0, len(texts), TEXTS):
            part = texts[i : i + TEXTS]
            if any(x in t for x in self.added for t in part):
                yield from self._around_added(part)
            else:
                yield from self._plain(part)

    def _plain(self, part: list[str]) -> list[bytes]:
        return self._batch(part) if max(map(len, part)) <= LONG else [self._long(t) for t in part]

    def _around_added(self, part: list[str]) -> list[bytes]:
        split = [self.at_added.split(t) for t in part]  # added tokens are at the odd places
        pieces = [x for xs in split for x in xs[::2]]
        ids = iter([x for i in range(0, len(pieces), TEXTS) for x in self._plain(pieces[i : i + TEXTS])])
        return [b"".join([self.added[x] if k % 2 else next(ids) for k, x in enumerate(xs)]) for xs in split]

    def _long(self, text: str) -> bytes:
        parts = list(self._slices(text))
        if self.keeps_space and len(parts) > 1:  # the parts after the first begin with the blank of their first word
            return b"".join(self._batch([parts[0]]) + [self._led(p) for p in parts[1:]])
        return b"".join(b for p in parts for b in self._batch([p]))

    def _led(self, part: str) -> bytes:
        """A part that begins with a single blank before a word."""
        if not self._is_regular(part[1:]):
            return self._whole(part)
        first, _, after = part[1:].partition("\n")
        words = first.split(" ")
        out = b"".join(map(self._ids_of(self.spaced, set(words), " ").__getitem__, words))
        return out + self.mark_bytes + self._batch([after])[0] if after else out


@lru_cache(maxsize=2)
def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder for a Python worker, which lives through many tasks; each of them forgets its words."""
    gc.set_threshold(100_000)  # tables and lists of words have no cycles, and each young collection goes through the lists
    return WordEncoder(path, keeps_space)
