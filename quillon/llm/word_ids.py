"""Token ids of whole texts by the tokenizers library, each distinct word encoded once for a while.

Both vocabularies split a text where a single space stands between two other characters
(byte-level: the space belongs to the next word) or at white space (word-level: it is dropped)
before anything else, so a text's ids are its words' ids one after the other. Other
runs of white space are left whole for the library.

The ids are those of the library's plain call with add_special_tokens=False. That call finds the vocabulary's added tokens
in a text before all else, so a text that holds one goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: Words kept by a worker; then it starts anew. Longer words are not kept.
KEPT_WORDS, KEPT_LENGTH = 800_000, 64
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_BLANK = str.maketrans("\t\n\r", "   ")
#: White space besides spaces and line ends.
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of Latin letters, maybe with signs after them: both pre-tokenisers cut between the two and nowhere else.
_LATIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


_LETTERS = byte_letters()


class WordIds:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, space_leads: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Added tokens as they stand in a text, and those that are looked for in the normalised text.
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.added_lower = [t.content.lower() for t in added if t.normalized]
        self.space_leads = space_leads
        #: By word; where the space leads, `kept` has words after a space, `bare` the first words of texts.
        self.kept: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a string that the vocabulary's pre-tokeniser leaves whole, by the library's model."""
        if piece not in self.pieces:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
            self.pieces[piece] = array("I", [x.id for x in self.library.model.tokenize(letters)]).tobytes()
        return self.pieces[piece]

    def _words(self, text: str) -> list[str]:
        if not self.space_leads:
            return text.translate(_BLANK).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
        if "  " in text or "\n " in text or " \n" in text or _OTHER_SPACE.search(text):
            return _SINGLE.split(text)
        return text.split(" ")

    def _add(self, kept: dict[str, bytes], words: set[str], lead: str) -> list[str]:
        """Encodes words into kept; those that are not to stay there."""
        if len(self.pieces) > KEPT_WORDS:
            self.pieces.clear()
        known, match, lower, rest, passing = self.pieces.get, _LATIN.fullmatch, not self.space_leads, [], []
        for word in words:
            lines = (word,)
            if "\n" in word:  # a line end between two other characters is a piece of its own
                lines = word.split("\n")
                passing.append(word)
            elif len(word) > KEPT_LENGTH:
                passing.append(word)
            whole, before = b"", lead
            for line in lines:
                found = match(before + line)
                if found is None:
                    rest.append(word)
                    break
                if whole:
                    whole += known("\n") or self._piece("\n")
                before = ""
                stem, signs = found.groups()
                if lower:
                    stem = stem.lower()
                whole += known(stem) or self._piece(stem)
                if signs:
                    whole += known(signs) or self._piece(signs)
            else:
                kept[word] = whole
        for first in range(0, len(rest), 20_000):
            part = rest[first : first + 20_000]
            coded = self.library.encode_batch_fast([lead + w for w in part], add_special_tokens=False)
            kept.update(zip(part, [array("I", x.ids).tobytes() for x in coded]))
        return passing

    def ids(self, texts: list[str]) -> list[bytes]:
        for held in (self.kept, self.bare):
            if len(held) > KEPT_WORDS:
                held.clear()
        kept, first = self.kept, self.bare if self.space_leads else self.kept
        out: list[bytes] = []
        open_: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        wanted, wanted_first = set(), set()
        for text in texts:
            if any(x in text for x in self.added) or self.added_lower and any(x in text.lower() for x in self.added_lower):
                out.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            words = self._words(text)
            parts = list(map(kept.get, words))
            parts[0] = first.get(words[0])
            try:
                out.append(b"".join(parts))
            except TypeError:  # some word is new
                missing = [k for k, x in enumerate(parts) if x is None]
                wanted.update([words[k] for k in missing if k])
                if parts[0] is None:
                    wanted_first.add(words[0])
                open_.append((len(out), words, parts, missing))
                out.append(b"")
        passing = [(kept, self._add(kept, wanted - kept.keys(), " " if self.space_leads else ""))]
        passing.append((first, self._add(first, wanted_first - first.keys(), "")))
        for at, words, parts, missing in open_:
            for k in missing:
                parts[k] = kept[words[k]] if k else first[words[0]]
            out[at] = b"".join(parts)
        for held, words in passing:
            for word in words:
                held.pop(word, None)
        return out


_MADE: dict[tuple[str, bool], WordIds] = {}


def worker_ids(path: str, space_leads: bool) -> WordIds:
    """One for each Python worker, kept between its tasks."""
    if (path, space_leads) not in _MADE:
        _MADE[path, space_leads] = WordIds(path, space_leads)
    return _MADE[path, space_leads]


def text_batches(texts: list, limit: int = 1 << 21):
    """Row ranges of about `limit` characters."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
