"""Tokens by a public vocabulary file. Its BPE drops white space, so a document is encoded word by word (words between ASCII white
space), each distinct word once for as long as the cache keeps it. Ids and spans are those of the whole text."""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 400_000
#: Words encoded in one call; each takes about a kilobyte until its ids are taken out.
ENCODED_WORDS = 8192
#: Marks that the vocabulary's rules split from letters before them; a word's letters and its marks are encoded apart.
MARKS = ".,!?;:%&*#$()\"-"  # not the apostrophe, nor what the names of special tokens are made of
#: Letters of the Latin alphabets, composed, whose lower case is one such letter: the vocabulary's rules leave a run of them in one piece.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and ord(c.lower()) < 0x250)
PLAIN = re.compile(f"([{LETTERS}]+)([{re.escape(MARKS)}]*)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps the file; asked for in the task, as executors have their own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """For each word its ids as little-endian 32-bit numbers; with spans, its tokens' starts and ends in it (code points) instead."""

    def __init__(self, path: str | None = None, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spans = spans
        self.cache: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def encoded(self, words: list[str]):
        """The entry of each word, by all the vocabulary's rules."""
        run = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        for at in range(0, len(words), ENCODED_WORDS):
            for e in run(words[at : at + ENCODED_WORDS], add_special_tokens=False):
                yield array("i", chain.from_iterable(e.offsets) if self.spans else e.ids).tobytes()  # four bytes on every platform that Spark runs on

    def merged(self, words: list[str]):
        """The entry of each word of lower-case LETTERS, by the vocabulary's merges alone."""
        tokenize = self.tokenizer.model.tokenize
        written = self.bytes_as_letters.pre_tokenize_str(" ".join(words))[0][0].split("Ġ") if words else []  # as a blank is written
        for word in written:
            if not self.spans:
                yield array("i", [t.id for t in tokenize(word)]).tobytes()
                continue
            cuts, end = array("i"), 0
            for t in tokenize(word):
                cuts.append(end)
                end = min(len(word), end + len(t.value))  # the last one has the mark of a word's end too
                cuts.append(end)
            yield cuts.tobytes()

    def learn(self, new: set[bytes]) -> None:
        cache, letters, spans = self.cache, self.letters, self.spans
        split, other = [], []
        for w in new:
            text = w.decode("utf-8", "replace")
            m = PLAIN.fullmatch(text)
            if m and not (spans and not text.isascii()):  # spans of other letters aren't those of their bytes
                split.append((w, m[1].lower(), m[2]))
            else:
                other.append((w, text))
        marks = dict.fromkeys(m for _, _, m in split)
        marks.update(zip(marks, self.encoded(list(marks)), strict=True))
        fresh = list({low for _, low, _ in split}.difference(letters))
        letters.update(zip(fresh, self.merged(fresh), strict=True))
        cache.update(zip((w for w, _ in other), self.encoded([t for _, t in other]), strict=True))
        for w, low, m in split:
            if not m:
                cache[w] = letters[low]
            elif not spans:
                cache[w] = letters[low] + marks[m]
            else:
                cache[w] = letters[low] + array("i", (len(low) + x for x in array("i", marks[m]))).tobytes()

    def of(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text the entries of its words, in order."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
            self.letters.clear()
        many = [(t or "").encode("utf-8", "replace").split() for t in texts]
        new = set().union(*many).difference(self.cache)
        if new:
            self.learn(new)
        entry = self.cache.__getitem__
        return [list(map(entry, words)) for words in many]
