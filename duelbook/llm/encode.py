"""Token ids of whole texts by a public tokenizer, with repeated stretches encoded once per worker.

Both vocabularies split a text into pre-tokens that never cross the places cut at here, so the ids of a text are those
of its stretches in a row. ``spaced``: byte-level splitting where a word takes the one blank before it. ``words``:
white space is dropped. Texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

from duelbook.llm.common import worker_store

BLANK = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACED = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
WORDS = re.compile(rf"[^{BLANK}]+")
# Blanks other than the space and the line end, and what marks a literal key; and two blanks in a row.
ODD_BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\0"
UNEVEN = (*ODD_BLANKS, "  ", "\n\n", " \n", "\n ")
NOT_WHITE = re.compile(r"[\x1c-\x1f]")  # split() would cut there
# A mark between a letter and a blank is a pre-token of its own. It is looked for by the mark, the rarest part.
MARK = re.compile(r"([.,])(?=\s|\Z)(?<=[^\W\d_][.,])")
# So is a run of ASCII signs there but for the apostrophe, which may begin a short form.
SIGN = r"[!-&(-/:-@\[-`{-~]"
TAIL = re.compile(rf"({SIGN}(?<=[^\W\d_]{SIGN}){SIGN}*)(?=\s|\Z)")
# Words of plain letters are one pre-token that nothing changes but the signs for bytes: the model alone gives their ids.
PLAIN = {"spaced": re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"), "words": re.compile("[a-z\xdf-\xf6\xf8-\xff]+")}
TRIAL = 600  # made-up words on which that is tried before it is relied on


def byte_sign(b: int) -> str:
    """The sign of a byte in a byte-level vocabulary: printing Latin-1 itself, the others in order from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b if b in prints else 256 + b - sum(p < b for p in prints))


SIGNS = {c: "".join(map(byte_sign, chr(c).encode())) for c in [32, *range(0xC0, 0x100)]}
OTHER_CASE = re.compile("[\u0130\u0250-\U0010ffff]")  # letters that may lower otherwise than in the tokenizer
MOST_KEPT = 800_000  # stretches; about 200 bytes each


def uneven(text: str) -> bool:
    """Whether a text has any blank other than single spaces and line ends between other characters, or a ``\\0``.

    Plain searches, one for each sign: a pattern of them all takes ten times as long, a fifth of all encoding.
    """
    return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(s in text for s in UNEVEN)


class Numbered(dict):
    """Numbers for keys in order of arrival."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Encoder:
    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.simple = self.tokenizer.model, PLAIN[kind]
        letters = [chr(c) for c in [*range(97, 123), *range(65, 91), *range(0xC0, 0x100)] if self.simple.fullmatch(chr(c))]
        trial = [("" if kind == "words" else " " * (i % 2)) + "".join(letters[(i * i * 7 + 11 * j * (i + j)) % len(letters)] for j in range(1 + i % 12)) for i in range(TRIAL)]
        if self.ids_of(trial) != [e.ids for e in self.tokenizer.encode_batch(trial, add_special_tokens=False)]:
            self.simple = re.compile(r"(?!)")
        self.clear()

    def clear(self):
        self.known, self.done = Numbered(), 0
        self.flat, self.filled = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def pieces(self, text: str) -> list[str]:
        """Stretches of a text as keys: after ``\\0`` literal, else with the space before them left off."""
        if self.kind == "words":
            if not OTHER_CASE.search(text):
                text = text.lower()
            text = MARK.sub(r" \1", text)
            return WORDS.findall(text) if NOT_WHITE.search(text) else text.split()
        if uneven(text):
            return ["\0" + p for p in SPACED.findall(text)]
        found = TAIL.sub(" \\0\\1", text.replace("\n", " \n \0")).split(" ")
        found[0] = "\0" + found[0]
        return found

    def plain(self, key: str) -> str:
        if self.kind == "words" or key[0] == "\n":
            return key
        return key[1:] if key[0] == "\0" else " " + key

    def learn(self):
        keys = list(self.known)[self.done :] if self.done < len(self.known) else []
        for at in range(0, len(keys), 10_000):
            batch = keys[at : at + 10_000]
            found = self.ids_of([self.plain(k) for k in batch])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum()))
            while self.filled + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, np.empty_like(self.flat))
            while self.done + len(batch) > len(self.start):
                self.start, self.length = np.append(self.start, np.empty_like(self.start)), np.append(self.length, np.empty_like(self.length))
            self.flat[self.filled : self.filled + len(ids)] = ids
            self.start[self.done : self.done + len(batch)] = self.filled + np.append(0, lengths[:-1].cumsum())
            self.length[self.done : self.done + len(batch)] = lengths
            self.filled, self.done = self.filled + len(ids), self.done + len(batch)

    def ids_of(self, keys: list[str]) -> list[list[int]]:
        """The ids of each key by itself."""
        match, tokenize = self.simple.fullmatch, self.model.tokenize
        found = [[t.id for t in tokenize(k.translate(SIGNS))] if match(k) else None for k in keys]
        rest = [i for i, f in enumerate(found) if f is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([keys[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as ``tokenizer.encode(text, add_special_tokens=False)`` gives them."""
        if len(self.known) > MOST_KEPT:
            self.clear()
        numbers, counts = [], []
        for text in texts:
            if not text or any(s in text for s in self.special):
                counts.append(0)
                continue
            keys = self.pieces(text)
            numbers.append(np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys)))
            counts.append(len(keys))
        self.learn()
        index = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        length = self.length[index]
        ends = length.cumsum()
        ids = self.flat[np.repeat(self.start[index] - (ends - length), length) + np.arange(int(length.sum()))]
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i, text in enumerate(texts):
            if text and not counts[i]:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


def encoder(path: str, kind: str) -> Encoder:
    """The worker's own encoder for a vocabulary file; made once and kept from task to task."""
    return worker_store(f"{path}:{kind}", lambda: Encoder(path, kind))
