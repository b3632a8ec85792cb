"""Token ids of whole texts from the tokenizers library, with each distinct piece of a batch encoded once.

A byte-level tokenizer never joins a space with the letter before it, so a text may be cut before every space that
follows something other than white space, and the pieces' ids put one after the other.  Pieces are counted off per
batch in Arrow, looked up in a bounded per-worker cache, and only new ones go to the library: plain words, which its
pre-tokenizer leaves whole, straight to the library's model, all others through its whole chain.  Texts in which white
space stands before a space, or with a NUL, are cut by a regular expression instead.  A text that holds an added token (such
as ``<|endoftext|>``) is encoded whole by the library, which gives it the token's id.

Memory: the cache is bounded by its pieces' number and bytes, pieces over ``LONG_PIECE`` characters leave it with
their batch, and all of it goes when the worker's next task does not encode.  A text over ``LONG_TEXT`` bytes is handled in parts of about that size, cut where pieces are cut; one
without any space is one piece, which the library has to take whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.arrow import parts_of, worker_cache

#: Pieces kept, and their characters; when they are more, those of the batch at hand stay.
CACHE, CACHE_CHARS = 1_000_000, 16 << 20
LONG_PIECE = 256
#: Text bytes handled at once, and those from which one text is cut.
SLICE, LONG_TEXT = 4 << 20, 16 << 20
#: Pieces learned at once: their ids are lists until they are kept.
LEARN = 20_000
_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters that every version of Unicode knows as such, and marks that the pre-tokenizer parts from them; a line may end between two words.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)(?:(\n)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?))?")


def pieces(texts: pa.Array, mark: str, odd: str, cut: re.Pattern) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(offsets per text, distinct pieces, piece numbers): texts cut before ``mark``; those that match ``odd`` by ``cut``."""
    parts = pc.split_pattern(pc.replace_substring(texts, mark, "\0" + mark), "\0")
    strange = pc.match_substring_regex(texts, odd)
    if pc.any(strange).as_py():
        whole = [[x for x in cut.split(t) if x] if s else None for t, s in zip(texts.to_pylist(), strange.to_pylist(), strict=True)]
        parts = pc.if_else(strange, pa.array(whole, parts.type), parts)
    flat = parts.flatten().dictionary_encode()
    return np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64), flat.dictionary, flat.indices.to_numpy()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Encodes batches with one tokenizer file; ids are 16 or 32 bits wide by the vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added)) or None
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        plain = repr(self.model.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" and self.model.normalizer is None
        self.words = _WORD.fullmatch if plain and type(self.model.model).__name__ == "BPE" else None
        self.letters = dict(enumerate(_byte_letters()))
        self.chars = 0
        self.slot: dict[str, int] = {}
        self.flat, self.at, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, wanted: list[str]) -> None:
        wanted = [x for x in wanted if x in self.slot]
        slot = np.array([self.slot[x] for x in wanted], np.int64)
        size = self.size[slot]
        end = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.at[slot] - (end - size), size) + np.arange(int(size.sum()))]
        self.slot, self.at, self.size = dict(zip(wanted, range(len(wanted)), strict=True)), end - size, size
        self.chars = sum(map(len, wanted))

    def _append(self, new: list[str], ids: list[int], sizes: np.ndarray) -> None:
        self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, np.array(ids, self.kind)])

    def _learn_words(self, new: list[str]) -> list[str]:
        """Learns the plain words among ``new``; the others are returned."""
        whole, letters = self.model.model.tokenize, self.letters
        mark = {None: [], "": [], **{m: [t.id for t in whole(letters[ord(m)])] for m in ".,\n"}}
        got, ids, sizes, others = [], [], [], []
        for x in new:
            if (found := self.words(x)) is None:
                others.append(x)
                continue
            word, after, line, second, end = found.groups()
            word = word.replace(" ", letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(letters)
            one = [t.id for t in whole(word)] + mark[after]
            if line:
                second = second if second.isascii() else second.encode().decode("latin-1").translate(letters)
                one += mark[line] + [t.id for t in whole(second)] + mark[end]
            got.append(x)
            ids += one
            sizes.append(len(one))
        self._append(got, ids, np.array(sizes, np.int64))
        return others

    def _learn(self, new: list[str]) -> None:
        for lo in range(0, len(new), LEARN):
            part = new[lo : lo + LEARN]
            if self.words and not (part := self._learn_words(part)):
                continue
            got = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            self._append(part, got.ids, np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)) if got.ids else np.zeros(len(part), np.int64))

    def _forget(self, long: list[str], before: tuple[int, int, int]) -> None:
        """Takes the pieces that were learned last out again."""
        for x in long:
            del self.slot[x]
        n, ids, self.chars = before
        self.at, self.size, self.flat = self.at[:n], self.size[:n], self.flat[:ids]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, len(texts) + 1 offsets)."""
        marked = pc.match_substring_regex(texts, self.added) if self.added else pa.array(np.zeros(len(texts), bool))
        apart = pc.or_(marked, pc.greater(pc.binary_length(texts), LONG_TEXT))
        if not pc.any(apart).as_py():
            return self._by_pieces(texts)
        ids, at = self._by_pieces(pc.if_else(apart, "", texts))
        parts = [self._alone(texts[i].as_py(), m) if a else ids[at[i] : at[i + 1]] for i, (a, m) in enumerate(zip(apart.to_pylist(), marked.to_pylist(), strict=True))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _alone(self, text: str, marked: bool) -> np.ndarray:
        """The ids of a text with an added token, or of a very long one."""
        if marked:
            return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind)
        return np.concatenate([self._by_pieces(pa.array([x]))[0] for x in parts_of(text, LONG_TEXT // 2, _CUT)])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds, distinct, number = pieces(texts, " ", r"[\s\x{1c}-\x{1f}\x{85}\p{Z}] |\x{0}", _CUT)
        distinct = distinct.to_pylist()
        if self.slot and (len(self.slot) + len(distinct) > CACHE or self.chars > CACHE_CHARS):
            self._keep(distinct)
        slots = list(map(self.slot.get, distinct))
        before, long = None, []
        if new := [x for x, s in zip(distinct, slots, strict=True) if s is None]:
            if long := [x for x in new if len(x) > LONG_PIECE]:
                new = [x for x in new if len(x) <= LONG_PIECE]
            self._learn(new)
            before = len(self.slot), len(self.flat), self.chars
            self._learn(long)
            slots = list(map(self.slot.get, distinct))
        slot = np.array(slots, np.int64)[number] if len(number) else np.zeros(0, np.int64)
        size = self.size[slot]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.repeat(self.at[slot] - (end - size), size) + np.arange(total)]
        if long:
            self._forget(long, before)
        return ids, np.concatenate([[0], end])[bounds]


_encoders: dict[str, Encoder] = worker_cache()


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
