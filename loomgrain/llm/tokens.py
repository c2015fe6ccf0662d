"""Encoding of whole texts by files of public tokenizers, each distinct piece once."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that an encoder remembers, at most.
MOST_PIECES = 500_000
#: Pieces that go to the library as one text.
JOINED = 1000
#: Letters of ASCII and Latin-1 between other ASCII marks. An apostrophe before letters may belong to them, and "<" to the string of a special token.
_LETTERS = r"^(?P<before>[^A-Za-z0-9'<\x80-\x{10ffff}]*)(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>[^A-Za-z0-9<\x80-\x{10ffff}]*)$"
#: Words of such letters in lower case, which no normalisation changes.
_FOLDED = "^[a-zß-öø-ÿ]+$"

#: A space before a character that is no white space, and not after a space: there a byte-level pre-tokenizer always starts anew.
_BEFORE_WORD = re.compile(rb"(?<! )(?= [!-~\xc3-\xdf\xe4-\xf4])")


def at_white_space(texts: pa.Array) -> pa.ListArray:
    """Pieces for a tokenizer that drops white space: none of its tokens reaches over any."""
    return pc.ascii_split_whitespace(texts)


def before_words(texts: pa.Array) -> pa.ListArray:
    """Pieces for a byte-level tokenizer whose tokens take one space before a word: cut before such spaces.

    Texts must start with a space and another character than white space for all pieces to start so; others are one piece in front.
    """
    cut = [_BEFORE_WORD.split(x.as_buffer().to_pybytes()) for x in texts]
    offsets = np.cumsum([0, *map(len, cut)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(chain.from_iterable(cut), pa.binary()).cast(pa.string()))


class PieceEncoder:
    """Token ids of texts by a file of the tokenizers library.

    ``cut`` cuts texts where no token and no rule of the tokenizer reaches across,
    so the ids of the pieces, one after the other, are those of the text. Each
    distinct piece goes to the library once: many are joined by ``mark``, a text
    whose ids tell where a piece ends; pieces that hold its NUL or don't start as
    ``fits`` says go alone. With ``word_end``, the end of a word's last token, words of ASCII and Latin-1 letters are
    folded to lower case, apart from other marks around them, joined by a space, and not normalised again. What is
    remembered is bounded. ``plain`` takes the strings of special tokens inside texts as text.
    """

    def __init__(self, path: str, cut: Callable[[pa.Array], pa.ListArray], mark: str = " \0 ", fits: str = "", plain: bool = False, word_end: str = "") -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.mark, self.fits = Tokenizer.from_file(path), cut, mark, fits
        self.tokenizer.encode_special_tokens = plain
        self.marked = self.tokenizer.encode(mark, add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        if word_end:
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(word_end)]] = True
        self.folds = bool(word_end)
        self.folded = Tokenizer(self.tokenizer.model)  # without the normaliser
        if self.tokenizer.pre_tokenizer:
            self.folded.pre_tokenizer = self.tokenizer.pre_tokenizer
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.empty(0, self.dtype), np.zeros(1, np.int64)

    def _encode(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.Array, mark: str, tokenizer=None):
        """Ids of ``JOINED`` pieces at a time, joined by ``mark``."""
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), JOINED), len(pieces)], pa.int32()), pieces)
        texts = pc.binary_join(lists, mark).to_pylist() if len(pieces) else []
        return chain.from_iterable(self._encode(texts[i : i + 16], tokenizer) for i in range(0, len(texts), 16))

    def made(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and how many each has."""
        true = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
        word = true(pc.match_substring_regex(pieces, _FOLDED)) if self.folds else np.zeros(len(pieces), bool)
        alone = true(pc.match_substring(pieces, "\0")) | ~true(pc.starts_with(pieces, self.fits))
        words, many, few = np.flatnonzero(word), np.flatnonzero(~word & ~alone), np.flatnonzero(alone)
        counts, parts = np.zeros(len(pieces), np.int64), []
        for k, own in enumerate(self._joined(pieces.take(pa.array(words)), " ", self.folded)):
            counts[words[k * JOINED : (k + 1) * JOINED]] = np.diff(np.flatnonzero(self.ends_word[own]), prepend=-1)
            parts.append(own)
        for k, own in enumerate(self._joined(pieces.take(pa.array(many)), self.mark)):
            at = np.flatnonzero(own == self.marked[-1])
            inside = np.ones(len(own), bool)
            for j in range(len(self.marked)):
                inside[at - j] = False
            counts[many[k * JOINED : (k + 1) * JOINED]] = np.diff(np.concatenate([[-1], at, [len(own) - 1 + len(self.marked)]])) - len(self.marked)
            parts.append(own[inside])
        singles = self._encode(pieces.take(pa.array(few)).to_pylist())
        counts[few] = [len(x) for x in singles]
        order = np.concatenate([words, many, few])
        flat = np.concatenate([np.empty(0, self.dtype), *parts, *singles])
        ends = np.cumsum(counts[order])
        starts = np.empty(len(pieces), np.int64)
        starts[order] = ends - counts[order]
        return gathered(flat, starts, counts), counts

    def _of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the pieces begin in what is known, and how many each has; new ones are learnt."""
        if len(self.known) > MOST_PIECES:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        ids, counts = self.made(new)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return self.ends[place], self.ends[place + 1] - self.ends[place]

    def _folded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces by their parts: all ids, where each piece's begin, and how many it has."""
        found = pc.extract_regex(pieces, _LETTERS)
        whole = pc.is_null(found)
        parts = [found.field("before"), pc.if_else(whole, pieces, pc.utf8_lower(found.field("letters"))), found.field("after")]
        parts = pa.concat_arrays([p.fill_null("") for p in parts]).dictionary_encode()
        starts, sizes = self._of(parts.dictionary)
        which = parts.indices.to_numpy().reshape(3, len(pieces)).T.ravel()
        flat = gathered(self.ids, starts[which], sizes[which])
        counts = sizes[which].reshape(-1, 3).sum(axis=1)
        return flat, np.cumsum(counts) - counts, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), one after the other, and where each text's ids begin and the last end."""
        lists = self.cut(texts)
        words = lists.flatten().dictionary_encode()
        if self.folds:
            flat, starts, sizes = self._folded(words.dictionary)
        else:
            starts, sizes = self._of(words.dictionary)
            flat = self.ids
        which = words.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(sizes[which])])
        return gathered(flat, starts[which], sizes[which]), before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(counts)
    shift = (starts - ends + counts).astype(np.int32 if len(flat) < 1 << 30 and (not len(ends) or ends[-1] < 1 << 30) else np.int64)
    return flat[np.repeat(shift, counts) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=shift.dtype)]


def word_bpe(path: str) -> PieceEncoder:
    """Encoder for a tokenizer that drops white space, folds case, splits letters from other marks and marks ends of words."""
    return PieceEncoder(path, at_white_space, word_end="</w>")


def byte_bpe(path: str) -> PieceEncoder:
    """Encoder for a byte-level tokenizer; special tokens inside texts are text."""
    return PieceEncoder(path, before_words, " \0", " ", plain=True)
