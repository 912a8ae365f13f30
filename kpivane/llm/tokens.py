"""Token ids of whole texts by a public tokenizer file, encoded once per distinct word.

The tokenizer splits at white space and encodes each word on its own, so a text's ids are the ids of
its words one after the other. Words repeat, so each task keeps a bounded table of words already
encoded; what it holds changes only the speed. Unknown words are encoded many to a call, with a sign
between them whose id shows where each ends.
"""

from __future__ import annotations

import itertools
import os
import re
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import split_words

if TYPE_CHECKING:
    from tokenizers import Tokenizer

REMEMBERED = 1_000_000
WORDS_A_CALL = 32
CALLS_AT_ONCE = 256
SIGNS = "^~|"
#: Words in which lower case is one character for one and nothing combines.
LATIN = "^[!-~À-ÿ]+$"
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "^[a-zß-öø-ÿ]+$"
ENDED = "[a-zß-öø-ÿ][!-&(-/:-@\\[-`{-~]+$"
TAIL = "(?P<tail>[!-&(-/:-@\\[-`{-~]+)$"


def gathered(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[first[i] : first[i] + count[i]] one after the other, and where each ends."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    take = np.arange(total, dtype=kind)
    take += np.repeat((first - (ends - count)).astype(kind), count)
    return ids[take], ends


class WordEncoder:
    """Encodes texts with the tokenizer in `path`; for tokenizers that treat words between white space apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)
        single = [(s, i[0]) for s in SIGNS if len(i := self.tokenizer.encode(s, add_special_tokens=False).ids) == 1]
        self.sign, self.sign_id = single[0] if single else (None, None)
        # Words of lower-case letters alone need no rules, only their bytes and the model; kept to if the letters show so.
        self.quick = Tokenizer(self.tokenizer.model)
        self.quick.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = "".join(c for c in map(chr, range(256)) if re.match(LETTERS, c))
        shown = " ".join([letters, letters[::-1], *letters, *SIGNS])
        same = self.quick.encode(shown, add_special_tokens=False).ids == self.tokenizer.encode(shown, add_special_tokens=False).ids
        if not same or any("<|" not in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            self.quick = self.tokenizer

    def _encoded(self, words: pa.Array, tokenizer: Tokenizer | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        batch = (tokenizer or self.tokenizer).encode_batch_fast
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        # The tokenizer's results are many times larger than the ids, so only those of some calls are held.
        for i in range(0, len(words), CALLS_AT_ONCE):
            found = [e.ids for e in batch(words.slice(i, CALLS_AT_ONCE).to_pylist(), add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def _joined(self, words: pa.Array, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without the sign and without special tokens, many to a call."""
        bounds = np.append(np.arange(0, len(words), WORDS_A_CALL), len(words))
        calls = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), f" {self.sign} ")
        ids, _ = self._encoded(pc.binary_join_element_wise(calls, self.sign, " "), tokenizer)
        signs = np.flatnonzero(ids == self.sign_id)
        if len(signs) != len(words):
            return self._encoded(words)
        return np.delete(ids, signs), np.diff(signs, prepend=-1) - 1

    def _learn(self, words: pa.Array) -> None:
        """Hold the ids of new words, in their order."""
        kinds = {"apart": np.ones(len(words), bool)}
        if self.sign:
            letters = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
            apart = pc.or_(pc.match_substring(words, "<|"), pc.match_substring(words, self.sign)).to_numpy(zero_copy_only=False)
            kinds = {"letters": letters, "other": ~(letters | apart), "apart": apart}
        parts = []
        for kind, chosen in kinds.items():
            if chosen.any():
                some = words.filter(pa.array(chosen))
                found = self._encoded(some) if kind == "apart" else self._joined(some, self.quick if kind == "letters" else self.tokenizer)
                parts.append((np.flatnonzero(chosen), *found))
        places, ids, lengths = (np.concatenate(p) for p in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.argsort(places)
            first, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
            ids, _ = gathered(ids, first, lengths)
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word's ids are held, encoding the unknown ones."""
        if len(self.words) > REMEMBERED:
            self.words, self.ids, self.bounds = self.words.slice(0, 0), self.ids[:0], self.bounds[:1]
        # Looked up from the side of the held words: the lookup table then holds the words of these texts alone.
        met = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(met >= 0)
        places = np.full(len(words), -1)
        places[met[held]] = held
        fresh = places < 0
        if fresh.any():
            places[fresh] = len(self.words) + np.arange(fresh.sum())
            self._learn(words.filter(pa.array(fresh)))
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the bounds of each text in it. A null text has no ids."""
        words = split_words(texts)
        if not len(words.codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        known = words.vocabulary
        # Lower case and splitting off what follows the last letter are the tokenizer's own rules; applied
        # beforehand where they cannot touch anything else, they leave fewer distinct words.
        plain = pc.and_(pc.match_substring_regex(known, LATIN), pc.invert(pc.match_substring(known, "<|")))
        known = pc.if_else(plain, pc.utf8_lower(known), known)
        ended = pc.and_(plain, pc.match_substring_regex(known, ENDED))
        stems = pc.if_else(ended, pc.utf8_rtrim(known, characters=PUNCTUATION), known)
        tails = pc.struct_field(pc.extract_regex(known.filter(ended), TAIL), "tail").dictionary_encode()
        stems = stems.dictionary_encode()
        held = self._places(stems.dictionary)[stems.indices.to_numpy(zero_copy_only=False)]
        first, count = self.bounds[held], self.bounds[held + 1] - self.bounds[held]
        if len(tails):
            tail = np.full(len(known), -1)
            tail[ended.to_numpy(zero_copy_only=False)] = tails.indices.to_numpy(zero_copy_only=False)
            more, lengths = self._encoded(tails.dictionary)
            lengths = np.append(lengths, 0)
            begins = len(self.ids) + np.cumsum(lengths) - lengths
            pieces = np.stack([count, lengths[tail]], axis=1)
            ids, ends = gathered(np.concatenate([self.ids, more]), np.stack([first, begins[tail]], axis=1).ravel(), pieces.ravel())
            count = pieces.sum(axis=1)
            first = ends[1::2] - count
        else:
            ids = self.ids
        ids, ends = gathered(ids, first[words.codes], count[words.codes])
        return ids, np.concatenate([[0], ends])[words.bounds]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    return WordEncoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end_id` after each text."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
