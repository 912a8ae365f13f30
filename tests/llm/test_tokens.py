"""Token ids by distinct words against the tokenizer on whole texts."""

import random

import numpy as np
import pyarrow as pa

from kpivane.llm import queries
from kpivane.llm.tokens import CALLS_AT_ONCE, WORDS_A_CALL, WordEncoder, gathered

FILE = queries.tokenizer_file()


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.calls += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def whole(words: WordEncoder, texts: list) -> list[list[int]]:
    return [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def by_words(words: WordEncoder, texts: list) -> list[list[int]]:
    ids, bounds = words.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_ids_are_those_of_the_whole_text():
    rng = random.Random(7)
    # Signs between words, special tokens, marks that combine, letters whose lower case is longer or depends on the place,
    # white space beyond ASCII.
    signs = [*map(chr, range(32, 0x180)), *"İſẞΣςσ中한😀’`^~|<>\n\t\x1c\x85 ̱́̇ͅ", "K", ";"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4_000)]
    texts += [c + d for c in signs for d in "hE.^'̱ "] + ["h." + c for c in signs]
    texts += [None, "", "  ", "^", "^^ ^ a^b", "<|endoftext|>", "a<|endoftext|>^b. c", "x. <|startoftext|>!", "Don't... CAN'T!", "ÄÖÜ!! äöü,"]
    words = WordEncoder(FILE)
    assert by_words(words, texts) == whole(words, texts)
    assert by_words(words, texts[::-1]) == whole(words, texts)[::-1]


def test_unknown_words_go_to_the_tokenizer_many_to_a_call():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäé"
    new = sorted({"".join(rng.choices(letters, k=9)) for _ in range(6_400)})
    for texts in (new, [f"{w}7x" for w in new]):
        words = WordEncoder(FILE)
        wanted = whole(words, texts)
        counting = words.tokenizer, words.quick = Counting(words.tokenizer), Counting(words.quick)
        assert by_words(words, texts) == wanted
        assert sum(c.calls for c in counting) <= len(texts) // WORDS_A_CALL + 2


def test_results_of_few_calls_are_held_at_once():
    class Largest(Counting):
        def encode_batch_fast(self, texts, **options):
            self.calls = max(self.calls, len(texts))
            return self.inner.encode_batch_fast(texts, **options)

    new = [f"{n:x}" for n in range(1 << 20, (1 << 20) + 40 * CALLS_AT_ONCE * WORDS_A_CALL // 16)]
    for texts in (new, [f"<|{w}" for w in new[: 3 * CALLS_AT_ONCE]]):
        words = WordEncoder(FILE)
        wanted = whole(words, texts)
        largest = words.tokenizer, words.quick = Largest(words.tokenizer), Largest(words.quick)
        assert by_words(words, texts) == wanted
        assert 0 < max(c.calls for c in largest) <= CALLS_AT_ONCE


def test_held_and_new_words_together():
    rng = random.Random(9)
    known = ["".join(rng.choices("abcdef", k=rng.randint(1, 3))) for _ in range(3_000)]
    words = WordEncoder(FILE)
    for i in range(0, len(known), 250):
        texts = [" ".join(known[i : i + 250]), " ".join(known[: i : 7]), ""]
        assert by_words(words, texts) == whole(words, texts)
    held = words.words.to_pylist()
    assert len(held) == len(set(held)) == len(set(known))


def test_case_and_what_follows_the_last_letter_make_no_new_words():
    words = WordEncoder(FILE)
    texts = ["wort Wort WORT. wort!!! wort$$$ wort-*", "été ÉTÉ Été, été###"]
    assert by_words(words, texts) == whole(words, texts)
    assert sorted(words.words.to_pylist()) == ["wort", "été"]


def test_the_file_without_a_sign_or_quick_path_gives_the_same():
    texts = ["Some words, 12 of them ^ and more", "some others"]
    words = WordEncoder(FILE)
    wanted = by_words(words, texts)
    plain, wrong = WordEncoder(FILE), WordEncoder(FILE)
    plain.sign, plain.quick, wrong.sign_id = None, plain.tokenizer, 0
    assert by_words(plain, texts) == wanted and by_words(wrong, texts) == wanted


def test_gathered():
    ids, ends = gathered(np.arange(10, dtype=np.uint32), np.array([7, 0, 3]), np.array([2, 0, 3]))
    assert ids.tolist() == [7, 8, 3, 4, 5] and ends.tolist() == [2, 2, 5]
    assert gathered(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))[0].tolist() == []
