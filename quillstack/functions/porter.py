"""The stemmer of Porter's paper of 1980, on words in lower case."""

VOWELS = "aeiou"
# Fixed values of the paper: suffixes and what they become, by step.
STEP_2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in VOWELS and not (c == "y" and i > 0 and out[-1]))
    return out


def _measure(stem: str) -> int:
    kinds = _consonants(stem)
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


def _replace(word: str, pairs: list[tuple[str, str]], least: int) -> str:
    for suffix, other in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + other if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    for suffix, other in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + other
            break
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, list(zip(STEP_2[::2], STEP_2[1::2])), 0)
    word = _replace(word, STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
